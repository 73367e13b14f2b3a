"""Registered queries: text patterns, top words, posting hours, JSON profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import patterns as T
from evalframe.plans.common import Registry, rounded
from evalframe.sources import adapters as A

reg = Registry()

TOP_K = 20
KEY_NEEDLE = "lang"


@reg.add("text_patterns", A.with_sql(A.DOC_POSTS_SQL) + """, b AS (SELECT user_id,
    CASE WHEN NOT coalesce(regexp_matches(retweeted_user_id, '^\\s*$'), true) THEN 'retweet'
         WHEN NOT coalesce(regexp_matches(reply_to_id, '^\\s*$'), true) THEN 'reply' ELSE 'post' END AS kind,
    length(coalesce(full_text, '')) AS len,
    regexp_extract_all(coalesce(full_text, ''), '#[\\p{L}\\p{N}_]+') AS tags,
    regexp_extract_all(coalesce(full_text, ''), '@[\\p{L}\\p{N}_]+') AS ments FROM doc_posts),
c AS (SELECT user_id, count(*) AS total_tweets, count_if(kind = 'post') AS posts, count_if(kind = 'reply') AS replies,
    count_if(kind = 'retweet') AS retweets, avg(len) AS avg_text_length, median(len) AS median_text_length,
    CAST(sum(len(tags)) AS BIGINT) AS hashtag_count, CAST(sum(len(ments)) AS BIGINT) AS mention_count FROM b GROUP BY user_id),
t AS (SELECT user_id, count(DISTINCT tag) AS unique_hashtags FROM (SELECT user_id, unnest(tags) AS tag FROM b) GROUP BY user_id),
m AS (SELECT user_id, count(DISTINCT mm) AS unique_mentions FROM (SELECT user_id, unnest(ments) AS mm FROM b) GROUP BY user_id)
SELECT c.user_id, total_tweets, posts, replies, retweets, round(avg_text_length, 6) AS avg_text_length,
  round(median_text_length, 6) AS median_text_length, hashtag_count, mention_count,
  coalesce(unique_hashtags, 0) AS unique_hashtags, coalesce(unique_mentions, 0) AS unique_mentions
FROM c LEFT JOIN t ON c.user_id = t.user_id LEFT JOIN m ON c.user_id = m.user_id""")
def text_patterns(spark, sf_dir):
    """Posting-pattern profile per user (documents as posts)."""
    out = T.post_patterns(A.posts_from_documents(spark, sf_dir))
    return rounded(out.withColumn("median_text_length", F.col("median_text_length").cast("double")))


@reg.add("top_words", f"""SELECT word, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents)
GROUP BY word ORDER BY count DESC, word LIMIT {TOP_K}""")
def top_words(spark, sf_dir):
    """The most common words of all documents."""
    return T.top_words(A.table(spark, sf_dir, "documents"), "text", TOP_K)


@reg.add("hour_histogram", A.with_sql(A.POSTS_SQL) + """SELECT CAST(substr(created_at, 12, 2) AS INTEGER) AS hour,
  count(*) AS posts FROM posts
WHERE regexp_matches(created_at, '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}\\+00:00$') GROUP BY ALL""")
def hour_histogram(spark, sf_dir):
    """Posts per hour of the day."""
    return T.hour_histogram(A.posts_from_conversations(spark, sf_dir))


def json_docs(spark, sf_dir):
    """JSON documents to profile: event properties and a nested rendering of documents."""
    ev = A.table(spark, sf_dir, "events").select(F.col("props").alias("doc"))
    d = A.table(spark, sf_dir, "documents")
    nested = F.to_json(F.struct(F.col("doc_id"), F.struct("lang", "source").alias("meta"),
                                F.array(F.col("n_chars"), F.length("text").cast("bigint")).alias("sizes"),
                                F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("lang"))
                                .alias("maybe_lang")), {"ignoreNullFields": "false"})
    return ev.unionByName(d.select(nested.alias("doc")))


_PROFILE_SQL = """WITH docs AS (SELECT props AS doc FROM events UNION ALL
  SELECT to_json({'doc_id': doc_id, 'meta': {'lang': lang, 'source': source}, 'sizes': [n_chars, CAST(length(text) AS BIGINT)],
                  'maybe_lang': CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END}) FROM documents),
t AS (SELECT j.fullkey, j.type FROM docs, json_tree(docs.doc) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')),
p AS (SELECT regexp_replace(regexp_replace(fullkey, '^\\$\\.', ''), '\\[[0-9]+\\]', '.[items]', 'g') AS path,
  CASE type WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str'
    WHEN 'NULL' THEN 'NoneType' WHEN 'BOOLEAN' THEN 'bool' ELSE lower(type) END AS type FROM t),
prof AS (SELECT path, array_to_string(list_sort(list(DISTINCT type)), ', ') AS types, count(*) AS occurrences
  FROM p GROUP BY path)
"""


@reg.add("json_profile", _PROFILE_SQL + "SELECT path, types, occurrences FROM prof")
def json_profile(spark, sf_dir):
    """Key paths and the primitive types found under each."""
    return T.json_profile(json_docs(spark, sf_dir), "doc")


@reg.add("json_key_search", _PROFILE_SQL + f"SELECT path, types, occurrences FROM prof WHERE contains(lower(path), '{KEY_NEEDLE}')")
def json_key_search(spark, sf_dir):
    """Profiled key paths containing a substring (case-insensitive)."""
    p = T.json_profile(json_docs(spark, sf_dir), "doc")
    return p.where(T.key_search(p, KEY_NEEDLE))
