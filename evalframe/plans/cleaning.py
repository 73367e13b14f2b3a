"""Registered queries: cleaning, eligibility, split, sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalframe.functions.text import EMOJI_CLASS, URL_PATTERN
from evalframe.operators import clean as C
from evalframe.plans.common import Registry, rounded
from evalframe.session import ensure_checkpoint_dir
from evalframe.sources import adapters as A
from evalframe.sources import files

reg = Registry()

# Split sizes used with the conversation adapter (posts P, replies R, originals P - R).
POSTS_PER_SET = 13
REPLIES_PER_SET = 10
STIMULI_K = 5
DATE_FROM, DATE_TO = "2023-08-05", "2023-08-20"


def _blank(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '^\\s*$'), true)"


def _nullify(x: str) -> str:
    return f"CASE WHEN trim({x}) IN ('', 'nan', 'None', 'NaN', '\"NaN\"', 'null') THEN NULL ELSE {x} END"


def flags_sql(src: str) -> str:
    """CTE body: normalised, de-duplicated rows of ``src`` with cleaning flags."""
    words = "coalesce(len(list_filter(string_split_regex(full_text, '\\s+'), lambda w: w <> '')), 0)"
    rest = f"string_split_regex(regexp_replace(full_text, '{URL_PATTERN}', '', 'g'), '\\s+')"
    link = f"coalesce(regexp_matches(full_text, '{URL_PATTERN}'), false)"
    return f"""SELECT *, retweeted_user_id IS NOT NULL AS is_retweet,
    (NOT {_blank('full_text')}) AND {_blank(f"regexp_replace(full_text, '{EMOJI_CLASS}', '', 'g')")} AS is_emoji_only,
    {link} AS has_url,
    coalesce({link} AND len(list_filter({rest}, lambda w: length(w) > 2)) < 5, false) AS url_without_context,
    {words} >= 3 AS has_min_words
  FROM (SELECT * REPLACE ({_nullify('reply_to_id')} AS reply_to_id,
                          {_nullify('retweeted_user_id')} AS retweeted_user_id),
               count(*) OVER (PARTITION BY tweet_id) AS copies,
               row_number() OVER (PARTITION BY tweet_id ORDER BY ingest_pos) AS dup_rn
        FROM {src}) n
  WHERE dup_rn = 1"""


def cleaned_sql(src: str) -> str:
    return (f"cleaned AS (SELECT * FROM ({flags_sql(src)}) f WHERE NOT is_retweet AND NOT is_emoji_only "
            f"AND NOT has_url AND has_min_words)")


def conv_cleaned(spark, sf_dir):
    return C.clean_posts(A.posts_from_conversations(spark, sf_dir))


_CONV_CLEAN = A.with_sql(A.POSTS_SQL, cleaned_sql("posts"))


@reg.add("clean_attrition", A.with_sql(A.DOC_POSTS_SQL, A.PAGE_POSTS_SQL,
                                       "raw AS (SELECT * FROM doc_posts UNION ALL SELECT * FROM page_posts)",
                                       f"f AS ({flags_sql('raw')})") + """
SELECT CAST(sum(copies) AS BIGINT) AS n_input, count(*) AS n_after_dedupe,
  count_if(NOT is_retweet) AS n_after_retweets,
  count_if(NOT is_retweet AND NOT is_emoji_only) AS n_after_emoji,
  count_if(NOT is_retweet AND NOT is_emoji_only AND NOT has_url) AS n_after_links,
  count_if(NOT is_retweet AND NOT is_emoji_only AND NOT has_url AND has_min_words) AS n_after_min_words,
  count_if(url_without_context) AS n_url_without_context
FROM f""")
def clean_attrition(spark, sf_dir):
    raw = A.posts_from_documents(spark, sf_dir).unionByName(A.posts_from_pages(spark, sf_dir))
    return C.attrition(raw)


@reg.add("dedupe_keep_first", """
SELECT doc_id, source, text_md5, copies FROM (
  SELECT doc_id, source, md5(text) AS text_md5,
         row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn,
         count(*) OVER (PARTITION BY md5(text)) AS copies
  FROM documents) t WHERE rn = 1""")
def dedupe_keep_first(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text_md5"))
    return C.dedupe_keep_first(d, "text_md5", order_col="doc_id", count_col="copies") \
        .select("doc_id", "source", "text_md5", "copies")


_USER_FILE_SQL = A.with_sql(A.POSTS_SQL) + """, uf AS (SELECT regexp_extract(tweet_id, '^[^_]*') AS user_id,
    CASE WHEN ingest_pos % 2 = 0 THEN 'history' ELSE 'holdout' END AS set, * EXCLUDE (user_id) FROM posts)
SELECT user_id, set, row_number() OVER (PARTITION BY user_id, set ORDER BY ingest_pos) - 1 AS pos, tweet_id, screen_name, created_at, full_text,
  reply_to_id, retweeted_user_id FROM uf"""


@reg.add("user_files", _USER_FILE_SQL)
def user_files(spark, sf_dir):
    """Each conversation as a user's file lines, written as text, read back by splits, normalised."""
    p = A.posts_from_conversations(spark, sf_dir)
    sets = F.when(F.col("ingest_pos") % 2 == 0, F.lit("history")).otherwise(F.lit("holdout"))
    p = p.withColumns({"user_id": F.substring_index("tweet_id", "_", 1), "set": sets, "pos": F.col("ingest_pos")})
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/user-files-{uuid.uuid4().hex}"
    files.user_file_lines(p).write.text(path)
    back = files.read_user_files(spark, path)["posts"]
    # the lines of all users lie in common files here, so each line's own user counts
    both = files.history(back).unionByName(files.holdout(back))
    return both.select("user_id", "set", F.col("pos").cast("bigint").alias("pos"), "tweet_id", "screen_name", "created_at", "full_text",
                       "reply_to_id", "retweeted_user_id")


@reg.add("parent_join", _CONV_CLEAN + """
SELECT c.tweet_id, c.reply_to_id,
       CASE WHEN p.tweet_id IS NOT NULL THEN coalesce(p.created_at, '') || ', ' || coalesce(p.screen_name, '')
            || ': ' || coalesce(p.full_text, '') END AS previous_message
FROM cleaned c LEFT JOIN cleaned p ON c.reply_to_id = p.tweet_id
WHERE c.reply_to_id IS NOT NULL""")
def parent_join(spark, sf_dir):
    j = C.parent_messages(conv_cleaned(spark, sf_dir))
    return j.where(F.col("reply_to_id").isNotNull()).select("tweet_id", "reply_to_id", "previous_message")


_UC = f"""uc AS (SELECT user_id, count(*) AS total_posts,
    count_if(reply_to_id IS NOT NULL) AS replies FROM cleaned WHERE user_id IS NOT NULL GROUP BY user_id),
ucf AS (SELECT *, total_posts - replies AS originals,
    replies >= {2 * REPLIES_PER_SET} AND total_posts - replies >= {2 * (POSTS_PER_SET - REPLIES_PER_SET)}
    AND total_posts >= {2 * POSTS_PER_SET} AS eligible FROM uc)"""


@reg.add("eligible_users", _CONV_CLEAN + "," + _UC + """
SELECT user_id, total_posts, replies, originals, eligible FROM ucf""")
def eligible_users(spark, sf_dir):
    return C.user_counts(conv_cleaned(spark, sf_dir), POSTS_PER_SET, REPLIES_PER_SET) \
        .select("user_id", "total_posts", "replies", "originals", "eligible")


_R, _O = REPLIES_PER_SET, POSTS_PER_SET - REPLIES_PER_SET
_SPLIT = _CONV_CLEAN + "," + _UC + f""",
rk AS (SELECT *, reply_to_id IS NOT NULL AS is_reply,
    row_number() OVER (PARTITION BY user_id, reply_to_id IS NOT NULL
                       ORDER BY md5('42|' || tweet_id), tweet_id) AS rn
  FROM cleaned WHERE user_id IN (SELECT user_id FROM ucf WHERE eligible)),
st AS (SELECT *, CASE WHEN rn <= (CASE WHEN is_reply THEN {_R} ELSE {_O} END) THEN 'holdout' ELSE 'history' END AS "set"
  FROM rk WHERE rn <= 2 * (CASE WHEN is_reply THEN {_R} ELSE {_O} END)),
ok AS (SELECT user_id FROM st GROUP BY user_id
  HAVING count_if("set" = 'holdout') = {POSTS_PER_SET} AND count_if("set" = 'holdout' AND is_reply) = {_R}
     AND count_if("set" = 'history') = {POSTS_PER_SET} AND count_if("set" = 'history' AND is_reply) = {_R}),
split AS (SELECT user_id, "set", row_number() OVER (PARTITION BY user_id, "set"
    ORDER BY md5('42|set|' || tweet_id), tweet_id) - 1 AS pos, tweet_id, is_reply
  FROM st WHERE user_id IN (SELECT user_id FROM ok))"""


def conv_split(spark, sf_dir):
    return C.split_history_holdout(conv_cleaned(spark, sf_dir), POSTS_PER_SET, REPLIES_PER_SET)


@reg.add("history_holdout_split", _SPLIT + "\nSELECT * FROM split")
def history_holdout_split(spark, sf_dir):
    return conv_split(spark, sf_dir).select("user_id", "set", F.col("pos").cast("bigint").alias("pos"),
                                            "tweet_id", "is_reply")


_SAMPLE = _SPLIT + f""",
smp AS (SELECT user_id, tweet_id, row_number() OVER (PARTITION BY user_id
    ORDER BY md5('42|stimuli|' || tweet_id), tweet_id) AS stimulus_rank FROM split WHERE "set" = 'holdout'),
smpk AS (SELECT * FROM smp WHERE stimulus_rank <= {STIMULI_K}
    AND user_id IN (SELECT user_id FROM smp GROUP BY user_id HAVING count_if(stimulus_rank <= {STIMULI_K}) = {STIMULI_K}))"""


def conv_sample(spark, sf_dir):
    hold = conv_split(spark, sf_dir).where(F.col("set") == "holdout")
    return C.sample_stimuli(hold, STIMULI_K)


@reg.add("stimulus_sample", _SAMPLE + "\nSELECT user_id, tweet_id, stimulus_rank FROM smpk")
def stimulus_sample(spark, sf_dir):
    return conv_sample(spark, sf_dir).select("user_id", "tweet_id",
                                             F.col("stimulus_rank").cast("bigint").alias("stimulus_rank"))


@reg.add("stimuli_by_condition", _SAMPLE + """
SELECT c.condition, s.user_id, s.tweet_id, s.stimulus_rank
FROM smpk s, (VALUES ('no_persona'), ('generic'), ('history_only'), ('best_persona')) c(condition)""")
def stimuli_by_condition(spark, sf_dir):
    s = C.stimuli_by_condition(conv_sample(spark, sf_dir))
    return s.select("condition", "user_id", "tweet_id",
                    F.col("stimulus_rank").cast("bigint").alias("stimulus_rank"))


@reg.add("filter_by_date", A.with_sql(A.POSTS_SQL) + f"""
SELECT tweet_id, user_id, CAST(TRY_CAST(substr(created_at, 1, 10) AS DATE) AS VARCHAR) AS created_date
FROM posts WHERE TRY_CAST(substr(created_at, 1, 10) AS DATE) BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'""")
def filter_by_date(spark, sf_dir):
    p = C.filter_by_date(A.posts_from_conversations(spark, sf_dir), DATE_FROM, DATE_TO)
    return p.select("tweet_id", "user_id", F.col("created_date").cast("string").alias("created_date"))


@reg.add("filter_by_type", A.with_sql(A.POSTS_SQL) + """
SELECT tweet_id, user_id FROM posts
WHERE coalesce(regexp_matches(retweeted_user_id, '^\\s*$'), true)
  AND NOT coalesce(regexp_matches(reply_to_id, '^\\s*$'), true)""")
def filter_by_type(spark, sf_dir):
    return C.filter_by_type(A.posts_from_conversations(spark, sf_dir), "replies").select("tweet_id", "user_id")


@reg.add("posts_by_type", A.with_sql(A.POSTS_SQL) + """
SELECT tweet_id, user_id, CASE WHEN NOT coalesce(regexp_matches(retweeted_user_id, '^\\s*$'), true) THEN 'retweets'
  WHEN NOT coalesce(regexp_matches(reply_to_id, '^\\s*$'), true) THEN 'replies' ELSE 'posts' END AS kind FROM posts""")
def posts_by_type(spark, sf_dir):
    """P10: the three filters side by side; together they hold every post once."""
    p = A.posts_from_conversations(spark, sf_dir)
    kinds = [C.filter_by_type(p, k).select("tweet_id", "user_id", F.lit(k).alias("kind")) for k in ("posts", "replies", "retweets")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@reg.add("task_type", A.with_sql(A.POSTS_SQL, cleaned_sql("posts"), A.PAIRS_SQL) + """,
pm AS (SELECT c.user_id, c.tweet_id, c.reply_to_id,
          CASE WHEN p.tweet_id IS NOT NULL THEN coalesce(p.created_at, '') || ', ' || coalesce(p.screen_name, '')
               || ': ' || coalesce(p.full_text, '') END AS previous_message
       FROM cleaned c LEFT JOIN cleaned p ON c.reply_to_id = p.tweet_id)
SELECT pr."index", pr.tweet_id,
       CASE WHEN pm.tweet_id IS NULL THEN NULL WHEN pm.reply_to_id IS NULL THEN 'post' ELSE 'reply' END AS task_lookup,
       CASE WHEN pm.tweet_id IS NULL THEN NULL
            WHEN pm.reply_to_id IS NULL AND pm.previous_message IS NULL THEN 'post' ELSE 'reply' END AS task_strict
FROM pairs pr LEFT JOIN pm ON pr.tweet_id = pm.tweet_id AND pr.user_id = pm.user_id""")
def task_type(spark, sf_dir):
    posts = C.parent_messages(conv_cleaned(spark, sf_dir))
    pairs = A.pairs_from_conversations(spark, sf_dir).select("user_id", "index", "tweet_id")
    look = posts.select(F.col("tweet_id").alias("_tid"), F.col("user_id").alias("_uid"),
                        F.when(F.col("reply_to_id").isNull(), F.lit("post")).otherwise(F.lit("reply"))
                        .alias("task_lookup"),
                        C.task_type_strict(F.col("reply_to_id"), F.col("previous_message")).alias("task_strict"))
    j = pairs.join(look, (pairs["tweet_id"] == look["_tid"]) & (pairs["user_id"] == look["_uid"]), "left")
    return rounded(j.select("index", "tweet_id", "task_lookup", "task_strict"))


@reg.add("holdout_counts", _SPLIT + """
SELECT user_id, count(*) AS holdout_size, count_if(is_reply) AS holdout_replies FROM split
WHERE "set" = 'holdout' GROUP BY user_id""")
def holdout_counts(spark, sf_dir):
    """Holdout size per user."""
    h = conv_split(spark, sf_dir).where(F.col("set") == "holdout")
    return h.groupBy("user_id").agg(F.count(F.lit(1)).alias("holdout_size"),
                                    F.count_if("is_reply").alias("holdout_replies"))
