"""Registered queries: masking, work list, batch requests / results."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.text import HIGH_PRIORITY_LEXICON, URL_ONLY_PATTERN
from evalframe.operators import mask as M
from evalframe.operators.skew import null_safe_join
from evalframe.plans.common import Registry, rounded
from evalframe.session import cut_lineage
from evalframe.sources import adapters as A

reg = Registry()

LEXICON_SHARE = 0.1         # a mined word occurs in this share of the toxic-labelled documents
BATCH_SIZE = 50             # requests per batch file in these queries
MODEL_MASK_MIN_LEN = 9      # the stand-in model masks tokens of this length or more


def holdout(spark, sf_dir):
    """Documents as holdout posts, of which every fourth one was already masked: the state that
    the incremental queries (P23: ``mask_deterministic``, ``mask_worklist``) start from."""
    p = A.posts_from_documents(spark, sf_dir)
    return p.withColumn("masked_text", F.when(F.col("ingest_pos") % 4 == 0, F.lit("[MASKED]")))


def posts(spark, sf_dir):
    """All documents as posts, none of them masked yet."""
    return A.posts_from_documents(spark, sf_dir)


def lexicon(spark, sf_dir):
    """Lexicon table: the fixed high-priority words plus every word that occurs in at
    least LEXICON_SHARE of the toxic documents.  A share bounds the table by the words
    of 1 / LEXICON_SHARE documents, whatever the size of the corpus."""
    d = A.table(spark, sf_dir, "documents").join(
        A.table(spark, sf_dir, "labels").where(F.col("toxic") == 1), "doc_id", "left_semi")
    w = d.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.filter(M.tokens(F.col("text")), lambda t: t.rlike(M.WORD_PATTERN)), lambda t: F.lower(t)))).alias("word"))
    n = d.agg((F.count(F.lit(1)) * LEXICON_SHARE).alias("n")).scalar()
    top = w.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= n)
    return top.select("word").unionByName(M.lexicon_table(spark)).distinct()


_TOK = "regexp_extract_all(coalesce({t}, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"
_HP = "[" + ", ".join(f"'{w}'" for w in HIGH_PRIORITY_LEXICON) + "]"
_LEX_SQL = A.with_sql(A.DOC_POSTS_SQL) + f""", hold AS (SELECT *, CASE WHEN ingest_pos % 4 = 0 THEN '[MASKED]' END AS masked_text
  FROM doc_posts),
tw AS (SELECT DISTINCT d.doc_id, lower(w) AS word FROM documents d, LATERAL (SELECT unnest({_TOK.format(t='d.text')}) AS w)
  WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND regexp_matches(w, '^[\\p{{L}}\\p{{N}}_]+$')),
top AS (SELECT word FROM tw GROUP BY word HAVING count(*) >= {LEXICON_SHARE} * (
  SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))),
lex AS (SELECT list(DISTINCT word) AS words FROM (SELECT word FROM top UNION SELECT unnest({_HP}))),
"""


def _mask_sql(text: str) -> str:
    toks = _TOK.format(t=text)
    return (f"CASE WHEN coalesce({text} = '', true) OR coalesce(regexp_matches({text}, '{URL_ONLY_PATTERN}'), false) "
            f"THEN '[MASKED]' ELSE array_to_string(list_transform({toks}, lambda t: CASE WHEN "
            f"list_contains(lex.words, lower(t)) THEN '[MASKED]' ELSE t END), ' ') END")


@reg.add("mask_deterministic", _LEX_SQL.rstrip().rstrip(",") + f"""
SELECT hold.tweet_id, {_mask_sql('hold.full_text')} AS masked_text FROM hold, lex WHERE hold.masked_text IS NULL""")
def mask_deterministic(spark, sf_dir):
    """K1 + P23: rule-based mask for every holdout post not yet masked."""
    todo = holdout(spark, sf_dir).where(F.col("masked_text").isNull())
    t = M.attach_lexicon(todo, lexicon(spark, sf_dir))
    return t.select("tweet_id", M.deterministic_mask(F.col("full_text")).alias("masked_text"))


@reg.add("mask_union", _LEX_SQL + f"""mt AS (SELECT tweet_id, ingest_pos, full_text, {_TOK.format(t='full_text')} AS toks
  FROM doc_posts),
mm AS (SELECT tweet_id, list_filter(string_split_regex(array_to_string(list_transform(toks, lambda t: CASE WHEN
    length(t) >= {MODEL_MASK_MIN_LEN} THEN '[MASKED]' ELSE t END), ' ')
    || CASE WHEN ingest_pos % 7 = 0 THEN ' extra' ELSE '' END, '\\s+'), lambda w: w <> '') AS model FROM mt),
lw AS (SELECT DISTINCT unnest(words) AS word FROM lex),
tk AS (SELECT tweet_id, len(toks) AS n, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM mt),
mk AS (SELECT tweet_id, len(model) AS nm, unnest(model) AS m, generate_subscripts(model, 1) AS i FROM mm),
th AS (SELECT tk.tweet_id, tk.i, tk.t, tk.n,
    (lower(tk.t) IN (SELECT word FROM lw)) OR coalesce(mk.nm = tk.n AND mk.m = '[MASKED]' AND tk.t <> '[MASKED]', false) AS hit,
    regexp_matches(tk.t, '^[\\p{{L}}\\p{{N}}_]+$') AS word
  FROM tk LEFT JOIN mk ON tk.tweet_id = mk.tweet_id AND tk.i = mk.i),
doc AS (SELECT tweet_id, bool_or(hit) AS any_hit, coalesce(max(i) FILTER (WHERE word), max(n)) AS last_pos
  FROM th GROUP BY tweet_id),
out AS (SELECT th.tweet_id, string_agg(CASE WHEN (doc.any_hit AND th.hit) OR (NOT doc.any_hit AND th.i = doc.last_pos)
    THEN '[MASKED]' ELSE th.t END, ' ' ORDER BY th.i) AS masked FROM th JOIN doc ON th.tweet_id = doc.tweet_id
  GROUP BY th.tweet_id)
SELECT mt.tweet_id, CASE WHEN coalesce(mt.full_text = '', true)
    OR coalesce(regexp_matches(mt.full_text, '{URL_ONLY_PATTERN}'), false) THEN '[MASKED]'
  ELSE coalesce(out.masked, '') END AS masked_text
FROM mt LEFT JOIN out ON mt.tweet_id = out.tweet_id""")
def mask_union(spark, sf_dir):
    """K2 + K3: rules union a model's masked positions, with the failsafe."""
    todo = posts(spark, sf_dir)
    toks = M.tokens(F.col("full_text"))
    model = F.concat(F.array_join(F.transform(toks, lambda t: F.when(F.length(t) >= MODEL_MASK_MIN_LEN,
                                                                     F.lit("[MASKED]")).otherwise(t)), " "),
                     F.when(F.col("ingest_pos") % 7 == 0, F.lit(" extra")).otherwise(F.lit("")))
    t = M.attach_lexicon(todo.withColumn("model_text", model), lexicon(spark, sf_dir))
    return t.select("tweet_id", M.union_mask(F.col("full_text"), F.col("model_text")).alias("masked_text"))


@reg.add("mask_worklist", _LEX_SQL.rstrip().rstrip(",") + f"""
SELECT user_id, count(*) AS texts, count_if(masked_text IS NOT NULL) AS processed,
  count_if(masked_text IS NULL) AS unprocessed, count_if(masked_text IS NULL) < 10 AS rules_only,
  CAST(ceil(count_if(masked_text IS NULL) / {BATCH_SIZE}) AS BIGINT) AS batches,
  round(count_if(masked_text IS NULL) * 100 / 1000.0 * 0.00015, 6) AS estimated_cost
FROM hold GROUP BY user_id""")
def mask_worklist(spark, sf_dir):
    """A36 + A37: work list per user and the batch plan."""
    return rounded(M.work_list(holdout(spark, sf_dir), batch_size=BATCH_SIZE))


_REQ_SQL = _LEX_SQL + f"""pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ingest_pos) - 1 AS position
  FROM doc_posts),
req AS (SELECT user_id, tweet_id, position, 'mask-' || CAST(position AS VARCHAR) AS custom_id,
    CAST(floor(position / {BATCH_SIZE}) AS BIGINT) AS batch, full_text,
    CAST(to_json({{'custom_id': 'mask-' || CAST(position AS VARCHAR), 'method': 'POST', 'url': '{M.BATCH_URL}',
      'body': {{'model': '{M.BATCH_MODEL}', 'messages': [{{'role': 'system', 'content': $${M.MASK_SYSTEM_PROMPT}$$}},
        {{'role': 'user', 'content': $${M.MASK_USER_PREFIX}$$ || full_text}}],
        'temperature': CAST({M.BATCH_TEMPERATURE} AS DOUBLE), 'max_tokens': {M.BATCH_MAX_TOKENS}}}}}) AS VARCHAR) AS request
  FROM pos WHERE NOT (coalesce(full_text = '', true) OR coalesce(regexp_matches(full_text, '{URL_ONLY_PATTERN}'), false))),
"""


def requests(spark, sf_dir, carry=()):
    return M.batch_requests(posts(spark, sf_dir), batch_size=BATCH_SIZE, carry=carry)


@reg.add("batch_requests", _REQ_SQL.rstrip().rstrip(",") + """
SELECT user_id, tweet_id, position, custom_id, batch, request FROM req""")
def batch_requests(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("user_id", "tweet_id", F.col("position").cast("bigint").alias("position"), "custom_id",
                    F.col("batch").cast("bigint").alias("batch"), "request")


@reg.add("batch_results", _REQ_SQL + f"""res AS (SELECT user_id, custom_id,
    CASE WHEN position % 5 = 0 THEN 500 ELSE 200 END AS status, {_mask_sql('full_text')} || '  ' AS content
  FROM req, lex),
parsed AS (SELECT user_id, custom_id, status = 200 AS ok,
    CASE WHEN status = 200 THEN regexp_replace(content, '^\\s+|\\s+$', '', 'g') ELSE '[MASKED]' END AS mt FROM res)
SELECT h.user_id, h.tweet_id, coalesce(p.mt, {_mask_sql('h.full_text')}) AS masked_text,
  CASE WHEN p.ok THEN 'batch' WHEN p.ok IS NOT NULL THEN 'failed' ELSE 'rules' END AS origin
FROM doc_posts h CROSS JOIN lex LEFT JOIN req r ON h.tweet_id IS NOT DISTINCT FROM r.tweet_id AND h.user_id IS NOT DISTINCT FROM r.user_id
LEFT JOIN parsed p ON r.custom_id = p.custom_id AND r.user_id IS NOT DISTINCT FROM p.user_id""")
def batch_results(spark, sf_dir):
    """S18 + J11: parse result lines, join back by request id, fall back to the rule mask where no
    result exists.  The requests are made once; users without an id keep their rows."""
    lex = lexicon(spark, sf_dir)
    req = cut_lineage(requests(spark, sf_dir, carry=("full_text",)).select("user_id", "tweet_id", "position", "custom_id", "full_text"))
    # the service's result lines (one JSON object per request) as they come back
    line = F.to_json(F.struct(
        F.col("custom_id"),
        F.struct(F.when(F.col("position") % 5 == 0, F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
                 F.struct(F.array(F.struct(F.struct(F.concat(M.deterministic_mask(F.col("full_text")), F.lit("  "))
                                                    .alias("content")).alias("message"))).alias("choices"))
                 .alias("body")).alias("response")))
    lines = M.attach_lexicon(req, lex).select("user_id", line.alias("value"))
    parsed = M.parse_batch_results(lines, keep=["user_id"])
    ids = null_safe_join(req.select("user_id", "tweet_id", "custom_id"), parsed, ["custom_id", "user_id"], "left")
    todo = posts(spark, sf_dir).select("user_id", "tweet_id", "full_text")
    j = null_safe_join(todo, ids.drop("custom_id"), ["user_id", "tweet_id"], "left")
    origin = F.when(F.col("ok"), F.lit("batch")).when(F.col("ok").isNotNull(), F.lit("failed")).otherwise(F.lit("rules"))
    return M.attach_lexicon(j, lex).select(
        "user_id", "tweet_id", F.coalesce(F.col("masked_text"), M.deterministic_mask(F.col("full_text"))).alias("masked_text"),
        origin.alias("origin"))


@reg.add("mask_outcome", _REQ_SQL.rstrip().rstrip(",") + """
SELECT user_id, count_if(position % 5 <> 0) AS ok, count_if(position % 5 = 0) AS failed, count(*) AS processed,
  round(count_if(position % 5 <> 0) / count(*), 6) AS success_rate FROM req GROUP BY user_id""")
def mask_outcome(spark, sf_dir):
    """Per user successful / failed requests and the success rate."""
    r = requests(spark, sf_dir)
    ok = F.col("position") % 5 != 0
    g = r.groupBy("user_id").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
                                 F.count(F.lit(1)).alias("processed"))
    return rounded(g.withColumn("success_rate", F.col("ok") / F.col("processed")))


MIN_TEXTS = 38              # users with fewer texts to mask are left to the rules in these queries


@reg.add("mask_routing", _LEX_SQL.rstrip().rstrip(",") + f""", c AS (SELECT user_id, count(*) AS todo_texts FROM hold WHERE masked_text IS NULL GROUP BY user_id)
SELECT h.user_id, h.tweet_id, c.todo_texts, CASE WHEN c.todo_texts < {MIN_TEXTS} THEN 'rules' ELSE 'batch' END AS route
FROM hold h JOIN c ON c.user_id IS NOT DISTINCT FROM h.user_id WHERE h.masked_text IS NULL""")
def mask_routing(spark, sf_dir):
    """K4: which way each text still to mask goes."""
    return M.route_texts(holdout(spark, sf_dir), min_texts=MIN_TEXTS).select("user_id", "tweet_id", "todo_texts", "route")


@reg.add("mask_list", _LEX_SQL.rstrip().rstrip(",") + f"""
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS position, {_mask_sql('text')} AS masked_text FROM conversations, lex""")
def mask_list(spark, sf_dir):
    """K5: all turns as one list, masked in order."""
    return M.mask_in_order(A.table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", lexicon(spark, sf_dir))
