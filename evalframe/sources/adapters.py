"""Driver tables -> engine tables.

The engine works on the reference's data model (posts, pairs, runs,
evaluations, condition results).  These adapters derive that model from
the parquet tables the driver provides, column for column, so every query
grows with the input.  Each adapter has a DuckDB twin (``*_SQL``) used by
the oracle so both sides start from the same rows.

Only projections (and, for pairs, one equi-join on the turn key): the scans
keep their column pruning and filter pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.functions.text import strip_html


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lpad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


# Fixed strategy names of the reference's experiment runs, in the order the
# adapter assigns them (conv_id % 6).
RUN_STRATEGIES = [
    "run_r50_all_metrics",
    "run_r50_rouge_1",
    "run_r50_bleu_only",
    "run_r50_perplexity_only",
    "run_r50_bertscore",
    "run_r50_imitations",
]


def _strategy(conv: Column) -> Column:
    e = None
    for i, name in enumerate(RUN_STRATEGIES):
        e = F.when((conv % 6) == i, F.lit(name)) if e is None else e.when((conv % 6) == i, F.lit(name))
    return e


def _strategy_sql(conv: str) -> str:
    arms = " ".join(f"WHEN {conv} % 6 = {i} THEN '{n}'" for i, n in enumerate(RUN_STRATEGIES))
    return f"CASE {arms} END"


# ---------------------------------------------------------------------------
# posts from conversations: a conversation turn is a post; turn > 0 replies
# to the previous turn; system turns play the role of retweets.
# ---------------------------------------------------------------------------

# a turn is a 32-bit number, so conversation and turn share one 64-bit number without collision
TURNS = 2**32


def posts_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    created = F.concat(
        F.lit("2023-08-"), _lpad2(1 + conv % 28), F.lit(" "),
        _lpad2((conv * 7 + turn) % 24), F.lit(":"), _lpad2((conv * 13 + turn * 5) % 60),
        F.lit(":00+00:00"))
    return c.select(
        (conv % 10).cast("string").alias("user_id"),
        F.concat_ws("_", conv, turn).alias("tweet_id"),
        F.col("role").alias("screen_name"),
        created.alias("created_at"),
        F.col("text").alias("full_text"),
        F.when(turn > 0, F.concat_ws("_", conv, turn - 1)).alias("reply_to_id"),
        F.when(F.col("role") == "system", F.lit("sys")).alias("retweeted_user_id"),
        (conv * TURNS + turn).alias("ingest_pos"),
    )


POSTS_SQL = f"""posts AS (
  SELECT CAST(conv_id % 10 AS VARCHAR) AS user_id,
         conv_id || '_' || turn AS tweet_id,
         role AS screen_name,
         '2023-08-' || lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0') || ' '
           || lpad(CAST((conv_id * 7 + turn) % 24 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST((conv_id * 13 + turn * 5) % 60 AS VARCHAR), 2, '0') || ':00+00:00' AS created_at,
         text AS full_text,
         CASE WHEN turn > 0 THEN conv_id || '_' || (turn - 1) END AS reply_to_id,
         CASE WHEN role = 'system' THEN 'sys' END AS retweeted_user_id,
         conv_id * {TURNS} + turn AS ingest_pos
  FROM conversations)"""


# ---------------------------------------------------------------------------
# prediction/reference pairs: an assistant turn imitates the turn before it.
# ---------------------------------------------------------------------------

def pairs_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turn (prediction) paired with the turn right before it
    (reference), which is null where there is none (J2).  A self equi-join on
    (conv_id, turn - 1): the join key
    contains the turn, so even a conversation holding a third of all rows
    is spread over many partitions (a ``lag`` window would put it in one)."""
    c = table(spark, sf_dir, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    a = c.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    conv, turn = F.col("conv_id"), F.col("turn")
    rnd = 1 + (conv / 6).cast("bigint") % 4
    return a.join(prev, ["conv_id", "turn"], "left").select(
        (conv % 10).cast("string").alias("user_id"),
        F.concat(_strategy(conv), F.lit("_round_"), rnd.cast("string")).alias("run_id"),
        (conv * TURNS + turn).alias("index"),
        # the item is keyed by the original (reference) post it imitates
        F.concat_ws("_", conv, turn - 1).alias("tweet_id"),
        F.col("text").alias("prediction"),
        F.col("reference"),
    )


PAIRS_SQL = f"""pairs AS (
  SELECT CAST(conv_id % 10 AS VARCHAR) AS user_id,
         {_strategy_sql('conv_id')} || '_round_' || CAST(1 + (conv_id // 6) % 4 AS VARCHAR) AS run_id,
         conv_id * {TURNS} + turn AS index,
         conv_id || '_' || (turn - 1) AS tweet_id,
         text AS prediction,
         CASE WHEN prev_turn = turn - 1 THEN reference END AS reference
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference,
               lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_turn
        FROM conversations) t
  WHERE role = 'assistant')"""


# ---------------------------------------------------------------------------
# documents / pages as posts (cleaning, masking, text patterns)
# ---------------------------------------------------------------------------

def posts_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    created = F.concat(F.lit("2023-08-"), _lpad2(1 + doc % 28), F.lit(" "),
                       _lpad2(doc % 24), F.lit(":00:00+00:00"))
    return d.select(
        F.col("source").alias("user_id"),
        doc.cast("string").alias("tweet_id"),
        F.col("lang").alias("screen_name"),
        created.alias("created_at"),
        F.col("text").alias("full_text"),
        F.when(doc % 3 == 0, (doc + 1).cast("string")).alias("reply_to_id"),
        F.lit(None).cast("string").alias("retweeted_user_id"),
        doc.alias("ingest_pos"),
    )


DOC_POSTS_SQL = """doc_posts AS (
  SELECT source AS user_id, CAST(doc_id AS VARCHAR) AS tweet_id, lang AS screen_name,
         '2023-08-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || ' '
           || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':00:00+00:00' AS created_at,
         text AS full_text,
         CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 1 AS VARCHAR) END AS reply_to_id,
         CAST(NULL AS VARCHAR) AS retweeted_user_id,
         doc_id AS ingest_pos
  FROM documents)"""


def posts_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.lit("pages").alias("user_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("tweet_id"),
        F.lit("web").alias("screen_name"),
        F.lit("2023-08-01 00:00:00+00:00").alias("created_at"),
        F.concat_ws(" ", F.col("url"), strip_html(F.col("html"))).alias("full_text"),
        F.lit(None).cast("string").alias("reply_to_id"),
        F.lit(None).cast("string").alias("retweeted_user_id"),
        F.col("page_id").alias("ingest_pos"),
    )


PAGE_POSTS_SQL = """page_posts AS (
  SELECT 'pages' AS user_id, 'p' || CAST(page_id AS VARCHAR) AS tweet_id, 'web' AS screen_name,
         '2023-08-01 00:00:00+00:00' AS created_at,
         concat_ws(' ', url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS full_text,
         CAST(NULL AS VARCHAR) AS reply_to_id, CAST(NULL AS VARCHAR) AS retweeted_user_id,
         page_id AS ingest_pos
  FROM pages)"""


# ---------------------------------------------------------------------------
# condition results / rounds from events
# ---------------------------------------------------------------------------

def results_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored item per event: user x condition x task x round."""
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts").cast("bigint")
    return e.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("condition"),
        F.when(F.col("event_id") % 2 == 0, F.lit("post")).otherwise(F.lit("reply")).alias("task"),
        day.alias("round"),
        F.concat(F.lit("baseline_"), F.col("event_type"), F.lit("_round_"), day.cast("string")).alias("run_id"),
        F.col("event_id").alias("item"),
        F.col("value").alias("score"),
        F.col("ts"),
        F.col("props"),
    )


RESULTS_SQL = """results AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS condition,
         CASE WHEN event_id % 2 = 0 THEN 'post' ELSE 'reply' END AS task,
         CAST(dayofmonth(ts) AS BIGINT) AS round,
         'baseline_' || event_type || '_round_' || CAST(dayofmonth(ts) AS VARCHAR) AS run_id,
         event_id AS item, value AS score, ts, props
  FROM events)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
