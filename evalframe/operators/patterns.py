"""Text-pattern profiles and JSON structure profiles."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators.clean import tweet_type
from evalframe.operators.skew import null_safe_join, quantiles

WORD = r"[\p{L}\p{N}_]+"
HASHTAG = r"#[\p{L}\p{N}_]+"
MENTION = r"@[\p{L}\p{N}_]+"
UTC_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\+00:00$"


def post_patterns(posts: DataFrame, group: Sequence[str] = ("user_id",)) -> DataFrame:
    """Type counts, mean / median text length, hashtag and mention
    totals and distinct counts per group.  Distinct tags are counted with
    an exact distinct aggregate over the exploded tags (no per-group sets)."""
    g = list(group)
    t = F.coalesce(F.col("full_text"), F.lit(""))
    kind = tweet_type(posts)
    base = posts.select(*g, kind.alias("kind"), F.length(t).alias("len"),
                        F.regexp_extract_all(t, F.lit(HASHTAG), 0).alias("tags"),
                        F.regexp_extract_all(t, F.lit(MENTION), 0).alias("ments"))
    counts = base.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total_tweets"), F.count_if(F.col("kind") == "post").alias("posts"),
        F.count_if(F.col("kind") == "reply").alias("replies"), F.count_if(F.col("kind") == "retweet").alias("retweets"),
        F.avg("len").alias("avg_text_length"),
        F.sum(F.size("tags")).alias("hashtag_count"), F.sum(F.size("ments")).alias("mention_count"))
    tags = base.select(*g, F.explode("tags").alias("tag")).groupBy(*g).agg(
        F.countDistinct("tag").alias("unique_hashtags"))
    ments = base.select(*g, F.explode("ments").alias("m")).groupBy(*g).agg(
        F.countDistinct("m").alias("unique_mentions"))
    middle = quantiles(base, g, "len", [0.5]).withColumn("median_text_length", F.col("_q")[0]).drop("_q")
    out = counts
    for part in (middle, tags, ments):
        out = null_safe_join(out, part, g, "left")
    return out.fillna(0, ["unique_hashtags", "unique_mentions"])


def top_words(texts: DataFrame, text_col: str, k: int = 20) -> DataFrame:
    """The k most common lower-cased words (ties by word)."""
    w = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), 0)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word").limit(k)


def hour_histogram(posts: DataFrame, stamp: str = "created_at") -> DataFrame:
    """Posts per hour of day, only for ``YYYY-MM-DD HH:MM:SS+00:00`` stamps."""
    ok = posts.where(F.col(stamp).rlike(UTC_STAMP))
    return ok.groupBy(F.substring(stamp, 12, 2).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("posts"))


def _type_name(v) -> str:
    return type(v).__name__


def json_paths(doc: str | None) -> list[tuple[str, str]]:
    """A34/X6 walker: every key path of a JSON document with the type of each
    primitive reached; array elements are the path step ``[items]``.
    Malformed documents yield nothing."""
    if doc is None:
        return []
    try:
        obj = json.loads(doc)
    except (ValueError, TypeError):
        return []
    out = []
    stack = [("", obj)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            for k, sub in v.items():
                stack.append((f"{path}.{k}" if path else str(k), sub))
        elif isinstance(v, list):
            for sub in v:
                stack.append((f"{path}.[items]" if path else "[items]", sub))
        else:
            out.append((path, _type_name(v)))
    return out


_PATHS_TYPE = "array<struct<path:string,type:string>>"
_UDF: dict = {}


def _paths_batch(docs: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "type": t} for p, t in json_paths(d)] for d in docs])


def json_profile(docs: DataFrame, doc_col: str) -> DataFrame:
    """Per key path the sorted set of primitive types seen and how often.

    The walker runs on Arrow batches and emits (path, type) rows; the
    profile is an ordinary aggregate (collect_set holds at most the handful
    of JSON type names per path)."""
    if "f" not in _UDF:
        _UDF["f"] = F.pandas_udf(_paths_batch, _PATHS_TYPE)
    paths = docs.select(F.explode(_UDF["f"](F.col(doc_col))).alias("p")).select("p.path", "p.type")
    return paths.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("types"),
                                     F.count(F.lit(1)).alias("occurrences"))


def key_search(profile: DataFrame, needle: str) -> Column:
    """A35 predicate: key paths whose lower-cased text contains ``needle``."""
    return F.lower(F.col("path")).contains(needle.lower())
