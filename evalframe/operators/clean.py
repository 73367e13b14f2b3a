"""Raw posts -> cleaned posts -> eligible users -> history / holdout sets.

P1-P10, W1, A1, W2, J1, W8, J8.  Every step is a DataFrame transform; the
only shuffles are the de-duplication (by tweet id), the parent join (by id)
and the per-user counts / top-k ranks, all of which are partial-aggregated
or group-limited before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.text import (
    blank_to_null,
    contains_url,
    is_blank,
    is_only_emoji,
    url_without_context,
    word_count,
)
from evalframe.operators.skew import lookup_join

SEED = 42

POST_COLS = ["user_id", "tweet_id", "screen_name", "created_at", "full_text",
             "reply_to_id", "retweeted_user_id"]


def normalise_ids(posts: DataFrame) -> DataFrame:
    """Missing reply / retweet ids spelled as text become NULL."""
    out = posts
    for c in ("reply_to_id", "retweeted_user_id"):
        if c in posts.columns:
            out = out.withColumn(c, blank_to_null(F.col(c)))
    return out


def dedupe_keep_first(df: DataFrame, key: str | Sequence[str], order_col: str = "ingest_pos",
                      count_col: str | None = None) -> DataFrame:
    """One row per key, the first in ingest order.

    ``min(struct(order, row))`` is an ordinary aggregate, so each map task
    keeps one row per key before the shuffle: a key with millions of copies
    costs one row per map task, not one task holding all copies.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    aggs = [F.min(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in rest])).alias("_first")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    g = df.groupBy(*keys).agg(*aggs)
    return g.select(*keys, F.col("_first._o").alias(order_col),
                    *[F.col(f"_first.{c}").alias(c) for c in rest],
                    *([F.col(count_col)] if count_col else []))


def cleaning_flags(posts: DataFrame, text_col: str = "full_text") -> DataFrame:
    """P2, P3, P5, P6, P7 as boolean columns (one projection, no filter yet)."""
    t = F.col(text_col)
    return posts.select(
        "*",
        F.col("retweeted_user_id").isNotNull().alias("is_retweet"),
        is_only_emoji(t).alias("is_emoji_only"),
        contains_url(t).alias("has_url"),
        url_without_context(t).alias("url_without_context"),
        (word_count(t) >= 3).alias("has_min_words"),
    )


def clean_posts(posts: DataFrame) -> DataFrame:
    """P8 cascade: normalise, de-duplicate by tweet id, drop retweets,
    emoji-only posts, posts with a link, and posts under 3 words."""
    p = dedupe_keep_first(normalise_ids(posts), "tweet_id")
    f = cleaning_flags(p)
    return (f.where(~F.col("is_retweet") & ~F.col("is_emoji_only") & ~F.col("has_url")
                    & F.col("has_min_words"))
             .drop("is_retweet", "is_emoji_only", "has_url", "url_without_context", "has_min_words"))


def attrition(posts: DataFrame) -> DataFrame:
    """P8 counts after each cleaning step, as one row (one global aggregate)."""
    p = dedupe_keep_first(normalise_ids(posts), "tweet_id", count_col="_copies")
    f = cleaning_flags(p)
    s1 = ~F.col("is_retweet")
    s2 = s1 & ~F.col("is_emoji_only")
    s3 = s2 & ~F.col("has_url")
    s4 = s3 & F.col("has_min_words")
    return f.agg(
        F.sum("_copies").alias("n_input"),
        F.count(F.lit(1)).alias("n_after_dedupe"),
        F.count_if(s1).alias("n_after_retweets"),
        F.count_if(s2).alias("n_after_emoji"),
        F.count_if(s3).alias("n_after_links"),
        F.count_if(s4).alias("n_after_min_words"),
        F.count_if(F.col("url_without_context")).alias("n_url_without_context"),
    )


def parent_messages(cleaned: DataFrame) -> DataFrame:
    """Every reply gets ``"created_at, screen_name: full_text"`` of its
    parent, looked up across all users after cleaning; null when absent.

    The parent side holds one row per id.  The replies of a parent with very
    many are dealt over salts, and posts that reply to nothing are spread over
    all tasks (``lookup_join``).
    """
    parents = cleaned.where(F.col("tweet_id").isNotNull()).select(
        F.col("tweet_id").alias("reply_to_id"),
        F.concat(F.coalesce(F.col("created_at"), F.lit("")), F.lit(", "),
                 F.coalesce(F.col("screen_name"), F.lit("")), F.lit(": "),
                 F.coalesce(F.col("full_text"), F.lit(""))).alias("previous_message"))
    return lookup_join(cleaned, parents, ["reply_to_id"], spread=["tweet_id"]).select(*cleaned.columns, "previous_message")


def user_counts(cleaned: DataFrame, posts_per_set: int = 100, replies_per_set: int = 50) -> DataFrame:
    """A1: posts / replies / originals per user and the eligibility rule
    (replies >= 2R, originals >= 2O, total >= 2P with O = P - R)."""
    originals_per_set = posts_per_set - replies_per_set
    g = cleaned.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.count_if(F.col("reply_to_id").isNotNull()).alias("replies"))
    g = g.withColumn("originals", F.col("total_posts") - F.col("replies"))
    return g.withColumn("eligible", (F.col("replies") >= 2 * replies_per_set)
                        & (F.col("originals") >= 2 * originals_per_set)
                        & (F.col("total_posts") >= 2 * posts_per_set))


def seeded_order(id_col: Column, seed: int | str = SEED, salt: str = "") -> Column:
    """Reproducible shuffle key: md5(seed | salt | id)."""
    parts = [F.lit(str(seed)), F.lit("|")]
    if salt:
        parts += [F.lit(salt), F.lit("|")]
    return F.md5(F.concat(*parts, id_col.cast("string")))


def split_history_holdout(cleaned: DataFrame, posts_per_set: int = 100, replies_per_set: int = 50,
                          seed: int = SEED) -> DataFrame:
    """Per eligible user, the first R replies / O originals of a seeded
    shuffle go to holdout, the next R / O to history; users whose sets do
    not have exactly P posts with R replies are dropped.

    The rank filter ``rn <= 2N`` is planned as a WindowGroupLimit, so even a
    user holding a third of all posts contributes at most 2N rows per map
    task to the shuffle.
    """
    originals_per_set = posts_per_set - replies_per_set
    counts = user_counts(cleaned, posts_per_set, replies_per_set).where("eligible").select("user_id")
    p = cleaned.withColumn("is_reply", F.col("reply_to_id").isNotNull())
    w = Window.partitionBy("user_id", "is_reply").orderBy(seeded_order(F.col("tweet_id"), seed), "tweet_id")
    n = F.when(F.col("is_reply"), F.lit(replies_per_set)).otherwise(F.lit(originals_per_set))
    ranked = p.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2 * max(replies_per_set,
                                                                                      originals_per_set))
    ranked = ranked.where(F.col("rn") <= 2 * n).withColumn(
        "set", F.when(F.col("rn") <= n, F.lit("holdout")).otherwise(F.lit("history")))
    ranked = ranked.join(counts, "user_id", "left_semi")
    # composition check over the (already bounded: <= 2R + 2O rows) user group
    u = Window.partitionBy("user_id")
    h = F.col("set") == "holdout"
    ok = ((F.count_if(h).over(u) == posts_per_set) & (F.count_if(h & F.col("is_reply")).over(u) == replies_per_set)
          & (F.count_if(~h).over(u) == posts_per_set)
          & (F.count_if(~h & F.col("is_reply")).over(u) == replies_per_set))
    kept = ranked.withColumn("_ok", ok).where("_ok").drop("_ok")
    w2 = Window.partitionBy("user_id", "set").orderBy(seeded_order(F.col("tweet_id"), seed, "set"), "tweet_id")
    return kept.withColumn("pos", F.row_number().over(w2) - 1).drop("rn")


def filter_by_date(posts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive date range on the first 10 chars of ``created_at``;
    unparsable dates are dropped only when a bound is given."""
    d = F.try_to_timestamp(F.substring("created_at", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    out = posts.withColumn("created_date", d)
    if start is None and end is None:
        return out
    cond = F.col("created_date").isNotNull()
    if start is not None:
        cond = cond & (F.col("created_date") >= F.to_date(F.lit(start)))
    if end is not None:
        cond = cond & (F.col("created_date") <= F.to_date(F.lit(end)))
    return out.where(cond)


def tweet_type(posts: DataFrame) -> Column:
    """P10 classifier: retweet / reply / post."""
    return (F.when(~is_blank(F.col("retweeted_user_id")), F.lit("retweet"))
             .when(~is_blank(F.col("reply_to_id")), F.lit("reply"))
             .otherwise(F.lit("post")))


def filter_by_type(posts: DataFrame, kind: str) -> DataFrame:
    """P10: 'posts', 'replies' or 'retweets' (anything else: unchanged)."""
    want = {"posts": "post", "replies": "reply", "retweets": "retweet"}.get(kind)
    if want is None:
        return posts
    return posts.where(tweet_type(posts) == want)


def task_type_strict(reply_to_id: Column, previous_message: Column) -> Column:
    """A post has neither a reply id nor a previous message."""
    return F.when(reply_to_id.isNull() & previous_message.isNull(), F.lit("post")).otherwise(F.lit("reply"))


def task_type_lookup(items: DataFrame, posts: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """P12 + J4: task type by looking the item's tweet up among the posts;
    unknown tweet -> null."""
    look = posts.select(F.col("tweet_id").alias("_tid"), "user_id",
                        F.when(F.col("reply_to_id").isNull(), F.lit("post")).otherwise(F.lit("reply"))
                        .alias("task_lookup"))
    keys = [items[id_col] == look["_tid"]]
    if "user_id" in items.columns:
        keys.append(items["user_id"] == look["user_id"])
    return items.join(look, keys, "left").drop("_tid").drop(look["user_id"])


# Condition names of the baseline experiment, fixed values, in fixed order.
CONDITIONS = ["no_persona", "generic", "history_only", "best_persona"]


def sample_stimuli(holdout: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Fixed-seed sample of k stimuli per user (``rn <= k`` is a
    group limit); users with fewer than k stimuli are dropped (G9)."""
    w = Window.partitionBy("user_id").orderBy(seeded_order(F.col("tweet_id"), seed, "stimuli"), "tweet_id")
    s = holdout.withColumn("stimulus_rank", F.row_number().over(w)).where(F.col("stimulus_rank") <= k)
    full = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select("user_id")
    return s.join(full, "user_id", "left_semi")


def stimuli_by_condition(stimuli: DataFrame, conditions: Sequence[str] = tuple(CONDITIONS)) -> DataFrame:
    """Every condition gets the identical stimulus list.  A generate over
    a literal array (no join): each stimulus row is repeated per condition."""
    arr = F.array(*[F.lit(c) for c in conditions])
    return stimuli.select(F.explode(arr).alias("condition"), "*")
