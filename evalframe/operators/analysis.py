"""Score analysis by user, run, round and condition.

Input is a long "results" table: one scored item per row with
``user_id, condition, task, round, run_id, item, score`` (plus any extra
metric columns).  Every function is a grouped aggregate or a bounded
window; none collects a group to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.operators.skew import lookup_join, null_safe_join, quantiles, ranked

# Fixed display order of the baseline conditions (used for ordinal sort keys).
CONDITION_ORDER = ["no_persona", "generic", "history_only", "best_persona"]
# Fixed condition labels.
CONDITION_LABELS = {
    "no_persona": "No-Persona",
    "generic": "Generic-Persona",
    "history_only": "History-Only",
    "best_persona": "Best-Persona",
}


def nan_to_null(c: Column) -> Column:
    """pandas ``nanmean`` semantics for Spark ``avg``: NaN -> null first."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def cell_means(results: DataFrame, keys: Sequence[str] = ("user_id", "condition", "task"),
               value: str = "score", fill: float | None = 0.0) -> DataFrame:
    """Mean of a metric per cell; missing metric -> ``fill``."""
    v = nan_to_null(F.col(value))
    out = results.groupBy(*keys).agg(F.avg(v).alias("mean_value"), F.count(v).alias("n"))
    if fill is not None:
        out = out.withColumn("mean_value", F.coalesce("mean_value", F.lit(float(fill))))
    return out


def descriptives(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample std, median per group."""
    v = F.col(value)
    g = df.groupBy(*group).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    g = null_safe_join(g, quantiles(df, group, value, [0.5]), group, "left")
    return g.select(*group, "count", "mean", "std", F.col("_q")[0].alias("median"))


def pivot_mean(df: DataFrame, row: str, col: str, values: Sequence[str], value: str) -> DataFrame:
    """Rows pivoted to one column per value (explicit values: no extra job)."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(value))


def grouping_summary(df: DataFrame, outer: str, inner: str, value: str,
                     order: Sequence[str] | None = None, overall_label: str = "overall") -> DataFrame:
    """Per (outer, inner) plus one overall row per outer, via GROUPING SETS,
    with an ordinal sort key from a fixed category order."""
    g = df.groupingSets([[outer, inner], [outer]], outer, inner).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"),
        F.grouping(inner).alias("_gi"))
    g = g.withColumn(inner, F.when(F.col("_gi") == 1, F.lit(overall_label)).otherwise(F.col(inner))).drop("_gi")
    if order:
        key = F.lit(len(order))
        for i, name in reversed(list(enumerate(order))):
            key = F.when(F.col(outer) == name, F.lit(i)).otherwise(key)
        g = g.withColumn("sort_key", key)
    return g


def sem(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean and standard error (sample std / sqrt(non-null n))."""
    v = F.col(value)
    return df.groupBy(*group).agg(F.avg(v).alias("mean"), F.count(v).alias("n"),
                                  F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v))).alias("sem"))


def describe(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max, 99th percentile at every size."""
    v = F.col(value)
    g = df.groupBy(*group).agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                               F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    g = null_safe_join(g, quantiles(df, group, value, [0.25, 0.5, 0.75, 0.99]), group, "left")
    return g.select(*group, "count", "mean", "std", "min",
                    F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                    F.col("_q")[2].alias("p75"), "max", F.col("_q")[3].alias("p99"))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns -> (metric, value) rows."""
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def round_aggregate(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per group and metric: mean, sample std, min, max, count."""
    long = unpivot_metrics(df.select(*group, *metrics), group, metrics)
    v = nan_to_null(F.col("value"))
    return long.groupBy(*group, "metric").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count(v).alias("count"))


def trend(agg: DataFrame, group: Sequence[str], round_col: str = "round", value: str = "mean") -> DataFrame:
    """First -> last round: delta, percent change (0 if base is 0), arrow."""
    g = agg.groupBy(*group).agg(
        F.min_by(value, round_col).alias("first"), F.max_by(value, round_col).alias("last"),
        F.min(round_col).alias("first_round"), F.max(round_col).alias("last_round"))
    delta = F.col("last") - F.col("first")
    return g.select(*group, "first_round", "last_round", "first", "last", delta.alias("delta"),
                    F.when(F.col("first") == 0, F.lit(0.0)).otherwise(F.try_divide(delta, F.col("first")) * 100)
                    .alias("pct_change"),
                    F.when(delta > 0, F.lit("up")).when(delta < 0, F.lit("down")).otherwise(F.lit("flat"))
                    .alias("direction"))


def argmax_per_group(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The row with the largest ``value`` per group (ties by ``tie`` asc).

    ``row_number() = 1`` is planned as a group limit, so the shuffle carries
    at most one row per group and map task."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), *[F.col(t) for t in tie])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def initial_vs_peak(agg: DataFrame, group: Sequence[str], round_col: str = "round",
                    value: str = "mean") -> DataFrame:
    """Initial (first round) vs peak value and the improvement."""
    g = agg.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.min_by(value, round_col).alias("initial"), F.max(value).alias("peak"))
    return g.withColumn("improvement", F.col("peak") - F.col("initial"))


def user_scores(results: DataFrame, group: Sequence[str] = ("condition",), value: str = "score") -> DataFrame:
    """Mean score per user within each group."""
    return results.groupBy(*group, "user_id").agg(F.avg(nan_to_null(F.col(value))).alias("mean_score"),
                                                  F.count(F.lit(1)).alias("n_items"))


def rank_users(scores: DataFrame, group: Sequence[str], metric: str = "mean_score",
               descending: bool = True) -> DataFrame:
    """Rank of each user within a group (ties by user id, null scores last, null ids first).

    Ranks come from counts per range of (group, metric, user), so the users of a group of any
    size are sorted by many tasks."""
    o = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return ranked(scores, group, [o, F.col("user_id")])


def top_bottom(scores: DataFrame, group: Sequence[str], metric: str = "mean_score", n: int = 5) -> DataFrame:
    """Top n and bottom n users; bottom is empty unless there are more
    than n users (top and bottom may overlap).  Both sides are ``rn <= n``
    group limits."""
    g = list(group)
    top = scores.withColumn("rn", F.row_number().over(
        Window.partitionBy(*g).orderBy(F.col(metric).desc(), F.col("user_id")))).where(F.col("rn") <= n) \
        .withColumn("side", F.lit("top"))
    bot = scores.withColumn("rn", F.row_number().over(
        Window.partitionBy(*g).orderBy(F.col(metric).asc(), F.col("user_id")))).where(F.col("rn") <= n) \
        .withColumn("side", F.lit("bottom"))
    cnt = scores.groupBy(*g).agg(F.count(F.lit(1)).alias("_users"))
    both = top.unionByName(bot).join(cnt, g)
    return both.where((F.col("side") == "top") | (F.col("_users") > n)).drop("_users")


def summary(scores: DataFrame, group: Sequence[str], metric: str = "mean_score") -> DataFrame:
    """Users, mean, population std, total of the per-user metric."""
    v = F.col(metric)
    return scores.groupBy(*group).agg(F.count(F.lit(1)).alias("users"), F.avg(v).alias("mean"),
                                      F.stddev_pop(v).alias("std_pop"), F.sum(v).alias("total"),
                                      F.max(v).alias("max"), F.min(v).alias("min"))


def run_stats(results: DataFrame, group: Sequence[str], value: str = "score") -> DataFrame:
    """Users, items, max round, mean metric, number of distinct rounds."""
    return results.groupBy(*group).agg(
        F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("items"),
        F.max("round").alias("max_round"), F.avg(value).alias("mean_score"),
        F.countDistinct("round").alias("rounds"))


def compare(scores: DataFrame, key: Sequence[str], by: str, a: str, b: str,
            metric: str = "mean_score") -> DataFrame:
    """Per key, metric under ``a`` minus metric under ``b`` (both present)."""
    p = scores.where(F.col(by).isin(a, b)).groupBy(*key).agg(
        F.max(F.when(F.col(by) == a, F.col(metric))).alias("score_a"),
        F.max(F.when(F.col(by) == b, F.col(metric))).alias("score_b"))
    return p.where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull()) \
        .withColumn("difference", F.col("score_a") - F.col("score_b"))


# ---------------------------------------------------------------------------
# persona / round windows
# ---------------------------------------------------------------------------

def latest_persona(reflections: DataFrame, key: Sequence[str] = ("user_id", "run_id"),
                   iteration: str = "iteration", pos: str = "pos",
                   persona: str = "improved_persona") -> DataFrame:
    """Improved persona of the highest iteration (first in file order on
    ties); empty -> null.  One aggregate, no window."""
    best = F.max(F.struct(F.col(iteration), (-F.col(pos)).alias("_p"), F.col(persona).alias("_v")))
    g = reflections.groupBy(*key).agg(best.alias("_b"))
    return g.select(*key, F.col(f"_b.{iteration}").alias("iteration"),
                    F.when(F.trim(F.col("_b._v")) != "", F.col("_b._v")).alias("persona"))


def best_round(per_round: DataFrame, key: str = "user_id", round_col: str = "round",
               value: str = "mean_score") -> DataFrame:
    """Round with the highest value per key, strict > (earliest wins a tie),
    and only if the value is > 0."""
    best = F.max(F.struct(F.col(value), (-F.col(round_col)).alias("_r")))
    g = per_round.where(F.col(value) > 0).groupBy(key).agg(best.alias("_b"))
    return g.select(key, (-F.col("_b._r")).alias("best_round"), F.col(f"_b.{value}").alias("best_value"))


def round_chain(personas: DataFrame, key: Sequence[str], round_col: str = "round") -> DataFrame:
    """The persona used in round r+1 is the improved persona of round r
    (an equi-join on round + 1)."""
    prev = personas.select(*key, (F.col(round_col) + 1).alias(round_col),
                           F.col("persona").alias("persona_in"))
    return personas.join(prev, list(key) + [round_col], "left")


# ---------------------------------------------------------------------------
# keyed upserts
# ---------------------------------------------------------------------------

def upsert_latest(existing: DataFrame, updates: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union, then per key the update wins over the existing row, and
    among several rows the largest ``order`` wins.  Idempotent per key."""
    cols = [c for c in existing.columns if c not in key]
    u = existing.withColumn("_prio", F.lit(0)).unionByName(updates.withColumn("_prio", F.lit(1)))
    best = F.max(F.struct(F.col("_prio"), *[F.col(o) for o in order],
                          *[F.col(c).alias(c) for c in cols if c not in order]))
    g = u.groupBy(*key).agg(best.alias("_b"))
    return g.select(*key, *[F.col(f"_b.{c}").alias(c) for c in cols])


def upsert_first(existing: DataFrame, updates: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Runs keep the first persona ever written (first wins)."""
    u = existing.unionByName(updates)
    cols = [c for c in u.columns if c not in key]
    g = u.groupBy(*key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in cols if c != order])).alias("_b"),
                            F.count(F.lit(1)).alias("n_rows"))
    return g.select(*key, *[F.col(f"_b.{c}").alias(c) for c in cols], "n_rows")


def progression(per_round: DataFrame, key: str = "user_id", round_col: str = "round",
                value: str = "mean_score") -> DataFrame:
    """Value and change per round of every key that has more than one round.

    ``per_round`` holds one row per key and round, so a window spans one key's rounds only."""
    w = Window.partitionBy(key).orderBy(round_col)
    out = per_round.withColumn("n_rounds", F.count(F.lit(1)).over(Window.partitionBy(key))) \
        .withColumn("delta", F.col(value) - F.lag(value).over(w)) \
        .withColumn("delta_from_first", F.col(value) - F.first(value).over(w))
    return out.where("n_rounds > 1")


def complete_rounds(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """P25: rounds with a mean for every metric; the others are dropped."""
    return df.groupBy(*group).agg(*[F.avg(m).alias(m) for m in metrics]).na.drop(subset=list(metrics))


def first_per_user(items: DataFrame, users: int, k: int, order: Sequence[str], key: str = "user_id") -> DataFrame:
    """T5: the first ``k`` items (by ``order``) of each of the first ``users`` users (by id).

    The list of users is as long as asked for and enters as a semi-join; items are cut by a group limit."""
    chosen = items.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(users)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return items.join(chosen, key, "left_semi").withColumn("place", place).where(F.col("place") <= k)


def category_order(df: DataFrame, category: str, value: str) -> DataFrame:
    """Categories with their mean and exact median, and their places by mean (largest first) and by
    median (smallest first); ties and missing values go by name, missing last."""
    g = df.groupBy(category).agg(F.avg(value).alias("mean"))
    g = null_safe_join(g, quantiles(df, [category], value, [0.5]), [category], "left").withColumn("median", F.col("_q")[0]).drop("_q")
    one = g.withColumn("_all", F.lit(0))
    by_mean = ranked(one, ["_all"], [F.col("mean").desc_nulls_last(), F.col(category)], rank="by_mean")
    return ranked(by_mean, ["_all"], [F.col("median").asc_nulls_last(), F.col(category)], rank="by_median").drop("_all")


def initial_vs_peak_complete(df: DataFrame, group: Sequence[str], metrics: Sequence[str], round_col: str = "round") -> DataFrame:
    """W7 + P25: each metric in the group's first round that has all metrics, its peak over such rounds, and
    the improvement.  Groups without such a round have no row."""
    rounds = complete_rounds(df, [*group, round_col], metrics)
    aggs = [F.min(round_col).alias("first_round")]
    for m in metrics:
        aggs += [F.min_by(m, round_col).alias(f"{m}_initial"), F.max(m).alias(f"{m}_peak")]
    g = rounds.groupBy(*group).agg(*aggs)
    return g.withColumns({f"{m}_improvement": F.col(f"{m}_peak") - F.col(f"{m}_initial") for m in metrics})


def valid_reflections(reflections: DataFrame, fields: Sequence[str] = ("reflection_on_results", "improved_persona")) -> DataFrame:
    """Reflections that have both texts; an upsert takes no others."""
    return reflections.dropna(subset=list(fields))


def join_runs(evaluations: DataFrame, runs: DataFrame, key: Sequence[str] = ("user_id", "run_id")) -> DataFrame:
    """Every evaluation with the columns of its run (null where the run is unknown); runs without an
    evaluation are left out.  ``runs`` has one row per key; heavy and null keys are spread."""
    return lookup_join(evaluations, runs, list(key))
