"""Joins, ranks and quantiles that one heavy key, group or value does not slow down.

* ``lookup_join``: heavy keys are found by a partial aggregate and salted on both sides; the
  values of the looked-up side are copied once per salt and never broadcast;
* ``range_blocks`` / ``ranked``: places of rows in their group from counts per sorted range;
* ``quantiles``: exact order statistics by narrowing the range that holds the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.session import cut_lineage


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                spread: Sequence[str] | None = None, min_rows: int = 16, sizes: DataFrame | None = None) -> DataFrame:
    """``left`` joined on ``keys`` with ``right``, which has at most one row per key.

    Keys of more rows than an even partition holds (the total over the number of shuffle
    partitions, so there are fewer of them than partitions) are dealt over as many salts as
    they fill partitions; the one row of ``right`` is copied for each salt.  Only the list of
    these keys' hashes is broadcast: at most 16 bytes a shuffle partition.  Rows with a null
    key match nothing and are spread over all partitions.  Salts come from the hash of
    ``spread`` (all columns of ``left`` if not given), so a repeated task deals alike.  A caller
    that already has the rows per key passes them as ``sizes`` (``keys`` and ``n``), which saves
    the pass over ``left`` that counts them.
    """
    keys, parts = list(keys), _parts(left)
    on = F.xxhash64(*keys)
    if sizes is None:
        counts = left.dropna(subset=keys).select(on.alias("__k")).groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    else:
        counts = sizes.dropna(subset=keys).select(on.alias("__k"), F.col("n").alias("__n"))
    even = F.greatest(F.lit(float(min_rows)), F.coalesce(counts.agg(F.sum("__n") / F.lit(parts)).scalar(), F.lit(0.0)))
    heavy = counts.where(F.col("__n") > even)
    if sizes is not None:  # different keys of one hash share its salts
        heavy = heavy.groupBy("__k").agg(F.max("__n").alias("__n"))
    heavy = F.broadcast(heavy.select("__k", F.ceil(F.col("__n") / even).alias("__c")))
    row = F.xxhash64(F.lit("salt"), *(spread or left.columns))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    dealt = (left.withColumn("__k", on).join(heavy, "__k", "left")
             .withColumn("__salt", F.when(no_key, F.pmod(row, F.lit(parts)))
                         .otherwise(F.pmod(row, F.coalesce("__c", F.lit(1)))).cast("long")).drop("__k", "__c"))
    copies = (right.withColumn("__k", on).join(heavy, "__k", "left")
              .withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__c"), F.lit(1)).cast("long") - 1)))
              .drop("__k", "__c"))
    return dealt.join(copies.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def range_blocks(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                 keep=cut_lineage, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` cut into ranges of (group, order), and the size of each group's part of a range.

    Returns (rows with ``_p``, the number of their range; blocks of (group, _p, _n, _off,
    _total): rows of the group in the range, in the ranges before it, and in all; a row counts
    ``weight`` if that is given).  The rows
    are written once (``keep``), as ranges are drawn from a sample.  A group of any size is
    spread over ranges; only rows equal in all of ``group`` and ``order`` stay together.
    """
    group = list(group)
    rows = keep(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy(*group, "_p").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .withColumn("_total", F.sum("_n").over(whole)))
    return rows, blocks


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys are those of ``left``."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: "__" + k for k in keys})
    return left.join(other, _renamed(keys), how).drop(*["__" + k for k in keys])


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], rank: str = "rank",
           total: str | None = None, keep=cut_lineage) -> DataFrame:
    """``df`` with each row's 1-based place in its group by ``order`` (and the group's size as
    ``total``).  No task sorts more than one range of a group; null group values are a group."""
    group = list(group)
    rows, blocks = range_blocks(df, group, order, keep)
    both = rows.join(blocks.withColumnsRenamed({c: "__" + c for c in [*group, "_p"]}).hint("merge"),
                     _renamed(group + ["_p"]))
    place = F.row_number().over(Window.partitionBy("_p", *group).orderBy(*order)) + F.col("_off")
    out = both.withColumn(rank, place.cast("long"))
    return out.select(*df.columns, rank, *([F.col("_total").alias(total)] if total else []))


def _renamed(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("__" + k))
    return cond


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], name: str = "_q") -> DataFrame:
    """Exact quantiles of ``value`` per group with linear interpolation, as array ``name`` in the
    order of ``probs`` (null where a group has no value; nulls in ``value`` are left out).

    Equal values are counted before anything is sorted, so a value that many rows share is one
    row.  Counts per range of (group, value) tell which ranges hold the wanted ranks; only these
    are put in order.  A group is spread over ranges, and no task keeps all its values."""
    group = list(group) or ["__all"]
    base = df.withColumn("__all", F.lit(0)) if group == ["__all"] else df
    v = F.col(value).cast("double")
    counted = base.select(*group, v.alias("_v")).where("_v is not null").groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    rows, blocks = range_blocks(counted, group, ["_v"], weight="_c")
    last = F.col("_total") - 1
    ranks = F.array_distinct(F.array(*[f((F.lit(float(p)) * last)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    wanted = F.filter(ranks, lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_n")))
    blocks = blocks.withColumn("_want", wanted).where(F.size("_want") > 0)
    found = null_safe_join(rows, blocks.select(*group, "_p", "_off", "_total", "_want"), [*group, "_p"])
    upto = Window.partitionBy("_p", *group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_off") + F.sum("_c").over(upto)
    hit = found.withColumn("_end", end).withColumn("_hits", F.filter("_want", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c"))))
    hit = hit.select(*group, "_total", "_v", F.explode("_hits").alias("_r"))
    at = hit.groupBy(*group).agg(F.max("_total").alias("_total"),  # at most two entries for each of ``probs``
                                 F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))
    out = []
    for p in probs:
        place = F.lit(float(p)) * last
        lo, hi = (F.try_element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        out.append(lo + F.when(hi == lo, F.lit(0.0)).otherwise((hi - lo) * (place - F.floor(place))))
    at = at.select(*group, F.array(*out).alias(name))
    groups = base.select(*group).distinct()
    return null_safe_join(groups, at, group, "left").drop("__all")
