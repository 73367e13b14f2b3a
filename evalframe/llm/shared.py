"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.session import ensure_checkpoint_dir

CHUNK_BYTES = 1_000_000  # numpy takes some 40 times that for a moment


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage reliably: a lost executor costs its running tasks only, and
    every later reader sees the same rows.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) pieces of an Arrow batch, each of about ``limit``
    bytes (a longer text makes a chunk of its own); null reads as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    first, size, out = 0, 0, []
    for i, v in enumerate(col):
        b = v.as_py() or b""
        if out and size + len(b) > limit:
            yield first, out
            first, size, out = i, 0, []
        out.append(b)
        size += len(b)
    if out:
        yield first, out


_kept: dict = {}


def kept(key, make: Callable):
    """What a Python worker keeps from task to task under ``key``, made when it is not there."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what tasks of other operators have left in this Python worker: Spark uses its
    workers again, so one stage's store would lie beside the next stage's arrays."""
    _kept.clear()


def connected_components(links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over ``links(a, b)``.

    Alternating large-star / small-star steps (each a min aggregate, so a hub with
    very many neighbours is pre-aggregated and never gathered), written to the
    shared folder after each round until the edge set stops changing.  Nodes
    without a link are not listed.
    """
    edges = shared_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .where("u > v").distinct(), name)

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    while seen[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = shared_table(large.distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = shared_table(small, name)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    comp = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return comp.select(F.col("u").alias("node"), "component").unionByName(
        roots.join(comp.select(F.col("u").alias("node")), "node", "left_anti"))
