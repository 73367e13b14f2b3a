"""Operator 8 [native]: two-pass external shuffle into shards.

Pass one scatters the rows, by seeded hashes, into buckets of about ``bucket_bytes``, as many
in a shard as its own bytes ask for, so a shard that one id fills has more of them; pass two
shuffles each bucket by Fisher-Yates (Spark's ``shuffle`` of an array) and writes it.
The shard of a row follows the ``key`` law: highest random weight hashing of its id, so
that one more shard takes rows only into itself.  Inside a shard a second seeded hash of
id, text and scan position picks the bucket, so buckets are even whatever the texts are,
and copies or rows without id do not meet in one.

The files are a Parquet table (shard, bucket, place, row); ``read_shards`` adds the slot of
each row in its shard.  A lost executor repeats its buckets; a bucket is committed once.
The shard of a row is reproducible; its bucket and place depend on how the input is partitioned.

Defined results: null ids are one key and share a shard; null texts count no bytes; rows
repeated in full are separate rows; other columns travel inside ``row``, whatever they are
called; an empty table gives empty files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.shared import shared_path

SHARDS = 16
BUCKET_BYTES = 32 << 20
SEED = 20240229


def key_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of a key: the one whose seeded hash with the key is greatest."""
    weights = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*weights) if shards > 1 else weights[0])["s"]


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES,
                 seed: int = SEED) -> None:
    shard = key_shard(F.col("doc_id"), shards, seed).alias("shard")
    sizes = docs.groupBy(shard).agg(F.sum(row_size(F.col("text"))).alias("bytes")).collect()  # one row a shard
    buckets = dict.fromkeys(range(shards), 1) | {r["shard"]: max(1, -(-r["bytes"] // bucket_bytes)) for r in sizes}
    of_shard = F.element_at(F.array(*[F.lit(buckets[s]).cast("long") for s in range(shards)]), F.col("shard") + 1)
    mixed = F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(seed + 1))
    scattered = docs.select(shard, mixed.alias("mixed"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drawn = (scattered.groupBy("shard", F.pmod("mixed", of_shard).alias("bucket")).agg(F.collect_list("row").alias("rows"))
             .select("shard", "bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))
             .select("shard", "bucket", F.col("place").cast("long").alias("place"), "row"))
    drawn.write.parquet(path)


def read_shards(spark, path: str, *columns: Column) -> DataFrame:
    """``columns`` (default: the whole rows) of the shard files, with ``shard`` and ``slot``."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("bucket")
    before = sizes.select("shard", "bucket", (F.sum("n").over(order) - F.col("n")).alias("before"))
    narrow = files.select("shard", "bucket", "place", *(columns or [F.col("row")]))
    return (narrow.join(before, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("place"))
            .drop("bucket", "place", "before"))


def shard_documents(docs: DataFrame, *columns: Column, path: str | None = None, shards: int = SHARDS,
                    bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Write the shards (to the shared folder unless ``path`` is given) and read them back."""
    path = path or shared_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, bucket_bytes, seed)
    return read_shards(docs.sparkSession, path, *columns)
