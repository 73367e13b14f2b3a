"""Incremental jobs on Structured Streaming.

The reference has no streaming operators; its incremental behaviours --
"mask only posts that are not masked yet" and "replace an evaluation when
its run id comes again" -- map onto ``foreachBatch`` micro-batches that reuse
the batch operators.  Each micro-batch writes to a directory named by its
batch id with ``overwrite`` and reads only folders of earlier batches that were
written to the end, so a replay after a failure rewrites the same output
(exactly-once with the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evalframe.operators import analysis as X
from evalframe.operators import mask as M


def _committed(spark: SparkSession, path: str, prefix: str, below: int | None = None) -> list[str]:
    """Folders ``<prefix><number>`` under ``path`` that were written to the end (``_SUCCESS``),
    in ascending order, with a number under ``below`` (listing only, no data read)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = []
    for s in fs.listStatus(p):
        name, own = s.getPath().getName(), s.getPath()
        if (name.startswith(prefix) and (below is None or int(name[len(prefix):]) < below)
                and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS"))):
            found.append((int(name[len(prefix):]), f"{path}/{name}"))
    return [f for _, f in sorted(found)]


def mask_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                checkpoint_dir: str, lexicon: DataFrame, fmt: str = "parquet",
                trigger_once: bool = True) -> StreamingQuery:
    """K4 + P23 as a stream: new post files are masked with the rules (K1); posts whose
    tweet id came before are skipped.

    The ids seen are keyed state of the stream (``dropDuplicates``): a batch looks up its own ids
    only and reads none of the earlier output.  A replayed batch starts from the state before it,
    so it keeps its rows.  Posts without an id are all masked."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    todo = stream.where(F.col("masked_text").isNull()) if "masked_text" in stream.columns else stream
    todo = todo.where(F.col("tweet_id").isNotNull()).dropDuplicates(["tweet_id"]).union(todo.where(F.col("tweet_id").isNull()))

    def batch(df: DataFrame, batch_id: int) -> None:
        out = M.attach_lexicon(df, lexicon).select(
            "user_id", "tweet_id", M.deterministic_mask(F.col("full_text")).alias("masked_text"))
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    w = todo.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def evaluation_upsert_stream(spark: SparkSession, source_dir: str, schema: StructType, table_dir: str,
                             checkpoint_dir: str, key=("user_id", "run_id"), order=("ts",),
                             fmt: str = "json", trigger_once: bool = True) -> StreamingQuery:
    """S15 as a stream: each micro-batch of evaluations replaces the rows
    with the same key (latest wins) and is written as a new version of the
    table (``version=<batch id>``); readers take the highest version."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def batch(df: DataFrame, batch_id: int) -> None:
        # the last whole version before this batch; a crashed write leaves none
        prev = latest_version(spark, table_dir, below=batch_id)
        current = spark.read.parquet(prev) if prev else df.limit(0)
        merged = X.upsert_latest(current.select(*df.columns), df, list(key), list(order))
        merged.write.mode("overwrite").parquet(f"{table_dir}/version={batch_id:012d}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def latest_version(spark: SparkSession, table_dir: str, below: int | None = None) -> str | None:
    """Path of the newest ``version=...`` folder that was written to the end."""
    found = _committed(spark, table_dir, "version=", below)
    return found[-1] if found else None


def evaluation_table_stream(spark: SparkSession, source_dir: str, schema: StructType, table_dir: str,
                            checkpoint_dir: str, key=("user_id", "run_id"), order=("ts",), buckets: int = 256,
                            fmt: str = "json", trigger_once: bool = True) -> StreamingQuery:
    """S15 for large tables: the table is cut into ``buckets`` by the hash of the key, and a batch
    reads and rewrites only those that its keys fall into.

    A batch writes its buckets under ``data=<batch id>`` and then, as its commit, a manifest of at most
    ``buckets`` rows (bucket, folder with its rows).  A crashed batch leaves no manifest; a replayed one
    starts from the manifest before it."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def batch(df: DataFrame, batch_id: int) -> None:
        new = df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # small numbers, at most `buckets`
        if not touched:
            new.unpersist()
            return
        before = _manifest(spark, table_dir, below=batch_id)
        own = f"data={batch_id:012d}"
        old = [f"{table_dir}/{folder}/bucket={k}" for k, folder in before.items() if k in touched]
        current = spark.read.schema(df.schema).parquet(*old) if old else df.limit(0)
        merged = X.upsert_latest(current.select(*df.columns), new.select(*df.columns), list(key), list(order))
        merged = merged.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_dir}/{own}")
        after = before | {k: own for k in touched}
        spark.createDataFrame(sorted(after.items()), "bucket int, folder string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{table_dir}/manifest={batch_id:012d}")
        new.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def _manifest(spark: SparkSession, table_dir: str, below: int | None = None) -> dict[int, str]:
    """The folder of each bucket in the last manifest that was written to the end."""
    found = _committed(spark, table_dir, "manifest=", below)
    return {r.bucket: r.folder for r in spark.read.parquet(found[-1]).collect()} if found else {}


def read_evaluations(spark: SparkSession, table_dir: str, schema: StructType) -> DataFrame:
    """The current rows of a table kept by ``evaluation_table_stream``."""
    folders = [f"{table_dir}/{folder}/bucket={k}" for k, folder in _manifest(spark, table_dir).items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
