"""Incremental masking and evaluation upserts on Structured Streaming."""

import os

from pyspark.sql import functions as F

from evalframe.operators import mask as M
from evalframe.streaming import incremental as ST

SCHEMA = "user_id string, tweet_id string, full_text string, masked_text string"


def test_mask_stream_skips_already_masked(spark, scratch):
    src, sink, ck = (os.path.join(scratch, d) for d in ("src", "sink", "ck"))
    spark.createDataFrame([("u", "1", "a stupid idea", None), ("u", "2", "fine", "[MASKED]")], SCHEMA) \
        .write.mode("append").parquet(src)
    schema = spark.createDataFrame([], SCHEMA).schema
    q = ST.mask_stream(spark, src, schema, sink, ck, M.lexicon_table(spark))
    q.awaitTermination()
    first = spark.read.parquet(sink).collect()
    assert [(r.tweet_id, r.masked_text) for r in first] == [("1", "a [MASKED] idea")]
    spark.createDataFrame([("u", "1", "a stupid idea", None), ("u", "3", "worst day", None)], SCHEMA) \
        .write.mode("append").parquet(src)
    q = ST.mask_stream(spark, src, schema, sink, ck, M.lexicon_table(spark))
    q.awaitTermination()
    rows = sorted((r.tweet_id, r.masked_text) for r in spark.read.parquet(sink).collect())
    assert rows == [("1", "a [MASKED] idea"), ("3", "[MASKED] day")]


def test_evaluation_upsert_stream_latest_wins(spark, scratch):
    src, table, ck = (os.path.join(scratch, d) for d in ("esrc", "etab", "eck"))
    schema = "user_id string, run_id string, ts long, score double"
    spark.createDataFrame([("u", "r1", 1, 0.1), ("u", "r2", 1, 0.2)], schema).write.mode("append").json(src)
    st = spark.createDataFrame([], schema).schema
    ST.evaluation_upsert_stream(spark, src, st, table, ck).awaitTermination()
    spark.createDataFrame([("u", "r1", 2, 0.9)], schema).write.mode("append").json(src)
    ST.evaluation_upsert_stream(spark, src, st, table, ck).awaitTermination()
    latest = ST.latest_version(spark, table)
    got = {r.run_id: r.score for r in spark.read.parquet(latest).collect()}
    assert got == {"r1": 0.9, "r2": 0.2}


def _forget_last_commit(checkpoint):
    """What a crash between the sink's write and the commit leaves behind."""
    commits = os.path.join(checkpoint, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))


def test_mask_stream_replay_keeps_its_rows(spark, scratch):
    src, sink, ck = (os.path.join(scratch, d) for d in ("src", "sink", "ck"))
    spark.createDataFrame([("u", str(i), "a stupid idea", None) for i in range(3)], SCHEMA).write.parquet(src)
    schema = spark.createDataFrame([], SCHEMA).schema
    for _ in range(2):
        ST.mask_stream(spark, src, schema, sink, ck, M.lexicon_table(spark)).awaitTermination()
        assert spark.read.parquet(sink).count() == 3
        _forget_last_commit(ck)


def test_evaluation_stream_restarts_after_a_crashed_write(spark, scratch):
    src, table, ck = (os.path.join(scratch, d) for d in ("esrc", "etab", "eck"))
    schema = "user_id string, run_id string, ts long, score double"
    spark.createDataFrame([("u", "r1", 1, 0.1)], schema).write.mode("append").json(src)
    st = spark.createDataFrame([], schema).schema
    ST.evaluation_upsert_stream(spark, src, st, table, ck).awaitTermination()
    os.makedirs(os.path.join(table, "version=000000000001", "_temporary", "0"))
    assert ST.latest_version(spark, table).endswith("version=000000000000")
    spark.createDataFrame([("u", "r2", 2, 0.9)], schema).write.mode("append").json(src)
    for _ in range(2):
        ST.evaluation_upsert_stream(spark, src, st, table, ck).awaitTermination()
        got = {r.run_id: r.score for r in spark.read.parquet(ST.latest_version(spark, table)).collect()}
        assert got == {"r1": 0.1, "r2": 0.9}
        _forget_last_commit(ck)


def test_mask_stream_keeps_posts_without_an_id(spark, scratch):
    src, sink, ck = (os.path.join(scratch, d) for d in ("src", "sink", "ck"))
    rows = [("u", None, "a stupid idea", None), ("u", None, "a stupid idea", None), ("u", "1", "x", None), ("u", "1", "x", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(src)
    ST.mask_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, sink, ck, M.lexicon_table(spark)).awaitTermination()
    assert sorted(r.tweet_id or "" for r in spark.read.parquet(sink).collect()) == ["", "", "1"]


def test_evaluation_table_rewrites_only_touched_buckets(spark, scratch):
    src, table, ck = (os.path.join(scratch, d) for d in ("esrc", "etab", "eck"))
    schema = "user_id string, run_id string, ts long, score double"
    st = spark.createDataFrame([], schema).schema
    rows = [(f"u{i}", None if i == 3 else "r", 1, float(i)) for i in range(60)]
    spark.createDataFrame(rows, schema).write.mode("append").json(src)

    def run():
        ST.evaluation_table_stream(spark, src, st, table, ck, buckets=32).awaitTermination()
        return {(r.user_id, r.run_id): r.score for r in ST.read_evaluations(spark, table, st).collect()}

    want = {(u, r): s for u, r, _, s in rows}
    assert run() == want
    spark.createDataFrame([("u5", "r", 2, 99.0), ("new", "r", 1, 7.0), ("u5", "r", 0, 1.0)], schema).write.mode("append").json(src)
    want |= {("u5", "r"): 99.0, ("new", "r"): 7.0}
    assert run() == want
    second = [d for d in os.listdir(os.path.join(table, "data=000000000001")) if d.startswith("bucket=")]
    assert 1 <= len(second) <= 2
    # a batch that crashed before its manifest, and one that is replayed, end in the same table
    _forget_last_commit(ck)
    assert run() == want
    os.makedirs(os.path.join(table, "manifest=000000000002", "_temporary"))
    spark.createDataFrame([("u6", "r", 3, -1.0)], schema).write.mode("append").json(src)
    assert run() == want | {("u6", "r"): -1.0}
