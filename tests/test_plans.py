"""Plan shape: no cartesian products, group limits for top-k, pruned scans, skew."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from evalframe.plans import queries
from evalframe.operators import clean as C

QUERIES = queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["history_holdout_split", "best_worst", "top_bottom", "stimulus_sample"])
def test_topk_windows_are_group_limited(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_read_only_used_columns(spark):
    plan = _plan(QUERIES["condition_describe"](spark, SF_SMALL))
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "props" not in scan and "value" in scan


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_split_with_a_hot_user_matches_brute_force(spark):
    rows = []
    for i in range(3000):                      # one user with a third of all posts
        rows.append(("hot", f"h{i}", "x y z", f"h{i - 1}" if i % 3 else None))
    for u in range(100):
        for i in range(60):
            rows.append((f"u{u}", f"u{u}_{i}", "a b c", f"u{u}_{i - 1}" if i % 2 else None))
    df = spark.createDataFrame(rows, "user_id string, tweet_id string, full_text string, reply_to_id string")
    got = C.split_history_holdout(df, posts_per_set=20, replies_per_set=10) \
        .select("user_id", "set", "tweet_id").toPandas()
    pdf = pd.DataFrame(rows, columns=["user_id", "tweet_id", "full_text", "reply_to_id"])
    want = []
    for u, g in pdf.groupby("user_id"):
        rep = g[g.reply_to_id.notna()].copy()
        org = g[g.reply_to_id.isna()].copy()
        if len(rep) < 20 or len(org) < 20 or len(g) < 40:
            continue
        for part, n in ((rep, 10), (org, 10)):
            part["k"] = [_md5("42|" + t) for t in part.tweet_id]
            part = part.sort_values(["k", "tweet_id"])
            want += [(u, "holdout", t) for t in part.tweet_id.iloc[:n]]
            want += [(u, "history", t) for t in part.tweet_id.iloc[n:2 * n]]
    assert sorted(map(tuple, got.values.tolist())) == sorted(want)


def test_dedupe_with_a_hot_key_keeps_first(spark):
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
        F.col("id").alias("ingest_pos"), (F.col("id") * 2).alias("payload"))
    out = C.dedupe_keep_first(df, "key", count_col="copies")
    hot = out.where("key = 'hot'").collect()[0]
    assert hot.ingest_pos == 0 and hot.payload == 0 and hot.copies == 10000
    assert out.count() == 20001
