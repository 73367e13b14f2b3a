"""Lookup joins, ranks, quantiles and positions: nulls, ties, and a third of the rows on one key."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.operators import analysis as X
from evalframe.operators.clean import parent_messages
from evalframe.operators.mask import batch_requests, sequential_index
from evalframe.operators.quality import bigram_perplexity
from evalframe.operators.skew import lookup_join, quantiles, range_blocks, ranked


def largest_share(df, *keys):
    """Rows of the fullest partition over those of an even one."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / (sum(n) / df.rdd.getNumPartitions())


@pytest.fixture()
def plain(spark):
    """No broadcast joins and no merging of partitions, so that the shuffle shows."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lookup_join_spreads_heavy_and_null_keys(plain):
    n = 24_000
    left = plain.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None))
                                 .otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"))
    right = plain.range(400).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v")).unionByName(
        plain.createDataFrame([("hot", -1), (None, -2)], "k string, v long"))
    got = lookup_join(left, right, ["k"])
    assert largest_share(got) < 3
    rows = got.collect()
    assert len(rows) == n and all(r.v == (-1 if r.k == "hot" else None if r.k is None or int(r.k[1:]) >= 400 else int(r.k[1:])) for r in rows)
    assert lookup_join(left, right, ["k"], "inner").count() == sum(r.v is not None for r in rows)
    assert lookup_join(left.limit(0), right, ["k"]).count() == 0 and lookup_join(left, right.limit(0), ["k"]).count() == n


def test_parents_of_a_viral_post(plain):
    posts = [(str(i), "u", "2024", f"t{i}", "0" if 0 < i < 4000 else None) for i in range(6000)] + [("x", "u", "2024", None, "5")]
    df = plain.createDataFrame(posts, "tweet_id string, screen_name string, created_at string, full_text string, reply_to_id string")
    got = parent_messages(df)
    assert largest_share(got) < 3
    rows = {r.tweet_id: r.previous_message for r in got.collect()}
    assert len(rows) == len(posts) and rows["7"] == "2024, u: t0" and rows["0"] is None and rows["x"] == "2024, u: t5"


def test_perplexity_of_a_hot_bigram(spark):
    docs = [(i, "the cat " * 3 + f"w{i % 7} end") for i in range(300)] + [(900, None), (901, "one")]
    got = {r.k: r for r in bigram_perplexity(spark.createDataFrame(docs, "k long, text string"), "k", "text").collect()}
    toks = {k: (t or "").split() for k, t in docs}
    bi = collections.Counter(b for t in toks.values() for b in zip(t, t[1:]))
    ctx = collections.Counter(b[0] for t in toks.values() for b in zip(t, t[1:]))
    vocab = len({w for t in toks.values() for w in t})
    for k, t in toks.items():
        pairs = list(zip(t, t[1:]))
        want = np.exp(-np.mean([np.log((bi[b] + 1) / (ctx[b[0]] + vocab)) for b in pairs])) if pairs else None
        assert got[k].n_bigrams == len(pairs) and (got[k].perplexity == pytest.approx(want) if pairs else got[k].perplexity is None)


def test_perplexity_writes_no_row_per_text(spark, monkeypatch):
    written = []
    monkeypatch.setattr("evalframe.operators.quality.cut_lineage", lambda df: written.append(df.columns) or df)
    docs = [(1, "a b a b"), (1, "b a"), (None, "a b"), (2, "lone"), (3, "")]
    got = sorted((r.k or 0, r.n_bigrams, r.perplexity and round(r.perplexity, 9))
                 for r in bigram_perplexity(spark.createDataFrame(docs, "k long, text string"), "k", "text").collect())
    # c(a b) = 3, c(b a) = 2 and 3 words; rows of one key share their sums
    ab, ba = np.log(4 / 6), np.log(3 / 5)
    one = round(float(np.exp(-(2 * ab + 2 * ba) / 4)), 9)
    assert got == [(0, 0, None), (1, 4, one), (1, 4, one), (2, 0, None), (3, 0, None)]
    assert written and all("k" not in columns for columns in written)


def test_lookup_join_with_given_sizes(spark):
    left = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)] + [(None, -1)], "k long, i long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 990)], "k long, v string")
    sizes = left.groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("left", "inner"):
        plain = sorted(map(str, lookup_join(left, right, ["k"], how).collect()))
        assert sorted(map(str, lookup_join(left, right, ["k"], how, sizes=sizes).collect())) == plain


def test_quantiles_equal_numpy(spark):
    rng, rows = np.random.default_rng(1), []
    for g, n in (("a", 1), ("b", 2), ("c", 3000), (None, 501), ("e", 0)):
        rows += [(g, float(v)) for v in rng.choice([rng.standard_normal(n), np.zeros(n)], axis=0, p=[0.5, 0.5])]
    rows += [("e", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0, 0.25, 0.5, 0.9, 0.99, 1]
    got = {r.g: r["_q"] for r in quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == {"a", "b", "c", None, "e"} and got["e"] is None
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], probs))
    alone = quantiles(df, [], "v", [0.5]).collect()
    assert alone[0]["_q"][0] == pytest.approx(np.median([v for _, v in rows if v is not None])) and len(alone) == 1
    assert quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    d = {r.g: r for r in X.describe(df, ["g"], "v").collect()}
    assert d[None].p50 == pytest.approx(got[None][2]) and d["c"].p99 == pytest.approx(got["c"][4]) and d["e"].p25 is None


def test_ranges_spread_a_hot_group(plain):
    df = plain.range(20_000).select(F.lit("only").alias("g"), F.xxhash64("id").alias("v"), "id")
    _, blocks = range_blocks(df, ["g"], ["v"])
    sizes = [r["_n"] for r in blocks.collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / 8


def test_ranks_with_ties_and_nulls(spark):
    rows = [("a", f"u{i}", float(i % 5)) for i in range(60)] + [(None, "x", 1.0), (None, "y", 2.0), ("a", "z", None), ("a", None, 4.0)]
    df = spark.createDataFrame(rows, "g string, user_id string, mean_score double")
    for down in (True, False):
        got = {(r.g, r.user_id): r["rank"] for r in X.rank_users(df, ["g"], descending=down).collect()}
        for g in ("a", None):
            order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0) if down else r[2] or 0, r[1] is not None, r[1] or ""))
            assert [got[g, u] for _, u, _ in order] == list(range(1, len(order) + 1))
    assert {r.n for r in ranked(df, ["g"], ["user_id"], total="n").collect()} == {62, 2}


def test_positions_keep_every_row(spark):
    rows = [("u", 5, "a"), ("u", 2, "b"), (None, 1, "c"), (None, None, "d"), ("u", None, "e"), ("u", None, "f"), ("u", 2_500_000, "g")]
    df = spark.createDataFrame(rows, "user_id string, ingest_pos long, full_text string")
    got = {r.full_text: r.position for r in sequential_index(df, ["user_id"], "ingest_pos").collect()}
    assert {k: got[k] for k in "abgcd"} == {"b": 0, "a": 1, "g": 2, "c": 0, "d": 1} and {got["e"], got["f"]} == {3, 4}
    posts = df.withColumns({"tweet_id": F.col("full_text"), "masked_text": F.lit(None).cast("string")})
    assert batch_requests(posts).count() == len(rows)
