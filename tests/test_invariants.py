"""Invariants the reference's tests assert."""

from pyspark.sql import functions as F

from conftest import SF_MID

from __spark_entry__ import queries
from evalframe.operators import prompts as P
from evalframe.operators import scoring as S
from evalframe.plans import runs as RP
from evalframe.sources import adapters as A

Q = queries()


def test_posts_plus_replies_equal_total(spark):
    rows = Q["eligible_users"](spark, SF_MID).collect()
    assert rows and all(r.replies + r.originals == r.total_posts for r in rows)


def test_run_ids_unique_per_round(spark):
    df = spark.range(1, 51).select(P.round_run_id("run_r50_all_metrics", F.col("id")).alias("run_id"))
    assert df.distinct().count() == 50


def test_backfill_covers_every_item_of_runs_lacking_the_metric(spark):
    lack = RP.presence(spark, SF_MID).where(~F.col("has_bleu")).select("user_id", "run_id")
    items = A.pairs_from_conversations(spark, SF_MID).join(lack, ["user_id", "run_id"], "left_semi")
    out = Q["metric_backfill"](spark, SF_MID)
    assert items.count() == out.count() > 0
    scored = S.score_pairs(items, metrics=["bleu"])
    empty = scored.where((F.col("translation_length") == 0) | (F.col("reference_length") == 0)).count()
    assert out.where(F.col("bleu").isNull()).count() == empty
    assert out.where(F.col("overall_bleu").isNull()).count() == 0


def test_best_and_worst_never_overlap(spark):
    bw = Q["best_worst"](spark, SF_MID)
    both = bw.groupBy("user_id", "run_id", "index").agg(F.countDistinct("list").alias("k")).where("k > 1")
    assert both.count() == 0


def test_split_sets_are_disjoint_and_sized(spark):
    sp = Q["history_holdout_split"](spark, SF_MID)
    assert sp.groupBy("user_id", "tweet_id").count().where("count > 1").count() == 0
    sizes = {(r.user_id, r["set"]): r["count"] for r in sp.groupBy("user_id", "set").count().collect()}
    assert sizes and len(set(sizes.values())) == 1


def test_describe_is_exact(spark):
    """The quartiles by ranges equal those of all values gathered."""
    from evalframe.operators import analysis as X
    r = A.results_from_events(spark, SF_MID)
    exact = {x.condition: x.q for x in r.groupBy("condition").agg(F.percentile("score", [0.25, 0.5, 0.75, 0.99]).alias("q")).collect()}
    got = {x.condition: [x.p25, x.p50, x.p75, x.p99] for x in X.describe(r, ["condition"], "score").collect()}
    assert got.keys() == exact.keys()
    for c, q in exact.items():
        assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(got[c], q))



def test_cut_lineage_checkpoints_into_the_session_dir(spark):
    from evalframe.session import cut_lineage
    df = spark.range(0, 100).withColumn("x", F.col("id") * 2)
    c = cut_lineage(df)
    assert c.count() == 100
    assert "LogicalRDD" in c._jdf.queryExecution().logical().toString()
    assert spark.conf.get("spark.checkpoint.dir")
