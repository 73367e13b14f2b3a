"""The reference's test cases (FIXTURES.md section 3) rebuilt on the engine."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL

from evalframe.operators import analysis as X
from evalframe.operators import clean as C
from evalframe.operators import mask as M
from evalframe.operators import quality as Q
from evalframe.operators import scoring as S
from evalframe.plans import cleaning as CL
from evalframe.sources import files as IO


def test_three_pairs_best_and_worst_disjoint(spark):
    pairs = spark.createDataFrame([
        ("u", "r", 0, "t1", "the cat sat on the mat", "the cat sat on the mat"),
        ("u", "r", 1, "t1", "a dog ran", "the cat sat on the mat"),
        ("u", "r", 2, "t1", "the cat sat", "the cat sat on the mat"),
    ], "user_id string, run_id string, index int, tweet_id string, prediction string, reference string")
    bw = S.best_worst(S.combined_score(S.score_pairs(pairs))).collect()
    best = {r["index"] for r in bw if r.list == "best"}
    worst = {r["index"] for r in bw if r.list == "worst"}
    assert best == {0} and worst == {1} and not best & worst


def test_upsert_is_idempotent_per_key(spark):
    base = spark.createDataFrame([("u", "r1", 1, 0.1), ("u", "r2", 1, 0.2)],
                                 "user_id string, run_id string, ts int, score double")
    upd = spark.createDataFrame([("u", "r1", 2, 0.9), ("u", "r3", 2, 0.3)],
                                "user_id string, run_id string, ts int, score double")
    once = X.upsert_latest(base, upd, ["user_id", "run_id"], ["ts"])
    twice = X.upsert_latest(once, upd, ["user_id", "run_id"], ["ts"])
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    assert dict(((r.run_id, r.score) for r in once.collect())) == {"r1": 0.9, "r2": 0.2, "r3": 0.3}


def test_same_seed_same_split_and_sample(spark):
    a = CL.conv_split(spark, SF_MID).select("user_id", "set", "tweet_id").collect()
    b = CL.conv_split(spark, SF_MID).select("user_id", "set", "tweet_id").collect()
    assert sorted(a) == sorted(b) and len(a) > 0
    cleaned = CL.conv_cleaned(spark, SF_MID)
    c = C.split_history_holdout(cleaned, CL.POSTS_PER_SET, CL.REPLIES_PER_SET, seed=7).select(
        "user_id", "set", "tweet_id").collect()
    assert sorted(a) != sorted(c)


def test_split_composition(spark):
    sp = CL.conv_split(spark, SF_MID).groupBy("user_id", "set").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_reply").alias("r")).collect()
    assert sp and all(r.n == CL.POSTS_PER_SET and r.r == CL.REPLIES_PER_SET for r in sp)


def test_identical_stimuli_across_conditions(spark):
    q = CL.stimuli_by_condition(spark, SF_MID)
    lists = q.groupBy("user_id", "condition").agg(F.sort_array(F.collect_list("tweet_id")).alias("ids"))
    per_user = lists.groupBy("user_id").agg(F.countDistinct("ids").alias("d"), F.count(F.lit(1)).alias("c"))
    rows = per_user.collect()
    assert rows and all(r.d == 1 and r.c == 4 for r in rows)


def _write_user_file(path):
    lines = [
        {"user_id": "42", "set": "history", "tweets": [
            {"tweet_id": "1", "full_text": "History post one", "screen_name": "alice",
             "created_at": "2023-08-10 12:00:00+00:00", "reply_to_id": None},
            {"tweet_id": "2", "full_text": "History reply", "screen_name": "alice",
             "created_at": "2023-08-10 13:00:00+00:00", "reply_to_id": "99", "previous_message": "hi"}]},
        {"user_id": "42", "set": "holdout", "tweets": [
            {"tweet_id": "3", "full_text": "Holdout tweet 1", "screen_name": "alice", "reply_to_id": "nan"},
            {"tweet_id": "4", "full_text": "Holdout reply", "screen_name": "alice", "reply_to_id": "98",
             "previous_message": "yo"}]},
        {"user_id": "42", "runs": [{"run_id": "run_round_1", "persona": "Initial persona",
                                    "imitations": [{"tweet_id": "3", "stimulus": "Post: x", "imitation": "Imit"}]}]},
        {"user_id": "42", "evaluations": [{"run_id": "run_round_1", "timestamp": "2024-01-01T00:00:00",
                                           "evaluation_results": {"overall": {"total_samples": 1},
                                                                  "individual_scores": [
                                                                      {"index": 0, "prediction": "Imit",
                                                                       "reference": "Holdout tweet 1",
                                                                       "combined_score": 0.5, "tweet_id": "3"}]}}]},
        {"reflections": [{"run_id": "run_round_1", "iteration": 1,
                          "reflection_results": {"reflection_on_results": "ok",
                                                 "improved_persona": "Improved persona"}}]},
    ]
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps(x) for x in lines) + "\n")


def test_user_file_loader(spark, scratch):
    _write_user_file(os.path.join(scratch, "u42.jsonl"))
    t = IO.read_user_files(spark, scratch)
    posts = t["posts"].collect()
    assert len(posts) == 4
    assert {p.set for p in posts} == {"history", "holdout"}
    assert [p.reply_to_id for p in posts if p.tweet_id == "3"] == [None]       # 'nan' -> NULL
    im = t["imitations"].join(t["posts"].where("set = 'holdout'").select("user_id", "tweet_id", "full_text"),
                              ["user_id", "tweet_id"], "left").collect()
    assert im[0].full_text == "Holdout tweet 1"
    refl = t["reflections"].withColumn("pos", F.lit(0))
    lp = X.latest_persona(refl, ["user_id", "run_id"]).collect()
    assert lp[0].user_id == "42" and lp[0].persona == "Improved persona"
    assert t["item_scores"].count() == 1 and t["evaluations"].count() == 1


def test_posts_csv_reader_drops_malformed(spark, scratch):
    p = os.path.join(scratch, "posts.csv")
    with open(p, "w") as fh:
        fh.write("tweet_id,original_user_id,reply_to_id,screen_name,created_at,collected_at,expandedURL,"
                 "full_text,retweeted_user_ID\n")
        fh.write('1.1782932009073132e+18,7,nan,a,2023-08-09 22:59:56+00:00,x,,"hello, world",\n')
        fh.write('2,7,1,a,2023-08-09 23:00:00+00:00,x,,"multi\nline",\n')
    df = IO.read_posts_csv(spark, p)
    rows = df.collect()
    assert rows[0].tweet_id == "1.1782932009073132e+18"
    assert len(rows) == 2 and rows[1].full_text == "multi\nline"


def test_aggregate_csv_to_long(spark, scratch):
    p = os.path.join(scratch, "agg.csv")
    with open(p, "w") as fh:
        fh.write(",posts_content_accuracy,posts_content_accuracy,posts_content_accuracy\n")
        fh.write(",mean,std,count\nround,,,\n1,0.5,0.1,3\n2,0.7,,1\n")
    out = IO.read_aggregate_csv(spark, p, tag="rouge").collect()
    assert len(out) == 6
    assert {(r.round, r.statistic, r.value) for r in out if r.statistic == "mean"} == {("1", "mean", 0.5),
                                                                                       ("2", "mean", 0.7)}


def test_deterministic_mask_rules(spark):
    lex = M.lexicon_table(spark)
    df = spark.createDataFrame([("You are a STUPID clown!",), ("https://x.y/z",), ("",), (None,),
                                ("plain words here",)], "t string")
    out = [r.m for r in M.attach_lexicon(df, lex).select(M.deterministic_mask(F.col("t")).alias("m")).collect()]
    assert out == ["You are a [MASKED] [MASKED] !", "[MASKED]", "[MASKED]", "[MASKED]", "plain words here"]


def test_union_mask_failsafe(spark):
    lex = M.lexicon_table(spark)
    df = spark.createDataFrame([("nice day today .", "nice [MASKED] today ."),
                                ("nice day today .", "too many tokens here now"),
                                ("a stupid day", None)], "t string, m string")
    out = [r.x for r in M.attach_lexicon(df, lex).select(M.union_mask(F.col("t"), F.col("m")).alias("x")).collect()]
    assert out == ["nice [MASKED] today .", "nice day [MASKED] .", "a [MASKED] day"]


def test_sequential_index_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5003).alias("o"))
    got = M.sequential_index(df, ["g"], "o", bucket=97).select("g", "o", "position")
    from pyspark.sql import Window
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert sorted(got.collect()) == sorted(want.collect())


def test_edge_cases_under_ansi_mode(spark):
    from evalframe.operators import quality as Q
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        pairs = spark.createDataFrame([
            ("u", "r", 0, "t", "", "some reference"), ("u", "r", 1, "t", "a prediction", ""),
            ("u", "r", 2, "t", "", ""), ("u", "r", 3, "t", None, "x y"),
        ], "user_id string, run_id string, index int, tweet_id string, prediction string, reference string")
        sc = S.combined_score(S.score_pairs(pairs))
        rows = {r["index"]: r for r in sc.collect()}
        assert all(rows[i].bleu is None for i in range(4))
        assert all(rows[i].rouge1 == 0.0 and rows[i].rougeL == 0.0 for i in range(4))
        assert S.bleu_corpus(sc).count() == 1
        one = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0)], "round int, score double")
        k = Q.kde_grid(one, ["round"], "score", 4).collect()
        assert len(k) == 8
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_bleu_layouts_are_read_alike(spark, scratch):
    import json
    import os

    from evalframe.sources import files as IO
    items = [{"index": i, "bleu": b} for i, b in enumerate(
        [{"bleu": 0.25, "precisions": [0.5, 0.25], "translation_length": 4}, {"score": 0.7}, 0.5, None])]
    lines = [{"user_id": "u", "set": "history", "tweets": []},
             {"evaluations": [{"run_id": "r", "evaluation_results": {"overall": {"bleu": 0.4}, "individual_scores": items}}]}]
    with open(os.path.join(scratch, "u.jsonl"), "w") as f:
        f.write("\n".join(map(json.dumps, lines)))
    got = IO.read_user_files(spark, scratch)
    rows = {r["index"]: r.bleu for r in got["item_scores"].collect()}
    assert [rows[i].bleu if rows[i] else None for i in range(4)] == [0.25, 0.7, 0.5, None]
    assert rows[0].precisions == [0.5, 0.25] and rows[0].translation_length == 4
    assert got["evaluations"].first().overall.bleu.bleu == 0.4


def test_union_mask_tokenises_a_text_once(spark):
    df = spark.createDataFrame([("so bad, really", "so bad , [MASKED]"), ("it is", "it is"), ("a - !", None), ("-", "x y")], "t string, m string")
    lex = M.lexicon_table(spark, ["BAD"])
    masked = M.attach_lexicon(df, lex).select(M.union_mask(F.col("t"), F.col("m")).alias("x"))
    assert masked._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.x for r in masked.collect()] == ["so [MASKED] , [MASKED]", "it [MASKED]", "[MASKED] - !", "[MASKED]"]


def test_persona_evolution_shuffles_no_row_per_token(spark):
    rows = [("s", 0, "a b"), ("s", 1, "b c c"), ("s", 2, None), ("s", 3, ""), (None, 0, "a"), (None, 1, "a")]
    out = Q.persona_evolution(spark.createDataFrame(rows, "k string, r long, t string"), "k", "r", "t")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.r): tuple(r)[2:] for r in out.collect()}
    assert got == {("s", 0): (2, 2, None, None), ("s", 1): (3, 2, 1, 1 / 3), ("s", 2): (0, 0, -3, 0.0), ("s", 3): (0, 0, 0, 0.0),
                   (None, 0): (1, 1, None, None), (None, 1): (1, 1, None, None)}
