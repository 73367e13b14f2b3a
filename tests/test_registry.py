"""Metrics by name, stored evaluations and the reflections that follow them."""

import json

import pytest
from pyspark.sql import functions as F

from evalframe.operators import mask as M
from evalframe.operators import runs as R
from evalframe.operators import scoring as S


def test_plugged_metric(spark):
    df = spark.createDataFrame([("u", "r", 1, "a b", "a b"), ("u", None, 2, None, "x")], "user_id string, run_id string, index int, prediction string, reference string")
    S.register_metric("test_len", lambda p, key: p.select(*key, F.length("prediction").alias("test_len")))
    try:
        got = {r["index"]: r for r in S.evaluate(df, ["test_len", "rouge_lsum"]).collect()}
        assert got[1].test_len == 3 and got[1].rougeLsum == 1.0 and got[2].test_len is None and len(got) == 2
        assert S.evaluate(df, []).columns == ["user_id", "run_id", "index"]
        with pytest.raises(ValueError):
            S.register_metric("bleu", None)
        with pytest.raises(ValueError):
            S.evaluate(df, ["no_such_metric"])
    finally:
        del S.REGISTRY["test_len"]


CASES = [({"overall": {"rouge": {"rouge1": 0.1}, "bleu": {}}}, "rouge"),
         ({"overall": {"rouge": {}, "bleu": {"bleu": 0}, "perplexity": None}}, "bleu,perplexity"),
         ({"overall": {}, "individual_scores": [{"bertscore": None, "rouge": {"rouge1": 0}}]}, "bertscore,rouge"),
         ({"overall": {"bleu": 0.0, "rouge": None}}, ""), ({"overall": None}, ""), ({}, ""), ({"individual_scores": []}, ""),
         ({"overall": {"rouge": 0.2, "bleu": [1], "perplexity": 1, "bertscore": {}}}, "bertscore,bleu,perplexity,rouge")]


def test_detection_looks_into_the_object(spark):
    rows = [("u", "run_r50_all_metrics", i, json.dumps(e)) for i, (e, _) in enumerate(CASES)]
    rows += [("u", "run_r50_all_metrics", 90, None), ("u", "run_r50_all_metrics", 91, "{broken")]
    df = spark.createDataFrame(rows, "user_id string, run_id string, i int, evaluation string")
    flags = R.detected_metrics(F.col("evaluation"))
    got = {r.i: r.m for r in df.select("i", F.array_join(R.metric_set(flags), ",").alias("m")).collect()}
    assert got == {i: m for i, (_, m) in enumerate(CASES)} | {90: "", 91: ""}


def test_layouts(spark):
    cases = [({"bleu": 0.5, "rouge_1": {"score": 0.25}, "rouge": {"rouge2": 0.125, "rougeL": 0.0625}}, (0.5, 0.25, 0.125, 0.0625)),
             ({"bleu": {"bleu": 0.5}, "rouge_1": "0.25", "rouge_2": None}, (0.5, 0.25, 0.0, 0.0)), ({"bleu": {"score": 0.75}}, (0.75, 0, 0, 0)), ({}, (0, 0, 0, 0))]
    df = spark.createDataFrame([(i, json.dumps({"overall": o})) for i, (o, _) in enumerate(cases)], "u int, evaluation string")
    for r in R.user_score_means(df, ["u"]).collect():
        assert (r.bleu, r.rouge_1, r.rouge_2, r.rouge_l) == cases[r.u][1] and r.combined == pytest.approx(sum(cases[r.u][1]) / 4)


def test_reflections_follow_their_own_run(spark):
    corrections = spark.createDataFrame([("u", "run_a", "run_b"), ("v", "run_a", "run_a")], "user_id string, run_id string, corrected_run_id string")
    refl = spark.createDataFrame([("u", "run_a", 1), ("v", "run_a", 2), ("u", "other", 3), (None, "run_a", 4), ("u", None, 5)],
                                 "user_id string, run_id string, iteration int")
    got = {r.iteration: (r.run_id, r.original_run_id) for r in R.move_reflections(refl, corrections).collect()}
    assert got == {1: ("run_b", "run_a"), 2: ("run_a", "run_a"), 3: ("other", "other"), 4: ("run_a", "run_a"), 5: (None, None)}


def test_small_users_go_to_the_rules(spark):
    posts = spark.createDataFrame([("a", str(i), None) for i in range(12)] + [("b", "x", None), (None, "y", None), ("a", "z", "done"), ("", "w", None)],
                                  "user_id string, tweet_id string, masked_text string")
    got = {r.tweet_id: (r.route, r.todo_texts) for r in M.route_texts(posts).collect()}
    assert got["3"] == ("batch", 12) and got["x"] == got["y"] == got["w"] == ("rules", 1) and "z" not in got and len(got) == 15


def test_list_mask_keeps_the_order(spark):
    texts = spark.createDataFrame([(i, None if i == 4 else f"a stupid idea {i}") for i in range(40)], "i int, t string").repartition(4)
    got = M.mask_in_order(texts, ["i"], "t", M.lexicon_table(spark)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(40)) and got[7].masked_text == "a [MASKED] idea 7" and got[4].masked_text == "[MASKED]"


def test_every_status(spark):
    good, bare = json.dumps({"overall": {"bertscore": 1}}), json.dumps({"overall": {"bleu": 1}})
    ev = spark.createDataFrame([("a", "p_1", good), ("b", "p_1", bare), ("c", "q", good), ("d", "p_2", "{broken"), ("d", "p_1", good), (None, "p", good),
                                ("e", None, good)], "user_id string, run_id string, evaluation string")
    users = spark.createDataFrame([(u,) for u in ("a", "a", "b", "c", "d", "e", "z")], "user_id string")
    got = {r.user_id: r.status for r in R.coverage_status(users, ev, "p_").collect()}
    assert got == {"a": "success", "b": "no_bertscore", "c": "no_matching_runs", "d": "error", "e": "no_matching_runs", "z": "no_evaluations"}


def test_evaluations_keep_unknown_runs_and_reflections_need_both_texts(spark):
    from evalframe.operators import analysis as X
    ev = spark.createDataFrame([("u", "r", 1.0), ("u", "q", 2.0), (None, "r", 3.0)], "user_id string, run_id string, s double")
    runs = spark.createDataFrame([("u", "r", "p"), ("u", "unused", "x")], "user_id string, run_id string, persona string")
    assert {r.s: r.persona for r in X.join_runs(ev, runs).collect()} == {1.0: "p", 2.0: None, 3.0: None}
    refl = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, "a", None), (4, "", "")], "k int, reflection_on_results string, improved_persona string")
    assert sorted(r.k for r in X.valid_reflections(refl).collect()) == [1, 4]


def test_initial_round_has_all_metrics(spark):
    from evalframe.operators import analysis as X
    df = spark.createDataFrame([("g", 1, 9.0, None), ("g", 2, 1.0, 2.0), ("g", 3, 4.0, 1.0), ("h", 1, None, 1.0)], "c string, round int, a double, b double")
    got = X.initial_vs_peak_complete(df, ["c"], ["a", "b"]).collect()
    assert [(r.c, r.first_round, r.a_initial, r.a_peak, r.b_improvement) for r in got] == [("g", 2, 1.0, 4.0, 0.0)]
