"""ROUGE-Lsum, bootstrap, greedy word vectors and keywords against plain programs."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL

from evalframe.operators import ngram
from evalframe.operators import scoring as S
from evalframe.operators import wordvec as V
from evalframe.operators.lcs import lcs_length, lcs_places, union_lcs
from evalframe.operators.quality import persona_keywords
from evalframe.plans import queries
from evalframe.sources import adapters as A


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def plain_places(a, b):
    """Table of lengths, then the way back from its last cell."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def plain_lsum(prediction, reference):
    ref, pred = ([words(s) for s in (t or "").split("\n") if s] for t in (reference, prediction))
    m, n = sum(map(len, ref)), sum(map(len, pred))
    if not m or not n:
        return 0.0
    left = [collections.Counter(w for s in t for w in s) for t in (ref, pred)]
    hits = 0
    for s in ref:
        for k in sorted(set().union(*(plain_places(s, c) for c in pred))):
            if left[0][s[k]] > 0 and left[1][s[k]] > 0:
                hits += 1
                left[0][s[k]] -= 1
                left[1][s[k]] -= 1
    return 2 * (hits / n) * (hits / m) / (hits / n + hits / m) if hits else 0.0


def test_places_are_those_of_the_table():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 14))) for _ in range(2))
        assert lcs_places(a, b) == plain_places(a, b) and len(lcs_places(a, b)) == lcs_length(a, b)
    assert union_lcs(None, [["a"]]) == (0, 1, 0) and union_lcs([["a", "b"], ["a"]], [["a"], ["b", "a"]])[0] == 2


def test_rouge_lsum_of_all_pairs(spark):
    pairs = {(r.user_id, r.run_id, r["index"]): plain_lsum(r.prediction, r.reference)
             for r in A.pairs_from_conversations(spark, SF_SMALL).collect()}
    got = {(r.user_id, r.run_id, r["index"]): r.rougeLsum for r in queries()["rouge_lsum"](spark, SF_SMALL).collect()}
    assert got.keys() == pairs.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in pairs.items())
    odd = spark.createDataFrame([("u", "r", 1, None, "a"), ("u", "r", 2, "a\n\nb", "b\na"), ("u", "r", 3, "", "")],
                                "user_id string, run_id string, index int, prediction string, reference string")
    assert [r.rougeLsum for r in S.rouge_lsum(odd).orderBy("index").collect()] == [0.0, 1.0, 0.0]


def test_pairs_without_a_reference_are_kept_and_scored(spark):
    rows = [("u", "r", 1, "some words here", None), ("u", "r", 2, "some words here", "some words here"), ("u", None, 3, None, None)]
    df = spark.createDataFrame(rows, "user_id string, run_id string, index int, prediction string, reference string")
    got = {r["index"]: r for r in S.combined_score(S.score_pairs(df)).collect()}
    assert len(got) == 3 and got[1].rouge1 == got[1].rougeL == 0.0 and got[1].bleu is None and got[1].combined_score == 0.0
    assert got[2].rougeL == 1.0 and got[3].combined_score == 0.0


def test_a_first_turn_of_the_assistant_has_no_original(spark, scratch):
    spark.createDataFrame([(1, 0, "assistant", "hello"), (1, 1, "user", "hi"), (1, 2, "assistant", "hi there")],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{scratch}/conversations.parquet")
    got = {r["index"] % A.TURNS: (r.prediction, r.reference) for r in A.pairs_from_conversations(spark, scratch).collect()}
    assert got == {0: ("hello", None), 2: ("hi there", "hi")}


def test_bootstrap_brackets_the_mean(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(0.5, 0.1, 400)
    rows = [("u", "big", i, float(v)) for i, v in enumerate(vals)] + [("u", None, 5000, 0.25), ("u", "none", 6000, None)]
    df = spark.createDataFrame(rows, "user_id string, run_id string, index int, m double").repartition(3)
    got = {r.run_id: r for r in S.bootstrap_means(df, ["m"], replicates=200).collect()}
    r, se = got["big"], vals.std() / 20
    assert r.mean == pytest.approx(vals.mean()) and r.mid == pytest.approx(vals.mean(), abs=se)
    assert r.high - r.low == pytest.approx(2 * 1.96 * se, rel=0.35)
    assert got[None].low == got[None].high == 0.25 and got["none"].mid is None
    again = {r.run_id: r for r in S.bootstrap_means(df.repartition(7), ["m"], replicates=200).collect()}
    assert all(again[k].mid == pytest.approx(got[k].mid) for k in ("big", None))


def test_poisson_draws():
    u = np.random.default_rng(1).integers(0, 2**32, 200_000)
    w = (u[:, None] >= np.array(S.POISSON)[None]).sum(1)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)


def test_greedy_matching(spark):
    texts = ["the cat sat on the mat", "a dog sat near the cat", "birds fly high", None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    vec = {r.word: np.array(r.vec) for r in V.word_vectors(table).collect()}
    want = collections.defaultdict(lambda: np.zeros(V.DIMS))
    for t in texts:
        w = words(t)
        for i, x in enumerate(w):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    want[x] += [(d in "01") - (d in "ef") for d in hashlib.md5(w[j].encode()).hexdigest()]
    assert vec.keys() == want.keys()
    for x in vec:
        n = np.linalg.norm(want[x])
        assert vec[x] == pytest.approx(want[x] / n if n else want[x])
    pairs = [(1, "the cat sat", "a dog sat sat"), (2, "the cat", "the cat"), (3, None, "cat"), (4, "unknown", "cat"), (None, "mat", "the mat")]
    df = spark.createDataFrame(pairs, "k int, prediction string, reference string")
    got = {r.k: r for r in V.greedy_match(df, V.word_vectors(table), ["k"]).collect()}
    for k, a, b in pairs:
        u, v = ([vec.get(x, np.zeros(V.DIMS)) for x in words(t)] for t in (a, b))
        p, r = (np.mean([max(x @ y for y in v) for x in u]), np.mean([max(x @ y for x in u) for y in v])) if u and v else (0, 0)
        assert (got[k].bertscore_precision, got[k].bertscore_recall) == pytest.approx((p, r))
        assert got[k].bertscore_f1 == pytest.approx(2 * p * r / (p + r) if p + r > 0 else 0)


def test_keywords(spark):
    rows = [("x", "apple apple pear the the"), ("y", "plum the the the"), (None, "kiwi the"), ("z", None)]
    got = persona_keywords(spark.createDataFrame(rows, "p string, t string"), "p", "t", k=2, prior_size=5.0).collect()
    top = {r.p: r.word for r in got if r["rank"] == 1}
    assert top == {"x": "apple", "y": "the", None: "kiwi"} and max(r["rank"] for r in got) == 2


def test_a_pair_has_one_python_worker(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c x e"), (2, None, "a")], "k long, prediction string, reference string")
    scored = S.score_pairs(pairs, ["k"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.splitlines()) == 1
    got = {r.k: r for r in scored.collect()}
    assert got[1].rouge1 == pytest.approx(0.8) and got[1].rougeL == pytest.approx(0.8) and got[1].bleu_m2 == 2 and got[2].rougeL == 0


def test_few_pairs_are_python_strings_at_once(monkeypatch):
    made = []
    plain = ngram._lists
    monkeypatch.setattr(ngram, "_lists", lambda rows: made.append(len(rows)) or plain(rows))
    a = pa.array([["x"] * (i % 5) if i % 7 else None for i in range(1000)], pa.list_(pa.string()))
    b = pa.array([[str(i)] for i in range(1000)], pa.list_(pa.string()))
    want = [(x or [], y) for x, y in zip(a.to_pylist(), b.to_pylist())]
    assert list(ngram.token_pairs(a, b)) == want and list(ngram.token_pairs(a[3:70], b[3:70])) == want[3:70]
    assert max(made) <= ngram.ROWS_AT_ONCE and not list(ngram.token_pairs(a[:0], b[:0]))


def test_greedy_reads_vectors_in_arrow():
    unit = [[1.0 if d == k else 0.0 for d in range(V.DIMS)] for k in range(2)]
    words = pa.array([[{"side": 0, "n": 2, "vec": unit[0]}, {"side": 0, "n": 1, "vec": unit[1]}, {"side": 1, "n": 1, "vec": unit[0]}],
                      [{"side": 0, "n": 1, "vec": unit[0]}]],
                     pa.list_(pa.struct([("side", pa.int32()), ("n", pa.int64()), ("vec", pa.list_(pa.float64()))])))
    got = V._greedy_batch(words).to_pylist()
    assert got == [{"p": pytest.approx(2 / 3), "r": 1.0, "f": pytest.approx(0.8)}, {"p": 0.0, "r": 0.0, "f": 0.0}]
