"""Scoring and statistics against plain-Python brute force on small fixtures."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from evalframe.functions.dist import betainc, f_upper_p, t_two_sided_p
from evalframe.operators import scoring as S
from evalframe.operators.lcs import lcs_length
from evalframe.sources import adapters as A


def rouge_tok(s):
    return re.findall(r"[a-z0-9]+", (s or "").lower())


def grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def f1(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_n(pred, ref, n):
    pg, rg = grams(rouge_tok(pred), n), grams(rouge_tok(ref), n)
    ov = sum(min(c, pg[g]) for g, c in rg.items())
    return f1(ov / max(sum(pg.values()), 1), ov / max(sum(rg.values()), 1))


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def rouge_l(pred, ref):
    a, b = rouge_tok(pred), rouge_tok(ref)
    if not a or not b:
        return 0.0
    lc = lcs_dp(a, b)
    return f1(lc / len(a), lc / len(b))


def bleu_tok(line):
    line = (line or "").replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def bleu(preds, refs):
    m, poss = [0] * 4, [0] * 4
    tl = rl = 0
    for p, r in zip(preds, refs):
        pt, rt = bleu_tok(p), bleu_tok(r)
        tl += len(pt)
        rl += len(rt)
        for n in range(1, 5):
            pg, rg = grams(pt, n), grams(rt, n)
            m[n - 1] += sum(min(c, rg[g]) for g, c in pg.items())
            if len(pt) - n + 1 > 0:
                poss[n - 1] += len(pt) - n + 1
    if tl == 0 or rl == 0:
        return None
    prec = [m[i] / poss[i] if poss[i] > 0 else 0.0 for i in range(4)]
    geo = math.exp(sum(0.25 * math.log(p) for p in prec)) if min(prec) > 0 else 0.0
    ratio = tl / rl
    return geo * (1.0 if ratio > 1.0 else math.exp(1 - 1 / ratio))


@pytest.fixture(scope="module")
def pairs(spark):
    return A.pairs_from_conversations(spark, SF_SMALL).toPandas()


@pytest.fixture(scope="module")
def scored(spark):
    p = A.pairs_from_conversations(spark, SF_SMALL)
    return S.combined_score(S.score_pairs(p)).toPandas().set_index("index")


def test_rouge_and_bleu_match_brute_force(pairs, scored):
    assert len(scored) == len(pairs) > 0
    for row in pairs.itertuples():
        s = scored.loc[row.index]
        assert s.rouge1 == pytest.approx(rouge_n(row.prediction, row.reference, 1), abs=1e-12)
        assert s.rouge2 == pytest.approx(rouge_n(row.prediction, row.reference, 2), abs=1e-12)
        assert s.rougeL == pytest.approx(rouge_l(row.prediction, row.reference), abs=1e-12)
        b = bleu([row.prediction], [row.reference])
        assert (s.bleu is None or math.isnan(s.bleu)) if b is None else s.bleu == pytest.approx(b, abs=1e-12)


def test_combined_score_weights(pairs, scored):
    for row in pairs.itertuples():
        s = scored.loc[row.index]
        b = bleu([row.prediction], [row.reference])
        want = (0.4 * rouge_l(row.prediction, row.reference) + 0.3 * b) / 0.7 if b is not None \
            else rouge_l(row.prediction, row.reference)
        assert s.combined_score == pytest.approx(want, abs=1e-12)


def test_corpus_bleu_is_not_mean_of_items(spark, pairs):
    p = A.pairs_from_conversations(spark, SF_SMALL)
    corpus = S.bleu_corpus(S.score_pairs(p, metrics=["bleu"])).toPandas()
    for r in corpus.itertuples():
        sub = pairs[(pairs.user_id == r.user_id) & (pairs.run_id == r.run_id)]
        want = bleu(list(sub.prediction), list(sub.reference))
        assert (r.bleu is None or math.isnan(r.bleu)) if want is None else r.bleu == pytest.approx(want, abs=1e-12)


def test_run_statistics_and_best_worst(scored):
    df = scored.reset_index()
    stats = S  # noqa: F841 - brute force below
    for (u, run), g in df.groupby(["user_id", "run_id"]):
        order = g.sort_values(["combined_score", "index"], ascending=[False, True])
        n = len(order)
        k = 3 if n >= 6 else (n // 2 if n > 1 else 0)
        kb = 3 if n >= 6 else (n if n <= 1 else n // 2)
        best = set(order["index"].iloc[:kb])
        worst = set(order["index"].iloc[n - k:]) if k else set()
        assert not (best & worst) or n < 2
        assert len(best) == kb and len(worst) == k


def test_best_worst_operator_against_brute_force(spark):
    p = A.pairs_from_conversations(spark, SF_SMALL)
    sc = S.combined_score(S.score_pairs(p))
    bw = S.best_worst(sc).toPandas()
    all_ = sc.toPandas()
    for (u, run), g in all_.groupby(["user_id", "run_id"]):
        order = list(g.sort_values(["combined_score", "index"], ascending=[False, True])["index"])
        n = len(order)
        k = 3 if n >= 6 else (n // 2 if n > 1 else 0)
        kb = 3 if n >= 6 else (n if n <= 1 else n // 2)
        got = bw[(bw.user_id == u) & (bw.run_id == run)]
        assert list(got[got.list == "best"].sort_values("rank")["index"]) == order[:kb]
        assert list(got[got.list == "worst"].sort_values("rank")["index"]) == (order[n - k:] if k else [])
        st = g.combined_score
        assert st.std(ddof=0) >= 0


def test_lcs_bit_parallel_equals_dp():
    import random
    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        assert lcs_length(a, b) == lcs_dp(a, b)


def test_p_values_against_table_values():
    assert t_two_sided_p(1.0, 1) == pytest.approx(0.5, abs=1e-12)       # Cauchy
    assert t_two_sided_p(2.228138851986, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0, abs=1e-12)
    assert f_upper_p(4.102821015130, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_rouge_tokens_match_python(spark):
    from evalframe.functions.text import bleu_tokens, rouge_tokens
    texts = ["Hello, World! 3.14 is-not 2-3 &amp; a/b", "Déjà vu: l'été 2024...", "", "x--y (z) [w] {v}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(rouge_tokens(F.col("t")).alias("r"), bleu_tokens(F.col("t")).alias("b")).collect()
    for t, row in zip(texts, got):
        assert list(row.r) == rouge_tok(t)
        assert list(row.b) == bleu_tok(t)
