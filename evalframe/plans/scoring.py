"""Registered queries: pair scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.text import rouge_tokens
from evalframe.operators import scoring as S
from evalframe.operators import wordvec as V
from evalframe.plans.common import Registry, rounded
from evalframe.plans.sqlgen import lcs_sql, pair_scores_sql, r6
from evalframe.session import cut_lineage
from evalframe.sources import adapters as A
from evalframe.sources.adapters import PAIRS_SQL, pairs_from_conversations

reg = Registry()

_SC = "WITH " + pair_scores_sql(PAIRS_SQL) + "\n"
# scored pairs with ROUGE-L and the combined score (0.4 ROUGE-L + 0.3 BLEU, renormalised)
_SCL = "WITH RECURSIVE " + pair_scores_sql(PAIRS_SQL) + ",\n" + lcs_sql() + """,
scl AS (SELECT sc.*, CASE WHEN l.la > 0 AND l.lb > 0 AND (CAST(l.lcs AS DOUBLE) / l.la + CAST(l.lcs AS DOUBLE) / l.lb) > 0
    THEN 2 * (CAST(l.lcs AS DOUBLE) / l.la) * (CAST(l.lcs AS DOUBLE) / l.lb)
         / (CAST(l.lcs AS DOUBLE) / l.la + CAST(l.lcs AS DOUBLE) / l.lb) ELSE 0.0 END AS rougeL
  FROM sc JOIN lcsr l ON sc."index" = l.idx),
cmb AS (SELECT *, (0.0 + rougeL * 0.4 + CASE WHEN bleu IS NOT NULL THEN bleu * 0.3 ELSE 0.0 END)
    / (0.0 + 0.4 + CASE WHEN bleu IS NOT NULL THEN 0.3 ELSE 0.0 END) AS combined_score FROM scl)
"""


def scored_pairs(spark, sf_dir, rouge_l=True):
    return S.score_pairs(pairs_from_conversations(spark, sf_dir), rouge_l=rouge_l)


@reg.add("rouge_n", _SC + f"""SELECT user_id, run_id, "index", tweet_id,
  {r6('rouge1', 'rouge1')}, {r6('rouge2', 'rouge2')} FROM sc""")
def rouge_n(spark, sf_dir):
    s = S.score_pairs(pairs_from_conversations(spark, sf_dir), metrics=["rouge"], rouge_l=False)
    return rounded(s.select("user_id", "run_id", "index", "tweet_id", "rouge1", "rouge2"))


@reg.add("rouge_l", _SCL + """SELECT user_id, run_id, "index", tweet_id, round(rougeL, 6) AS rougeL FROM scl""")
def rouge_l(spark, sf_dir):
    s = S.score_pairs(pairs_from_conversations(spark, sf_dir), metrics=["rouge"])
    return rounded(s.select("user_id", "run_id", "index", "tweet_id", "rougeL"))


@reg.add("bleu_item", _SC + f"""SELECT user_id, run_id, "index", {r6('bleu', 'bleu')},
  {r6('brevity_penalty', 'brevity_penalty')}, {r6('CASE WHEN rl > 0 THEN ratio END', 'length_ratio')},
  {r6('p1', 'precision_1')}, {r6('p2', 'precision_2')}, {r6('p3', 'precision_3')}, {r6('p4', 'precision_4')},
  tl AS translation_length, rl AS reference_length FROM sc""")
def bleu_item(spark, sf_dir):
    s = S.score_pairs(pairs_from_conversations(spark, sf_dir), metrics=["bleu"])
    p = F.col("bleu_precisions")
    return rounded(s.select("user_id", "run_id", "index", "bleu", "brevity_penalty", "length_ratio",
                            *[p[i].alias(f"precision_{i + 1}") for i in range(4)],
                            F.col("translation_length").cast("bigint").alias("translation_length"),
                            F.col("reference_length").cast("bigint").alias("reference_length")))


_CORPUS = _SC + """, agg AS (SELECT user_id, run_id, CAST(sum(bm1) AS BIGINT) AS m1, CAST(sum(bm2) AS BIGINT) AS m2,
    CAST(sum(bm3) AS BIGINT) AS m3, CAST(sum(bm4) AS BIGINT) AS m4, CAST(sum(bp1) AS BIGINT) AS q1, CAST(sum(bp2) AS BIGINT) AS q2,
    CAST(sum(bp3) AS BIGINT) AS q3, CAST(sum(bp4) AS BIGINT) AS q4, CAST(sum(tl) AS BIGINT) AS tl,
    CAST(sum(rl) AS BIGINT) AS rl, count(*) AS total_samples FROM sc GROUP BY ALL),
pr AS (SELECT *, CASE WHEN q1 > 0 THEN CAST(m1 AS DOUBLE) / q1 ELSE 0.0 END AS p1,
    CASE WHEN q2 > 0 THEN CAST(m2 AS DOUBLE) / q2 ELSE 0.0 END AS p2,
    CASE WHEN q3 > 0 THEN CAST(m3 AS DOUBLE) / q3 ELSE 0.0 END AS p3,
    CASE WHEN q4 > 0 THEN CAST(m4 AS DOUBLE) / q4 ELSE 0.0 END AS p4,
    CAST(tl AS DOUBLE) / rl AS ratio FROM agg)
SELECT user_id, run_id,
  round(CASE WHEN tl > 0 AND rl > 0 THEN (CASE WHEN least(p1, p2, p3, p4) > 0
     THEN exp(0.25 * ln(p1) + 0.25 * ln(p2) + 0.25 * ln(p3) + 0.25 * ln(p4)) ELSE 0.0 END)
     * (CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1 - 1 / ratio) END) END, 6) AS bleu,
  round(CASE WHEN tl > 0 AND rl > 0 THEN (CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1 - 1 / ratio) END) END, 6)
     AS brevity_penalty,
  round(CASE WHEN rl > 0 THEN ratio END, 6) AS length_ratio,
  round(p1, 6) AS precision_1, round(p2, 6) AS precision_2, round(p3, 6) AS precision_3,
  round(p4, 6) AS precision_4, tl AS translation_length, rl AS reference_length, total_samples
FROM pr"""


@reg.add("bleu_corpus", _CORPUS)
def bleu_corpus(spark, sf_dir):
    s = S.score_pairs(pairs_from_conversations(spark, sf_dir), metrics=["bleu"])
    out = S.bleu_corpus(s)
    return rounded(out.select(*[F.col(c).cast("bigint").alias(c) if c in ("translation_length", "reference_length")
                                else F.col(c) for c in out.columns]))


@reg.add("combined_score", _SCL + """SELECT user_id, run_id, "index", tweet_id, round(rouge1, 6) AS rouge1,
  round(rougeL, 6) AS rougeL, round(bleu, 6) AS bleu, round(combined_score, 6) AS combined_score FROM cmb""")
def combined(spark, sf_dir):
    s = S.combined_score(scored_pairs(spark, sf_dir))
    return rounded(s.select("user_id", "run_id", "index", "tweet_id", "rouge1", "rougeL", "bleu",
                            "combined_score"))


@reg.add("run_statistics", _SCL + """SELECT user_id, run_id, round(avg(combined_score), 6) AS mean_combined_score,
  round(stddev_pop(combined_score), 6) AS std_combined_score, round(max(combined_score), 6) AS best_score,
  round(min(combined_score), 6) AS worst_score, count(combined_score) AS total_samples FROM cmb GROUP BY user_id, run_id""")
def run_statistics(spark, sf_dir):
    s = S.combined_score(scored_pairs(spark, sf_dir))
    return rounded(S.run_statistics(s))


@reg.add("best_worst", _SCL + """, rk AS (SELECT *,
    row_number() OVER (PARTITION BY user_id, run_id ORDER BY combined_score DESC, "index" ASC) AS rd,
    row_number() OVER (PARTITION BY user_id, run_id ORDER BY combined_score ASC, "index" DESC) AS ra,
    count(*) OVER (PARTITION BY user_id, run_id) AS n FROM cmb),
kk AS (SELECT *, CASE WHEN n >= 6 THEN 3 WHEN n <= 1 THEN n ELSE n // 2 END AS kb,
    CASE WHEN n >= 6 THEN 3 WHEN n <= 1 THEN 0 ELSE n // 2 END AS kw FROM rk)
SELECT user_id, run_id, 'best' AS list, CAST(rd AS INTEGER) AS rank, "index", round(combined_score, 6) AS combined_score,
  tweet_id FROM kk WHERE rd <= 3 AND rd <= kb
UNION ALL
SELECT user_id, run_id, 'worst' AS list, CAST(kw - ra + 1 AS INTEGER) AS rank, "index",
  round(combined_score, 6) AS combined_score, tweet_id FROM kk WHERE ra <= 3 AND ra <= kw""")
def best_worst(spark, sf_dir):
    pairs = pairs_from_conversations(spark, sf_dir)
    s = S.combined_score(S.score_pairs(pairs))
    return rounded(S.best_worst(s, sizes=pairs.select("user_id", "run_id")))


@reg.add("overall_scores", _SCL + """, agg AS (SELECT user_id, run_id, avg(rouge1) AS rouge1, avg(rouge2) AS rouge2,
    avg(rougeL) AS rougeL, sum(bm1) AS m1, sum(bm2) AS m2, sum(bm3) AS m3, sum(bm4) AS m4, sum(bp1) AS q1,
    sum(bp2) AS q2, sum(bp3) AS q3, sum(bp4) AS q4, sum(tl) AS tl, sum(rl) AS rl, count(*) AS total_samples
  FROM scl GROUP BY user_id, run_id),
pr AS (SELECT *, CASE WHEN q1 > 0 THEN CAST(m1 AS DOUBLE) / q1 ELSE 0.0 END AS p1,
    CASE WHEN q2 > 0 THEN CAST(m2 AS DOUBLE) / q2 ELSE 0.0 END AS p2,
    CASE WHEN q3 > 0 THEN CAST(m3 AS DOUBLE) / q3 ELSE 0.0 END AS p3,
    CASE WHEN q4 > 0 THEN CAST(m4 AS DOUBLE) / q4 ELSE 0.0 END AS p4,
    CAST(tl AS DOUBLE) / rl AS ratio FROM agg)
SELECT user_id, run_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougeL, 6) AS rougeL,
  round(CASE WHEN tl > 0 AND rl > 0 THEN (CASE WHEN least(p1, p2, p3, p4) > 0
     THEN exp(0.25 * ln(p1) + 0.25 * ln(p2) + 0.25 * ln(p3) + 0.25 * ln(p4)) ELSE 0.0 END)
     * (CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1 - 1 / ratio) END) END, 6) AS bleu, total_samples FROM pr""")
def overall_scores(spark, sf_dir):
    """Per run overall block: mean ROUGE F1s, corpus BLEU, total samples."""
    s = scored_pairs(spark, sf_dir)
    out = S.bleu_corpus(s, extra_aggs=[F.avg("rouge1").alias("rouge1"), F.avg("rouge2").alias("rouge2"),
                                       F.avg("rougeL").alias("rougeL")])
    return rounded(out.select("user_id", "run_id", "rouge1", "rouge2", "rougeL", "bleu", "total_samples"))


@reg.add("rouge_lsum")
def rouge_lsum(spark, sf_dir):
    """M2: ROUGE-Lsum per pair.  Its way back through the tables is not for SQL; the tests hold it
    against a plain dynamic program over all given pairs."""
    return rounded(S.rouge_lsum(pairs_from_conversations(spark, sf_dir)))


REPLICATES, SEED = 60, 42
_POISSON = "[" + ", ".join(map(str, S.POISSON)) + "]"


@reg.add("rouge_bootstrap", _SCL + f""", d AS (SELECT user_id, run_id, rouge1, rouge2, rougeL, 4 * w + k AS replicate,
    CAST('0x' || substr(md5('{SEED}|' || CAST("index" AS VARCHAR) || '|' || CAST(w AS VARCHAR)), 8 * k + 1, 8) AS BIGINT) AS u
  FROM scl, (SELECT unnest(range(0, {-(-REPLICATES // 4)})) AS w), (SELECT unnest(range(0, 4)) AS k)),
wt AS (SELECT *, len(list_filter({_POISSON}, lambda c: u >= c)) AS weight FROM d WHERE replicate < {REPLICATES}),
m AS (SELECT user_id, run_id, replicate, sum(rouge1 * weight) / sum(weight) AS rouge1, sum(rouge2 * weight) / sum(weight) AS rouge2,
  sum(rougeL * weight) / sum(weight) AS rougeL FROM wt WHERE weight > 0 GROUP BY user_id, run_id, replicate),
q AS (SELECT user_id, run_id, metric, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.975) AS high
  FROM (UNPIVOT m ON rouge1, rouge2, rougeL INTO NAME metric VALUE v) GROUP BY ALL),
p AS (SELECT user_id, run_id, metric, avg(v) AS mean FROM (UNPIVOT (SELECT user_id, run_id, rouge1, rouge2, rougeL FROM scl)
  ON rouge1, rouge2, rougeL INTO NAME metric VALUE v) GROUP BY ALL)
SELECT p.user_id, p.run_id, p.metric, round(p.mean, 6) AS mean, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high
FROM p LEFT JOIN q ON p.user_id = q.user_id AND p.run_id = q.run_id AND p.metric = q.metric""")
def rouge_bootstrap(spark, sf_dir):
    """Overall ROUGE of each run with the bootstrap's low, mid and high."""
    s = S.score_pairs(pairs_from_conversations(spark, sf_dir), metrics=["rouge"]).select("user_id", "run_id", "index", "rouge1", "rouge2", "rougeL")
    return rounded(S.bootstrap_means(cut_lineage(s), ["rouge1", "rouge2", "rougeL"], replicates=REPLICATES, seed=SEED))


_VEC = f""", wt0 AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM conversations),
wtok AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM wt0),
co AS (SELECT t[i] AS word, t[i + o] AS other, count(*) AS n FROM wtok, (SELECT unnest([{', '.join(str(o) for o in range(-V.REACH, V.REACH + 1) if o)}]) AS o)
  WHERE i + o BETWEEN 1 AND len(t) GROUP BY ALL),
sd AS (SELECT word, d, CAST(sum(n * CASE WHEN substr(md5(other), d, 1) IN ('0', '1') THEN 1 WHEN substr(md5(other), d, 1) IN ('e', 'f') THEN -1
  ELSE 0 END) AS DOUBLE) AS x FROM co, (SELECT unnest(range(1, {V.DIMS + 1})) AS d) GROUP BY word, d),
sv AS (SELECT word, list(x ORDER BY d) AS v FROM sd GROUP BY word),
vec AS (SELECT word, list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0.0 END) AS v FROM sv),
pw AS (SELECT "index" AS idx, side, word, count(*) AS n FROM (
    SELECT "index", 0 AS side, unnest(regexp_extract_all(lower(coalesce(prediction, '')), '[a-z0-9]+')) AS word FROM pairs
    UNION ALL SELECT "index", 1, unnest(regexp_extract_all(lower(coalesce(reference, '')), '[a-z0-9]+')) FROM pairs) GROUP BY ALL),
pv AS (SELECT pw.*, coalesce(vec.v, list_transform(range({V.DIMS}), lambda x: 0.0)) AS v FROM pw LEFT JOIN vec ON vec.word = pw.word),
mx AS (SELECT a.idx, a.side, a.word, any_value(a.n) AS n, max(list_dot_product(a.v, b.v)) AS best
  FROM pv a JOIN pv b ON a.idx = b.idx AND a.side <> b.side GROUP BY a.idx, a.side, a.word),
vpr AS (SELECT idx, sum(best * n) FILTER (WHERE side = 0) / sum(n) FILTER (WHERE side = 0) AS p,
  sum(best * n) FILTER (WHERE side = 1) / sum(n) FILTER (WHERE side = 1) AS r FROM mx GROUP BY idx),
bs AS (SELECT q."index", q.user_id, q.run_id, coalesce(p, 0.0) AS bertscore_precision, coalesce(r, 0.0) AS bertscore_recall,
  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS bertscore_f1 FROM pairs q LEFT JOIN vpr ON vpr.idx = q."index")
"""


def greedy_scores(spark, sf_dir):
    vectors = cut_lineage(V.word_vectors(A.table(spark, sf_dir, "conversations")))
    return V.greedy_match(pairs_from_conversations(spark, sf_dir), vectors, S.DEFAULT_KEY)


@reg.add("bertscore_greedy", "WITH " + PAIRS_SQL + _VEC + """SELECT user_id, run_id, "index", round(bertscore_precision, 6) AS bertscore_precision,
  round(bertscore_recall, 6) AS bertscore_recall, round(bertscore_f1, 6) AS bertscore_f1 FROM bs""")
def bertscore_greedy(spark, sf_dir):
    """M4 re-aimed: greedy matching of the corpus' word vectors per pair."""
    return rounded(greedy_scores(spark, sf_dir))


@reg.add("bertscore_overall", _SCL + _VEC + """SELECT b.user_id, b.run_id, round(avg(bertscore_precision), 6) AS bertscore_precision,
  round(avg(bertscore_recall), 6) AS bertscore_recall, round(avg(bertscore_f1), 6) AS bertscore_f1,
  round(avg((s.rougeL * 0.4 + coalesce(s.bleu, 0.0) * 0.3 + bertscore_precision * 0.3) /
    (0.7 + CASE WHEN s.bleu IS NOT NULL THEN 0.3 ELSE 0.0 END)), 6) AS mean_combined_score
FROM bs b JOIN scl s ON s."index" = b."index" GROUP BY b.user_id, b.run_id""")
def bertscore_overall(spark, sf_dir):
    """M4 + M6: means of each run, and the combined score with all three metrics."""
    s = scored_pairs(spark, sf_dir).select(*S.DEFAULT_KEY, "rougeL", "bleu").join(greedy_scores(spark, sf_dir), list(S.DEFAULT_KEY))
    return rounded(S.combined_score(s).groupBy("user_id", "run_id").agg(
        *[F.avg(f"bertscore_{m}").alias(f"bertscore_{m}") for m in ("precision", "recall", "f1")],
        F.avg("combined_score").alias("mean_combined_score")))


def exact_match(pairs, key):
    """A plugged metric: 1 where both texts have the same words, else 0."""
    same = F.coalesce(rouge_tokens(F.col("prediction")) == rouge_tokens(F.col("reference")), F.lit(False))
    return pairs.select(*key, same.cast("int").cast("double").alias("exact_match"))


def length_ratio(pairs, key):
    """A plugged metric: characters of the prediction over those of the reference (null for an empty one)."""
    return pairs.select(*key, F.try_divide(F.length("prediction").cast("double"), F.length("reference").cast("double")).alias("char_ratio"))


@reg.add("plugged_metrics", _SC + """SELECT sc.user_id, sc.run_id, sc."index", round(sc.bleu, 6) AS bleu,
  CASE WHEN regexp_extract_all(lower(coalesce(p.prediction, '')), '[a-z0-9]+') = regexp_extract_all(lower(coalesce(p.reference, '')), '[a-z0-9]+')
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match,
  round(CASE WHEN length(p.reference) > 0 THEN CAST(length(p.prediction) AS DOUBLE) / length(p.reference) END, 6) AS char_ratio
FROM sc JOIN pairs p ON p."index" = sc."index" """)
def plugged_metrics(spark, sf_dir):
    """X5 + M14: a built-in and two plugged metrics, chosen by name."""
    for name, fn in (("exact_match", exact_match), ("char_ratio", length_ratio)):
        if name not in S.REGISTRY:
            S.register_metric(name, fn)
    return rounded(S.evaluate(pairs_from_conversations(spark, sf_dir), ["bleu", "exact_match", "char_ratio"]))


_FLAT = ("rouge1", "rouge2", "rougeL", "bleu", "combined_score")


@reg.add("flatten_evaluation", _SCL + f"""
SELECT user_id, run_id, count(*) AS total_samples, {', '.join(
    f'round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, round(max({m}), 6) AS {m}_max, round(min({m}), 6) AS {m}_min' for m in _FLAT)}
FROM cmb GROUP BY user_id, run_id""")
def flatten_evaluation(spark, sf_dir):
    """All item metrics of an evaluation as mean, population std, largest and smallest."""
    s = S.combined_score(scored_pairs(spark, sf_dir))
    aggs = [f(F.col(m)).alias(f"{m}_{n}") for m in _FLAT for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))]
    return rounded(s.groupBy("user_id", "run_id").agg(F.count(F.lit(1)).alias("total_samples"), *aggs))
