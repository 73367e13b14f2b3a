"""Registered queries: analysis by condition / round / user."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import analysis as X
from evalframe.plans.common import Registry, rounded
from evalframe.sources import adapters as A

reg = Registry()

# Fixed category order of the event conditions (ordinal sort key of A22).
EVENT_CONDITION_ORDER = ["view", "click", "signup", "purchase", "error"]
TASKS = ["post", "reply"]
COMPARE_A, COMPARE_B = "click", "view"
TOP_N = 5

_R = A.with_sql(A.RESULTS_SQL)
_CELLS = A.with_sql(A.RESULTS_SQL, """cells AS (SELECT user_id, condition, task,
  coalesce(avg(score), 0.0) AS mean_value, count(score) AS n FROM results GROUP BY ALL)""")


def results(spark, sf_dir):
    return A.results_from_events(spark, sf_dir)


def cells(spark, sf_dir):
    return X.cell_means(results(spark, sf_dir))


@reg.add("condition_results", _CELLS + "SELECT user_id, condition, task, round(mean_value, 6) AS mean_value, n FROM cells")
def condition_results(spark, sf_dir):
    return rounded(cells(spark, sf_dir))


@reg.add("condition_descriptives", _CELLS + """SELECT condition, task, count(mean_value) AS count,
  round(avg(mean_value), 6) AS mean, round(stddev_samp(mean_value), 6) AS std,
  round(median(mean_value), 6) AS median FROM cells GROUP BY ALL""")
def condition_descriptives(spark, sf_dir):
    return rounded(X.descriptives(cells(spark, sf_dir), ["condition", "task"], "mean_value"))


@reg.add("condition_pivot", _CELLS + """SELECT condition,
  round(avg(mean_value) FILTER (WHERE task = 'post'), 6) AS post,
  round(avg(mean_value) FILTER (WHERE task = 'reply'), 6) AS reply FROM cells GROUP BY condition""")
def condition_pivot(spark, sf_dir):
    return rounded(X.pivot_mean(cells(spark, sf_dir), "condition", "task", TASKS, "mean_value"))


_ORDER_SQL = "CASE " + " ".join(f"WHEN condition = '{c}' THEN {i}" for i, c in enumerate(EVENT_CONDITION_ORDER)) \
    + f" ELSE {len(EVENT_CONDITION_ORDER)} END"


@reg.add("condition_grouping_sets", _CELLS + f"""SELECT condition,
  CASE WHEN grouping(task) = 1 THEN 'overall' ELSE task END AS task,
  round(avg(mean_value), 6) AS mean, round(stddev_samp(mean_value), 6) AS std, count(mean_value) AS count,
  {_ORDER_SQL} AS sort_key
FROM cells GROUP BY GROUPING SETS ((condition, task), (condition))""")
def condition_grouping_sets(spark, sf_dir):
    g = X.grouping_summary(cells(spark, sf_dir), "condition", "task", "mean_value", EVENT_CONDITION_ORDER)
    return rounded(g.withColumn("sort_key", F.col("sort_key").cast("int")))


@reg.add("condition_sem", _CELLS + """SELECT condition, round(avg(mean_value), 6) AS mean,
  count(mean_value) AS n, round(stddev_samp(mean_value) / sqrt(count(mean_value)), 6) AS sem
FROM cells GROUP BY condition""")
def condition_sem(spark, sf_dir):
    return rounded(X.sem(cells(spark, sf_dir), ["condition"], "mean_value"))


@reg.add("condition_describe", _R + """SELECT condition, count(score) AS count, round(avg(score), 6) AS mean,
  round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min,
  round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50,
  round(quantile_cont(score, 0.75), 6) AS p75, round(max(score), 6) AS max,
  round(quantile_cont(score, 0.99), 6) AS p99
FROM results GROUP BY condition""")
def condition_describe(spark, sf_dir):
    return rounded(X.describe(results(spark, sf_dir), ["condition"], "score"))


def with_k(spark, sf_dir):
    return results(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))


_LONG = A.with_sql(A.RESULTS_SQL, """long AS (
  SELECT condition, round, 'score' AS metric, score AS value FROM results
  UNION ALL SELECT condition, round, 'k' AS metric, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM results),
ra AS (SELECT condition, round, metric, avg(value) AS mean, stddev_samp(value) AS std,
  min(value) AS min, max(value) AS max, count(value) AS count FROM long GROUP BY ALL)""")


def round_agg(spark, sf_dir):
    return X.round_aggregate(with_k(spark, sf_dir), ["condition", "round"], ["score", "k"])


@reg.add("round_aggregate", _LONG + """SELECT condition, round, metric, round(mean, 6) AS mean,
  round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, count FROM ra""")
def round_aggregate(spark, sf_dir):
    return rounded(round_agg(spark, sf_dir))


@reg.add("trend", _LONG + """, t AS (SELECT condition, metric, arg_min(mean, round) AS first, arg_max(mean, round) AS last,
  min(round) AS first_round, max(round) AS last_round FROM ra GROUP BY ALL)
SELECT condition, metric, first_round, last_round, round(first, 6) AS first, round(last, 6) AS last,
  round(last - first, 6) AS delta,
  round(CASE WHEN first = 0 THEN 0.0 ELSE (last - first) / first * 100 END, 6) AS pct_change,
  CASE WHEN last - first > 0 THEN 'up' WHEN last - first < 0 THEN 'down' ELSE 'flat' END AS direction
FROM t""")
def trend(spark, sf_dir):
    return rounded(X.trend(round_agg(spark, sf_dir), ["condition", "metric"]))


@reg.add("initial_vs_peak", _LONG + """SELECT condition, metric, round(arg_min(mean, round), 6) AS initial,
  round(max(mean), 6) AS peak, round(max(mean) - arg_min(mean, round), 6) AS improvement
FROM ra WHERE mean IS NOT NULL GROUP BY ALL""")
def initial_vs_peak(spark, sf_dir):
    return rounded(X.initial_vs_peak(round_agg(spark, sf_dir), ["condition", "metric"]))


@reg.add("best_per_round", _LONG + """SELECT round, metric, condition, round(mean, 6) AS mean FROM (
  SELECT *, row_number() OVER (PARTITION BY round, metric ORDER BY mean DESC, condition) AS rn FROM ra) t
WHERE rn = 1""")
def best_per_round(spark, sf_dir):
    b = X.argmax_per_group(round_agg(spark, sf_dir), ["round", "metric"], "mean", ["condition"])
    return rounded(b.select("round", "metric", "condition", "mean"))


_US = A.with_sql(A.RESULTS_SQL, """us AS (SELECT condition, user_id, avg(score) AS mean_score,
  count(*) AS n_items FROM results GROUP BY ALL)""")


def user_scores(spark, sf_dir):
    return X.user_scores(results(spark, sf_dir))


@reg.add("user_scores", _US + "SELECT condition, user_id, round(mean_score, 6) AS mean_score, n_items FROM us")
def q_user_scores(spark, sf_dir):
    return rounded(user_scores(spark, sf_dir))


@reg.add("rank_users", _US + """SELECT condition, user_id, round(mean_score, 6) AS mean_score, n_items,
  row_number() OVER (PARTITION BY condition ORDER BY mean_score DESC, user_id) AS rank FROM us""")
def rank_users(spark, sf_dir):
    r = X.rank_users(user_scores(spark, sf_dir), ["condition"])
    return rounded(r.withColumn("rank", F.col("rank").cast("bigint")))


@reg.add("top_bottom", _US + f""", c AS (SELECT condition, count(*) AS users FROM us GROUP BY condition),
tb AS (SELECT us.*, 'top' AS side, row_number() OVER (PARTITION BY condition ORDER BY mean_score DESC, user_id) AS rn FROM us
  UNION ALL
  SELECT us.*, 'bottom' AS side, row_number() OVER (PARTITION BY condition ORDER BY mean_score ASC, user_id) AS rn FROM us)
SELECT tb.condition, user_id, round(mean_score, 6) AS mean_score, n_items, side, rn
FROM tb JOIN c ON tb.condition = c.condition
WHERE rn <= {TOP_N} AND (side = 'top' OR users > {TOP_N})""")
def top_bottom(spark, sf_dir):
    t = X.top_bottom(user_scores(spark, sf_dir), ["condition"], n=TOP_N)
    return rounded(t.select("condition", "user_id", "mean_score", "n_items", "side",
                            F.col("rn").cast("bigint").alias("rn")))


@reg.add("performance_summary", _US + """SELECT condition, count(*) AS users, round(avg(mean_score), 6) AS mean,
  round(stddev_pop(mean_score), 6) AS std_pop, round(sum(mean_score), 6) AS total,
  round(max(mean_score), 6) AS max, round(min(mean_score), 6) AS min FROM us GROUP BY condition""")
def performance_summary(spark, sf_dir):
    return rounded(X.summary(user_scores(spark, sf_dir), ["condition"]))


@reg.add("run_stats", _R + """SELECT condition, count(DISTINCT user_id) AS users, count(*) AS items,
  max(round) AS max_round, round(avg(score), 6) AS mean_score, count(DISTINCT round) AS rounds
FROM results GROUP BY condition""")
def run_stats(spark, sf_dir):
    return rounded(X.run_stats(results(spark, sf_dir), ["condition"]))


@reg.add("user_rounds", _R + """SELECT user_id, condition, round, round(avg(score), 6) AS mean_score,
  count(*) AS n FROM results GROUP BY ALL""")
def user_rounds(spark, sf_dir):
    r = results(spark, sf_dir).groupBy("user_id", "condition", "round").agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return rounded(r)


@reg.add("compare_runs", _US + f"""SELECT user_id, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b,
  round(score_a - score_b, 6) AS difference FROM (
  SELECT user_id, max(mean_score) FILTER (WHERE condition = '{COMPARE_A}') AS score_a,
         max(mean_score) FILTER (WHERE condition = '{COMPARE_B}') AS score_b FROM us GROUP BY user_id) t
WHERE score_a IS NOT NULL AND score_b IS NOT NULL""")
def compare_runs(spark, sf_dir):
    c = X.compare(user_scores(spark, sf_dir), ["user_id"], "condition", COMPARE_A, COMPARE_B)
    return rounded(c)


# ---------------------------------------------------------------------------
# reflections / personas derived from events: an event is a reflection step
# ---------------------------------------------------------------------------

def reflections(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.select("user_id", "condition", "round", "run_id", (F.col("item") % 3).alias("iteration"),
                    F.col("item").alias("pos"),
                    F.when(F.col("score") < 2, F.lit("")).otherwise(F.concat(F.lit("persona-"),
                                                                              F.col("item").cast("string")))
                    .alias("improved_persona"))


_REFL = A.with_sql(A.RESULTS_SQL, """refl AS (SELECT user_id, condition, round, run_id, item % 3 AS iteration,
  item AS pos, CASE WHEN score < 2 THEN '' ELSE 'persona-' || CAST(item AS VARCHAR) END AS improved_persona
  FROM results)""")


def _latest_sql(keys: str) -> str:
    return f"""SELECT {keys}, iteration, CASE WHEN trim(improved_persona) <> '' THEN improved_persona END AS persona
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY iteration DESC, pos ASC) AS rn FROM refl) t
WHERE rn = 1"""


@reg.add("latest_persona", _REFL + _latest_sql("user_id, run_id"))
def latest_persona(spark, sf_dir):
    return X.latest_persona(reflections(spark, sf_dir), ["user_id", "run_id"])


_PER_ROUND = """pr AS (SELECT user_id, round, avg(score) AS mean_score FROM results GROUP BY ALL),
br AS (SELECT user_id, round AS best_round, mean_score AS best_value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean_score DESC, round ASC) AS rn
  FROM pr WHERE mean_score > 0) t WHERE rn = 1)"""


def per_round(spark, sf_dir):
    return results(spark, sf_dir).groupBy("user_id", "round").agg(F.avg("score").alias("mean_score"))


@reg.add("best_round", A.with_sql(A.RESULTS_SQL, _PER_ROUND) + """SELECT user_id, best_round,
  round(best_value, 6) AS best_value FROM br""")
def best_round(spark, sf_dir):
    return rounded(X.best_round(per_round(spark, sf_dir)))


@reg.add("round_chain", _REFL + f""", lp AS ({_latest_sql('user_id, condition, round')})
SELECT a.user_id, a.condition, a.round, a.iteration, a.persona, b.persona AS persona_in
FROM lp a LEFT JOIN lp b ON a.user_id = b.user_id AND a.condition = b.condition AND a.round = b.round + 1""")
def round_chain(spark, sf_dir):
    lp = X.latest_persona(reflections(spark, sf_dir), ["user_id", "condition", "round"])
    return X.round_chain(lp, ["user_id", "condition"]).select(
        "user_id", "condition", "round", "iteration", "persona", "persona_in")


@reg.add("best_persona", _REFL + "," + _PER_ROUND + f""", lp AS ({_latest_sql('user_id, round')})
SELECT br.user_id, br.best_round, round(br.best_value, 6) AS best_value, lp.persona
FROM br JOIN lp ON br.user_id = lp.user_id AND br.best_round = lp.round""")
def best_persona(spark, sf_dir):
    """Best round (W5) joined to the latest improved persona of that round."""
    br = X.best_round(per_round(spark, sf_dir))
    lp = X.latest_persona(reflections(spark, sf_dir), ["user_id", "round"])
    j = br.join(lp, (br["user_id"] == lp["user_id"]) & (br["best_round"] == lp["round"]))
    return rounded(j.select(br["user_id"], "best_round", "best_value", "persona"))


# ---------------------------------------------------------------------------
# keyed upserts (S14-S16): existing rows + an update batch, both from events
# ---------------------------------------------------------------------------

def _evals(spark, sf_dir):
    return results(spark, sf_dir).select("user_id", "run_id", "item", "ts", "score")


@reg.add("upsert_evaluation", _R + """SELECT user_id, run_id, item, ts_s AS ts, round(score, 6) AS score FROM (
  SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_s, row_number() OVER (PARTITION BY user_id, run_id
      ORDER BY (item % 3 = 0) DESC, ts DESC, item DESC) AS rn FROM results) t WHERE rn = 1""")
def upsert_evaluation(spark, sf_dir):
    e = _evals(spark, sf_dir)
    out = X.upsert_latest(e.where(F.col("item") % 3 != 0), e.where(F.col("item") % 3 == 0),
                          ["user_id", "run_id"], ["ts", "item"])
    return rounded(out.select("user_id", "run_id", "item",
                              F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "score"))


@reg.add("upsert_imitation", _R + """SELECT user_id, run_id, min(item) AS item, count(*) AS n_rows
FROM results GROUP BY ALL""")
def upsert_imitation(spark, sf_dir):
    e = results(spark, sf_dir).select("user_id", "run_id", "item")
    out = X.upsert_first(e.where(F.col("item") % 2 == 0), e.where(F.col("item") % 2 == 1),
                         ["user_id", "run_id"], "item")
    return out.select("user_id", "run_id", "item", "n_rows")


@reg.add("upsert_reflection", _REFL + """SELECT user_id, run_id, iteration, pos, improved_persona FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, run_id, iteration
      ORDER BY (pos % 2 = 1) DESC, pos DESC) AS rn FROM refl) t WHERE rn = 1""")
def upsert_reflection(spark, sf_dir):
    r = reflections(spark, sf_dir).select("user_id", "run_id", "iteration", "pos", "improved_persona")
    out = X.upsert_latest(r.where(F.col("pos") % 2 == 0), r.where(F.col("pos") % 2 == 1),
                          ["user_id", "run_id", "iteration"], ["pos"])
    return out.select("user_id", "run_id", "iteration", "pos", "improved_persona")


@reg.add("condition_metric_table", _LONG + """SELECT condition, metric, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, count(value) AS count FROM long GROUP BY ALL""")
def condition_metric_table(spark, sf_dir):
    """Mean and sample std of several metrics per condition."""
    long = X.unpivot_metrics(with_k(spark, sf_dir).select("condition", "score", "k"), ["condition"], ["score", "k"])
    g = long.groupBy("condition", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                                F.count("value").alias("count"))
    return rounded(g)


FAIL_BELOW = 1.0   # an item scored below this counts as a failed generation


@reg.add("condition_failures", _R + f"""SELECT condition, count_if(score >= {FAIL_BELOW}) AS ok,
  count_if(score < {FAIL_BELOW}) AS failed, count(*) AS total,
  round(count_if(score < {FAIL_BELOW}) / count(*), 6) AS failure_rate,
  CASE WHEN count_if(score >= {FAIL_BELOW}) = 0 OR count_if(score < {FAIL_BELOW}) / count(*) > 0.5
       THEN 'error' ELSE 'ok' END AS status
FROM results GROUP BY condition""")
def condition_failures(spark, sf_dir):
    """A condition fails when nothing succeeded or more than half failed."""
    r = results(spark, sf_dir)
    ok = F.col("score") >= FAIL_BELOW
    g = r.groupBy("condition").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"),
                                   F.count(F.lit(1)).alias("total"))
    g = g.withColumn("failure_rate", F.col("failed") / F.col("total"))
    g = g.withColumn("status", F.when((F.col("ok") == 0) | (F.col("failure_rate") > 0.5), F.lit("error"))
                     .otherwise(F.lit("ok")))
    return rounded(g)


@reg.add("user_progression", A.with_sql(A.RESULTS_SQL, """ur AS (
  SELECT user_id, round, avg(score) AS mean_score FROM results GROUP BY user_id, round)""") + """
SELECT user_id, round, round(mean_score, 6) AS mean_score, n_rounds, round(delta, 6) AS delta,
  round(delta_from_first, 6) AS delta_from_first
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_rounds,
        mean_score - lag(mean_score) OVER (PARTITION BY user_id ORDER BY round) AS delta,
        mean_score - first_value(mean_score) OVER (PARTITION BY user_id ORDER BY round) AS delta_from_first FROM ur)
WHERE n_rounds > 1""")
def user_progression(spark, sf_dir):
    """Score and change per round of the users with more than one round."""
    per = results(spark, sf_dir).groupBy("user_id", "round").agg(F.avg("score").alias("mean_score"))
    return rounded(X.progression(per).select("user_id", "round", "mean_score", "n_rounds", "delta", "delta_from_first"))


@reg.add("complete_rounds", A.with_sql(A.RESULTS_SQL) + """
SELECT condition, round, round(avg(score), 6) AS score,
  round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k
FROM results GROUP BY condition, round HAVING avg(score) IS NOT NULL
  AND avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) IS NOT NULL""")
def complete_rounds(spark, sf_dir):
    """P25: rounds in which every metric is present."""
    return rounded(X.complete_rounds(with_k(spark, sf_dir), ["condition", "round"], ["score", "k"]))


@reg.add("category_order", A.with_sql(A.RESULTS_SQL, """g AS (SELECT condition, avg(score) AS mean, quantile_cont(score, 0.5) AS median
  FROM results GROUP BY condition)""") + """SELECT condition, round(mean, 6) AS mean, round(median, 6) AS median,
  row_number() OVER (ORDER BY mean DESC, condition) AS by_mean, row_number() OVER (ORDER BY median ASC, condition) AS by_median FROM g""")
def category_order(spark, sf_dir):
    """Conditions by mean and by median."""
    return rounded(X.category_order(results(spark, sf_dir), "condition", "score"))


FIRST_USERS, FIRST_ITEMS = 7, 3


@reg.add("first_items", _R + f"""SELECT user_id, item, place FROM (
  SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY item) AS place FROM results
  WHERE user_id IN (SELECT DISTINCT user_id FROM results ORDER BY user_id LIMIT {FIRST_USERS})) WHERE place <= {FIRST_ITEMS}""")
def first_items(spark, sf_dir):
    """T5: the first items of the first users."""
    f = X.first_per_user(results(spark, sf_dir).select("user_id", "item"), FIRST_USERS, FIRST_ITEMS, ["item"])
    return f.select("user_id", "item", F.col("place").cast("bigint").alias("place"))


@reg.add("initial_vs_peak_complete", A.with_sql(A.RESULTS_SQL, """cr AS (SELECT condition, round, avg(score) AS score,
    avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k FROM results GROUP BY condition, round
  HAVING avg(score) IS NOT NULL AND avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) IS NOT NULL),
g AS (SELECT condition, min(round) AS first_round, arg_min(score, round) AS s0, max(score) AS s1, arg_min(k, round) AS k0, max(k) AS k1
  FROM cr GROUP BY condition)""") + """SELECT condition, first_round, round(s0, 6) AS score_initial, round(s1, 6) AS score_peak,
  round(k0, 6) AS k_initial, round(k1, 6) AS k_peak, round(s1 - s0, 6) AS score_improvement, round(k1 - k0, 6) AS k_improvement FROM g""")
def initial_vs_peak_complete(spark, sf_dir):
    """From the first round that has all metrics."""
    return rounded(X.initial_vs_peak_complete(with_k(spark, sf_dir), ["condition"], ["score", "k"]))


@reg.add("upsert_valid_reflection", _REFL + """SELECT user_id, run_id, iteration, pos, improved_persona, reflection FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, run_id, iteration ORDER BY (pos % 2 = 1) DESC, pos DESC) AS rn FROM (
    SELECT *, CASE WHEN pos % 5 <> 0 THEN 'reflection ' || CAST(pos AS VARCHAR) END AS reflection FROM refl) v
  WHERE reflection IS NOT NULL AND improved_persona IS NOT NULL) t WHERE rn = 1""")
def upsert_valid_reflection(spark, sf_dir):
    """Reflections without one of their texts (every fifth here) are rejected before the upsert."""
    text = F.when(F.col("pos") % 5 != 0, F.concat(F.lit("reflection "), F.col("pos").cast("string")))
    r = reflections(spark, sf_dir).select("user_id", "run_id", "iteration", "pos", "improved_persona", text.alias("reflection"))
    r = X.valid_reflections(r, ["reflection", "improved_persona"])
    out = X.upsert_latest(r.where(F.col("pos") % 2 == 0), r.where(F.col("pos") % 2 == 1), ["user_id", "run_id", "iteration"], ["pos"])
    return out.select("user_id", "run_id", "iteration", "pos", "improved_persona", "reflection")


@reg.add("evaluations_with_runs", _REFL + """, ev AS (SELECT user_id, run_id, avg(score) AS mean_score, count(*) AS items FROM results GROUP BY ALL),
rn AS (SELECT user_id, run_id, arg_min(improved_persona, pos) AS persona, count(*) AS n_reflections FROM refl WHERE pos % 3 = 0 GROUP BY ALL)
SELECT ev.user_id, ev.run_id, round(mean_score, 6) AS mean_score, items, persona, n_reflections
FROM ev LEFT JOIN rn ON rn.user_id = ev.user_id AND rn.run_id = ev.run_id""")
def evaluations_with_runs(spark, sf_dir):
    """Evaluations with their run's persona; a run is known from every third event."""
    ev = results(spark, sf_dir).groupBy("user_id", "run_id").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("items"))
    runs = reflections(spark, sf_dir).where(F.col("pos") % 3 == 0).groupBy("user_id", "run_id").agg(
        F.min_by("improved_persona", "pos").alias("persona"), F.count(F.lit(1)).alias("n_reflections"))
    return rounded(X.join_runs(ev, runs).select("user_id", "run_id", "mean_score", "items", "persona", "n_reflections"))
