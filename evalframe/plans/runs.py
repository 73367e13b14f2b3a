"""Registered queries: run ids, run overviews, coverage and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import analysis as X
from evalframe.operators import runs as R
from evalframe.operators import scoring as S
from evalframe.plans.common import Registry, rounded
from evalframe.plans.sqlgen import pair_scores_sql
from evalframe.sources import adapters as A

reg = Registry()

BASELINE_CONDITIONS = ["no_persona", "generic", "history_only", "best_persona", "control"]
PREFIX = "run_r50_"


# ---------------------------------------------------------------------------
# run ids seen in the data: pair runs, event rounds, baseline conditions, imitation files
# ---------------------------------------------------------------------------

def all_run_ids(spark, sf_dir):
    pairs = A.pairs_from_conversations(spark, sf_dir).select("run_id")
    res = A.results_from_events(spark, sf_dir).select("run_id")
    ev = A.table(spark, sf_dir, "events")
    cond = F.element_at(F.array(*[F.lit(c) for c in BASELINE_CONDITIONS]),
                        (F.col("user_id") % len(BASELINE_CONDITIONS) + 1).cast("int"))
    base = ev.select(F.concat(F.lit("baseline_"), cond, F.lit("_2024010"),
                              (F.col("user_id") % 9 + 1).cast("string"), F.lit("_120000")).alias("run_id"))
    docs = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("imitations_"), F.col("source")).alias("run_id"))
    return pairs.unionByName(res).unionByName(base).unionByName(docs).distinct()


_COND_LIST = "[" + ", ".join(f"'{c}'" for c in BASELINE_CONDITIONS) + "]"
RUN_IDS_SQL = A.with_sql(A.PAIRS_SQL, A.RESULTS_SQL) + f""", ids AS (
  SELECT run_id FROM pairs UNION SELECT run_id FROM results
  UNION SELECT 'baseline_' || {_COND_LIST}[user_id % {len(BASELINE_CONDITIONS)} + 1] || '_2024010'
     || CAST(user_id % 9 + 1 AS VARCHAR) || '_120000' FROM events
  UNION SELECT 'imitations_' || source FROM documents)
"""


@reg.add("run_id_parse", RUN_IDS_SQL + """SELECT run_id,
  coalesce(CASE WHEN len(string_split(run_id, '_round_')) > 1 THEN TRY_CAST(string_split(run_id, '_round_')[2] AS INTEGER) END, 0) AS round_after,
  coalesce(TRY_CAST(regexp_extract(run_id, 'round_(\\d+)', 1) AS INTEGER), 1) AS round_regex,
  regexp_replace(run_id, '_round_\\d+$', '') AS base_run
FROM ids""")
def run_id_parse(spark, sf_dir):
    ids = all_run_ids(spark, sf_dir)
    r = F.col("run_id")
    return ids.select("run_id", R.round_after_marker(r).alias("round_after"),
                      R.round_from_regex(r).alias("round_regex"), R.base_run(r).alias("base_run"))


def _run_type_sql(c: str) -> str:
    e = "'other'"
    for p in R.RUN_TYPE_PATTERNS:
        e = f"CASE WHEN contains({c}, '{p}') THEN '{p}' ELSE {e} END"
    return e


@reg.add("run_types", RUN_IDS_SQL + f"SELECT run_id, {_run_type_sql('run_id')} AS run_type FROM ids")
def run_types(spark, sf_dir):
    return all_run_ids(spark, sf_dir).select("run_id", R.run_type(F.col("run_id")).alias("run_type"))


def _cond_sql(c: str) -> str:
    arms = " ".join(f"WHEN contains({c}, '{k}') THEN '{k}'" for k in R.CONDITION_KEYS)
    return f"CASE {arms} END"


def _label_sql(c: str) -> str:
    arms = " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in R.CONDITION_LABELS.items())
    return f"CASE {arms} END"


@reg.add("condition_map", RUN_IDS_SQL + f"""SELECT * FROM (SELECT run_id, {_cond_sql('run_id')} AS condition,
  nullif(regexp_extract(run_id, '{R.CONDITION_REGEX}', 1), '') AS condition_regex,
  {_label_sql("nullif(regexp_extract(run_id, '" + R.CONDITION_REGEX + "', 1), '')")} AS label FROM ids) t
WHERE label IS NOT NULL""")
def condition_map(spark, sf_dir):
    ids = all_run_ids(spark, sf_dir)
    r = F.col("run_id")
    out = ids.select("run_id", R.condition_of(r).alias("condition"),
                     R.condition_by_regex(r).alias("condition_regex"))
    out = out.withColumn("label", R.condition_label(F.col("condition_regex")))
    return out.where(F.col("label").isNotNull())


# ---------------------------------------------------------------------------
# generations per run (imitations vs item scores of the pair runs)
# ---------------------------------------------------------------------------

def overview(spark, sf_dir):
    p = A.pairs_from_conversations(spark, sf_dir).select("run_id", "index")
    gens = R.generations(p, p.where(F.col("index") % 3 != 0))
    return R.run_overview(gens)


_GEN_SQL = A.with_sql(A.PAIRS_SQL) + f""", gens AS (
  SELECT run_id, count(*) AS generations, 'imitations' AS source FROM pairs GROUP BY run_id
  UNION ALL SELECT run_id, count(*), 'item_scores' FROM pairs WHERE "index" % 3 <> 0 GROUP BY run_id),
ov AS (SELECT run_id, max(generations) AS generations,
    arg_min(source, (-generations, source)) AS source,
    coalesce(TRY_CAST(regexp_extract(run_id, 'round_(\\d+)', 1) AS INTEGER), 1) AS rounds,
    regexp_replace(run_id, '_round_\\d+$', '') AS base_run,
    {_run_type_sql('run_id')} AS run_type FROM gens GROUP BY run_id)
"""


@reg.add("run_overview", _GEN_SQL + "SELECT * FROM ov")
def run_overview(spark, sf_dir):
    return overview(spark, sf_dir)


@reg.add("base_run_overview", _GEN_SQL + """SELECT base_run, min(rounds) AS min_round, max(rounds) AS max_round,
  count(rounds) AS num_runs, arg_min(generations, run_id) AS gens_per_run,
  CAST(sum(generations) AS BIGINT) AS total_gens FROM ov GROUP BY base_run""")
def base_run_overview(spark, sf_dir):
    return R.base_run_overview(overview(spark, sf_dir))


@reg.add("run_type_stats", _GEN_SQL + """SELECT run_type, count(generations) AS num_runs,
  CAST(sum(generations) AS BIGINT) AS total_gens, round(avg(generations), 2) AS mean_gens,
  round(median(generations), 2) AS median_gens, round(stddev_samp(generations), 2) AS std_gens,
  min(generations) AS min_gens, max(generations) AS max_gens FROM ov GROUP BY run_type""")
def run_type_stats(spark, sf_dir):
    return rounded(R.stats_by(overview(spark, sf_dir), "run_type", "generations"))


@reg.add("generation_distribution", _GEN_SQL + """SELECT generations, count(*) AS runs,
  CAST(sum(generations) AS BIGINT) AS total_generations FROM ov GROUP BY generations""")
def generation_distribution(spark, sf_dir):
    return overview(spark, sf_dir).groupBy("generations").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("generations").alias("total_generations"))


@reg.add("run_ids_by_prefix", RUN_IDS_SQL + f"SELECT run_id FROM ids WHERE starts_with(run_id, '{PREFIX}')")
def run_ids_by_prefix(spark, sf_dir):
    """Distinct run ids with a prefix (union of all run id sources)."""
    return all_run_ids(spark, sf_dir).where(F.col("run_id").startswith(PREFIX)).orderBy("run_id")


# ---------------------------------------------------------------------------
# coverage: documents are runs of their source, labels are evaluations
# ---------------------------------------------------------------------------

def doc_runs(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("user_id"), F.concat(F.lit("run_"), F.col("doc_id").cast("string"))
                    .alias("run_id"), "doc_id", "text", "n_chars")


def label_evals(spark, sf_dir):
    lab = A.table(spark, sf_dir, "labels")
    return lab.select(F.concat(F.lit("run_"), F.col("doc_id").cast("string")).alias("run_id"), "quality", "toxic")


@reg.add("runs_without_eval", """SELECT source AS user_id, 'run_' || CAST(doc_id AS VARCHAR) AS run_id
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def runs_without_eval(spark, sf_dir):
    return R.runs_without_evaluation(doc_runs(spark, sf_dir), label_evals(spark, sf_dir), ["run_id"]) \
        .select("user_id", "run_id")


@reg.add("runs_with_eval", """SELECT source AS user_id, count(*) AS evaluated_runs
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source""")
def runs_with_eval(spark, sf_dir):
    j = R.with_evaluation(doc_runs(spark, sf_dir), label_evals(spark, sf_dir), ["run_id"])
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("evaluated_runs"))


_PER_USER_SQL = """pu AS (SELECT d.source AS user_id,
    count_if(d.doc_id IS NULL) AS missing_ids,
    count_if(d.doc_id % 2 = 0) AS history, count_if(d.doc_id % 2 = 1) AS holdout,
    count_if(l.doc_id IS NULL) AS runs_without_eval,
    count(*) - count(DISTINCT md5(d.text)) AS duplicate_ids,
    count_if(d.n_chars < 20) AS empty_personas
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source),
chk AS (SELECT *, list_filter([CASE WHEN missing_ids > 0 THEN 'missing tweet ids' END,
    CASE WHEN history = 0 THEN 'empty history' END, CASE WHEN holdout = 0 THEN 'empty holdout' END,
    CASE WHEN runs_without_eval > 0 THEN 'runs without evaluation' END,
    CASE WHEN duplicate_ids > 0 THEN 'duplicate tweet ids' END,
    CASE WHEN empty_personas > 0 THEN 'empty personas' END], lambda x: x IS NOT NULL) AS issues FROM pu)
"""


def per_user_checks(spark, sf_dir):
    runs = doc_runs(spark, sf_dir)
    ev = label_evals(spark, sf_dir).select("run_id", F.lit(True).alias("_has"))
    j = runs.join(ev, "run_id", "left")
    pu = j.groupBy("user_id").agg(
        F.count_if(F.col("doc_id").isNull()).alias("missing_ids"),
        F.count_if(F.col("doc_id") % 2 == 0).alias("history"),
        F.count_if(F.col("doc_id") % 2 == 1).alias("holdout"),
        F.count_if(F.col("_has").isNull()).alias("runs_without_eval"),
        (F.count(F.lit(1)) - F.countDistinct(F.md5("text"))).alias("duplicate_ids"),
        F.count_if(F.col("n_chars") < 20).alias("empty_personas"))
    return R.integrity(pu)


@reg.add("integrity", "WITH " + _PER_USER_SQL + """SELECT user_id, missing_ids, history, holdout, runs_without_eval,
  duplicate_ids, empty_personas, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS valid FROM chk""")
def integrity(spark, sf_dir):
    c = per_user_checks(spark, sf_dir)
    return c.withColumn("issues", F.array_join("issues", "; "))


@reg.add("common_issues", "WITH " + _PER_USER_SQL + """SELECT issue, count(*) AS users FROM (
  SELECT unnest(issues) AS issue FROM chk) t GROUP BY issue ORDER BY users DESC, issue LIMIT 10""")
def common_issues(spark, sf_dir):
    return R.common_issues(per_user_checks(spark, sf_dir))


_COVERAGE_SQL = """cov AS (SELECT d.source AS user_id, count(l.doc_id) AS n_evaluations,
    count_if(l.quality = 1) AS n_with_metric,
    max(CASE WHEN l.quality = 1 THEN d.n_chars END) AS best_value,
    arg_max(CASE WHEN l.quality = 1 THEN 'run_' || CAST(d.doc_id AS VARCHAR) END,
            CASE WHEN l.quality = 1 THEN {'n': d.n_chars, 'first': -d.doc_id} END) AS best_run
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source),
cs AS (SELECT *, CASE WHEN n_evaluations = 0 THEN 'no_evaluations' WHEN n_with_metric = 0 THEN 'no_bertscore'
    ELSE 'success' END AS status FROM cov)
"""


def coverage(spark, sf_dir):
    """Per-user metric coverage status, best value and best run."""
    runs = doc_runs(spark, sf_dir)
    j = runs.join(label_evals(spark, sf_dir), "run_id", "left")
    ok = F.col("quality") == 1
    g = j.groupBy("user_id").agg(
        F.count("quality").alias("n_evaluations"), F.count_if(ok).alias("n_with_metric"),
        F.max(F.when(ok, F.col("n_chars"))).alias("best_value"),
        F.max_by(F.when(ok, F.col("run_id")), F.when(ok, F.struct(F.col("n_chars"), -F.col("doc_id"))))
        .alias("best_run"))
    status = (F.when(F.col("n_evaluations") == 0, F.lit("no_evaluations"))
               .when(F.col("n_with_metric") == 0, F.lit("no_bertscore")).otherwise(F.lit("success")))
    return g.withColumn("status", status)


@reg.add("metric_coverage", "WITH " + _COVERAGE_SQL + """SELECT user_id, status, n_evaluations, n_with_metric,
  best_value, best_run FROM cs""")
def metric_coverage(spark, sf_dir):
    return coverage(spark, sf_dir).select("user_id", "status", "n_evaluations", "n_with_metric",
                                          "best_value", "best_run")


@reg.add("coverage_status_counts", "WITH " + _COVERAGE_SQL + "SELECT status, count(*) AS users FROM cs GROUP BY status")
def coverage_status_counts(spark, sf_dir):
    return coverage(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("users"))


# ---------------------------------------------------------------------------
# metric presence of the pair evaluations (P20) and run id correction
# ---------------------------------------------------------------------------

def presence(spark, sf_dir):
    """Which metric objects each pair evaluation holds: the strategy's metric
    list; all-metrics runs logged a different subset in each round."""
    p = A.pairs_from_conversations(spark, sf_dir)
    g = p.groupBy("user_id", "run_id").agg(F.count(F.lit(1)).alias("items"))
    r = F.col("run_id")
    rnd = R.round_from_regex(r)
    allm = r.contains("all_metrics")
    return g.select(
        "user_id", "run_id", "items",
        ((allm & rnd.isin(1, 2, 3)) | r.contains("rouge_1")).alias("has_rouge"),
        ((allm & rnd.isin(1, 2, 4)) | r.contains("bleu_only")).alias("has_bleu"),
        ((allm & rnd.isin(1, 4)) | r.contains("perplexity_only")).alias("has_perplexity"),
        ((allm & (rnd == 1)) | r.contains("bertscore")).alias("has_bertscore"))


_PRESENCE_SQL = A.with_sql(A.PAIRS_SQL) + """, g AS (SELECT user_id, run_id, count(*) AS items,
    coalesce(TRY_CAST(regexp_extract(run_id, 'round_(\\d+)', 1) AS INTEGER), 1) AS rnd,
    contains(run_id, 'all_metrics') AS allm FROM pairs GROUP BY ALL),
pres AS (SELECT user_id, run_id, items,
    (allm AND rnd IN (1, 2, 3)) OR contains(run_id, 'rouge_1') AS has_rouge,
    (allm AND rnd IN (1, 2, 4)) OR contains(run_id, 'bleu_only') AS has_bleu,
    (allm AND rnd IN (1, 4)) OR contains(run_id, 'perplexity_only') AS has_perplexity,
    (allm AND rnd = 1) OR contains(run_id, 'bertscore') AS has_bertscore FROM g),
ms AS (SELECT *, list_filter([CASE WHEN has_bertscore THEN 'bertscore' END, CASE WHEN has_bleu THEN 'bleu' END,
    CASE WHEN has_perplexity THEN 'perplexity' END, CASE WHEN has_rouge THEN 'rouge' END],
    lambda x: x IS NOT NULL) AS metrics FROM pres)
"""


def _fix_sql() -> str:
    e = "replace(run_id, 'all_metrics', array_to_string(metrics, '_'))"
    for ms, name in reversed(R.RUN_ID_FIXES):
        e = (f"CASE WHEN array_to_string(metrics, ',') = '{','.join(sorted(ms))}' "
             f"THEN replace(run_id, 'all_metrics', '{name}') ELSE {e} END")
    return f"CASE WHEN array_to_string(metrics, ',') = '{','.join(R.ALL_METRICS)}' THEN run_id ELSE {e} END"


@reg.add("run_id_correction", _PRESENCE_SQL + f"""SELECT user_id, run_id, array_to_string(metrics, ',') AS metrics,
  {_fix_sql()} AS corrected_run_id FROM ms""")
def run_id_correction(spark, sf_dir):
    p = presence(spark, sf_dir)
    m = R.metric_set({"rouge": F.col("has_rouge"), "bleu": F.col("has_bleu"),
                      "perplexity": F.col("has_perplexity"), "bertscore": F.col("has_bertscore")})
    p = p.withColumn("_m", m)
    return p.select("user_id", "run_id", F.array_join("_m", ",").alias("metrics"),
                    R.corrected_run_id(F.col("run_id"), F.col("_m")).alias("corrected_run_id"))


@reg.add("metric_audit", _PRESENCE_SQL + """SELECT CASE WHEN contains(run_id, 'all_metrics') THEN 'all_metrics'
  ELSE 'single' END AS kind, count(*) AS evaluations, count_if(has_bertscore) AS with_bertscore,
  count_if(NOT has_bertscore) AS without_bertscore, count_if(NOT has_bertscore AND items > 0) AS needs_backfill,
  count_if(has_rouge) AS with_rouge, count_if(has_bleu) AS with_bleu, count_if(has_perplexity) AS with_perplexity
FROM ms GROUP BY ALL""")
def metric_audit(spark, sf_dir):
    """Metric availability and reconstruction need per kind of run."""
    p = presence(spark, sf_dir)
    kind = F.when(F.col("run_id").contains("all_metrics"), F.lit("all_metrics")).otherwise(F.lit("single"))
    return p.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("evaluations"), F.count_if("has_bertscore").alias("with_bertscore"),
        F.count_if(~F.col("has_bertscore")).alias("without_bertscore"),
        F.count_if(~F.col("has_bertscore") & (F.col("items") > 0)).alias("needs_backfill"),
        F.count_if("has_rouge").alias("with_rouge"), F.count_if("has_bleu").alias("with_bleu"),
        F.count_if("has_perplexity").alias("with_perplexity"))


def data_report(spark, sf_dir) -> dict:
    """The full data report as a dict of DataFrames (run ids, integrity,
    most common issues, coverage) -- each one a distributed query."""
    return {"run_ids": all_run_ids(spark, sf_dir), "integrity": per_user_checks(spark, sf_dir),
            "common_issues": R.common_issues(per_user_checks(spark, sf_dir)),
            "coverage": coverage(spark, sf_dir)}


@reg.add("data_report_summary", "WITH " + _PER_USER_SQL + """, ru AS (SELECT count(*) AS runs,
    count_if(doc_id IN (SELECT doc_id FROM labels)) AS evaluated_runs FROM documents)
SELECT count(*) AS users, count_if(len(issues) = 0) AS valid_users, count_if(len(issues) > 0) AS invalid_users,
  (SELECT runs FROM ru) AS runs, (SELECT evaluated_runs FROM ru) AS evaluated_runs FROM chk""")
def data_report_summary(spark, sf_dir):
    """A46 headline: users, valid / invalid users, runs and evaluated runs."""
    chk = per_user_checks(spark, sf_dir)
    u = chk.agg(F.count(F.lit(1)).alias("users"), F.count_if("valid").alias("valid_users"),
                F.count_if(~F.col("valid")).alias("invalid_users"))
    r = doc_runs(spark, sf_dir).join(label_evals(spark, sf_dir).select("run_id", F.lit(1).alias("_e")),
                                     "run_id", "left") \
        .agg(F.count(F.lit(1)).alias("runs"), F.count("_e").alias("evaluated_runs"))
    # both sides are one-row global aggregates: the second enters as a scalar subquery
    rs = r.select(F.struct("runs", "evaluated_runs").alias("s")).scalar()
    return u.select("*", rs["runs"].alias("runs"), rs["evaluated_runs"].alias("evaluated_runs"))


# ---------------------------------------------------------------------------
# valid evaluations, largest runs, run ids by list and by substring
# ---------------------------------------------------------------------------

_F1_SQL = "WITH " + pair_scores_sql(A.PAIRS_SQL) + ", " + A.RESULTS_SQL + """, ev AS (
  SELECT user_id, run_id, avg(rouge1) AS f1 FROM sc GROUP BY ALL
  UNION ALL SELECT user_id, run_id, avg(score) AS f1 FROM results GROUP BY ALL),
va AS (SELECT *, contains(run_id, 'run_r50_') AND contains(run_id, '_round_')
  AND NOT contains(run_id, 'baseline_') AND f1 IS NOT NULL AS valid FROM ev)
"""


def run_f1(spark, sf_dir):
    """Mean F1 (ROUGE-1) of each scored pair run, mean score of each event run, and whether it is valid."""
    pairs = S.score_pairs(A.pairs_from_conversations(spark, sf_dir), metrics=["rouge"], rouge_l=False)
    f1 = pairs.groupBy("user_id", "run_id").agg(F.avg("rouge1").alias("f1"))
    res = A.results_from_events(spark, sf_dir).groupBy("user_id", "run_id").agg(F.avg("score").alias("f1"))
    return f1.unionByName(res).withColumn("valid", R.valid_evaluation(F.col("run_id"), F.col("f1")))


@reg.add("valid_evaluations", _F1_SQL + "SELECT user_id, run_id, round(f1, 6) AS f1, valid FROM va")
def valid_evaluations(spark, sf_dir):
    """P22 over all evaluations: the scored pair runs and the event runs."""
    return rounded(run_f1(spark, sf_dir))


@reg.add("best_valid_round", _F1_SQL + """SELECT user_id, run_id, best_round, round(f1, 6) AS best_value FROM (
  SELECT *, coalesce(TRY_CAST(regexp_extract(run_id, 'round_(\\d+)', 1) AS INTEGER), 1) AS best_round,
    row_number() OVER (PARTITION BY user_id ORDER BY f1 DESC, coalesce(TRY_CAST(regexp_extract(run_id, 'round_(\\d+)', 1) AS INTEGER), 1), run_id) AS rn
  FROM va WHERE valid AND f1 > 0) WHERE rn = 1""")
def best_valid_round(spark, sf_dir):
    """W5 behind P22: each user's best round by F1 among the valid evaluations."""
    ok = run_f1(spark, sf_dir).where(F.col("valid") & (F.col("f1") > 0)).withColumn("best_round", R.round_from_regex(F.col("run_id")))
    best = X.argmax_per_group(ok, ["user_id"], "f1", ["best_round", "run_id"])
    return rounded(best.select("user_id", "run_id", "best_round", F.col("f1").alias("best_value")))


# ---------------------------------------------------------------------------
# evaluations as stored: the runs' own scores as JSON, in the layouts that occur
# ---------------------------------------------------------------------------

# overall object and first item by kind of run; %1$s, %2$s, %3$s: ROUGE-1, ROUGE-2, BLEU
EVALUATIONS = {
    "all_metrics_round_1": ('{"rouge": {"rouge1": %1$s, "rouge2": %2$s, "rougeL": %1$s}, "bleu": {"bleu": %3$s}, "perplexity": {"mean": 9.5}, '
                            '"bertscore": {"f1": 0.5}}', '{}'),
    "all_metrics_round_2": ('{"rouge_1": %1$s, "rouge_2": {"score": %2$s}, "rouge": {"rouge1": 0.25}, "bleu": %3$s}', '{"rouge": {}}'),
    "all_metrics_round_3": ('{"rouge": {"rouge1": %1$s}, "bleu": {}}', '{"bleu": 0}'),
    "all_metrics_round_4": ('{}', '{"bleu": {"bleu": %3$s}, "perplexity": null, "rouge": {}}'),
    "rouge_1": ('{"rouge_1": {"score": %1$s}, "rouge_l": "%2$s"}', '{"rouge": {"rouge1": %1$s}}'),
    "bleu_only": ('{"bleu": {"score": %3$s}, "rouge": null}', '{}'),
    "perplexity_only": ('{"perplexity": null}', '{}'),
    "bertscore": ('{"bertscore": {"f1": 0.5}, "rouge": []}', '{}'),
}


def _evaluation(part, otherwise, fill):
    out = otherwise
    for kind, texts in reversed(EVALUATIONS.items()):
        out = fill(kind, '{"overall": ' + texts[0] + ', "individual_scores": [' + texts[1] + ']}', out)
    return out


def evaluations(spark, sf_dir):
    """(user_id, run_id, items, evaluation): one stored evaluation (JSON) per pair run."""
    sc = S.score_pairs(A.pairs_from_conversations(spark, sf_dir), rouge_l=False)
    g = sc.groupBy("user_id", "run_id").agg(F.count(F.lit(1)).alias("items"), *[F.avg(m).alias(m) for m in ("rouge1", "rouge2", "bleu")])
    n = [F.format_string("%.9f", F.coalesce(F.col(m), F.lit(0.0))) for m in ("rouge1", "rouge2", "bleu")]

    def fill(kind, text, rest):
        for i, c in enumerate(n):
            text = F.replace(F.lit(text) if isinstance(text, str) else text, F.lit(f"%{i + 1}$s"), c)
        return F.when(F.col("run_id").contains(kind), text).otherwise(rest)

    return g.select("user_id", "run_id", "items", _evaluation(EVALUATIONS, F.lit('{"overall": {}}'), fill).alias("evaluation"))


def _fill_sql(kind, text, rest):
    text = "'" + text + "'"
    for i, c in enumerate(("rouge1", "rouge2", "bleu")):
        text = f"replace({text}, '%{i + 1}$s', printf('%.9f', coalesce({c}, 0.0)))"
    return f"CASE WHEN contains(run_id, '{kind}') THEN {text} ELSE {rest} END"


def _filled_sql(path: str) -> str:
    v = f"CAST(json_extract(e, '{path}') AS VARCHAR)"
    return f"coalesce({v} NOT IN ('', 'null', 'false', '{{}}', '[]', '\"\"') AND coalesce(TRY_CAST({v} AS DOUBLE), 1.0) <> 0, false)"


_HAS = {m: " OR ".join(_filled_sql(p + m) if m in ("rouge", "bleu") else f"json_exists(e, '{p + m}')"
                       for p in ("$.overall.", "$.individual_scores[0].")) for m in R.ALL_METRICS}
_EVAL_SQL = "WITH " + pair_scores_sql(A.PAIRS_SQL) + f""", g AS (SELECT user_id, run_id, count(*) AS items, avg(rouge1) AS rouge1,
    avg(rouge2) AS rouge2, avg(bleu) AS bleu FROM sc GROUP BY ALL),
ev AS (SELECT user_id, run_id, items, CAST({_evaluation(EVALUATIONS, "'{\"overall\": {}}'", _fill_sql)} AS JSON) AS e FROM g),
md AS (SELECT user_id, run_id, items, e, list_filter([{', '.join(f"CASE WHEN {c} THEN '{m}' END" for m, c in _HAS.items())}],
  lambda x: x IS NOT NULL) AS metrics FROM ev),
fx AS (SELECT *, CASE WHEN contains(run_id, 'run_r50_all_metrics') THEN {_fix_sql()} ELSE run_id END AS corrected_run_id FROM md)
"""


@reg.add("metric_detection", _EVAL_SQL + """SELECT user_id, run_id, items, array_to_string(metrics, ',') AS metrics, corrected_run_id FROM fx""")
def metric_detection(spark, sf_dir):
    """P20 + P21 on stored evaluations: what each really holds, and the id that follows."""
    e = evaluations(spark, sf_dir)
    fixed = R.metric_corrections(e)
    return fixed.join(e.select("user_id", "run_id", "items"), ["user_id", "run_id"]).select(
        "user_id", "run_id", "items", F.array_join("metrics", ",").alias("metrics"), "corrected_run_id")


@reg.add("metric_key_audit", _EVAL_SQL + """SELECT kind, key, count(*) AS evaluations FROM (
  SELECT CASE WHEN contains(run_id, 'all_metrics') THEN 'all_metrics' ELSE 'single' END AS kind,
    unnest(json_keys(e, '$.overall')) AS key FROM ev) GROUP BY ALL""")
def metric_key_audit(spark, sf_dir):
    """How many evaluations of each kind of run have each key in their overall object."""
    e = evaluations(spark, sf_dir)
    kind = F.when(F.col("run_id").contains("all_metrics"), F.lit("all_metrics")).otherwise(F.lit("single"))
    keys = e.select(kind.alias("kind"), F.explode(F.map_keys(R.overall_object(F.col("evaluation")))).alias("key"))
    return keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("evaluations"))


def _layout_sql(m: str) -> str:
    paths = [f"$.overall.{k}" + (f".{part}" if part else "") for k, part in R.SCORE_LAYOUTS[m]]
    return "coalesce(" + ", ".join(f"TRY_CAST(json_extract_string(e, '{p}') AS DOUBLE)" for p in paths) + ", 0.0)"


@reg.add("score_layouts", _EVAL_SQL + f"""SELECT user_id, base_run, {', '.join(f'round({m}, 6) AS {m}' for m in R.SCORE_LAYOUTS)}, evaluation_count,
  round((bleu + rouge_1 + rouge_2 + rouge_l) / 4, 6) AS combined FROM (
  SELECT user_id, regexp_replace(run_id, '_round_\\d+$', '') AS base_run, {', '.join(f'avg({_layout_sql(m)}) AS {m}' for m in R.SCORE_LAYOUTS)},
    count(*) AS evaluation_count FROM ev GROUP BY ALL)""")
def score_layouts(spark, sf_dir):
    """Mean BLEU and ROUGE-1/2/L per user and base run over all score layouts, and their common mean."""
    e = evaluations(spark, sf_dir).withColumn("base_run", R.base_run(F.col("run_id")))
    return rounded(R.user_score_means(e, ["user_id", "base_run"]))


@reg.add("reflection_run_fix", _EVAL_SQL + """SELECT c.user_id, coalesce(f.corrected_run_id, c.run_id) AS run_id, c.item, c.run_id AS original_run_id
FROM (SELECT user_id, run_id, "index" AS item FROM pairs
  UNION ALL SELECT CAST(user_id AS VARCHAR), 'baseline_' || event_type, event_id FROM events) c
LEFT JOIN fx f ON f.user_id = c.user_id AND f.run_id = c.run_id""")
def reflection_run_fix(spark, sf_dir):
    """Reflections (one per item) follow the corrected id of their own run; event runs have no evaluation."""
    pairs = A.pairs_from_conversations(spark, sf_dir).select("user_id", "run_id", F.col("index").alias("item"))
    ev = A.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.concat(
        F.lit("baseline_"), F.col("event_type")).alias("run_id"), F.col("event_id").alias("item"))
    return R.move_reflections(pairs.unionByName(ev), R.metric_corrections(evaluations(spark, sf_dir)))


@reg.add("coverage_statuses", _EVAL_SQL + """, us AS (SELECT DISTINCT user_id FROM pairs UNION SELECT DISTINCT CAST(user_id AS VARCHAR) FROM events),
cv AS (SELECT user_id, count(*) AS n_evaluations, count(*) FILTER (WHERE contains(run_id, 'all_metrics_round_')) AS n_matching,
  count(*) FILTER (WHERE contains(run_id, 'all_metrics_round_') AND list_contains(metrics, 'bertscore')) AS n_with_metric FROM md GROUP BY user_id)
SELECT us.user_id, coalesce(n_evaluations, 0) AS n_evaluations, coalesce(n_matching, 0) AS n_matching, coalesce(n_with_metric, 0) AS n_with_metric,
  CASE WHEN coalesce(n_evaluations, 0) = 0 THEN 'no_evaluations' WHEN n_matching = 0 THEN 'no_matching_runs'
    WHEN n_with_metric = 0 THEN 'no_bertscore' ELSE 'success' END AS status FROM us LEFT JOIN cv ON cv.user_id = us.user_id""")
def coverage_statuses(spark, sf_dir):
    """A29 on stored evaluations: every user of the pairs and the events."""
    users = A.pairs_from_conversations(spark, sf_dir).select("user_id").unionByName(
        A.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id")))
    c = R.coverage_status(users, evaluations(spark, sf_dir), "all_metrics_round_")
    return c.select("user_id", "n_evaluations", "n_matching", "n_with_metric", "status")


@reg.add("top_runs", A.with_sql(A.PAIRS_SQL) + """SELECT run_id, count(*) AS generations FROM pairs
  GROUP BY run_id ORDER BY generations DESC, run_id LIMIT 5""")
def top_runs(spark, sf_dir):
    """T4: the five runs with most generations."""
    return R.top_runs(A.pairs_from_conversations(spark, sf_dir).select("run_id"), 5)


@reg.add("run_ids_selected", RUN_IDS_SQL + f"""SELECT run_id, 'list' AS chosen_by FROM ids
  WHERE run_id IN ('imitations_src0', 'imitations_src1', 'no_such_run')
UNION ALL SELECT run_id, 'substring' AS chosen_by FROM ids WHERE contains(run_id, '_round_1')""")
def run_ids_selected(spark, sf_dir):
    """Run ids from a list and by substring."""
    ids = all_run_ids(spark, sf_dir)
    by_list = R.runs_in(ids, wanted=["imitations_src0", "imitations_src1", "no_such_run"])
    return (by_list.withColumn("chosen_by", F.lit("list"))
            .unionByName(R.runs_in(ids, part="_round_1").withColumn("chosen_by", F.lit("substring"))))
