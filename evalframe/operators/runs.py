"""Run ids, run overviews, coverage and integrity audits
(P13-P21, J3, J5, J6, J9, A2-A6, A26-A32, U2, U3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators.skew import lookup_join, null_safe_join, quantiles

# Run-type patterns, fixed values; a later pattern overrides an earlier one.
RUN_TYPE_PATTERNS = ["bleu_only", "perplexity_only", "all_metrics", "rouge_only", "imitations"]
# Condition keys in their fixed lookup order (first contained key wins).
CONDITION_KEYS = ["no_persona", "generic", "history_only", "best_persona"]
CONDITION_REGEX = r"(best_persona|generic|no_persona|history_only)"
# Display labels of the conditions, fixed values.
CONDITION_LABELS = {"no_persona": "No-Persona", "generic": "Generic-Persona",
                    "history_only": "History-Only", "best_persona": "Best-Persona"}
ALL_METRICS = ["bertscore", "bleu", "perplexity", "rouge"]
# Named corrections of an "all_metrics" run id by the metric set found, fixed values.
RUN_ID_FIXES = [
    (("rouge",), "rouge_only"),
    (("bleu",), "bleu_only"),
    (("perplexity",), "perplexity_only"),
    (("bleu", "rouge"), "rouge_bleu"),
    (("perplexity", "rouge"), "rouge_perplexity"),
    (("bleu", "perplexity"), "bleu_perplexity"),
]


def round_after_marker(run_id: Column, missing: int | None = 0) -> Column:
    """P14 rule 1: integer after the first ``_round_``; absent or invalid ->
    ``missing`` (the reference's "or 0" variant; pass None to drop later)."""
    part = F.element_at(F.split(run_id, "_round_"), 2)
    r = F.when(F.size(F.split(run_id, "_round_")) > 1, part.try_cast("int"))
    return r if missing is None else F.coalesce(r, F.lit(missing))


def round_from_regex(run_id: Column, default: int = 1) -> Column:
    """P14 rule 2: ``round_(\\d+)`` anywhere, default 1."""
    return F.coalesce(F.regexp_extract(run_id, r"round_(\d+)", 1).try_cast("int"), F.lit(default))


def base_run(run_id: Column) -> Column:
    """Strip a trailing ``_round_N``."""
    return F.regexp_replace(run_id, r"_round_\d+$", "")


def run_type(run_id: Column) -> Column:
    """The last matching pattern wins, default 'other'."""
    e = F.lit("other")
    for p in RUN_TYPE_PATTERNS:
        e = F.when(run_id.contains(p), F.lit(p)).otherwise(e)
    return e


def condition_of(run_id: Column) -> Column:
    """First contained condition key in fixed order (null when none)."""
    e = F.lit(None).cast("string")
    for k in reversed(CONDITION_KEYS):
        e = F.when(run_id.contains(k), F.lit(k)).otherwise(e)
    return e


def condition_by_regex(run_id: Column) -> Column:
    """P17 regex variant: leftmost match of the alternation."""
    return F.nullif(F.regexp_extract(run_id, CONDITION_REGEX, 1), F.lit(""))


def condition_label(cond: Column) -> Column:
    """Code -> label (null for unmapped; callers drop those rows)."""
    e = F.lit(None).cast("string")
    for k, v in CONDITION_LABELS.items():
        e = F.when(cond == k, F.lit(v)).otherwise(e)
    return e


def corrected_run_id(run_id: Column, metrics: Column) -> Column:
    """Rename an ``all_metrics`` run after the metric set actually found
    (``metrics`` = sorted array of metric names)."""
    e = F.replace(run_id, F.lit("all_metrics"), F.array_join(metrics, "_"))
    for ms, name in reversed(RUN_ID_FIXES):
        e = F.when(F.array_join(metrics, ",") == ",".join(sorted(ms)),
                   F.replace(run_id, F.lit("all_metrics"), F.lit(name))).otherwise(e)
    return F.when(F.array_join(metrics, ",") == ",".join(ALL_METRICS), run_id).otherwise(e)


def metric_set(flags: dict[str, Column]) -> Column:
    """P20: sorted array of the metric names whose flag is true."""
    return F.array_compact(F.array(*[F.when(flags[m], F.lit(m)) for m in sorted(flags)]))


def generations(imitations: DataFrame, item_scores: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A2: generations per run from two sources (imitations, item scores)."""
    a = imitations.groupBy(run_col).agg(F.count(F.lit(1)).alias("generations")) \
        .withColumn("source", F.lit("imitations"))
    b = item_scores.groupBy(run_col).agg(F.count(F.lit(1)).alias("generations")) \
        .withColumn("source", F.lit("item_scores"))
    return a.unionByName(b)


def run_overview(gens: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A3: per run keep the source row with most generations (ties: source asc)."""
    g = gens.groupBy(run_col).agg(F.max("generations").alias("generations"),
                                  F.min_by("source", F.struct(-F.col("generations"), F.col("source")))
                                  .alias("source"))
    return g.select(run_col, "generations", "source", round_from_regex(F.col(run_col)).alias("rounds"),
                    base_run(F.col(run_col)).alias("base_run"), run_type(F.col(run_col)).alias("run_type"))


def base_run_overview(overview: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A4: per base run: rounds min/max/count, generations of the first run id
    and their sum, number of runs."""
    return overview.groupBy("base_run").agg(
        F.min("rounds").alias("min_round"), F.max("rounds").alias("max_round"),
        F.count("rounds").alias("num_runs"),
        F.min_by("generations", run_col).alias("gens_per_run"),
        F.sum("generations").alias("total_gens"))


def stats_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """A5: count, sum, mean, median, sample std, min, max (rounded to 2)."""
    v = F.col(value)
    g = df.groupBy(group).agg(
        F.count(v).alias("num_runs"), F.sum(v).alias("total_gens"), F.round(F.avg(v), 2).alias("mean_gens"),
        F.round(F.stddev_samp(v), 2).alias("std_gens"), F.min(v).alias("min_gens"), F.max(v).alias("max_gens"))
    g = null_safe_join(g, quantiles(df, [group], value, [0.5]), [group], "left")
    return g.select(group, "num_runs", "total_gens", "mean_gens", F.round(F.col("_q")[0], 2).alias("median_gens"),
                    "std_gens", "min_gens", "max_gens")


def runs_without_evaluation(runs: DataFrame, evaluations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Runs that have no evaluation (left anti join)."""
    return runs.join(evaluations.select(*key).distinct(), list(key), "left_anti")


def with_evaluation(runs: DataFrame, evaluations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Runs that have an evaluation (left semi join)."""
    return runs.join(evaluations.select(*key), list(key), "left_semi")


def integrity(per_user: DataFrame) -> DataFrame:
    """The list of issues per user from pre-computed per-user counts."""
    issues = F.array_compact(F.array(
        F.when(F.col("missing_ids") > 0, F.lit("missing tweet ids")),
        F.when(F.col("history") == 0, F.lit("empty history")),
        F.when(F.col("holdout") == 0, F.lit("empty holdout")),
        F.when(F.col("runs_without_eval") > 0, F.lit("runs without evaluation")),
        F.when(F.col("duplicate_ids") > 0, F.lit("duplicate tweet ids")),
        F.when(F.col("empty_personas") > 0, F.lit("empty personas")),
    ))
    return per_user.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def common_issues(checked: DataFrame, top: int = 10) -> DataFrame:
    """The most common issues (top k; ties by issue text)."""
    return (checked.select(F.explode("issues").alias("issue")).groupBy("issue")
            .agg(F.count(F.lit(1)).alias("users")).orderBy(F.desc("users"), "issue").limit(top))


def valid_evaluation(run_id: Column, f1: Column) -> Column:
    """A round of a 50-round run, not a baseline, with an F1 score."""
    return (run_id.contains("run_r50_") & run_id.contains("_round_") & ~run_id.contains("baseline_")
            & f1.isNotNull())


def top_runs(generations: DataFrame, k: int, run: str = "run_id") -> DataFrame:
    """T4: the ``k`` runs with most generations (ties by run id)."""
    return (generations.groupBy(run).agg(F.count(F.lit(1)).alias("generations"))
            .orderBy(F.desc("generations"), run).limit(k))


def runs_in(ids: DataFrame, wanted: Sequence[str] | None = None, part: str | None = None) -> DataFrame:
    """Run ids from a list, or those that hold a substring."""
    r = F.col("run_id")
    return ids.where((r.isin(list(wanted)) if wanted is not None else F.lit(True))
                     & (r.contains(part) if part is not None else F.lit(True)))


# ---------------------------------------------------------------------------
# evaluations as the JSON objects they are stored in (P20, A28, A7 layouts, J9)
# ---------------------------------------------------------------------------

OBJECT = "map<string,string>"
# Where a score may lie in an evaluation's overall object, fixed layouts: a number or {score} under
# its own name, or the scorer's nested object.
SCORE_LAYOUTS = {"bleu": [("bleu", None), ("bleu", "score"), ("bleu", "bleu")],
                 "rouge_1": [("rouge_1", None), ("rouge_1", "score"), ("rouge", "rouge1")],
                 "rouge_2": [("rouge_2", None), ("rouge_2", "score"), ("rouge", "rouge2")],
                 "rouge_l": [("rouge_l", None), ("rouge_l", "score"), ("rouge", "rougeL")]}


def overall_object(evaluation: Column) -> Column:
    """The overall scores of an evaluation (JSON) as a map of JSON texts."""
    return F.from_json(F.get_json_object(evaluation, "$.overall"), OBJECT)


def first_item(evaluation: Column) -> Column:
    """The first item's scores as a map of JSON texts (null without items)."""
    return F.from_json(F.get_json_object(evaluation, "$.individual_scores[0]"), OBJECT)


def _filled(obj: Column, name: str) -> Column:
    """The key is there and its value is not empty: no null, false, zero, empty text, list or object."""
    v = F.trim(F.try_element_at(obj, F.lit(name)))
    empty = v.isin("", "null", "false", "{}", "[]", '""') | F.coalesce(v.try_cast("double") == 0, F.lit(False))
    return F.coalesce(v.isNotNull() & ~empty, F.lit(False))


def detected_metrics(evaluation: Column) -> dict[str, Column]:
    """P20: flags of the metrics that an evaluation really holds, in its overall scores or its first
    item: ROUGE and BLEU must be filled, perplexity and BERTScore just there, be it as null."""
    objects = overall_object(evaluation), first_item(evaluation)
    out = {}
    for m in ALL_METRICS:
        found = [_filled(o, m) if m in ("rouge", "bleu") else F.coalesce(F.map_contains_key(o, m), F.lit(False)) for o in objects]
        out[m] = found[0] | found[1]
    return out


def layout_scores(evaluation: Column) -> dict[str, Column]:
    """BLEU and ROUGE-1/2/L of an evaluation in any of the known layouts, 0 where none has it."""
    overall = overall_object(evaluation)
    out = {}
    for m, places in SCORE_LAYOUTS.items():
        values = [F.try_element_at(overall, F.lit(k)) if part is None else
                  F.get_json_object(F.try_element_at(overall, F.lit(k)), f"$.{part}") for k, part in places]
        out[m] = F.coalesce(*[v.try_cast("double") for v in values], F.lit(0.0))
    return out


def user_score_means(evaluations: DataFrame, group: Sequence[str], json: str = "evaluation") -> DataFrame:
    """Mean of the four scores over the evaluations of a group, their common mean, and the count."""
    scores = layout_scores(F.col(json))
    g = evaluations.select(*group, *[c.alias(m) for m, c in scores.items()]).groupBy(*group).agg(
        *[F.avg(m).alias(m) for m in scores], F.count(F.lit(1)).alias("evaluation_count"))
    return g.withColumn("combined", sum((F.col(m) for m in scores), F.lit(0.0)) / len(scores))


def metric_corrections(evaluations: DataFrame, prefix: str = "run_r50_all_metrics", json: str = "evaluation") -> DataFrame:
    """P20 + P21: (user_id, run_id, metrics, corrected_run_id); ids without ``prefix`` stay."""
    e = evaluations.withColumn("metrics", metric_set(detected_metrics(F.col(json))))
    fixed = F.when(F.col("run_id").contains(prefix), corrected_run_id(F.col("run_id"), F.col("metrics"))).otherwise(F.col("run_id"))
    return e.select("user_id", "run_id", "metrics", fixed.alias("corrected_run_id"))


def move_reflections(reflections: DataFrame, corrections: DataFrame, key: Sequence[str] = ("user_id", "run_id")) -> DataFrame:
    """Each reflection follows the corrected id of its own run; those whose run has no evaluation,
    and rows without a key, keep their id.  ``corrections`` has one row per key."""
    moved = lookup_join(reflections, corrections.select(*key, "corrected_run_id"), list(key))
    return moved.withColumn("original_run_id", F.col("run_id")).withColumn("run_id", F.coalesce("corrected_run_id", "run_id")) \
        .select(*reflections.columns, "original_run_id")


def coverage_status(users: DataFrame, evaluations: DataFrame, prefix: str, metric: str = "bertscore", json: str = "evaluation") -> DataFrame:
    """Per user of ``users(user_id)`` the evaluations, those of runs with ``prefix``, those of them that
    hold ``metric``, and the status: error (an evaluation that cannot be read), no_evaluations,
    no_matching_runs, no_<metric> or success.  Evaluations of unknown users are left out."""
    match = F.coalesce(F.col("run_id").contains(prefix), F.lit(False))
    held = detected_metrics(F.col(json))[metric]
    broken = F.from_json(F.col(json), OBJECT, {"mode": "PERMISSIVE"}).isNull() | (F.get_json_object(F.col(json), "$").isNull())
    g = evaluations.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_evaluations"), F.count_if(match).alias("n_matching"),
        F.count_if(match & held).alias("n_with_metric"), F.count_if(broken).alias("n_broken"))
    out = users.select("user_id").distinct().join(g, "user_id", "left").fillna(0, ["n_evaluations", "n_matching", "n_with_metric", "n_broken"])
    return out.withColumn("status", F.when(F.col("n_broken") > 0, F.lit("error")).when(F.col("n_evaluations") == 0, F.lit("no_evaluations"))
                          .when(F.col("n_matching") == 0, F.lit("no_matching_runs"))
                          .when(F.col("n_with_metric") == 0, F.lit(f"no_{metric}")).otherwise(F.lit("success")))
