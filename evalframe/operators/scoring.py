"""Pair scoring (M1-M3, M6, M14) and run-level summaries.

Input: a pair table with ``prediction``, ``reference`` and key columns.
Output: one row per pair with the requested metric columns.  Everything is
native Spark except the LCS helper used by ROUGE-L.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.text import bleu_tokens, rouge_tokens
from evalframe.operators.lcs import lcs, union_lcs_counts
from evalframe.operators.ngram import overlap_counts
from evalframe.operators.skew import null_safe_join

DEFAULT_KEY = ("user_id", "run_id", "index")
BLEU_MAX_ORDER = 4

# Combined-score weights, fixed values: ROUGE-L 0.4, BLEU 0.3, BERTScore precision 0.3.
COMBINED_WEIGHTS = {"rougeL": 0.4, "bleu": 0.3, "bertscore_precision": 0.3}

# Metric names accepted in a metric selection (M14); synonyms map to one name.
METRIC_ALIASES = {"rouge": "rouge", "bleu": "bleu", "bertscore": "bertscore",
                  "bert_score": "bertscore", "perplexity": "perplexity",
                  "gpt_eval": "judge", "llm_evaluation": "judge"}


# metrics that score_pairs computes from two texts; the others need a model or a corpus
SCORED_METRICS = {"rouge", "bleu"}


def metric_name(name: str) -> str:
    """The canonical metric of a configured name; raises for unknown ones."""
    if name not in METRIC_ALIASES:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRIC_ALIASES)}")
    return METRIC_ALIASES[name]


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _div(a: Column, b: Column) -> Column:
    """Division that yields null for a zero divisor in ANSI and non-ANSI mode alike."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def bleu_from_counts(m: Sequence[Column], possible: Sequence[Column], tl: Column, rl: Column,
                     max_order: int = BLEU_MAX_ORDER) -> dict[str, Column]:
    """BLEU from clipped matches ``m[n-1]``, possible matches ``possible[n-1]``
    (number of prediction n-grams) and lengths (no smoothing).

    Works for one pair and for summed corpus counts alike (possible matches
    are summed per pair, never derived from the summed length).  Null when
    either length is 0 (the reference implementation raises there).
    """
    prec = [F.when(possible[n - 1] > 0, _div(m[n - 1], possible[n - 1])).otherwise(F.lit(0.0))
            for n in range(1, max_order + 1)]
    log_sum = None
    for p in prec:
        term = F.lit(1.0 / max_order) * F.log(p)
        log_sum = term if log_sum is None else log_sum + term
    geo = F.when(F.least(*prec) > 0, F.exp(log_sum)).otherwise(F.lit(0.0))
    ratio = _div(tl, rl)
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    ok = (tl > 0) & (rl > 0)
    return {
        "bleu": F.when(ok, geo * bp),
        "precisions": F.array(*prec),
        "brevity_penalty": F.when(ok, bp),
        "length_ratio": F.when(rl > 0, ratio),
        "translation_length": tl,
        "reference_length": rl,
    }


def score_pairs(pairs: DataFrame, key_cols: Sequence[str] = DEFAULT_KEY,
                metrics: Sequence[str] = ("rouge", "bleu"),
                carry: Sequence[str] = ("tweet_id",),
                rouge_l: bool = True, wide: Sequence[str] = ()) -> DataFrame:
    """Per-pair ROUGE-1/2/L F1 and BLEU (with precisions, BP, lengths).

    ``metrics`` is the configured metric list (M14): only the requested token streams,
    n-gram orders and helpers are planned; an unknown name, or a metric that this function
    cannot score from two texts, raises.  Scoring works inside the row, so the plan has no
    exchange; ``carry`` and ``wide`` name the columns to keep beside the key.
    """
    wanted = {metric_name(m) for m in metrics}
    if wanted - SCORED_METRICS:
        raise ValueError(f"not scored from text pairs: {sorted(wanted - SCORED_METRICS)}")
    key = list(key_cols)
    carry = [c for c in carry if c in pairs.columns and c not in key]
    wide = [c for c in wide if c in pairs.columns and c not in key and c not in carry]
    # token arrays are made once; the helpers read them as columns
    counts = pairs.select(*key, *carry, *wide, *[F.col(c).alias("_" + c) for c in ("prediction", "reference")])
    pred, ref = F.col("_prediction"), F.col("_reference")
    if "rouge" in wanted:
        counts = counts.withColumns({"_rp": rouge_tokens(pred), "_rr": rouge_tokens(ref)})
    if "bleu" in wanted:
        counts = counts.withColumns({"_bp": bleu_tokens(pred), "_br": bleu_tokens(ref)})
    sets, others = {}, []
    if "rouge" in wanted:
        sets["r"] = (F.col("_rp"), F.col("_rr"), (1, 2))
        others = [lcs(F.col("_rp"), F.col("_rr"))] if rouge_l else []
    if "bleu" in wanted:
        sets["b"] = (F.col("_bp"), F.col("_br"), tuple(range(1, BLEU_MAX_ORDER + 1)))
    counts = overlap_counts(counts, sets, others=others)
    out = [F.col(c) for c in key + carry + wide]
    if "rouge" in wanted:
        lp, lr = F.col("r_p1"), F.col("r_r1")
        for n in (1, 2):
            m = F.col(f"r_m{n}")
            p = _div(m, F.greatest(F.col(f"r_p{n}"), F.lit(1)))
            r = _div(m, F.greatest(F.col(f"r_r{n}"), F.lit(1)))
            out.append(_f1(p, r).alias(f"rouge{n}"))
        if rouge_l:
            lc = F.col("r_lcs")
            ok = (lp > 0) & (lr > 0)
            out.append(F.when(ok, _f1(_div(lc, lp), _div(lc, lr))).otherwise(F.lit(0.0)).alias("rougeL"))
    if "bleu" in wanted:
        m = [F.col(f"b_m{n}") for n in range(1, BLEU_MAX_ORDER + 1)]
        poss = [F.col(f"b_p{n}") for n in range(1, BLEU_MAX_ORDER + 1)]
        parts = bleu_from_counts(m, poss, F.col("b_p1"), F.col("b_r1"))
        out += [parts["bleu"].alias("bleu"), parts["precisions"].alias("bleu_precisions"),
                parts["brevity_penalty"].alias("brevity_penalty"),
                parts["length_ratio"].alias("length_ratio"),
                F.col("b_p1").alias("translation_length"), F.col("b_r1").alias("reference_length")]
        out += [F.col(f"b_m{n}").alias(f"bleu_m{n}") for n in range(1, BLEU_MAX_ORDER + 1)]
        out += [F.col(f"b_p{n}").alias(f"bleu_p{n}") for n in range(1, BLEU_MAX_ORDER + 1)]
    return counts.select(*out)


def rouge_lsum(pairs: DataFrame, key_cols: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """M2: ROUGE-Lsum per pair: precision, recall and F1 of the union of the common subsequences of
    each line of the reference with all lines of the prediction; 0 where a side has no word."""
    def lines(c: str) -> Column:
        kept = F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: x != "")
        return F.transform(kept, rouge_tokens)

    counted = pairs.select(*key_cols, union_lcs_counts(lines("reference"), lines("prediction")).alias("u"))
    p = F.coalesce(_div(F.col("u.hits"), F.col("u.n_pred")), F.lit(0.0))
    r = F.coalesce(_div(F.col("u.hits"), F.col("u.n_ref")), F.lit(0.0))
    return counted.select(*key_cols, p.alias("rougeLsum_precision"), r.alias("rougeLsum_recall"), _f1(p, r).alias("rougeLsum"))


# Metrics by name.  A function takes the pairs and the key columns and returns the key with its
# metric columns, one row per pair.
MetricFn = Callable[[DataFrame, Sequence[str]], DataFrame]
REGISTRY: dict[str, MetricFn] = {
    "rouge": lambda pairs, key: score_pairs(pairs, key, metrics=["rouge"], carry=()),
    "rouge_lsum": lambda pairs, key: rouge_lsum(pairs, key),
    "bleu": lambda pairs, key: score_pairs(pairs, key, metrics=["bleu"], carry=()).select(*key, "bleu"),
}


def register_metric(name: str, fn: MetricFn) -> None:
    """Plug in a metric under a new name (an existing one raises)."""
    if name in REGISTRY:
        raise ValueError(f"metric {name!r} exists")
    REGISTRY[name] = fn


def evaluate(pairs: DataFrame, metrics: Sequence[str], key_cols: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """X5 + M14: the columns of the chosen metrics, plugged ones included, beside the key.  Only chosen
    metrics are planned; an unknown name raises before anything runs."""
    unknown = sorted({m for m in metrics if m not in REGISTRY})
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(REGISTRY)}")
    out = pairs.select(*key_cols)
    for m in metrics:
        out = null_safe_join(out, REGISTRY[m](pairs, list(key_cols)), key_cols, "left")
    return out


# cumulative chances of 0, 1, 2, ... of a Poisson variable of mean 1, in units of 2**-32
POISSON = [math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def bootstrap_means(scored: DataFrame, metrics: Sequence[str], group_cols: Sequence[str] = ("user_id", "run_id"),
                    item: str = "index", replicates: int = 100, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Per group and metric the mean over items, and low, mid and high percentiles of its bootstrap.

    An item's weight in a replicate is a Poisson(1) draw from the hash of (seed, item, replicate), so a
    replicate is a resample of expected size that any task can draw alone, and repeats alike.  Items give
    one row per replicate, summed per group before the shuffle; a group ends with ``replicates`` means.
    A replicate that drew no item is left out."""
    g, low = list(group_cols), (1 - confidence) / 2
    words = -(-replicates // 4)  # a hash gives four draws of 32 bits
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string"), F.col("_w").cast("string")))
    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(
        (F.col("_w") * 4 + k).alias("replicate"), F.conv(h.substr(k * 8 + 1, F.lit(8)), 16, 10).cast("long").alias("u"))),
        lambda x: x["replicate"] < replicates)
    rows = (scored.select(*g, item, *metrics, F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("_w"))
            .select(*g, *metrics, F.explode(draws).alias("d")))
    weight = F.size(F.filter(F.array(*[F.lit(c) for c in POISSON]), lambda c: F.col("d.u") >= c))
    rows = rows.select(*g, *metrics, F.col("d.replicate").alias("replicate"), weight.alias("w")).where("w > 0")
    means = rows.groupBy(*g, "replicate").agg(*[_div(F.sum(F.col(m) * F.col("w")), F.sum(F.when(F.col(m).isNotNull(), F.col("w"))))
                                                .alias(m) for m in metrics])
    long = means.unpivot([*g, "replicate"], list(metrics), "metric", "mean")
    out = long.groupBy(*g, "metric").agg(*[F.percentile("mean", q).alias(n) for n, q in (("low", low), ("mid", 0.5), ("high", 1 - low))])
    plain = scored.groupBy(*g).agg(*[F.avg(m).alias(m) for m in metrics]).unpivot(g, list(metrics), "metric", "mean")
    return null_safe_join(plain, out, [*g, "metric"], "left")


def bleu_corpus(scored: DataFrame, group_cols: Sequence[str] = ("user_id", "run_id"),
                extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """A12 corpus BLEU per group from summed n-gram counts (not a mean of items).

    Decomposable: a partial aggregate per map task, one small shuffle.
    ``extra_aggs`` ride in the same aggregation (e.g. mean ROUGE).
    """
    sums = [F.sum(F.coalesce(F.col(f"bleu_m{n}"), F.lit(0))).alias(f"m{n}")
            for n in range(1, BLEU_MAX_ORDER + 1)]
    sums += [F.sum(F.coalesce(F.col(f"bleu_p{n}"), F.lit(0))).alias(f"p{n}")
             for n in range(1, BLEU_MAX_ORDER + 1)]
    agg = scored.groupBy(*group_cols).agg(
        *sums, F.sum("translation_length").alias("tl"), F.sum("reference_length").alias("rl"),
        F.count(F.lit(1)).alias("total_samples"), *extra_aggs)
    parts = bleu_from_counts([F.col(f"m{n}") for n in range(1, BLEU_MAX_ORDER + 1)],
                             [F.col(f"p{n}") for n in range(1, BLEU_MAX_ORDER + 1)],
                             F.col("tl"), F.col("rl"))
    return agg.select(*group_cols, parts["bleu"].alias("bleu"),
                      parts["brevity_penalty"].alias("brevity_penalty"),
                      parts["length_ratio"].alias("length_ratio"),
                      *[parts["precisions"][i].alias(f"precision_{i + 1}") for i in range(BLEU_MAX_ORDER)],
                      F.col("tl").alias("translation_length"), F.col("rl").alias("reference_length"),
                      "total_samples", *[F.col(n) for n in agg.columns[len(group_cols) + 11:]])


def combined_score(df: DataFrame, weights: dict[str, float] | None = None,
                   columns: dict[str, str] | None = None) -> DataFrame:
    """M6: weighted mean over the metrics present for the item.

    A metric counts when its value is non-null (the metric object exists),
    even if it is 0; 0 when no metric is present.
    """
    weights = weights or COMBINED_WEIGHTS
    columns = columns or {}
    num = F.lit(0.0)
    den = F.lit(0.0)
    for metric, w in weights.items():
        col = columns.get(metric, metric)
        if col not in df.columns:
            continue
        v = F.col(col).cast("double")
        num = num + F.when(v.isNotNull(), v * w).otherwise(0.0)
        den = den + F.when(v.isNotNull(), F.lit(w)).otherwise(0.0)
    return df.withColumn("combined_score", F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(0.0)))


def run_statistics(scored: DataFrame, group_cols: Sequence[str] = ("user_id", "run_id"),
                   score: str = "combined_score") -> DataFrame:
    """Mean, population std, best, worst, count of the combined score."""
    s = F.col(score)
    return scored.groupBy(*group_cols).agg(
        F.avg(s).alias("mean_combined_score"),
        F.stddev_pop(s).alias("std_combined_score"),
        F.max(s).alias("best_score"),
        F.min(s).alias("worst_score"),
        F.count(s).alias("total_samples"))


def best_worst(scored: DataFrame, group_cols: Sequence[str] = ("user_id", "run_id"),
               score: str = "combined_score", order_col: str = "index",
               carry: Sequence[str] = ("tweet_id",), sizes: DataFrame | None = None) -> DataFrame:
    """Best and worst lists per run.

    n >= 6 -> 3 + 3; n <= 1 -> all best, no worst; else n // 2 each.
    Order is score desc, then ``order_col`` asc (stable sort).  Both lists
    need at most 3 rows per end, so each side is a ``row_number() <= 3``
    filter that Spark turns into a map-side WindowGroupLimit: a hot run
    never gathers more than 3 rows per map task.
    """
    g = list(group_cols)
    carry = [c for c in carry if c in scored.columns]
    cols = g + [order_col, score] + carry
    s = scored.select(*cols)
    desc = Window.partitionBy(*g).orderBy(F.col(score).desc(), F.col(order_col).asc())
    asc = Window.partitionBy(*g).orderBy(F.col(score).asc(), F.col(order_col).desc())
    top = s.withColumn("rn", F.row_number().over(desc)).where("rn <= 3").withColumn("list", F.lit("best"))
    bot = s.withColumn("rn", F.row_number().over(asc)).where("rn <= 3").withColumn("list", F.lit("worst"))
    # run sizes: pass them in (e.g. counted on the unscored pair table) to
    # avoid a second evaluation of the scoring pipeline
    n = (sizes if sizes is not None else scored).groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    k_best = F.when(F.col("n") >= 6, 3).when(F.col("n") <= 1, F.col("n")).otherwise(F.floor(F.col("n") / 2))
    k_worst = F.when(F.col("n") >= 6, 3).when(F.col("n") <= 1, 0).otherwise(F.floor(F.col("n") / 2))
    both = top.unionByName(bot).join(n, g)
    keep = F.when(F.col("list") == "best", F.col("rn") <= k_best).otherwise(F.col("rn") <= k_worst)
    rank = F.when(F.col("list") == "best", F.col("rn")).otherwise(k_worst - F.col("rn") + 1)
    return both.where(keep).select(*g, "list", rank.cast("int").alias("rank"), order_col, score, *carry)
