"""Post-task metrics, judge parsing, similarity, perplexity and distribution
summaries (M5, M7-M13, A13-A15, A43, A45, F12).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions.text import FORMAT_ARTIFACTS, PREDICTION_PREFIXES, rouge_tokens
from evalframe.operators import bigrams as B
from evalframe.operators.ngram import overlap_counts
from evalframe.operators.skew import lookup_join, null_safe_join, quantiles
from evalframe.session import cut_lineage

# Content-accuracy thresholds and format penalties, fixed values.
HIGH_SIM, LOW_SIM = 0.7, 0.3
ARTIFACT_PENALTY, LENGTH_PENALTY = 0.5, 0.7
MAX_LEN_RATIO, MIN_LEN_RATIO = 3.0, 0.3
# Missing metrics implied by a run id (first contained key wins), fixed values.
MISSING_BY_RUN = [
    ("bleu_only", ["rouge", "bertscore", "perplexity"]),
    ("perplexity_only", ["rouge", "bleu", "bertscore"]),
    ("bertscore", ["rouge", "bleu", "perplexity"]),
    ("rouge_1", ["bleu", "bertscore", "perplexity"]),
]


def strip(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_prediction(pred: Column) -> Column:
    """M8: drop model prefixes, un-bold ``**x**``, strip."""
    s = strip(F.coalesce(pred, F.lit("")))
    for p in PREDICTION_PREFIXES:
        s = F.replace(s, F.lit(p), F.lit(""))
    s = strip(s)
    return strip(F.regexp_replace(s, r"\*\*([^*]+)\*\*", "$1"))


def exact_match(clean_pred: Column, ref: Column) -> Column:
    """M9: case-insensitive equality of cleaned prediction and stripped reference."""
    return F.lower(clean_pred) == F.lower(strip(F.coalesce(ref, F.lit(""))))


def content_accuracy(sim: Column) -> Column:
    """1 above the high threshold, the similarity above the low one, else 0."""
    return F.when(sim > HIGH_SIM, F.lit(1.0)).when(sim > LOW_SIM, sim).otherwise(F.lit(0.0))


def format_compliance(raw_pred: Column, clean_pred: Column, ref: Column) -> Column:
    """x0.5 for a formatting artifact in the raw prediction, x0.7 when the
    length ratio to a non-empty reference is > 3 or < 0.3."""
    raw = strip(F.coalesce(raw_pred, F.lit("")))
    r = strip(F.coalesce(ref, F.lit("")))
    art = None
    for a in FORMAT_ARTIFACTS:
        art = raw.contains(a) if art is None else (art | raw.contains(a))
    ratio = F.length(clean_pred).cast("double") / F.greatest(F.length(r), F.lit(1))
    score = F.when(art, F.lit(ARTIFACT_PENALTY)).otherwise(F.lit(1.0))
    bad_len = (F.length(r) > 0) & ((ratio > MAX_LEN_RATIO) | (ratio < MIN_LEN_RATIO))
    return score * F.when(bad_len, F.lit(LENGTH_PENALTY)).otherwise(F.lit(1.0))


def tf_cosine(pairs: DataFrame, key: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Lexical similarity fallback for M10: cosine of term-frequency vectors
    of the ROUGE tokens (0 when a side is empty), counted inside the row."""
    base = pairs.select(*key, rouge_tokens(a).alias("_a"), rouge_tokens(b).alias("_b"))
    c = overlap_counts(base, {"s": (F.col("_a"), F.col("_b"), (1,))}, cosine=("s",))
    den = F.sqrt(F.col("s_np2").cast("double") * F.col("s_nr2").cast("double"))
    return c.select(*key, F.when(den > 0, F.col("s_dot") / den).otherwise(F.lit(0.0)).alias("similarity"))


def cosine(a: Column, b: Column) -> Column:
    """cosine of two numeric arrays (0 for empty / zero vectors)."""
    da = F.transform(a, lambda x: x.cast("double"))
    db = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.aggregate(da, F.lit(0.0), lambda acc, x: acc + x * x)
    nb = F.aggregate(db, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when((na > 0) & (nb > 0), dot / F.sqrt(na * nb)).otherwise(F.lit(0.0))


def post_block(items: DataFrame, group: Sequence[str]) -> DataFrame:
    """Post metrics per group; means divide by all items, std is population."""
    return items.groupBy(*group).agg(
        (F.count_if("exact") / F.count(F.lit(1))).alias("posts_exact_match_rate"),
        F.avg("similarity").alias("posts_semantic_similarity"),
        F.avg("content").alias("posts_content_accuracy"),
        F.avg("format").alias("posts_format_compliance"),
        F.count_if("exact").alias("posts_exact_matches"),
        F.count(F.lit(1)).alias("posts_total_samples"),
        F.stddev_pop("similarity").alias("posts_semantic_similarity_std"))


def missing_metrics(run_id: Column) -> Column:
    """M12 rule: metrics a limited run lacks (empty array for others)."""
    e = F.array().cast("array<string>")
    for key, ms in reversed(MISSING_BY_RUN):
        e = F.when(run_id.contains(key), F.array(*[F.lit(m) for m in ms])).otherwise(e)
    return e


def nan_mean(c: Column) -> Column:
    return F.avg(F.nanvl(c.cast("double"), F.lit(None).cast("double")))


def list_fallback(logged: Column, has_logged: Column, computed: Column) -> Column:
    """Mean of the logged values when any item logged the metric,
    otherwise mean of the computed values (list-level fallback)."""
    return F.when(F.count_if(has_logged) > 0, nan_mean(F.when(has_logged, logged))) \
        .otherwise(nan_mean(computed))


# ---------------------------------------------------------------------------
# M7 judge reply
# ---------------------------------------------------------------------------

def judge_parse(response: Column) -> list[Column]:
    """M7: coherence / consistency digits (else 0) and justification."""
    coh = F.regexp_extract(response, r"Coherence: (\d)", 1)
    con = F.regexp_extract(response, r"Consistency: (\d)", 1)
    jus = F.regexp_extract(response, r"Justification: (.*)", 1)
    has_j = F.coalesce(response.rlike(r"Justification: "), F.lit(False))
    return [
        F.coalesce(F.nullif(coh, F.lit("")).cast("int"), F.lit(0)).alias("coherence_score"),
        F.coalesce(F.nullif(con, F.lit("")).cast("int"), F.lit(0)).alias("consistency_score"),
        F.when(has_j, strip(jus)).otherwise(F.lit("No justification provided.")).alias("justification"),
    ]


# ---------------------------------------------------------------------------
# M5 re-aimed: bigram language-model perplexity with add-k smoothing
# ---------------------------------------------------------------------------

def bigram_perplexity(docs: DataFrame, key: str, text: str, k: float = 1.0) -> DataFrame:
    """Perplexity of each text under a bigram LM estimated on all texts.

    p(w | v) = (c(v, w) + k) / (c(v) + k * V).  A bigram is a pair of words beside each
    other.  Texts are written once, as blocks of coded tokens; a block asks for the counts of
    its different words, then of its different bigrams, and sums up its own texts (see
    ``bigrams``), so no row per occurrence is shuffled.  Texts of one key share their sums.
    Texts with fewer than two tokens get null.
    """
    toks = docs.select(key, rouge_tokens(F.col(text)).alias("t"))
    keys = T.ArrayType(docs.schema[key].dataType).simpleString()
    schema = f"block long, n_words long, n_tokens long, keys {keys}, sizes binary, codes binary, words binary, times binary"
    limit = B.BLOCK_TOKENS
    blocks = cut_lineage(toks.mapInArrow(lambda batches: B.blocks(batches, limit), schema))
    n_words, n_tokens = blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    # at most so many rows in a bucket, but work for all partitions
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words_in, bigrams_in = max(parts, -(-(n_words or 0) // B.BUCKET_WORDS)), max(parts, -(-(n_tokens or 0) // B.BUCKET_TOKENS))
    asked = blocks.select("block", "words", "times").mapInArrow(lambda batches: B.ask_words(batches, words_in), B.ASKED)
    known = cut_lineage(asked.groupBy("bucket").applyInArrow(lambda rows: B.number_words(rows, words_in), B.WORD_REPLY))
    vocabulary, fullest = (n or 0 for n in known.agg(F.sum("different"), F.max("different")).first())
    numbers = fullest * words_in
    if numbers > 1 << 32:
        raise ValueError(f"{vocabulary} different words: two word numbers do not fit into 64 bits")
    by_block = blocks.select("block", "n_words", "keys", "sizes", "codes").groupBy("block")
    words = known.select("block", "bucket", "at", "number", "times")
    pairs = by_block.cogroup(words.groupBy("block")).applyInArrow(
        lambda block, replies: B.ask_bigrams(block, replies, numbers, bigrams_in), B.ASKED)
    counted = pairs.groupBy("bucket").applyInArrow(B.count_bigrams, B.BIGRAM_REPLY)
    replies = words.unionByName(counted, allowMissingColumns=True)
    scores = by_block.cogroup(replies.groupBy("block")).applyInArrow(
        lambda block, rows: B.text_scores(block, rows, numbers, bigrams_in, k, vocabulary),
        T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("sum_lp", T.DoubleType()), T.StructField("n", T.LongType())]))
    per = scores.groupBy(F.col("key").alias(key)).agg((F.sum("sum_lp") / F.sum("n")).alias("avg_log_p"), F.sum("n").alias("n_bigrams"))
    out = docs.select(key).join(per, key, "left")
    return out.select(key, F.exp(-F.col("avg_log_p")).alias("perplexity"),
                      F.coalesce("n_bigrams", F.lit(0)).alias("n_bigrams"))


# ---------------------------------------------------------------------------
# A43 distribution summaries
# ---------------------------------------------------------------------------

def box_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (1.5 IQR rule clipped to the data) and count."""
    v = F.col(value)
    g = df.groupBy(*group).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))
    g = null_safe_join(g, quantiles(df, group, value, [0.25, 0.5, 0.75]), group, "left")
    q1, q2, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    iqr = q3 - q1
    return g.select(*group, q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
                    F.greatest(F.col("min"), q1 - 1.5 * iqr).alias("whisker_low"),
                    F.least(F.col("max"), q3 + 1.5 * iqr).alias("whisker_high"), "count")


def kde_grid(df: DataFrame, group: Sequence[str], value: str, points: int = 32) -> DataFrame:
    """Gaussian KDE per group on ``points`` grid points spanning the
    group's range, Scott bandwidth (sample std * n^(-1/5)).

    Each row emits its contribution to the fixed grid (a generate of
    ``points`` entries, no join of rows with rows); contributions are
    summed per grid point.  Per-group stats are a small aggregate joined back.
    """
    v = F.col(value)
    st = df.groupBy(*group).agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"),
                                F.min(v).alias("lo"), F.max(v).alias("hi"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    x = df.select(*group, v.alias("_v")).where(F.col("_v").isNotNull()).join(st, list(group))
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    e = x.select(*group, "n", "h", "lo", "hi", "_v", F.explode(grid).alias("grid_index"))
    gx = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("grid_index") / max(points - 1, 1)
    z = F.try_divide(gx - F.col("_v"), F.col("h"))
    contrib = F.try_divide(F.exp(-0.5 * z * z), F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    e = e.select(*group, "grid_index", gx.alias("x"), contrib.alias("c"))
    return e.groupBy(*group, "grid_index", "x").agg(F.sum("c").alias("density"))


# ---------------------------------------------------------------------------
# A45 persona evolution: token counts, change and Jaccard overlap round to round
# ---------------------------------------------------------------------------

def persona_evolution(personas: DataFrame, key: str, round_col: str, text: str) -> DataFrame:
    """Per (key, round): token count, distinct tokens, change vs the previous
    round and Jaccard similarity of the distinct token sets.  The previous
    round is an equi-join on round - 1 that brings its different tokens as one
    array, and the overlap is counted in the row -- no row per token is shuffled.
    Texts that share a (key, round) share the sum of their overlaps."""
    t = personas.select(key, round_col, rouge_tokens(F.col(text)).alias("t"))
    sets = t.select(key, round_col, F.size("t").alias("n_tokens"), F.array_distinct("t").alias("d"))
    prev = sets.select(key, (F.col(round_col) + 1).alias(round_col), F.col("n_tokens").alias("prev_tokens"),
                       F.col("d").alias("prev_d"))
    j = sets.join(prev, [key, round_col], "left").select(
        key, round_col, "n_tokens", F.size("d").alias("n_distinct"), "prev_tokens",
        F.when(F.col("prev_d").isNotNull(), F.size("prev_d")).alias("prev_distinct"),
        F.size(F.array_intersect("d", F.coalesce("prev_d", F.array().cast("array<string>")))).alias("own"))
    # the join has already put the rows of a (key, round) together
    common = F.sum("own").over(Window.partitionBy(key, round_col))
    union = F.col("n_distinct") + F.col("prev_distinct") - common
    return j.select(key, round_col, "n_tokens", "n_distinct",
                    (F.col("n_tokens") - F.col("prev_tokens")).alias("token_change"),
                    F.when(F.col("prev_distinct").isNotNull(),
                           F.when(union > 0, common / union).otherwise(F.lit(0.0))).alias("jaccard_prev"))


def persona_keywords(personas: DataFrame, key: str, text: str, k: int = 10, prior_size: float = 500.0) -> DataFrame:
    """The ``k`` words that set a persona's texts apart from all others': log-odds with an
    informative Dirichlet prior (the corpus' own word shares, ``prior_size`` words in all), divided
    by their standard deviation.  Ties go to the lesser word; a null persona is one of its own.

    Counts are summed before any shuffle, word and persona totals are looked up, and the lists come
    from a group limit, so neither a frequent word nor a large persona meets one task."""
    toks = personas.select(F.col(key).alias("key"), F.explode(rouge_tokens(F.col(text))).alias("word"))
    own = cut_lineage(toks.groupBy("key", "word").agg(F.count(F.lit(1)).alias("n")))
    words = own.groupBy("word").agg(F.sum("n").alias("n_word"))
    sizes = own.groupBy("key").agg(F.sum("n").alias("n_key"))
    total = own.agg(F.sum("n").alias("n")).scalar()
    named = F.coalesce("key", F.lit("")).alias("_k"), F.col("key").isNull().alias("_null")
    j = lookup_join(own.select("*", *named), words, ["word"], spread=["key", "word"])
    j = lookup_join(j, sizes.select("n_key", *named), ["_k", "_null"], spread=["word"]).withColumn("n_all", total)
    prior = F.lit(prior_size) * F.col("n_word") / F.col("n_all")
    a, b = F.col("n") + prior, F.col("n_word") - F.col("n") + prior
    size_a, size_b = F.col("n_key") + F.lit(prior_size), F.col("n_all") - F.col("n_key") + F.lit(prior_size)
    odds = F.log(F.try_divide(a, size_a - a)) - F.log(F.try_divide(b, size_b - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    scored = j.select(F.col("key").alias(key), "word", "n", odds.alias("log_odds"), z.alias("z")).where("z is not null")
    order = Window.partitionBy(key).orderBy(F.round("z", 9).desc(), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
