"""Operator 7 [native]: quality by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted over all documents: one of the trusted
target (rows with quality 1 in the label table) and one of the raw corpus.  The n-grams
are words, word pairs and the last three characters of words.  A document's score is the
mean over its n-grams of log p_target / p_raw; it is kept when the score reaches
``threshold`` and the base rules do not fail.

The base rules count inside each row: words, their characters, symbols, repeated lines and
words in repeated five-word windows.  Counting the n-grams is one pre-aggregated shuffle of
at most ``buckets`` rows a task; the weights are one row of ``buckets`` numbers.

Defined results: a null or empty text has no words, fails the base rules and scores 0;
rows are scored one by one, so repeated rows and null ids return a row each; a label table
without quality 1 keeps what passes the base rules (all weights are then 0); several
labels of one id count as target if any of them is 1; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, r"[\x20\x09-\x0D]+"))


def hashed_grams(buckets: int) -> Column:
    """Buckets of the n-grams of the columns ``words`` and ``hashes`` (of the words)."""
    own = F.transform("hashes", lambda h: F.pmod(h, F.lit(buckets)))
    pairs = F.expr(f"transform(sequence(0, size(hashes) - 2), i -> pmod(xxhash64(hashes[i], hashes[i + 1]), {buckets}L))")
    ends = F.transform("words", lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(3)), F.lit("end")), F.lit(buckets)))
    return F.when(F.size("words") > 1, F.concat(own, pairs, ends)).otherwise(F.concat(own, ends))


def _hashed(docs: DataFrame) -> DataFrame:
    return (docs.withColumn("words", words_of(F.col("text")))
            .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))))


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``weights``: log p_target / p_raw of each bucket, add-one smoothed."""
    trusted = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    # a merge join at every size: the label table grows with the documents
    marked = docs.select("doc_id", "text").join(trusted.select("doc_id", F.lit(1).alias("t")).hint("merge"), "doc_id", "left")
    grams = (_hashed(marked.select("text", F.coalesce("t", F.lit(0)).alias("t")))
             .select("t", F.explode(hashed_grams(buckets)).alias("bucket")))
    counted = grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("r"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").fillna(0)
    row = every.agg(F.sum("t").alias("T"), F.sum("r").alias("R"),
                    F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("c"))
    ratio = F.expr(f"transform(c, x -> if(T = 0, 0D, ln((x.t + 1D) / (T + {buckets}D)) - ln((x.r + 1D) / (R + {buckets}D))))")
    return row.select(ratio.alias("weights"))


def base_rules() -> dict[str, Column]:
    """The counts of the base rules, from ``text``, ``words`` and ``hashes``."""
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    spans = ", ".join(f"hashes[i + {j}]" for j in range(WINDOW))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.expr(f"transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({spans}))")
                     ).otherwise(F.array().cast("array<bigint>"))
    placed = "sort_array(transform(windows, (h, i) -> struct(h as h, i as i)))"
    twice = ("transform(filter(transform(placed, (x, k) -> struct(x.i as i, (k > 0 and get(placed, k - 1).h = x.h) or "
             "coalesce(get(placed, k + 1).h = x.h, false) as twice)), x -> x.twice), x -> x.i)")
    covered = f"aggregate(transform(places, (p, k) -> least({WINDOW}, coalesce(get(places, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)"
    return {"n_words": n.cast("long"), "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
            "n_dup_lines": F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("long"),
            "windows": windows,
            "placed": F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.expr(placed)),
            "places": F.sort_array(F.expr(twice)),
            "n_repeat_words": F.coalesce(F.expr(covered), F.lit(0)).cast("long")}


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD,
            min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    table = weights(docs, labels, buckets).scalar()
    rows = _hashed(docs.select("doc_id", "text"))
    for name, col in base_rules().items():
        rows = rows.withColumn(name, col)
    grams = hashed_grams(buckets)
    rows = rows.withColumn("weights", table).withColumn("grams", grams)
    total = F.expr("aggregate(grams, 0D, (a, b) -> a + weights[cast(b as int)])")
    rows = rows.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
