"""Greedy matching of word vectors (M4), re-aimed: random-indexing vectors of the corpus' own words.

A word's index vector has ``DIMS`` entries -1, 0 or 1, one from each hex digit of its MD5; its vector
is the sum of the index vectors of the words within ``REACH`` places in all texts.  The table
comes from one aggregate of word pairs and grows with the vocabulary only.  It is looked up for
the words of each pair of texts, and the matching happens in the pair's row: each word
takes its best cosine on the other side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.text import rouge_tokens
from evalframe.operators.skew import lookup_join, null_safe_join
from evalframe.session import cut_lineage

DIMS = 32
REACH = 2


def index_vector(word: Column) -> Column:
    """Digits 0 and 1 of the word's MD5 give 1, e and f give -1, the others 0."""
    digits = F.split(F.md5(word), "")
    return F.transform(F.slice(digits, 1, DIMS), lambda d: F.when(d.isin("0", "1"), 1).when(d.isin("e", "f"), -1).otherwise(0))


def word_vectors(texts: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """(word, vec): unit vectors (or zeros) of all words that ``texts`` hold."""
    toks = texts.select(rouge_tokens(F.col(text)).alias("t"))
    near = toks.select("t", F.posexplode("t").alias("i", "word")).select(
        "word", F.explode(F.concat(F.slice("t", F.greatest(F.col("i") + 1 - reach, F.lit(1)), F.least("i", F.lit(reach))),
                                   F.slice("t", F.col("i") + 2, F.lit(reach)))).alias("other"))
    pairs = near.groupBy("word", "other").agg(F.count(F.lit(1)).alias("n"))
    idx = index_vector(F.col("other"))
    sums = pairs.select("word", "n", idx.alias("x")).groupBy("word").agg(
        F.array(*[F.sum(F.col("n") * F.col("x")[d]) for d in range(DIMS)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return sums.select("word", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))).alias("vec"))


def greedy(side: np.ndarray, n: np.ndarray, vec: np.ndarray) -> tuple[float, float, float]:
    """(precision, recall, F1) of one pair from its different words: side, count and vector."""
    a, b = side == 0, side == 1
    if not a.any() or not b.any():
        return 0.0, 0.0, 0.0
    cos = vec[a] @ vec[b].T
    p, r = (cos.max(1) * n[a]).sum() / n[a].sum(), (cos.max(0) * n[b]).sum() / n[b].sum()
    return float(p), float(r), float(2 * p * r / (p + r)) if p + r > 0 else 0.0


def _greedy_batch(words: pa.Array) -> pa.Array:
    """The words stay in Arrow's buffers: numpy looks at them, one pair after the other."""
    at, flat = words.offsets.to_numpy(), words.values
    side, n = flat.field("side").to_numpy(), flat.field("n").to_numpy()
    vec, start = flat.field("vec").values.to_numpy(), flat.field("vec").offsets.to_numpy()
    rows = [greedy(side[i:j], n[i:j].astype(float), vec[start[i]:start[j]].reshape(-1, DIMS)) for i, j in zip(at[:-1], at[1:])]
    columns = zip(*rows) if rows else [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], ["p", "r", "f"])


def greedy_match(pairs: DataFrame, vectors: DataFrame, key: Sequence[str]) -> DataFrame:
    """M4: ``key`` and precision, recall and F1 of each pair (0 where a side has no word); a word
    without a vector matches nothing."""
    key = list(key)
    words = None
    for side, c in enumerate(("prediction", "reference")):
        part = pairs.select(*key, F.lit(side).alias("side"), F.explode(rouge_tokens(F.col(c))).alias("word"))
        words = part if words is None else words.unionByName(part)
    words = cut_lineage(words.groupBy(*key, "side", "word").agg(F.count(F.lit(1)).alias("n")))
    zero = F.array(*[F.lit(0.0)] * DIMS)
    found = lookup_join(words, vectors, ["word"], spread=[*key, "side"]).withColumn("vec", F.coalesce("vec", zero))
    # one row a pair, with the different words of its two texts
    rows = found.groupBy(*key).agg(F.collect_list(F.struct("side", "n", "vec")).alias("words"))
    match = F.arrow_udf(_greedy_batch, "p double, r double, f double")
    scored = rows.select(*key, match("words").alias("m"))
    out = null_safe_join(pairs.select(*key), scored, key, "left")
    return out.select(*key, *[F.coalesce(f"m.{c}", F.lit(0.0)).alias(n) for c, n in
                              (("p", "bertscore_precision"), ("r", "bertscore_recall"), ("f", "bertscore_f1"))])
