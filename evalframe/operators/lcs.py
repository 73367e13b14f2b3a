"""Longest common subsequences for ROUGE-L and ROUGE-Lsum (M2).

LCS has no native Spark expression, so these are Arrow-batched helpers
of the scoring path.  They use the bit-parallel formulation
(Allison & Dix 1986, Hyyro 2004): one machine-word-parallel update per
token of the first text, so whole texts are scored exactly with cost
O(|a| * |b| / 64) -- no token cap, no prefix.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.operators.ngram import token_pairs


def lcs_length(a, b) -> int:
    """Length of the LCS of two token sequences."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(b) > len(a):
        a, b = b, a
    masks: dict = {}
    for i, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def _lcs_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array((lcs_length(x, y) for x, y in token_pairs(a, b)), pa.int32())], ["r_lcs"])


def lcs(a_tokens: Column, b_tokens: Column) -> Column:
    """Struct (r_lcs) of the LCS length of two token-array columns (Arrow batches, one pair at a time)."""
    return F.arrow_udf(_lcs_batch, "r_lcs int")(a_tokens, b_tokens)


def lcs_places(a, b) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``: the one found from the ends, which
    leaves a word of ``b`` out only if that keeps the length and leaving out one of ``a`` does not."""
    if not len(a) or not len(b):
        return set()
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    rows = [full]
    for tok in a:
        v = rows[-1]
        u = v & masks.get(tok, 0)
        rows.append(((v + u) | (v - u)) & full)

    def length(i: int, j: int) -> int:  # of the first i words of a and the first j of b
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j, found = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


def union_lcs(reference, prediction) -> tuple[int, int, int]:
    """(matches, prediction words, reference words) of ROUGE-Lsum over lists of sentences: for each
    reference sentence the words in a common subsequence with any prediction sentence, where a
    word counts no more often than both texts have it."""
    reference, prediction = ([list(s) for s in text] if text is not None else [] for text in (reference, prediction))
    in_ref, in_pred = Counter(t for s in reference for t in s), Counter(t for s in prediction for t in s)
    hits = 0
    for sentence in reference:
        places = set().union(*(lcs_places(sentence, other) for other in prediction)) if prediction else set()
        for k in sorted(places):
            t = sentence[k]
            if in_ref[t] > 0 and in_pred[t] > 0:
                hits += 1
                in_ref[t] -= 1
                in_pred[t] -= 1
    return hits, sum(map(len, prediction)), sum(map(len, reference))


def _union_batch(reference: pa.Array, prediction: pa.Array) -> pa.Array:
    rows = [union_lcs(r, p) for r, p in token_pairs(reference, prediction)]
    columns = zip(*rows) if rows else [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["hits", "n_pred", "n_ref"])


def union_lcs_counts(reference: Column, prediction: Column) -> Column:
    """Struct (hits, n_pred, n_ref) of two columns of sentences (arrays of token arrays)."""
    return F.arrow_udf(_union_batch, "hits long, n_pred long, n_ref long")(reference, prediction)
