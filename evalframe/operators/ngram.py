"""N-gram overlap of the two texts of a pair (M1 ROUGE-N, M3 BLEU, lexical cosine).

Both token arrays of a pair are on one row, so the overlap is counted there, by a small
Arrow-batched helper: no gram is ever shuffled, a hot pair key or a very long text costs
its own row only, and every other column stays in place.  A batch stays in Arrow's buffers;
only a few pairs at a time are made into Python strings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ROWS_AT_ONCE = 64


def _grams(tokens, n: int) -> Counter:
    return Counter(tokens) if n == 1 else Counter(zip(*(tokens[i:] for i in range(n))))


def pair_counts(a: Sequence[str], b: Sequence[str], orders: Sequence[int], cosine: bool) -> list[int]:
    """For each order the clipped overlap and both totals; with ``cosine`` also the dot
    product of the term frequencies and both squared norms."""
    a, b = list(a) if a is not None else [], list(b) if b is not None else []
    out: list[int] = []
    for n in orders:
        p, r = _grams(a, n), _grams(b, n)
        small, large = (p, r) if len(p) <= len(r) else (r, p)
        out += [sum(min(c, large[g]) for g, c in small.items() if g in large), max(0, len(a) - n + 1), max(0, len(b) - n + 1)]
    if cosine:
        p, r = _grams(a, 1), _grams(b, 1)
        out += [sum(c * r[g] for g, c in p.items() if g in r), sum(c * c for c in p.values()), sum(c * c for c in r.values())]
    return out


def _lists(rows: pa.Array) -> list[list]:
    at = rows.offsets.to_numpy()
    words = rows.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).tolist()
    return [words[i - at[0]:j - at[0]] for i, j in zip(at[:-1], at[1:])]


def token_pairs(a: pa.Array, b: pa.Array):
    """The two lists of each row (empty for null): ``ROWS_AT_ONCE`` rows are Python strings at a time."""
    a, b = (pc.if_else(x.is_null(), pa.scalar([], x.type), x) if x.null_count else x for x in (a, b))
    for k in range(0, len(a), ROWS_AT_ONCE):
        yield from zip(_lists(a.slice(k, ROWS_AT_ONCE)), _lists(b.slice(k, ROWS_AT_ONCE)))


def overlap_struct(pred: Column, ref: Column, prefix: str, orders: Sequence[int], cosine: bool = False) -> Column:
    """Struct of ``{prefix}_m{n}`` clipped overlaps, ``{prefix}_p{n}`` / ``{prefix}_r{n}`` gram totals of the
    prediction / reference side, and with ``cosine`` ``{prefix}_dot``, ``{prefix}_np2``, ``{prefix}_nr2``."""
    names = [f"{prefix}_{k}{n}" for n in orders for k in "mpr"]
    names += [f"{prefix}_{k}" for k in ("dot", "np2", "nr2")] if cosine else []
    orders = tuple(orders)

    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [pair_counts(x, y, orders, cosine) for x, y in token_pairs(a, b)]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return F.arrow_udf(count, ", ".join(f"{n} long" for n in names))(pred, ref)


def overlap_counts(pairs: DataFrame, token_sets: dict[str, tuple[Column, Column, Sequence[int]]],
                   cosine: Sequence[str] = (), others: Sequence[Column] = ()) -> DataFrame:
    """All columns of ``pairs`` and the ``overlap_struct`` fields per prefix, with dot product and norms
    for prefixes in ``cosine``, and the fields of ``others``, further Arrow helpers' structs."""
    structs = [overlap_struct(pred, ref, prefix, orders, prefix in cosine) for prefix, (pred, ref, orders) in token_sets.items()]
    # one projection asks for all, so that Spark runs them in one Python worker of a task
    named = {f"_counts{i}": s for i, s in enumerate([*structs, *others])}
    return pairs.select("*", *[s.alias(n) for n, s in named.items()]).select(*pairs.columns, *[f"{n}.*" for n in named])
