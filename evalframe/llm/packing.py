"""Operator 2: best-fit packing with swap-based local search.

Each document becomes its token ids and an end id; only documents above the capacity are
cut, into pieces of exactly the capacity (the last may be shorter).  Full pieces are
sequences of their own.  The other pieces are dealt evenly over buckets of about
``bucket_rows`` pieces; each bucket is packed in one task:

* best fit, longest first, gives the start;
* local search then empties the least filled bins: a piece of such a bin moves into
  another underfull bin, or is exchanged one-for-one or two-for-one against shorter pieces
  there, always such that the sum of squared fills grows, until no step is left or no bin
  can be saved any more.

Buckets are independent, so a lost executor repeats its buckets only, and packing costs at
most one partly filled sequence a bucket against packing everything in one task.

Defined results: null and empty texts are one end id; rows with equal or null ids are
separate documents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import shared_table, text_chunks
from evalframe.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
BUCKET_ROWS = 16384
END_ID = 0


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                 end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of each piece of each document;
    ``keep_ids=False`` leaves out the ids themselves."""
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for first, texts in text_chunks(batch):
                rows: list[tuple] = []
                for i, text in enumerate(texts, first):
                    seq = words.encode(text) + end
                    for p in range(-(-len(seq) // (4 * capacity))):
                        part = seq[4 * capacity * p:4 * capacity * (p + 1)]
                        rows.append((ids[i], p, capacity * p, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows))
                out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out, names = [*out, pa.array(cols[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def best_fit(length: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, into the fullest bin that has room."""
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, bins, out = 0, 0, np.empty(len(length), np.int64)
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        room = gaps >> n
        if room:
            gap = n + ((room & -room).bit_length() - 1)
            b = at[gap].pop()
            if not at[gap]:
                gaps &= ~(1 << gap)
        else:
            b, gap, bins = bins, capacity, bins + 1
        out[i] = b
        gap -= n
        if gap:
            at[gap].append(b)
            gaps |= 1 << gap
    return out


def local_search(length: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty the least filled bins by moves and exchanges that raise the sum of squared
    fills; returns the new bin of each piece."""
    bins = bins.copy()
    count = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, length, count).astype(np.int64)
    members: list[list[int]] = [[] for _ in range(count)]
    for i, b in enumerate(bins.tolist()):
        members[b].append(i)
    spare = int(capacity * count - fill.sum()) // capacity

    def units(of) -> tuple[np.ndarray, np.ndarray, list]:
        """What bins can give for a longer unit: single pieces and pairs of pieces."""
        owner, size, parts = [], [], []
        for b in of:
            m = members[b]
            for x in range(len(m)):
                owner.append(b), size.append(int(length[m[x]])), parts.append((m[x],))
                for y in range(x + 1, len(m) if len(m) <= 6 else 0):
                    owner.append(b), size.append(int(length[m[x]] + length[m[y]])), parts.append((m[x], m[y]))
        return np.array(owner, np.int64), np.array(size, np.int64), parts

    while spare > 0:
        touched: set[int] | None = None  # bins that changed since the units were listed
        saved = 0
        for v in sorted(np.flatnonzero((fill > 0) & (fill < capacity)).tolist(), key=lambda b: (fill[b], b)):
            if saved >= spare:
                break
            moved = True
            while members[v] and moved:
                moved = False
                m = sorted(members[v], key=lambda i: (-length[i], i))
                gap = capacity - fill
                gap[v] = 0
                gap[(fill < fill[v]) | (fill == 0)] = 0
                for i in m:  # move
                    room = np.where(gap >= length[i], gap, capacity + 1)
                    b = int(room.argmin())
                    if room[b] <= capacity:
                        _shift(members, fill, bins, length, v, b, (i,), ())
                        if touched is not None:
                            touched |= {v, b}
                        moved = True
                        break
                if moved:
                    continue
                if touched is None or len(touched) > 64:
                    listed, touched = units(np.flatnonzero((fill < capacity) & (fill > 0)).tolist()), set()
                stale = np.zeros(count, bool)
                stale[list(touched)] = True
                best, choice = 0, None
                give = [(i,) for i in m] + [(i, j) for k, i in enumerate(m) for j in m[k + 1:]]
                for owner, size, parts, usable in ((*listed, ~stale), (*units(sorted(touched)), stale)):
                    usable = usable[owner] & (gap[owner] > 0)
                    for unit in give:  # exchange for a shorter unit of a fuller bin
                        n = int(sum(length[k] for k in unit))
                        gain = np.where(usable & (size + gap[owner] >= n), n - size, 0)
                        k = int(gain.argmax()) if len(gain) else 0
                        if len(gain) and gain[k] > best:
                            best, choice = int(gain[k]), (int(owner[k]), unit, parts[k])
                if choice:
                    b, unit, back = choice
                    _shift(members, fill, bins, length, v, b, unit, back)
                    touched |= {v, b}
                    moved = True
            saved += not members[v]
        spare -= saved
        if not saved:
            break
    return bins


def _shift(members, fill, bins, length, v, b, there, back) -> None:
    """Unit ``there`` goes from bin v to b, unit ``back`` from b to v."""
    for i in there:
        members[v].remove(i)
        members[b].append(i)
        bins[i] = b
        fill[v] -= length[i]
        fill[b] += length[i]
    for i in back:
        members[b].remove(i)
        members[v].append(i)
        bins[i] = v
        fill[b] -= length[i]
        fill[v] += length[i]


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (place in the sequence) to rows that have a
    ``length`` of at most ``capacity``; all other columns stay."""
    pieces = shared_table(pieces, "pieces").withColumn("sequence_id", F.monotonically_increasing_id())
    full, part = pieces.where(F.col("length") >= capacity), pieces.where(F.col("length") < capacity)
    buckets = max(1, -(-part.count() // bucket_rows))
    schema = part.withColumn("offset", F.lit(0).cast("long")).schema

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sequence_id", kind="stable").reset_index(drop=True)
        length = rows["length"].to_numpy()
        bins = local_search(length, best_fit(length, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.concatenate(([True], np.diff(bins[order]) > 0))
        rows = rows.iloc[order]
        return rows.assign(offset=before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order)))),
                           sequence_id=-1 - (int(key[0]) + buckets * bins[order]))[[f.name for f in schema]]

    dealt = part.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(buckets)).alias("bucket"))
    return full.withColumn("offset", F.lit(0).cast("long")).unionByName(dealt.applyInPandas(place, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves, from rows
    that kept their ids.  A group is one sequence, so its size is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.expr("aggregate(p.ids, X'', (a, x) -> concat(a, x))").alias("ids"),
                    F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets")))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                   keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place; ``sequences`` of it gives the ids."""
    return pack(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), capacity)
