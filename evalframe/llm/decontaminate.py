"""Operator 5: benchmark decontamination with SimHash windows.

Each benchmark item is fingerprinted (64-bit SimHash of word hashes) by windows of its own
size, rounded down to a geometric grid at or below ``similarity`` of its words and to at
most ``MAX_WINDOW`` words, at every offset.  Documents are fingerprinted at every word by
windows of the sizes that occur.  The fingerprints of the items are indexed by
``RADIUS + 1`` blocks of bits: two fingerprints within the radius agree in one block at
least, so looking up each block finds all of them.  A candidate places the item over the
document's words; it counts when the weighted Jaccard similarity of the five-word shingles
(weight: bytes of the words, with repeats) reaches ``similarity``.  It is compared with the
stretch of the item's own length there and, for passages with words deleted or inserted,
with each run about it, of any length that can reach ``similarity``, from the item's first
word to its last.  Not tried are runs of another length whose first or last word differs.

A run of words that is left whole in the document gives a distance of 0, and a passage at
0.8 or more keeps one that is longer than a window.  The items are searched in blocks of
about ``block_bytes`` of text; each block is one pass over the documents with an index of
bounded size, so neither the driver nor a task holds more than a block.

Defined results: null, empty or word-less texts and items never match; an item of one to
four words has one shingle, its whole sequence; each matching row of documents has a row of its
own, also if rows or ids repeat or are null; several texts of one item id are one item, at its
most similar place; of places that are equally similar the first counts; very long texts are
searched whole; other columns are ignored; no items or an empty table: no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import shared_table, text_chunks
from evalframe.llm.wordhash import SHINGLE, shingles, window_hashes, words

SIMILARITY = 0.8
RADIUS = 3
MAX_WINDOW = 32
BLOCK_BYTES = 8 << 20
STEP = 1 << 14
GRID = [1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 26, 32]


def simhash(h: np.ndarray, width: int, sums: np.ndarray | None = None) -> np.ndarray:
    """SimHash of each run of ``width`` word hashes: the majority of each bit."""
    if sums is None:
        sums = bit_sums(h)
    more = (sums[width:] - sums[:-width]).view(np.uint8) > width // 2
    return np.packbits(more, axis=1).view(np.uint64)[:, 0]


def bit_sums(h: np.ndarray) -> np.ndarray:
    """Running sums of the 64 bits, a byte each, eight to a number.  A byte may run over into the
    next, but a difference of two sums is right as long as it fits (windows up to 255 words)."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    out = np.zeros((len(h) + 1, 8), np.uint64)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def profile(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, repeats, weight of one) of a run of words with their byte lengths."""
    key = shingles(h)
    width = min(SHINGLE, len(h))
    weight = np.convolve(size, np.ones(width, np.int64), "valid")
    key, first, count = np.unique(key, return_index=True, return_counts=True)
    return key, count, weight[first]


def weighted_jaccard(p, q) -> float:
    _, i, j = np.intersect1d(p[0], q[0], assume_unique=True, return_indices=True)
    common = float((np.minimum(p[1][i], q[1][j]) * p[2][i]).sum())
    total = float((p[1] * p[2]).sum() + (q[1] * q[2]).sum()) - common
    return common / total if total else 0.0


class Runs:
    """Runs of words of a chunk of texts, compared with items of ``SHINGLE`` words or more."""

    def __init__(self, h: np.ndarray, size: np.ndarray) -> None:
        self.h, self.keys = h, window_hashes(h)
        self.weight = np.convolve(size, np.ones(SHINGLE, np.int64), "valid") if len(h) >= SHINGLE else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(self.weight)))

    def best(self, low: int, high: int, place: int, upto: int, ends: tuple, own, similarity: float) -> tuple[float, int]:
        """(similarity, first word) of the best run about words ``place`` to ``upto``, inside words
        ``low`` to ``high``, from the item's first word to its last.  A run that reaches
        ``similarity`` weighs at most 1 / similarity of the item."""
        total = int((own[1] * own[2]).sum())
        most, top = total / similarity, len(self.before) - 1
        low = max(low, int(np.searchsorted(self.before, self.before[min(max(place, 0), top)] - most)))
        high = min(high, int(np.searchsorted(self.before, self.before[min(max(upto, 0), top)] + most, "right")) + SHINGLE)
        starts = low + np.flatnonzero(self.h[low:high] == ends[0])
        stops = low + np.flatnonzero(self.h[low:high] == ends[1]) + 1
        if not len(starts) or not len(stops):
            return 0.0, 0
        keys = self.keys[low:max(low, high - SHINGLE + 1)]
        item = np.minimum(np.searchsorted(own[0], keys), len(own[0]) - 1)
        at = np.flatnonzero(own[0][item] == keys)
        item = item[at]
        at = at + low
        if (own[1] * own[2])[np.unique(item)].sum() < similarity * total:
            return 0.0, 0
        # the place of the same shingle as many repeats ago as the item has
        order = np.argsort(item, kind="stable")
        first = np.searchsorted(item[order], item[order])
        rank, old = np.arange(len(order)) - first, np.full(len(order), -1)
        over = np.flatnonzero(rank >= own[1][item[order]])
        old[order[over]] = at[order[over - own[1][item[order[over]]]]]
        best = 0.0, 0
        for a in starts.tolist():
            b = stops[(stops >= a + SHINGLE)]
            b = b[self.before[b - SHINGLE + 1] - self.before[a] <= most]
            if not len(b):
                continue
            common = np.concatenate(([0], np.cumsum(np.where((at >= a) & (old < a), self.weight[at], 0))))
            common = common[np.searchsorted(at, b - SHINGLE, "right")]
            found = common / (self.before[b - SHINGLE + 1] - self.before[a] + total - common)
            best = max(best, (float(found.max()), a), key=lambda x: x[0])
        return best


class Index:
    """Fingerprints of a block of items, by window size and block of bits."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY) -> None:
        self.similarity, self.items, self.ends, self.sizes = similarity, [], [], {}
        found: dict[int, list] = {}
        h, bounds, start, end = words([(t or "").encode() for _, t in items])
        for k, (item_id, _) in enumerate(items):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if a == b:
                continue
            fit = max(1, min(MAX_WINDOW, int(similarity * (b - a))))
            width = max(w for w in GRID if w <= fit)
            marks = simhash(h[a:b], width)
            at = np.arange(len(marks))
            found.setdefault(width, []).append((marks, np.full(len(at), len(self.items)), at))
            self.items.append((item_id, b - a, profile(h[a:b], (end - start)[a:b])))
            self.ends.append((h[a], h[b - 1]))
        for width, parts in found.items():
            marks, item, at = (np.concatenate(x) for x in zip(*parts))
            blocks = []
            for v in marks.view(np.uint16).reshape(-1, RADIUS + 1).T:
                order = np.argsort(v, kind="stable")
                first = np.searchsorted(v[order], np.arange(65537)).astype(np.int32)
                blocks.append((first, order.astype(np.int32), np.diff(first) > 0))
            self.sizes[width] = (marks, item, at, blocks)

    def near(self, h: np.ndarray, width: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) pairs of fingerprints within the radius."""
        marks, _, _, blocks = self.sizes[width]
        mine = simhash(h, width, sums)
        values = mine.view(np.uint16).reshape(-1, RADIUS + 1).T
        window, entry = [], []
        for v, (first, order, some) in zip(values, blocks):
            hit = np.flatnonzero(some[v])
            n = first[v[hit].astype(np.int32) + 1] - first[v[hit]]
            w = np.repeat(hit, n)
            e = order[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[v[hit]], n)]
            close = np.bitwise_count(mine[w] ^ marks[e]) <= RADIUS
            window.append(w[close])
            entry.append(e[close])
        return np.concatenate(window), np.concatenate(entry)

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """Word places at which an item may begin, by (text, item)."""
        found: dict[tuple[int, int], set[int]] = {}
        for lo in range(0, len(h), STEP):
            part = h[lo:lo + STEP + MAX_WINDOW - 1]
            sums = bit_sums(part)
            for width, (_, item, at, _) in self.sizes.items():
                if len(part) < width:
                    continue
                window, entry = self.near(part, width, sums)
                window = window + lo
                row = np.searchsorted(bounds, window, side="right") - 1
                inside = window + width <= bounds[row + 1]
                for r, i, w in zip(row[inside].tolist(), item[entry[inside]].tolist(), (window - at[entry])[inside].tolist()):
                    found.setdefault((r, i), set()).add(w)
        return found

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(text, item, first word, similarity) of the best passage of each item in each text
        (the first of several that are equally similar), if it reaches the threshold."""
        h, bounds, start, end = words(texts)
        size, out, runs = end - start, [], None
        for (r, i), places in self.candidates(h, bounds).items():
            low, high, n, own = int(bounds[r]), int(bounds[r + 1]), self.items[i][1], self.items[i][2]
            places = sorted(places)
            best, first = 0.0, 0
            for w in places:
                a, b = max(w, low), min(w + n, high)
                s = weighted_jaccard(profile(h[a:b], size[a:b]), own)
                if s > best:
                    best, first = s, a
            if best < 1 and n >= SHINGLE:
                runs = runs or Runs(h, size)
                k = 0
                while k < len(places):  # places within an item's length are searched as one stretch
                    j = k
                    while j + 1 < len(places) and places[j + 1] - places[j] <= n:
                        j += 1
                    s, a = runs.best(low, high, places[k], places[j] + n, self.ends[i], own, self.similarity)
                    if (s, -a) > (best, -first):
                        best, first = s, a
                    k = j + 1
            if best >= self.similarity:
                out.append((r, i, first - low, best))
        return out

    def by_id(self, texts: list[bytes]) -> list[tuple[int, int, int, float]]:
        """As ``search``, with the item's id; of several texts of one id the most similar one."""
        best: dict[tuple, tuple] = {}
        for r, i, a, s in self.search(texts):
            key = (r, self.items[i][0])
            best[key] = max(best.get(key, (0.0, 0)), (s, -a))
        return [(*key, -a, s) for key, (s, a) in best.items()]


def item_blocks(benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of the distinct items, one block of about ``block_bytes`` after the other; all
    texts of an id are in one block."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        index = Index([tuple(r) for r in rows], similarity)
        if index.items:
            yield index


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): the best place of each item in each row of
    ``docs``.  Each block of items is one pass over the documents, written before the next."""
    schema = "doc_id long, item_id long, start_word long, similarity double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, last = docs.sparkSession.createDataFrame([], schema), None
    for index in item_blocks(benchmark, similarity, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                for first, texts in text_chunks(batch):
                    got = sent.value.by_id(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[first + g[0]].as_py() for g in got], pa.int64()),
                         pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                         pa.array([g[3] for g in got], pa.float64())], ["doc_id", "item_id", "start_word", "similarity"])

        if last is not None:
            found = found.unionByName(shared_table(last, "passages"))
        last = docs.mapInArrow(look, schema)
    return found if last is None else found.unionByName(last)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark passage.  What one block
    of items leaves is written before the next block is looked for in it."""
    done = False
    for index in item_blocks(benchmark, similarity, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, texts in text_chunks(batch):
                    clean[[first + g[0] for g in sent.value.search(texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = (shared_table(docs, "clean") if done else docs).mapInArrow(keep, docs.schema)
        done = True
    return docs
