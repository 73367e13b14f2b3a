"""Bigram counts of a corpus with few bytes between the machines (M5 perplexity).

Texts are taken in blocks of some million tokens, and a block is one row: the different
words, and the tokens as compressed places in them.  What a block must know of the whole
corpus it asks for in packed arrays: its words (``ask_words``), then its different bigrams
(``ask_bigrams``), each dealt over buckets by a hash.  A bucket sees all that blocks ask of
its part (``number_words``, ``count_bigrams``) and replies in the order it was asked, so a
reply needs no keys.  Words are compared as words and bigrams as pairs of word numbers:
hashes only deal.  A block asks for a bigram once, however often it has it, so a frequent
one fills no bucket; a Python worker holds one block or one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BLOCK_TOKENS = 1 << 21  # of a block, unless one text has more
BUCKET_WORDS = 1 << 19  # words that a bucket is asked for, about
BUCKET_TOKENS = 1 << 21  # tokens a bucket of bigrams; blocks ask for no more bigrams than they have tokens
WORDS_AT_ONCE = 1 << 16  # Python bytes while words are dealt
BIGRAMS_AT_ONCE = 1 << 18  # scored in one step

ASKED = "bucket long, block long, at binary, what binary, times binary"
WORD_REPLY = "block long, bucket long, at binary, number binary, times binary, different long"
BIGRAM_REPLY = "block long, bucket long, times binary"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed: the lowest bytes of all, then the next ones."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or int(values.max(initial=0)) < 1 << 8 * s)
    planes = np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T)
    return bytes([size]) + len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(values) else b"")


def unpack(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(memoryview(data)[9:], decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}")[:, 0]


def pack_words(words: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.record_batch([words], ["w"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack_words(data: bytes) -> pa.Array:
    return pa.concat_arrays(pa.ipc.open_stream(data).read_all().column(0).chunks)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64() if t == "long" else pa.binary()) for c, t in zip(columns, types)], list(names))


def _parts(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their buckets, and where each bucket begins; with the end."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _has_next(sizes: np.ndarray) -> np.ndarray:
    """For each token of texts of these sizes, whether its text goes on."""
    more = np.ones(int(sizes.sum()), bool)
    more[np.cumsum(sizes)[sizes > 0] - 1] = False
    return more


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Texts (key, array of tokens) as blocks of about ``limit`` tokens: ``keys`` and ``sizes`` of the texts,
    ``codes`` of their tokens, the different ``words`` by falling count, and how often each has a next (``times``)."""
    block, held, n = TaskContext.get().partitionId() << 33, [], 0

    def row() -> pa.RecordBatch:
        keys, sizes, tokens = zip(*held)
        keys, sizes = pa.concat_arrays(keys), np.concatenate(sizes)
        coded = pa.concat_arrays(tokens)  # of one dictionary
        codes = coded.indices.to_numpy()
        order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        codes = rank[codes]
        times = np.bincount(codes[_has_next(sizes)], minlength=len(order))
        return pa.record_batch(
            [pa.array([block], pa.int64()), pa.array([len(order)], pa.int64()), pa.array([len(codes)], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([pack(sizes)], pa.binary()),
             pa.array([pack(codes)], pa.binary()), pa.array([pack_words(coded.dictionary.take(pa.array(order)))], pa.binary()),
             pa.array([pack(times)], pa.binary())],
            ["block", "n_words", "n_tokens", "keys", "sizes", "codes", "words", "times"])

    for batch in batches:
        keys, tokens = batch.column(0), batch.column(1)
        ends, start = tokens.offsets.to_numpy(), 0
        while start < len(keys):
            stop = int(np.searchsorted(ends, ends[start] + limit - n, side="right")) - 1
            if stop <= start and not held:
                stop = start + 1  # a text of more than ``limit`` tokens
            if stop > start:
                # copies, so that the batch can go
                part = tokens.slice(start, stop - start).flatten().dictionary_encode()
                held.append((keys.take(pa.array(np.arange(start, stop))), np.diff(ends[start:stop + 1]).astype(np.int64), part))
                n, start = n + int(ends[stop] - ends[start]), stop
            if start < len(keys):  # the next text has no room
                yield row()
                block, held, n = block + 1, [], 0
    if held:
        yield row()


def ask_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of blocks (block, words, times) dealt over ``buckets``, with their places ``at`` in the block."""
    for batch in batches:
        for block, words, times in zip(*(c.to_pylist() for c in batch.columns)):
            words, times = unpack_words(words), unpack(times)
            bucket = np.empty(len(words), np.int64)
            for k in range(0, len(words), WORDS_AT_ONCE):
                some = words.slice(k, WORDS_AT_ONCE).to_pylist()
                bucket[k:k + len(some)] = [crc32(w.encode()) % buckets for w in some]
            order, begins = _parts(bucket, buckets)
            asked = ((b, order[i:j]) for b, (i, j) in enumerate(zip(begins, begins[1:])) if j > i)
            rows = [(b, block, pack(at), pack_words(words.take(pa.array(at))), pack(times[at])) for b, at in asked]
            yield from _table(ASKED, rows).to_batches()


def number_words(asked: pa.Table, buckets: int) -> pa.Table:
    """A number for each different word of a bucket, no other bucket's, and its ``times`` in all blocks.
    The first reply tells how many ``different`` words the bucket has."""
    rows = sorted(zip(*(c.to_pylist() for c in asked.columns)), key=lambda r: r[1])
    parts = [unpack_words(r[3]) for r in rows]
    coded = pa.concat_arrays(parts).dictionary_encode()
    codes, different = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    times = _sums(codes, np.concatenate([unpack(r[4]) for r in rows]), different)
    out, i = [], 0
    for (bucket, block, at, *_), words in zip(rows, parts):
        own = codes[i:i + len(words)]
        out.append((block, bucket, at, pack(own * buckets + bucket), pack(times[own]), 0 if i else different))
        i += len(words)
    return _table(WORD_REPLY, out)


def _sums(codes: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, codes, times.astype(np.int64))
    return out


class Block:
    """A block with the replies for its words: ``bigrams`` as one number for two words, in the order of its texts."""

    def __init__(self, block: pa.Table, replies: list[tuple], numbers: int):
        self.id, self.keys = block["block"][0].as_py(), _whole(block["keys"]).flatten()
        self.sizes = unpack(block["sizes"][0].as_py()).astype(np.int64)
        codes = unpack(block["codes"][0].as_py())
        number = np.zeros(block["n_words"][0].as_py(), np.uint64)
        self.times = np.zeros(len(number), np.int64)
        for at, n, times in replies:
            at = unpack(at)
            number[at], self.times[at] = unpack(n), unpack(times)
        more = _has_next(self.sizes)
        self.first = codes[more]
        self.bigrams = number[self.first]
        self.bigrams *= np.uint64(numbers)
        self.bigrams += number[codes[1:][more[:-1]]]

    def dealt(self, different: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        bucket = different * np.uint64(0x9E3779B97F4A7C15)
        bucket >>= np.uint64(32)
        bucket %= np.uint64(buckets)
        return _parts(bucket.view(np.int64), buckets)


def ask_bigrams(block: pa.Table, replies: pa.Table, numbers: int, buckets: int) -> pa.Table:
    """The different bigrams of a block, with how often it has each, dealt over ``buckets``."""
    b = Block(block, list(zip(*(replies[c].to_pylist() for c in ("at", "number", "times")))), numbers)
    different, times = np.unique(b.bigrams, return_counts=True)
    order, begins = b.dealt(different, buckets)
    asked = ((k, order[i:j]) for k, (i, j) in enumerate(zip(begins, begins[1:])) if j > i)
    # rising numbers are packed as what each adds
    rows = [(k, b.id, None, pack(np.diff(different[at], prepend=np.uint64(0))), pack(times[at])) for k, at in asked]
    return _table(ASKED, rows)


def count_bigrams(asked: pa.Table) -> pa.Table:
    """How often all blocks have each bigram that a block asked its bucket for, in the order it asked."""
    rows = sorted(zip(*(c.to_pylist() for c in asked.columns)), key=lambda r: r[1])
    parts = [np.cumsum(unpack(r[3]), dtype=np.uint64) for r in rows]
    ends = np.cumsum([len(p) for p in parts])
    different, codes = np.unique(np.concatenate(parts), return_inverse=True)
    times = _sums(codes, np.concatenate([unpack(r[4]) for r in rows]), len(different))
    return _table(BIGRAM_REPLY, [(r[1], r[0], pack(times[codes[e - len(p):e]])) for r, p, e in zip(rows, parts, ends)])


def text_scores(block: pa.Table, replies: pa.Table, numbers: int, buckets: int, k: float, vocabulary: int) -> pa.Table:
    """Of each text with a bigram: its key, the sum of its bigrams' log-probabilities and their number.
    Replies without ``at`` are those for bigrams."""
    rows = list(zip(*(replies[c].to_pylist() for c in ("bucket", "at", "number", "times"))))
    b = Block(block, [r[1:] for r in rows if r[1] is not None], numbers)
    different, codes = np.unique(b.bigrams, return_inverse=True)
    order, begins = b.dealt(different, buckets)
    times = np.zeros(len(different), np.int64)
    for bucket, at, _, reply in rows:
        if at is None:
            times[order[begins[bucket]:begins[bucket + 1]]] = unpack(reply)
    lp = np.empty(len(codes))
    for i in range(0, len(lp), BIGRAMS_AT_ONCE):
        some = slice(i, i + BIGRAMS_AT_ONCE)
        lp[some] = np.log((times[codes[some]] + k) / (b.times[b.first[some]] + k * vocabulary))
    n = np.maximum(b.sizes - 1, 0)
    sums = np.bincount(np.repeat(np.arange(len(n)), n), weights=lp, minlength=len(n))
    return pa.table([b.keys, pa.array(sums, pa.float64()), pa.array(n, pa.int64())], ["key", "sum_lp", "n"]).filter(pa.array(n > 0))
