"""Operator 4: token-id files in patched frame-of-reference blocks.

Documents are put in ascending id order by a range shuffle; each range becomes one
segment after another, closed by the document that reaches ``segment_ids`` ids.  A segment is a self-contained
byte string (``encode_segment`` / ``decode_segment`` / ``read_ids``):

    header    magic "PFOR", version, block size, ids, documents, first id position
    documents (doc_id int64, ids uint64) per document, all of them whole
    index     byte place of each block (uint64 each), so any block can be read alone
    blocks    minimum uint32, count uint16, width uint8, exceptions uint16, then
              count values minus the minimum packed at ``width`` bits, then the
              exceptions: places (uint16) and full differences (uint32)

The width of a block is the smallest that holds at least ``percentile`` of its
differences; the larger ones are exceptions.  The segments are written as rows of a
Parquet table (range, segment, data), since Spark commits those safely on any store and
after lost executors; each row is one file image that can also be stored on its own.

Defined results: null and empty texts hold the end id only; a very long text makes a
segment of its own; rows with null ids come first; rows of equal ids follow each other by
the hash of their text; other columns are ignored; an empty table gives no segment.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.shared import shared_path, text_chunks
from evalframe.llm.tokens import default_tokenizer, encoder

BLOCK = 256
PERCENTILE = 0.95
SEGMENT_IDS = 1 << 20
END_ID = 2
HEADER = struct.Struct("<4sHHQQQ")
MAGIC, VERSION = b"PFOR", 1
NULL_ID = -2**63


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, ``width`` bits each, low bits first."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(*values.shape, 4), axis=-1, bitorder="little")
    return np.packbits(bits[..., :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, bitorder="little")[:, :count * width].reshape(len(data), count, width)
    full = np.zeros((len(data), count, 32), np.uint8)
    full[..., :width] = bits
    return np.packbits(full, axis=-1, bitorder="little").reshape(len(data), count * 4).view("<u4")


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of a run of ids, in order."""
    whole = len(ids) // block
    out: list[bytes] = [b""] * -(-len(ids) // block)
    for rows, first in ((ids[:whole * block].reshape(whole, block), 0), (ids[None, whole * block:], whole)):
        if not rows.size:
            continue
        low = rows.min(axis=1)
        diff = rows - low[:, None]
        need = np.frexp(diff.astype(np.float64))[1]
        rank = int(np.ceil(percentile * rows.shape[1])) - 1
        width = np.partition(need, rank, axis=1)[:, rank]
        over = need > width[:, None]
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            body = _pack(diff[at], w)
            for k, b in enumerate(at.tolist()):
                places = np.flatnonzero(over[b])
                out[first + b] = (struct.pack("<IHBH", int(low[b]), rows.shape[1], w, len(places)) + body[k].tobytes()
                                  + places.astype("<u2").tobytes() + diff[b, places].astype("<u4").tobytes())
    return out


def decode_block(data: bytes, at: int = 0) -> np.ndarray:
    """The ids of the block that starts at byte ``at``."""
    low, count, width, patches = struct.unpack_from("<IHBH", data, at)
    at += 9
    size = (count * width + 7) // 8
    ids = _unpack(np.frombuffer(data, np.uint8, size, at)[None], count, width)[0].copy()
    places = np.frombuffer(data, "<u2", patches, at + size)
    ids[places] = np.frombuffer(data, "<u4", patches, at + size + 2 * patches)
    return ids + np.uint32(low)


def encode_segment(ids: np.ndarray, docs: list[tuple[int | None, int]], first: int,
                   block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    blocks = encode_blocks(np.asarray(ids, np.uint32), block, percentile)
    head = HEADER.pack(MAGIC, VERSION, block, len(ids), len(docs), first)
    table = np.array([(NULL_ID if d is None else d, n) for d, n in docs], np.int64).reshape(-1, 2)
    at = len(head) + 16 * len(docs) + 8 * len(blocks)
    index = at + np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1]
    return b"".join([head, table.astype("<i8").tobytes(), index.astype("<u8").tobytes(), *blocks])


def segment_head(data: bytes):
    """(block size, ids, first position, documents as (doc_id, n) rows, block index)."""
    magic, version, block, n, docs, first = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment")
    table = np.frombuffer(data, "<i8", 2 * docs, HEADER.size).reshape(-1, 2)
    index = np.frombuffer(data, "<u8", -(-n // block), HEADER.size + 16 * docs)
    return block, n, first, table, index


def read_ids(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment; only the blocks that hold them are read."""
    block, n, _, _, index = segment_head(data)
    start, stop = max(0, start), min(n, stop)
    if start >= stop:
        return np.zeros(0, np.uint32)
    parts = [decode_block(data, int(index[b])) for b in range(start // block, -(-stop // block))]
    return np.concatenate(parts)[start - start // block * block:][:stop - start]


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, documents as (doc_id, n) rows); blocks of one width are unpacked at once."""
    block, n, _, table, index = segment_head(data)
    raw, out = np.frombuffer(data, np.uint8), np.empty(n, np.uint32)
    at = index.astype(np.int64)
    if not len(at):
        return out, table
    last = decode_block(data, int(at[-1]))
    out[n - len(last):] = last
    at = at[:-1]
    heads = raw[at[:, None] + np.arange(9)]
    low = heads[:, :4].copy().view("<u4")[:, 0]
    patches = heads[:, 7:9].copy().view("<u2")[:, 0]
    rows = out[:len(at) * block].reshape(len(at), block)
    for w in np.unique(heads[:, 6]).tolist():
        k = np.flatnonzero(heads[:, 6] == w)
        size = (block * w + 7) // 8
        rows[k] = _unpack(raw[at[k][:, None] + 9 + np.arange(size)], block, w)
        for b in k[patches[k] > 0].tolist():
            p, place = int(patches[b]), int(at[b]) + 9 + size
            rows[b, np.frombuffer(data, "<u2", p, place)] = np.frombuffer(data, "<u4", p, place + 2 * p)
    rows += low[:, None]
    return out, table


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                      segment_ids: int = SEGMENT_IDS, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
    """Write the ids of all documents, in ascending id order, as segments under ``path``."""
    name, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(name)
        held, docs_, waiting, number, written, part = [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = encode_segment(np.frombuffer(b"".join(held), "<u4"), docs_, written, block, percentile)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([waiting], pa.int64()),
                 pa.array([data], pa.binary())], ["part", "segment", "n", "data"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for first, texts in text_chunks(batch):
                for i, text in enumerate(texts, first):
                    seq = words.encode(text) + end
                    held.append(seq)
                    docs_.append((ids[i], len(seq) // 4))
                    waiting += len(seq) // 4
                    if waiting >= segment_ids:
                        yield flush()
                        held, docs_, number, written, waiting = [], [], number + 1, written + waiting, 0
        if docs_:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(parts, "doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id()))
    ordered.mapInArrow(segments, "part int, segment long, n long, data binary").write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of the segments under ``path``;
    ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts the ids of all
    documents before it."""
    files = spark.read.parquet(path)
    # ids before each range: one row for each range (at most spark.sql.shuffle.partitions)
    per = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                ids, table = decode_segment(data)
                ends = np.cumsum(table[:, 1])
                start = base + segment_head(data)[2] + ends - table[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == NULL_ID else d for d in table[:, 0].tolist()], pa.int64()), pa.array(start),
                     pa.array(table[:, 1]), pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return files.join(F.broadcast(before), "part").select("base", "data").mapInArrow(
        unpack, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, **layout) -> DataFrame:
    """Write the segments (to the shared folder unless ``path`` is given) and read them back."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **layout)
    return read_token_files(docs.sparkSession, path)
