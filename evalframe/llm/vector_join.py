"""Operator 12: near copies among embeddings by Euclidean p-stable hashing and exact cosines.

Vectors are normalised, projected on seeded Gaussian directions, shifted and cut into cells of
``WIDTH``; the cells of several directions together are a vector's bucket in one of several
tables.  Directions per table grow with the logarithm of the number of different vectors, so
that a vector meets some ``CHANCE`` unrelated ones a table at any size; the number of tables
follows from the wanted chance ``RECALL`` that a pair right at the threshold (the least likely
one) shares a bucket.  Pairs of a bucket are checked by their cosine in double precision.

* Equal vectors are one class; its size counts as links, and copies are never paired.
* A bucket of more than ``BLOCK`` vectors is cut into blocks by hash, and each two blocks are
  one piece of work, so no task holds more than about two blocks and no pair is left out.
* A pair counts in the first table whose bucket it shares.  Pieces of work return one number a
  vector and edges of a spanning forest, not their pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component
links with nothing, nor do vectors of different lengths; repeated rows are vectors of their own
(equal ones link); rows with a null id take part, and where no reachable vector has an id
component_id and kept are null; rows that share an id but not the vector are told apart; an
empty table gives an empty result; labels and other columns are ignored.  Components are of the
links found; ``recall`` in the tests holds these against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import connected_components, shared_table
from evalframe.operators.skew import lookup_join

COSINE = 0.95
RECALL = 0.995
WIDTH = 2.0
CHANCE = 64
BLOCK = 1024
SEED = 20240501


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at ``distance`` fall into one cell of one direction."""
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(directions per table, tables) for ``n`` different vectors."""
    near, far = same_cell(math.sqrt(2 - 2 * cosine)), same_cell(math.sqrt(2))
    directions = max(4, math.ceil(math.log(max(n / CHANCE, 1)) / -math.log(far)))
    return directions, math.ceil(math.log(1 - recall) / math.log(1 - near ** directions))


def usable(v: Column) -> Column:
    """Whether a vector can link: finite components, not all zero."""
    fine = F.forall(v, lambda x: F.coalesce((x > F.lit(float("-inf"))) & (x < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def bucketed(classes: DataFrame, directions: int, tables: int) -> DataFrame:
    """(node, m, unit, codes): normalised vectors and their bucket in each table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                u = unit(flat[starts[at][:, None] + np.arange(dim)])
                if dim not in drawn:
                    rng = np.random.default_rng([SEED, int(dim)])
                    drawn[dim] = (rng.standard_normal((dim, directions * tables)), rng.uniform(0, WIDTH, directions * tables),
                                  rng.integers(1, 2**64, directions, dtype=np.uint64) | np.uint64(1))
                lines, shift, odd = drawn[dim]
                cells = np.floor((u @ lines + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(u), tables, directions)
                h = np.full((len(u), tables), dim, np.uint64)
                for k in range(directions):
                    h = (h ^ cells[:, :, k]) * odd[k]
                    h ^= h >> np.uint64(29)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(at)), batch.column("m").take(pa.array(at)),
                     pa.ListArray.from_arrays(np.arange(0, u.size + 1, dim, dtype=np.int32), pa.array(u.ravel())),
                     pa.ListArray.from_arrays(np.arange(0, h.size + 1, tables, dtype=np.int32), pa.array(h.view(np.int64).ravel()))],
                    ["node", "m", "unit", "codes"])

    return classes.select("node", "m", "v").mapInArrow(code, "node long, m long, unit array<double>, codes array<long>")


def compare(u: np.ndarray, codes: np.ndarray, m: np.ndarray, side: np.ndarray, t: int,
            cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, row that it hangs on) of one piece of work: all pairs of its rows,
    or those between its two sides.  A pair counts if table ``t`` is the first that has it."""
    near = u @ u.T >= cosine
    if side.any():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    first = ~(codes[a, :t] == codes[b, :t]).any(1)
    links = np.bincount(a[first], weights=m[b[first]], minlength=len(u)).astype(np.int64)
    top = np.arange(len(u))
    while len(a):  # the least row number spreads over the links
        low = top.copy()
        np.minimum.at(low, a, top[b])
        low = low[low]
        if (low == top).all():
            break
        top = low
    return links, top


def linked(work: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): vector a has n links in this piece of work and is connected with b."""
    key = ["t", "code", "lo", "hi"]
    dealt = work.repartition(*key).sortWithinPartitions(*key, "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            held = None
            for batch in batches:
                tab = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                keys = np.stack([tab[c].to_numpy() for c in key], 1)
                cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                last = int(cut[-1]) if len(cut) else 0
                if last:
                    yield tab.slice(0, last), np.concatenate(([0], cut))
                held = tab.slice(last)
            if held is not None and held.num_rows:
                yield held, np.array([0, held.num_rows])

        for tab, cut in pieces():
            tab = tab.combine_chunks()
            node, m, t, side = (tab[c].to_numpy() for c in ("node", "m", "t", "side"))
            lists, codes = tab["unit"].chunk(0), tab["codes"].chunk(0)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            codes = codes.flatten().to_numpy(zero_copy_only=False).reshape(tab.num_rows, -1)
            out = []
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if y - x < 2:
                    continue
                u = flat[ends[x]:ends[y]].reshape(y - x, -1)
                links, top = compare(u, codes[x:y], m[x:y], side[x:y], int(t[x]), cosine)
                hit = np.flatnonzero((links > 0) | (top != np.arange(y - x)))
                out.append((node[x:y][hit], node[x:y][top[hit]], links[hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["a", "b", "n"])

    return dealt.select(*key, "node", "m", "side", "unit", "codes").mapInArrow(check, "a long, b long, n long")


def vector_join(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; see the module text."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("fine", usable(F.col("v")))
    classes = (rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = shared_table(classes, "class")
    directions, tables = plan(classes.count(), cosine, recall)
    coded = shared_table(bucketed(classes, directions, tables), "coded")
    cells = coded.select("node", F.posexplode("codes").alias("t", "code"))
    sizes = shared_table(cells.groupBy("t", "code").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    parts = F.ceil(F.col("size") / block).cast("long")
    members = (lookup_join(cells, sizes, ["t", "code"], "inner", spread=["node"]).withColumn("parts", parts)
               .withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")))
               .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    work = members.select("t", "code", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"),
                          (F.col("i") > F.col("j")).cast("int").alias("side"), "node").join(coded, "node")
    found = shared_table(linked(work, cosine), "found")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("a <> b").select("a", "b"), "vectors")
    named = classes.select("node", "rep", "m", "v").join(comp, "node", "left").join(links, "node", "left").select(
        "v", "rep", F.coalesce("component", "node").alias("component"),
        (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    named = shared_table(named, "named")
    heads = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = lookup_join(named, heads, ["component"], spread=["v"])
    lone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_rows = (lookup_join(rows.where("fine").select("vec_id", "v"), named.select("v", "n_links", "component_id"), ["v"],
                            spread=["vec_id"]).select("vec_id", "n_links", "component_id").unionByName(lone))
    return all_rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))
