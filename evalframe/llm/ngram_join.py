"""Operator 3: n-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of five-word shingles is
at least ``num / 100``.  The plan:

* a fixed-size table of counters (``2**sketch_bits``) holds how many documents have a
  shingle of each hash bucket; it orders all shingles, rare ones first;
* documents with equal sets form one class, represented by the smallest id;
* a class of size n with match level l keeps the ``n - ceil(t n) + l`` first shingles
  of its set.  Two classes at t or above share at least ``min(l, l')`` shingles of their
  prefixes, so l can differ by document: each takes the level with the least estimated
  cost (postings read plus candidates that would reach verification);
* star round: every class is compared with the smallest class of each posting list;
* full round: classes that are not yet in one component meet in the posting lists that hold
  several components (see ``open_pairs``): in short lists each time, in long ones once at
  most, as each posting carries the long lists of its set.  Pairs that share ``min(l, l')``
  prefix shingles are verified exactly, unless the places of a shared one leave too little
  room.  The smaller set of a pair needs only ``n - ceil(2 t n / (1 + t)) + l`` places of its
  prefix.  Long lists are cut into parts.

Every pair at or above the threshold is verified or already connected, so the
components are exact.  Copies cost one row per document, near copies one row per posting.

Defined results: null or word-less text has an empty set and links with nothing; a row
with a null id gets a null component; repeated rows (same id and text) each return a row
with the same result; should an id carry several texts, its links are those of the smallest
text that shares a prefix; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import connected_components, shared_table, text_chunks
from evalframe.llm.wordhash import shingle_sets
from evalframe.operators.skew import lookup_join

NUM = 80
SKETCH_BITS = 20
MAX_LEVEL = 16
VERIFY_COST = 50.0
FILTER_BITS = 22
LIST_PART = 1024
SHORT_LIST = 32


def _bucket(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def shingle_counters(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Documents per hash bucket of shingles, over all documents: 2**bits numbers,
    whatever the size of the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, texts in text_chunks(batch):
                sets = shingle_sets(texts)
                total += np.bincount(_bucket(np.concatenate(sets), bits), minlength=1 << bits)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["bucket", "n"])

    rows = (docs.select("text").mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(1 << bits, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def choose_level(excess: np.ndarray, first: int, max_level: int = MAX_LEVEL) -> int:
    """Match level of least estimated cost.  ``excess``: documents expected to share each
    shingle, in prefix order; ``first``: prefix length at level 1."""
    top = min(max_level, len(excess) - first + 1)
    read = np.cumsum(excess)[first - 1:first - 1 + top]
    level = np.arange(1, len(read) + 1)
    return int(np.argmin(read + VERIFY_COST * read / level + level)) + 1


def prefixes(docs: DataFrame, counters: np.ndarray, num: int = NUM, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n, sig, level, prefix) of each document."""
    known = docs.sparkSession.sparkContext.broadcast(counters)
    schema = "doc_id long, n long, sig binary, level int, prefix array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnt = known.value
        noise = cnt.mean() + 4 * np.sqrt(cnt.mean()) + 1
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in text_chunks(batch):
                n, sig, levels, pre = [], [], [], []
                for s in shingle_sets(texts):
                    n.append(len(s))
                    sig.append(blake2b(s.tobytes(), digest_size=16).digest())
                    if not len(s):
                        levels.append(0)
                        pre.append(s.view(np.int64))
                        continue
                    c = cnt[_bucket(s, bits)]
                    order = np.lexsort((s, c))
                    keep = len(s) - (num * len(s) + 99) // 100
                    level = choose_level(np.maximum(c[order] - noise, 0.0), keep + 1)
                    levels.append(level)
                    pre.append(s[order[:keep + level]].view(np.int64))
                flat = np.concatenate(pre)
                offs = np.concatenate(([0], np.cumsum([len(p) for p in pre]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(levels, pa.int32()), pa.ListArray.from_arrays(offs, pa.array(flat))],
                    ["doc_id", "n", "sig", "level", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def index_length(num: int) -> Column:
    """Places of its prefix that a set needs against sets of its size and above: the overlap
    is then at least 2 t / (1 + t) of it, so ``n - ceil(2 t n / (1 + t)) + level`` do."""
    return F.col("n") - F.ceil(F.col("n") * (2 * num) / (100 + num)) + F.col("level")


def can_reach(num: int, before: Column | None = None) -> Column:
    """Whether sets that share a shingle at places ``ia`` and ``ib`` can be similar enough: no
    more than ``before`` (or the shorter starts), the shingle and the shorter ends are common."""
    most = (F.least("ia", "ib") if before is None else before) + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return most * (100 + num) >= num * (F.col("na") + F.col("nb"))


def bitmap(keys: DataFrame, bits: int = FILTER_BITS):
    """A predicate on the one column of ``keys``: false only where the value is not among
    them.  It is a bitmap of 2**bits places, whatever the number of keys, that keeps most
    rows without a partner out of a shuffle; a join decides about the others."""
    place = F.pmod(F.xxhash64(keys.columns[0]), F.lit(1 << bits)).cast("int")
    marks = np.zeros(1 << bits, bool)
    marks[keys.select(place.alias("m")).distinct().toArrow()["m"].to_numpy()] = True
    known = keys.sparkSession.sparkContext.broadcast(np.packbits(marks))

    @F.pandas_udf("boolean")
    def may_be(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series(known.value[at >> 3] >> (7 - (at & 7)) & 1 == 1)

    return may_be(place)


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of the classes in ``pairs``."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null").where(bitmap(ids))
    return shared_table(wanted.join(ids, "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text")), "texts")


def verify(pairs: DataFrame, texts: DataFrame, num: int = NUM, per_copy: int = 512) -> DataFrame:
    """Pairs (a, b) of ``texts(rep, text)`` whose exact set similarity reaches num / 100.

    A class in very many pairs is sent in one copy for each ``per_copy`` of its pairs, so
    that no task gets them all.  The texts grow with the input and are merged at every size."""
    load = pairs.groupBy("a").agg(F.count("*").alias("m"))
    copies = (load.select("a", F.explode(F.sequence(F.lit(0), (F.col("m") / per_copy).cast("int"))).alias("part"))
              .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a"))
    spread = (pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), (F.col("m") / per_copy).cast("int") + 1)
                                           .cast("int").alias("part")))
    both = (spread.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
            .join(copies.hint("merge"), ["a", "part"]).select("a", "b", "text_a", "text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())
            last, sa, keep = None, None, []
            for i in range(len(a)):
                if a[i] != last:
                    last, sa = a[i], shingle_sets([ta[i].as_py() or b""])[0]
                sb = shingle_sets([tb[i].as_py() or b""])[0]
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if both and 100 * both >= num * (len(sa) + len(sb) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()),
                                              pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def open_pairs(tagged: DataFrame, num: int = NUM, part: int = LIST_PART, short: int = SHORT_LIST) -> DataFrame:
    """Pairs (a, b) of ``tagged(tok, rep, i, n, level, comp)`` that are in different components and
    share as many prefix shingles as the lower of their levels.

    Lists of up to ``short`` postings give a row for each pair and list, at most ``short`` times
    their postings.  Of the longer lists, a pair leaves the join in the first that it shares, with
    the number of those that it shares, and only if the short ones can make up for the rest."""
    lists = (tagged.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
             .where("lo < hi").select("tok", "m"))
    rows = shared_table(lookup_join(tagged.select("tok", "rep", "i", "n", "level", "comp"), lists, ["tok"], "inner", spread=["rep"]), "open")
    few, many = rows.where(F.col("m") <= short), rows.where(F.col("m") > short)
    level, of_set = F.least("levela", "levelb"), ["rep", "n", "level"]

    def side(of: DataFrame, tag: str, *on: str) -> DataFrame:
        return of.select("tok", *on, *[F.col(c).alias(c + tag) for c in of.columns if c not in ("tok", "m", "share", "rep")],
                         F.col("rep").alias(tag))

    def meet(larger: DataFrame, smaller: DataFrame, *on: str) -> DataFrame:
        return (side(larger, "a", *on).join(side(smaller, "b", *on), ["tok", *on])
                .where("compa <> compb and (na > nb or (na = nb and a > b))"))

    needed = F.col("i") < index_length(num)
    one_each = meet(few, few.where(needed)).where(can_reach(num)).select("a", "b", level.alias("least"), F.lit(1).alias("shared"))

    def with_lists(of: DataFrame) -> DataFrame:
        """The long lists of a set in the order of its prefix, and how many short ones it is in."""
        long = of.where(F.col("m") > short).groupBy(*of_set).agg(F.sort_array(F.collect_list(F.struct("i", "tok"))).alias("x"))
        brief = of.where(F.col("m") <= short).groupBy(*of_set).agg(F.count("*").alias("brief"))
        known = long.join(brief, of_set, "left").select(*of_set, F.col("x.tok").alias("toks"), F.coalesce("brief", F.lit(0)).alias("brief"))
        return of.where(F.col("m") > short).join(known, of_set).withColumn("k", F.array_position("toks", F.col("tok")))

    parts = F.ceil(F.col("m") / part).cast("long")
    larger = with_lists(rows).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    smaller = with_lists(rows.where(needed)).withColumn("share", F.pmod(F.xxhash64("rep"), parts))
    spare, common = F.least("briefa", "briefb"), F.size(F.array_intersect("toksa", "toksb"))
    before = F.size(F.array_intersect(F.slice("toksa", F.lit(1), F.col("ka").cast("int") - 1),
                                      F.slice("toksb", F.lit(1), F.col("kb").cast("int") - 1)))
    once = (meet(larger, smaller, "share").where(can_reach(num, F.least(spare, "ia", "ib")))
            .where((common + spare >= level) & (before == 0)).select("a", "b", level.alias("least"), common.alias("shared")))
    return (one_each.unionByName(once).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
            .where("shared >= least").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def ngram_join(docs: DataFrame, num: int = NUM, bits: int = SKETCH_BITS, part: int = LIST_PART, short: int = SHORT_LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_class) per input row: size of the shingle
    set, smallest id reachable over links (itself included), and how many rows have the
    very same set.  See the module text for the method and the edge cases."""
    docs = docs.select("doc_id", "text")
    rows = shared_table(prefixes(docs, shingle_counters(docs, bits), num, bits), "prefix")
    classes = shared_table(rows.where("n > 0 and doc_id is not null").groupBy("sig")
                           .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_class")), "class")
    # only rows of classes with copies have to be joined to find their head
    copied = classes.where("n_class > 1").select("sig", "rep")
    full = rows.where("n > 0 and doc_id is not null").withColumn("copied", bitmap(copied.select("sig")))
    heads = full.where("not copied").select(F.col("doc_id").alias("rep"), "n", "level", "prefix").unionByName(
        full.where("copied").join(classes.select("sig", "rep"), "sig").where("doc_id = rep")
        .dropDuplicates(["rep", "sig"]).select("rep", "n", "level", "prefix"))
    # place, size and level of a posting travel as one number, its list's smallest class with it
    packed = F.col("i").cast("long") * 2**40 + F.col("n") * 2**8 + F.col("level")
    postings = heads.select("rep", "n", "level", F.posexplode("prefix").alias("i", "tok")).select("tok", "rep", packed.alias("p"))
    lists = (postings.groupBy("tok").agg(F.min("rep").alias("lead"), F.min_by("p", "rep").alias("lp"), F.count("*").alias("m"))
             .where("m > 1").drop("m"))

    def unpacked(p: str, tag: str) -> list[Column]:
        return [F.expr(f"cast(shiftright({p}, 40) as int)").alias("i" + tag),
                F.expr(f"cast(shiftright({p}, 8) & 4294967295 as int)").alias("n" + tag), F.expr(f"cast({p} & 255 as int)").alias("level" + tag)]

    met = shared_table(postings.join(lists, "tok"), "met")
    # pairs that share as many prefix shingles as their lower level asks for
    first = met.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"), *unpacked("lp", "a"), *unpacked("p", "b"))
    first = first.where(can_reach(num))
    met = met.select("tok", "rep", *unpacked("p", ""))
    star = shared_table(first.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("levela", "levelb")).alias("least"))
                        .where("shared >= least").select("a", "b"), "star")
    links = shared_table(verify(star, texts_of(star, docs), num), "links")
    comp = shared_table(connected_components(links), "comp")
    tagged = met.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    rest = shared_table(open_pairs(tagged, num, part, short).join(star, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(verify(rest, texts_of(rest, docs), num))
    comp = shared_table(connected_components(links), "comp")
    named = (classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("sig", "n_class", F.coalesce("component", "rep").alias("component")))
    return (rows.select("doc_id", "n", "sig").join(named, "sig", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("n_class")).alias("n_class")))


def drop_near_copies(docs: DataFrame, num: int = NUM) -> DataFrame:
    """``docs``, all columns, with one document of each component: that of the smallest id.
    Rows that repeat id and text are one document; rows without id all stay."""
    found = shared_table(ngram_join(docs, num).where("doc_id is not null"), "found")
    linked = (found.where("component_id <> doc_id or n_class > 1").groupBy(F.col("doc_id").alias("linked"))
              .agg(F.max(F.col("component_id") == F.col("doc_id")).alias("head")))
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-2**63))
    near = "__near"
    while near in docs.columns:
        near += "_"
    marked = docs.withColumn(near, F.col("doc_id").isNotNull() & bitmap(linked.select(F.col("linked").alias("doc_id"))))
    rest = marked.where(F.col(near)).join(linked, key == F.col("linked"), "left")
    one = rest.where("head").dropDuplicates(["doc_id"])
    return (marked.where(~F.col(near)).drop(near).unionByName(rest.where("linked is null").select(*docs.columns))
            .unionByName(one.select(*docs.columns)))
