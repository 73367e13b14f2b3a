"""Operator 11: the trie of conversation prefixes, rolled up by bands of depth.

Every conversation ``c`` is rebuilt first: the first ``h = crc32(decimal c) % 4`` turns of
conversation ``c - c % 20`` (all if it has fewer, none if it is absent), then its own turns
after its first ``h``.  A node is a distinct sequence of first ``d`` turns (role, text).

* Places of turns come from counts per sorted range, so a conversation of any length is spread
  over tasks; texts are read once, as a SHA-256 and a word count, and never shuffled.
* A node's id is the running XOR of two 64-bit hashes of (depth, role, digest): equal prefixes
  have equal ids, others collide with a chance of about 2**-128.  The running XOR goes band by
  band and over band totals, again by bands.
* Subtree totals (``rollup``): within bands of ``HEIGHT`` depths each node explodes to its
  ancestors of the band only.  Band roots form a trie of their own, ``HEIGHT`` times less deep,
  whose totals are completed in the same way; then each band root's total goes to the ancestors
  in the band above.  The rounds grow with the logarithm of the depth, the explosion is at most
  twice ``HEIGHT``, and hot ancestors are summed before the shuffle.
* The ids that end in a node are joined in blocks of ids, which one task hashes one after the
  other, as SHA-256 asks for; it holds one block at a time.

Defined results: null role or text is the empty string; null turns come first; equal turns are
ordered by role, then by the SHA-256 of the text, and repeated rows are turns of their own;
rows without conv_id belong to no conversation; ``%`` keeps the sign of conv_id, as in SQL;
very long texts count whole; an empty table has no node, not even a root; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.shared import shared_table
from evalframe.operators.skew import lookup_join, range_blocks

HEIGHT = 16
GROUP = 20
MOST_HEAD = 4
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "p1", "p2"]


def keep(df: DataFrame) -> DataFrame:
    return shared_table(df, "trie")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: conv_id, depth, a, b, words, ends; conversations)."""
    text = F.coalesce("text", F.lit(""))
    narrow = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.sha2(text, 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"),
        F.monotonically_increasing_id().alias("k"))
    order = [F.col("turn").asc_nulls_first(), "role", "digest", "k"]
    rows, blocks = range_blocks(narrow, ["conv_id"], order, keep)
    blocks = keep(blocks)
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD
    convs = (blocks.groupBy("conv_id").agg(F.max("_total").alias("n"))
             .withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = (convs.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
             .withColumn("total", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    convs = keep(convs.select("conv_id", "base", "h", "head", "total"))
    # blocks of a conversation are at most as many as ranges, rows of a block at most a range
    placed = rows.join(blocks.select("conv_id", "_p", "_off"), ["conv_id", "_p"]).withColumn(
        "pos", F.col("_off") + F.row_number().over(Window.partitionBy("conv_id", "_p").orderBy(*order)))
    placed = keep(placed.select("conv_id", "_p", "pos", "role", "digest", "words"))
    heads = placed.where(f"pos < {MOST_HEAD} and conv_id % {GROUP} = 0").select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "role", "digest", "words")
    head = (convs.where("head > 0").join(heads, "base").where("depth <= head")
            .select("conv_id", "total", "depth", "role", "digest", "words"))
    of_block = blocks.select("conv_id", "_p").join(convs.select("conv_id", "h", "head", "total"), "conv_id")
    tail = (placed.join(of_block, ["conv_id", "_p"]).where("pos > h")
            .select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "role", "digest", "words"))
    both = head.unionByName(tail).select(
        "conv_id", "depth", F.xxhash64("depth", "role", "digest").alias("a"),
        F.xxhash64(F.lit("second"), "digest", "role", "depth").alias("b"), F.col("words").cast("long").alias("words"),
        (F.col("depth") == F.col("total")).alias("ends"))
    return keep(both), convs


def running_xor(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``rows(conv_id, at, a, b, ...)``, ``at`` counting from 0 without gaps, with the XOR of
    a and b up to the row as p1 and p2.  Each window holds at most ``height`` rows."""
    rows = rows.withColumn("band", F.floor(F.col("at") / height).cast("long"))
    upto = Window.partitionBy("conv_id", "band").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("p1", F.bit_xor("a").over(upto)).withColumn("p2", F.bit_xor("b").over(upto))
    if not rows.where("band > 0").limit(1).take(1):
        return inner.drop("band")
    long = rows.where("band > 0").select("conv_id").distinct()
    sums = keep(rows.join(long, "conv_id", "left_semi").groupBy("conv_id", F.col("band").alias("at"))
                .agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")))
    before = running_xor(sums, height).select("conv_id", (F.col("at") + 1).alias("band"), F.col("p1").alias("c1"),
                                              F.col("p2").alias("c2"))
    carried = (inner.where("band > 0").join(before, ["conv_id", "band"])
               .withColumn("p1", F.col("p1").bitwiseXOR(F.col("c1"))).withColumn("p2", F.col("p2").bitwiseXOR(F.col("c2"))))
    return inner.where("band = 0").unionByName(carried.drop("c1", "c2")).drop("band")


def rollup(nodes: DataFrame, prefixes: DataFrame, sums: list[str], height: int = HEIGHT) -> DataFrame:
    """(depth, p1, p2, rep, sums) of ``nodes``, the sums taken over each node's subtree.

    ``nodes(depth, p1, p2, rep, sums)``; ``prefixes(conv_id, depth, p1, p2)``: the ids along
    each conversation; ``rep``: a conversation that has the node."""
    band = F.floor(F.col("depth") / height).cast("long")
    paths = (prefixes.groupBy("conv_id", band.alias("band"))  # at most `height` entries each
             .agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("path")))

    def up(rows: DataFrame, at) -> DataFrame:
        """Each row's sums added to its representative's nodes in band ``at``, itself at most."""
        found = rows.withColumn("band", at).join(paths.withColumnRenamed("conv_id", "rep"), ["rep", "band"])
        return (found.select(F.col("depth").alias("own"), *sums, F.explode("path").alias("x")).where("x.depth <= own")
                .groupBy(*[F.col(f"x.{c}").alias(c) for c in NODE]).agg(*[F.sum(s).alias(s) for s in sums]))

    nodes = nodes.withColumn("band", band)
    within = keep(up(nodes, F.col("band")).join(nodes.select(*NODE, "rep"), NODE))
    if not nodes.where("band > 0").limit(1).take(1):
        return within
    scaled = (F.col("depth") / height).cast("long").alias("depth")
    roots = within.where(f"depth % {height} = 0").select(scaled, "p1", "p2", "rep", *sums)
    steps = prefixes.where(f"depth % {height} = 0").select("conv_id", scaled, "p1", "p2")
    done = rollup(keep(roots), keep(steps), sums, height).where("depth > 0")
    below = done.withColumn("depth", F.col("depth") * height)
    from_below = up(below, F.floor(F.col("depth") / height).cast("long") - 1)
    total = within.join(from_below.withColumnsRenamed({s: "__" + s for s in sums}), NODE, "left")
    return keep(total.select(*NODE, "rep", *[(F.col(s) + F.coalesce("__" + s, F.lit(0))).alias(s) for s in sums]))


def end_hashes(ends: DataFrame, block: int = 10) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of ``ends(depth, p1, p2, conv_id)``: ids ascending, joined by
    commas, in blocks of 2**block id numbers, hashed one block after the other."""
    blocks = (ends.groupBy(*NODE, F.shiftright("conv_id", block).alias("blk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))
    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "blk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def out(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k, _ in done], pa.int64()) for i in range(3)] + [pa.array([d for _, d in done], pa.string())],
                [*NODE, "ends_sha256"])

        for batch in batches:
            done = []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*NODE, "ids"]]
            for d, a, b, ids in zip(*cols):
                if (d, a, b) != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state = (d, a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield out(done)
        if state is not None:
            yield out([(at, state.hexdigest())])

    return dealt.select(*NODE, "ids").mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  See the module text for the method and edge cases."""
    rows, convs = rebuilt(turns)
    # depths count from 1; the root is depth 0 of every conversation
    steps = running_xor(rows.withColumn("at", F.col("depth") - 1), height)
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "a", "b", "words")], (F.col("total") == 0).alias("ends"),
                        zero.alias("p1"), zero.alias("p2"))
    steps = keep(steps.select("conv_id", F.col("depth").cast("long").alias("depth"), "a", "b", "words", "ends", "p1", "p2")
                 .unionByName(root))
    nodes = steps.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"),
                                     F.min("words").alias("words"), F.min("a").alias("a"), F.min("b").alias("b"))
    nodes = keep(nodes.select(*NODE, "rep", "n_convs", "words", (F.col("depth") - 1).alias("up"),
                              F.col("p1").bitwiseXOR(F.col("a")).alias("q1"), F.col("p2").bitwiseXOR(F.col("b")).alias("q2")))
    children = (nodes.where("depth > 0").groupBy(F.col("up").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = keep(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select(*NODE, "rep", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = rollup(own, steps.select("conv_id", *NODE), ["n_leaves", "saved_tokens"], height)
    hashes = end_hashes(steps.where("ends").select(*NODE, "conv_id"))
    parents = nodes.select(F.col("depth").alias("up"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("rep").alias("parent_conv_id"))
    full = (nodes.join(totals.drop("rep"), NODE).join(hashes, NODE, "left"))
    return (lookup_join(full, parents, ["up", "q1", "q2"], spread=["p1", "p2"])
            .select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
