"""Operator 13: spelling variants by composing the vocabulary's minimised acceptor with a
one-edit transducer and the acceptor again.

Words are runs of letters with ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences at least.
Two are near if one inserted, deleted or replaced code point separates them.  The composed
machine (acceptor, one edit, acceptor) is enumerated by partitions of initial states.

* A pair is worked on with ``l``, the length of its shorter word, whose places are cut into two
  segments.  All of both words outside the segment of their first difference is equal; it names
  the partition, and its initial state is the one that the part before the segment leads to.
* In a partition, the middle parts of its words make a minimised acyclic acceptor.  Before the
  edit both copies of the acceptor are in the same state, so the composition goes through the
  states once: two different arcs of a state are a replacement, one arc against staying is an
  insertion, and after it both copies read the same code points to their ends.
* A partition of more than ``LIMIT`` words has its segment halved, again and again; with segments
  of one place the alphabet bounds it.  No words or pairs are dropped.
* Forms grow tenfold a step, so a chain has at most 19 steps, and roots are found by doubling.

Defined results: null texts have no words, a null doc_id is written as nothing in the hash;
repeated rows count as often as they occur; very long runs are words like others; equal counts
are decided by code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import shared_table
from evalframe.operators.skew import lookup_join

MIN_LENGTH = 7
MIN_COUNT = 2
EDIT_ONE_IN = 31
RATIO = 10
LIMIT = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all texts.  Shorter runs cannot become words, so the pattern leaves them out."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), 0)
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    h = F.crc32(F.concat_ws(":", "d", "w"))
    at = (h % F.length("w")).cast("int")
    less = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    word = F.when(h % EDIT_ONE_IN == 0, less).otherwise(F.col("w"))
    return (run.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def acceptor(words: list[str]) -> tuple[list[tuple[bool, dict[str, int]]], int]:
    """Minimised acyclic acceptor of sorted different words: (final, arcs) of each state, and the
    initial state.  States with the same right language are one: each is registered by its end
    mark and arcs as soon as no later word can add to it."""
    states, register = [], {}
    path, last = [[False, {}]], ""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            key = (final, *arcs.items())
            if key not in register:
                register[key] = len(states)
                states.append((final, arcs))
            path[-1][1][last[len(path) - 1]] = register[key]

    for w in words:
        k = 0
        while k < len(w) and k < len(last) and w[k] == last[k]:
            k += 1
        close(k)
        path.extend([False, {}] for _ in range(len(w) - k))
        path[-1][0] = True
        last = w
    close(0)
    states.append((path[0][0], path[0][1]))
    return states, len(states) - 1


def common(states: list, p: int, q: int, skip: str = "") -> Iterator[str]:
    """What both states accept, without strings that begin with ``skip``."""
    todo, read = [(p, q, 0, "")], []
    while todo:
        p, q, depth, c = todo.pop()
        del read[max(depth - 1, 0):]
        if depth:
            read.append(c)
        if states[p][0] and states[q][0]:
            yield "".join(read)
        other = states[q][1]
        for c, to in states[p][1].items():
            if c in other and (depth or c != skip):
                todo.append((to, other[c], depth + 1, c))


def composed(states: list, start: int) -> Iterator[tuple[str, str]]:
    """The pairs that acceptor, one edit and acceptor let through, each once: the shorter first, or
    the lesser of two of one length.  The edit is at the first place where the two differ."""
    edits = {}
    for q, (_, arcs) in enumerate(states):
        tails = []
        arc = list(arcs.items())
        for i, (a, to) in enumerate(arc):
            for b, other in arc[i + 1:]:
                tails.extend((a + z, b + z) for z in common(states, to, other))
            tails.extend((z, a + z) for z in common(states, q, to, skip=a))
        if tails:
            edits[q] = tails
    into = [[] for _ in states]
    for q, (_, arcs) in enumerate(states):
        for c, to in arcs.items():
            into[to].append((q, c))
    for q, tails in edits.items():
        todo, read = [(q, 0, "")], []
        while todo:  # all ways from the initial state, read backwards
            at, depth, c = todo.pop()
            del read[max(depth - 1, 0):]
            if depth:
                read.append(c)
            if at == start:
                head = "".join(reversed(read))
                for x, y in tails:
                    yield head + x, head + y
            todo.extend((p, depth + 1, c) for p, c in into[at])


def group_pairs(words: list[str], size: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Near pairs of words that agree outside places ``lo`` to ``hi`` of a shorter word of ``size``
    places, and differ there first."""
    rest = size - hi
    middle = {w[lo:len(w) - rest]: w for w in words}
    if len(middle) < 2:
        return
    last = hi == size
    for x, y in composed(*acceptor(sorted(middle))):
        if len(x) > len(y):
            x, y = y, x
        if len(x) != hi - lo:  # two words of the longer kind: another partition's pair
            continue
        if len(y) > len(x) and not last:
            k = 0
            while k < len(x) and x[k] == y[k]:
                k += 1
            if k == len(x):  # it differs first in the next segment
                continue
        yield middle[x], middle[y]


def near_pairs(vocab: DataFrame, limit: int = LIMIT, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, near, near_n) in both directions."""
    size = F.explode(F.filter(F.array(F.length("word") - 1, F.length("word")), lambda x: x >= min_length))
    rows = vocab.select("word", "n", size.alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).withColumn("cuts", F.lit(2))
    todo, found = rows, []
    while True:
        lo = F.floor(F.col("seg") * F.col("size") / F.col("cuts")).cast("int")
        hi = F.floor((F.col("seg") + 1) * F.col("size") / F.col("cuts")).cast("int")
        rest = F.col("size") - F.col("hi")
        key = F.sha2(F.concat_ws(" ", "size", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")),
                                 F.substring(F.col("word"), F.length("word") - rest + 1, rest)), 256)
        keyed = shared_table(todo.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi").withColumn("key", key), "spell")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("hi") - F.col("lo")).alias("wide"))
        sizes = shared_table(sizes.where("m > 1"), "spell")
        large = sizes.where(f"m > {limit} and wide > 1").select("key", F.lit(True).alias("large"))
        split = bool(large.limit(1).take(1))
        keyed = lookup_join(keyed, sizes.select("key", (F.expr(f"m > {limit} and wide > 1")).alias("large")), ["key"], "inner",
                            spread=["word"])
        found.append(enumerated(keyed.where("not large")))
        if not split:
            break
        todo = keyed.where("large").select("word", "n", "size", (F.col("cuts") * 2).alias("cuts"),
                                           F.explode(F.array(F.col("seg") * 2, F.col("seg") * 2 + 1)).alias("seg"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def enumerated(keyed: DataFrame) -> DataFrame:
    """Pairs of each partition of ``keyed(key, word, n, size, lo, hi)``, one partition at a time."""
    dealt = keyed.select("key", "word", "n", "size", "lo", "hi").repartition("key").sortWithinPartitions("key")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shape = None, {}, None

        def pairs():
            return [y for a, b in group_pairs(list(held), *shape) for y in ((a, held[a], b, held[b]), (b, held[b], a, held[a]))]

        def out(rows):
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "n", "near", "near_n"])

        for batch in batches:
            done = []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "word", "n", "size", "lo", "hi")]
            for key, word, n, *rest in zip(*cols):
                if key != at:
                    if len(held) > 1:
                        done.extend(pairs())
                    at, held, shape = key, {}, rest
                held[word] = n
            if done:
                yield out(done)
        if len(held) > 1:
            yield out(pairs())

    return dealt.mapInArrow(walk, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: each round doubles the steps followed."""
    at = shared_table(forms.select("word", F.col("form").alias("root")), "root")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = shared_table(lookup_join(at, onward, ["root"], spread=["word"]), "root")
        if not step.where("next is not null").limit(1).take(1):
            return at
        at = shared_table(step.select("word", F.coalesce("next", "root").alias("root")), "root")


def spelling_variants(docs: DataFrame, limit: int = LIMIT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary; see the module text."""
    vocab = shared_table(vocabulary(docs), "vocab")
    near = near_pairs(vocab, limit).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))).alias("best"))
    best = vocab.join(near, "word", "left").withColumn("best_n", -F.col("best.k"))
    takes = F.col("best_n") >= ratio * F.col("n")
    formed = shared_table(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                      F.when(takes, F.col("best.w")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "form")
    ends = roots(formed.where("form is not null"))
    return (formed.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
