"""The training-data operators against brute force, and on awkward rows."""

import collections
import math
import re
import string
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, d long, h long, n int, rep long, row string, "
          "shard int, bucket int, score double, rank int, pos int, words int, text_a string, sequence_id long")
VOCAB = [f"w{i}" for i in range(400)]


def some_words(seed, n):
    rng = np.random.default_rng(seed)
    return [VOCAB[i] for i in rng.integers(0, len(VOCAB), n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 16) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    base, other = some_words(1, 120), some_words(2, 90)
    near = base[:]
    near[0] = "changed"
    long = some_words(3, 30000)
    run = "\n".join(" ".join(some_words(k, 12)) for k in range(50, 56))
    out = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(near)), (4, " ".join(other)), (5, None), (6, ""),
           (7, " \n\t "), (8, "one two"), (9, "One  two"), (10, " ".join(long)), (11, " ".join(long + ["end"])),
           (None, "no id " + " ".join(other[:20])), (None, None), (4, " ".join(other)),
           (20, f"first line\n{run}\nlast line"), (21, f"another one\n{run}\nother end\n"), (22, run),
           (23, "naïve Ünïcode 中文 \U0001F600 don't... <|endoftext|> a1b22"), (24, "x" * 5000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_wordhash_matches_words(rows):
    from evalframe.llm.wordhash import shingle_sets, words
    texts = [(t or "").encode() for _, t in rows]
    h, bounds, start, end = words(texts)
    joined = b"\n".join(texts) + b"\n"
    found = [joined[a:b] for a, b in zip(start, end)]
    assert found == [w for t in texts for w in t.split()]
    assert len({(w.lower(), int(x)) for w, x in zip(found, h)}) == len({w.lower() for w in found})
    assert len(set(h.tolist())) == len({w.lower() for w in found})
    swapped, _, _, _ = words([b"ab ba abc acb cab"])
    assert len(set(swapped.tolist())) == 5
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for _, t in rows]


def test_ngram_join(docs, rows, none):
    from evalframe.llm.ngram_join import drop_near_copies, ngram_join
    got = ngram_join(docs).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, (r.n_shingles, r.component_id)) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ids.count(None) == 2
    assert ngram_join(none).count() == 0 and drop_near_copies(none).count() == 0


def test_ngram_join_edits_and_levels(spark):
    """Many edited copies of few bases: exact components, also at other thresholds."""
    from evalframe.llm.ngram_join import choose_level, ngram_join
    rng, rows = np.random.default_rng(7), []
    for b in range(4):
        base = some_words(100 + b, 80)
        for c in range(30):
            w = base[:]
            for p in rng.integers(0, 80, rng.integers(0, 4)):
                w[p] = f"e{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(w[: 80 - rng.integers(0, 6)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, rows), bits=8).collect()}
    assert got == brute_components(rows)
    assert choose_level(np.zeros(20), 5) == 1
    assert choose_level(np.full(60, 1000.0), 10) > 4


@pytest.mark.parametrize("part, short", [(1024, 32), (7, 4), (1024, 1000)])
def test_ngram_join_of_a_group_about_the_threshold(spark, part, short):
    """Copies of one text with few to many edits: most pairs lie just under the threshold."""
    from evalframe.llm.ngram_join import ngram_join
    rng, base, rows = np.random.default_rng(17), some_words(41, 150), []
    for c in range(150):
        w = base[:]
        for _ in range(int(rng.integers(0, 9))):
            w[rng.integers(0, 150)] = f"e{rng.integers(0, 400)}"
        rows.append((int(c), " ".join(w)))
    rows += [(1000 + c, " ".join(some_words(300 + c, 60))) for c in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, rows), bits=10, part=part, short=short).collect()}
    want = brute_components(rows)
    assert got == want
    assert 5 < len({c for i, (_, c) in want.items() if i < 1000}) < 100


def test_ngram_join_open_pairs_come_once(spark):
    from evalframe.llm.ngram_join import open_pairs
    rng, rows = np.random.default_rng(3), []
    sets = {rep: sorted(rng.choice(60, 40, replace=False).tolist()) for rep in range(30)}
    for rep, toks in sets.items():  # places follow one order of all tokens
        rows += [(t, rep, i, 40, 3 + rep % 3, rep % 20) for i, t in enumerate(toks[:12])]
    tagged = spark.createDataFrame(rows, "tok long, rep long, i int, n int, level int, comp long")
    for part, short in ((1024, 0), (4, 0), (1024, 5), (4, 6), (1024, 100)):
        got = [tuple(r) for r in open_pairs(tagged, 60, part, short).collect()]
        assert len(got) == len(set(got)) > 10
        for a in sets:
            for b in sets:
                k = len(set(sets[a]) & set(sets[b]))
                if a < b and a % 20 != b % 20 and 100 * k >= 60 * (80 - k):
                    shared = len(set(sets[a][:12]) & set(sets[b][:12]))
                    assert ((a, b) in got) or shared < min(3 + a % 3, 3 + b % 3)


def test_word_store_is_bounded_and_keeps_frequent_words():
    from evalframe.llm.tokens import LIMIT, WordIds, default_tokenizer
    words = WordIds(default_tokenizer(), limit=40)
    asked, learn = [], words.learn
    words.learn = lambda w: (asked.extend(x for x in w if x not in words and x not in words.old), learn(w))
    for k in range(200):
        text = f"often zq{k} Zq{k}x, often {k}."
        ids = np.frombuffer(words.encode(text.encode()), np.uint32).tolist()
        assert ids == words.library.encode(text, add_special_tokens=False).ids
        assert len(words) + len(words.old) <= 40 + 2 * 10  # and the words and cores of a text
    assert asked.count(b"often") == 2  # twice in the first text
    assert LIMIT <= 1 << 18


def test_words_are_looked_up_once_and_letters_skip_the_whole_library():
    from evalframe.llm.tokens import WordIds, default_tokenizer
    whole = []

    class Counted(WordIds):
        gets = 0

        def get(self, word):
            Counted.gets += 1
            return super().get(word)

    words = Counted(default_tokenizer())
    library, words.library = words.library, type("Library", (), {
        "encode_batch_fast": lambda _, texts, **kw: (whole.extend(texts), library.encode_batch_fast(texts, **kw))[1]})()

    def check(text):
        got = np.frombuffer(words.encode(text.encode()), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text

    text = "Ab abc Ab, abd*** \u00c9t\u00e9.### stra\u00dfe\u00c4 it's) (x) don't'\"; "
    check(text * 3)
    assert Counted.gets == 3 * len(text.split())
    assert not {"abd***", "\u00c9t\u00e9.###", "stra\u00dfe\u00c4"} & set(whole)
    for text in ("a<|endoftext|>b* c<|endoftext|>,* <|endoftext|>&", "<|endoftext|><|startoftext|>*", "<|a|>* |> ab|>",
                 "\u00c5 A\u030a\u00c9* e\u0301* \u00d7\u00f7\u00d7* \u0130* \u0178* \u00aa* \u00b5* \u212b* \u0958*, \u1112\u1161*", "a\u00a0b* \u0085 \u00a0*",
                 "\u00df\u00ff\u00de\u00dd\u00c0%$ \u4e00* \u0660* 12* 3,4.* \U0001f600* x_* _x* '* 's* 's's' l's*t '", *string.punctuation):
        check(text)
    for c in string.punctuation:
        for text in (f"ab{c}", f"7{c}{c} \u00c9{c}s", f"{c}ab{c}", f"ab{c}'{c} ab'{c}s", f"a\u0301{c} a{c}\u0301"):
            check(text)


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    from evalframe.llm.packing import CAPACITY, best_fit, local_search, pack_documents, sequences
    from evalframe.llm.tokens import default_tokenizer
    lib = Tokenizer.from_file(default_tokenizer())
    want = collections.Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(-(-len(ids) // CAPACITY)):
            part = ids[p * CAPACITY:(p + 1) * CAPACITY]
            want[i, p, p * CAPACITY, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    packed = pack_documents(docs).cache()
    got = packed.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for s in by.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= CAPACITY
    made = {r.sequence_id: bytes(r.ids) for r in sequences(packed).collect()}
    assert made == {k: b"".join(x[2] for x in sorted(s)) for k, s in by.items()}
    assert pack_documents(none).count() == 0
    rng = np.random.default_rng(0)
    for lo, hi in ((600, 1000), (300, 700), (1, 2047), (900, 1100)):
        length = rng.integers(lo, hi, 800)
        first = best_fit(length, CAPACITY)
        last = local_search(length, first, CAPACITY)
        fill = np.bincount(last, length)
        assert fill.max() <= CAPACITY and fill.sum() == length.sum()
        assert len(np.unique(last)) <= len(np.unique(first))
    length = np.array([1000, 1000, 900, 1148, 24, 24])  # an exchange frees a bin
    assert len(np.unique(local_search(length, np.array([0, 1, 1, 2, 2, 0]), CAPACITY))) == 2


def test_token_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    from evalframe.llm.tokenfile import decode_segment, encode_segment, read_ids, token_files
    from evalframe.llm.tokens import default_tokenizer
    lib = Tokenizer.from_file(default_tokenizer())
    got = token_files(docs, segment_ids=3000, block=64).collect()
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows if i is not None}
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in got)
    for r in got:
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id]
    assert token_files(none).count() == 0
    rng = np.random.default_rng(5)
    for n in (0, 1, 255, 256, 257, 5000):
        x = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) if n % 2 else rng.geometric(0.01, n).astype(np.uint32)
        data = encode_segment(x, [(3, n)], 0)
        back, table = decode_segment(data)
        assert np.array_equal(back, x) and table.tolist() == [[3, n]]
        assert np.array_equal(read_ids(data, 100, 300), x[100:300])


def test_line_dedup(docs, rows, none):
    from evalframe.llm.line_dedup import dedup_lines, drop_repeats
    keyed = sorted({(i if i is not None else -1, t) for i, t in rows if t is not None})
    firsts, gone = {}, collections.defaultdict(set)
    lines = {k: k[1].split("\n") for k in keyed}
    for k in keyed:
        for a in range(len(lines[k])):
            for b in range(a + 1, len(lines[k]) + 1):
                run = tuple(lines[k][a:b])
                if sum(len(WORD.findall(x)) for x in run) >= 50:
                    if run in firsts:
                        gone[k] |= set(range(a, b))
                    firsts.setdefault(run, k)
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (5,) or (r.doc_id is None and r.text is None):
            assert (r.text, r.n_lines, r.n_removed) == (None, 0, 0)
    want = collections.Counter()
    for i, t in rows:
        if t is not None:
            k = (i if i is not None else -1, t)
            want[i, "\n".join(x for p, x in enumerate(lines[k]) if p not in gone[k]), len(lines[k]), len(gone[k])] += 1
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got if r.text is not None) == want
    assert sum(r.n_removed for r in got) >= 12
    kept = drop_repeats(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert 22 not in [r.doc_id for r in kept.select("doc_id").collect()] and kept.count() == len(rows) - 1
    assert dedup_lines(none).count() == 0 and drop_repeats(none).count() == 0


def test_sharding(docs, rows, none):
    from pyspark.sql import functions as F

    from evalframe.llm.sharding import key_shard, shard_documents
    got = shard_documents(docs, shards=4, bucket_bytes=20_000).collect()
    assert collections.Counter((r.row.doc_id, r.row.text) for r in got) == collections.Counter(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    both = docs.select(key_shard(F.col("doc_id"), 4).alias("a"), key_shard(F.col("doc_id"), 5).alias("b")).collect()
    assert all(r.a == r.b or r.b == 4 for r in both)
    assert shard_documents(none).count() == 0


def test_sharding_spreads_copies(spark):
    from evalframe.llm.sharding import shard_documents
    got = shard_documents(frame(spark, [(i, "same") for i in range(3000)]), shards=16, bucket_bytes=500).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(sizes) == 16 and max(sizes.values()) < 2 * min(sizes.values())
    order = [r.row.doc_id for r in sorted(got, key=lambda r: r.slot) if r.shard == 0]
    assert order != sorted(order)


def test_sharding_a_hot_id(spark, scratch):
    """A third of the rows with one id: its shard gets more buckets, not larger ones."""
    from evalframe.llm.sharding import read_shards, write_shards
    rows = [(7 if i % 3 == 0 else 1000 + i, f"text {i}") for i in range(3000)]
    write_shards(frame(spark, rows), f"{scratch}/shards", shards=16, bucket_bytes=500)
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch}/shards").groupBy("shard", "bucket").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 3 * np.median(sizes)
    got = read_shards(spark, f"{scratch}/shards").collect()
    assert collections.Counter((r.row.doc_id, r.row.text) for r in got) == collections.Counter(rows)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_quality(spark, docs, rows, none):
    from evalframe.llm.quality import quality
    labels = spark.createDataFrame([(1, 1), (4, 1), (10, 0), (1, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        if r.doc_id is None:
            continue
        t = texts[r.doc_id]
        w, seen, dup = WORD.findall(t), set(), 0
        at = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if at[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality(none, labels).count() == 0
    assert all(r.score == 0 for r in quality(docs, labels.where("false")).collect())


def test_quality_scores_by_brute_force(spark):
    """The hashed ratio itself, with the xxHash of Spark taken from the xxhash package."""
    import xxhash

    from evalframe.llm.quality import BUCKETS, quality
    rows = [(i, " ".join(some_words(i, 40 + i))) for i in range(12)]
    good = {0, 2, 4, 6}
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(10)], "doc_id long, quality int")

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    def grams(t):
        w = WORD.findall(t)
        h = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in w]
        pair = [signed(xxhash.xxh64((b % 2**64).to_bytes(8, "little"), seed=xxhash.xxh64(
            (a % 2**64).to_bytes(8, "little"), seed=42).intdigest()).intdigest()) for a, b in zip(h, h[1:])]
        end = [signed(xxhash.xxh64(b"end", seed=xxhash.xxh64(x[-3:].encode(), seed=42).intdigest()).intdigest()) for x in w]
        return [x % BUCKETS for x in h + pair + end]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    R, T = sum(raw.values()), sum(target.values())
    weight = {b: np.log((target[b] + 1) / (T + BUCKETS)) - np.log((raw[b] + 1) / (R + BUCKETS)) for b in raw}
    got = {r.doc_id: r.score for r in quality(frame(spark, rows), labels).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(np.mean([weight[b] for b in grams(t)]), abs=1e-9)


def test_decontamination(spark, docs, rows, none):
    from evalframe.llm.decontaminate import benchmark_passages, decontaminate
    base = some_words(1, 120)
    item, far = base[30:70], some_words(77, 40)
    edge = ["changed", *base[61:100]]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(far)), (3, None), (4, ""), (None, "one two"),
                                   (5, " ".join(edge)), (1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in benchmark_passages(docs, bench).collect()}
    assert got[1, 1] == (30, 1.0) and got[2, 1] == (30, 1.0) and got[3, 1] == (30, 1.0)
    assert got[1, 5][1] >= 0.8 and got[8, None][1] == 1.0 and got[9, None][1] == 1.0
    assert {d for d, _ in got} == {1, 2, 3, 8, 9}
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in clean.select("doc_id").collect()) == sorted(i or 0 for i, _ in rows if i not in {1, 2, 3, 8, 9})
    assert benchmark_passages(none, bench).count() == 0 and benchmark_passages(docs, bench.where("false")).count() == 0
    assert decontaminate(docs, bench.where("false")).count() == len(rows)


def test_decontamination_rows_and_blocks(spark):
    """A row for each matching row and item, however ids repeat and items are dealt."""
    from evalframe.llm.decontaminate import benchmark_passages, decontaminate
    one, two, long = some_words(61, 40), some_words(62, 30), " ".join(some_words(63, 20000))
    hit = " ".join(some_words(64, 9) + one + two)
    rows = [(1, hit), (1, hit), (None, " ".join(one)), (None, " ".join(two)), (2, f"{long} {hit} {long}"), (3, long), (4, None)]
    bench = spark.createDataFrame([(10, " ".join(one)), (11, " ".join(two)), (11, " ".join(one[:39])), (12, "absent words " * 9)],
                                  "item_id long, text string")
    want = sorted([(1, 10, 9), (1, 10, 9), (1, 11, 9), (1, 11, 9), (None, 10, 0), (None, 11, 0), (None, 11, 0), (2, 10, 20009),
                   (2, 11, 20009)], key=repr)
    for block_bytes in (1 << 20, 100):
        got = benchmark_passages(frame(spark, rows), bench, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.item_id, r.start_word) for r in got), key=repr) == want
        clean = decontaminate(frame(spark, rows), bench, block_bytes=block_bytes)
        assert sorted(r.doc_id for r in clean.collect()) == [3, 4]


def plain_similarity(a, b):
    """Weighted Jaccard similarity of the five-word shingles, with repeats, of two lists of words."""
    def counted(w):
        k = min(5, len(w))
        return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    p, q = counted([x.lower() for x in a]), counted([x.lower() for x in b])
    weight = {g: sum(len(x.encode()) for x in g) for g in p | q}
    union = sum(max(p[g], q[g]) * weight[g] for g in weight)
    return sum(min(p[g], q[g]) * weight[g] for g in weight) / union if union else 0.0


def test_decontamination_finds_all_that_brute_force_finds():
    """Every item that some run of words reaches 0.8 with, of texts with planted and edited items:
    runs of the item's length, and those of other lengths from its first word to its last."""
    from evalframe.llm.decontaminate import Index
    rng = np.random.default_rng(3)
    items = [(k, some_words(500 + k, int(n))) for k, n in enumerate(rng.integers(6, 60, 18))]
    texts = []
    for k, w in items:
        for cut in (0, 1, 2):
            edited = w[:]
            edited[:cut] = ["zz"] * cut
            texts.append(some_words(900 + k, 30) + edited + some_words(950 + k, 25))
        texts.append(some_words(900 + k, 30) + w[:4] + w[5:] + some_words(950 + k, 25))
    index = Index([(k, " ".join(w)) for k, w in items])
    found = {(r, i): s for r, i, _, s in index.search([" ".join(t).encode() for t in texts])}
    for r, t in enumerate(texts):
        for i, (_, w) in enumerate(items):
            if not set(zip(t, t[1:])) & set(zip(w, w[1:])) and len(w) > 1:
                assert (r, i) not in found
                continue
            best = max([plain_similarity(t[s:s + len(w)], w) for s in range(max(1, len(t) - len(w) + 1))]
                       + [plain_similarity(t[s:e + 1], w) for s in range(len(t)) if t[s] == w[0]
                          for e in range(s + 4, len(t)) if t[e] == w[-1]])
            assert (best >= 0.8) == ((r, i) in found), (r, i, best)
            assert best < 0.8 or found[r, i] == pytest.approx(best)


def test_decontamination_finds_deleted_and_inserted_words():
    """The best run from an item's first word to its last, by brute force over all of them."""
    from evalframe.llm.decontaminate import Index, profile, weighted_jaccard
    from evalframe.llm.wordhash import words
    rng = np.random.default_rng(5)
    items = [(k, " ".join(some_words(1500 + k, int(n)))) for k, n in enumerate(rng.integers(28, 120, 30))]
    items[0] = (0, " ".join(some_words(1500, 12) * 4))  # shingles that repeat
    texts = []
    for k, t in items:
        for insert in (False, True):
            w = t.split()
            x = int(rng.integers(2, 5))
            w[x:x + (not insert)] = ["zz"] * insert
            texts.append(" ".join(some_words(1900 + k, 30) + w + some_words(1950 + k, 25)).encode())
    index, best = Index(items), {}
    for r, i, a, s in index.search(texts):
        best[r, i] = max(best.get((r, i), (0, 0)), (s, -a))
    h, bounds, start, end = words(texts)
    for r in range(len(texts)):
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        _, n, own = index.items[r // 2]
        first, last = index.ends[r // 2]
        runs = [(a, b) for a in range(lo, hi) for b in range(a + 5, hi + 1)
                if b - a == n or (h[a] == first and h[b - 1] == last)]
        want = max((weighted_jaccard(profile(h[a:b], (end - start)[a:b]), own), lo - a) for a, b in runs)
        assert want[0] < 0.8 or best[r, r // 2] == want
    assert len(best) >= 50


def test_simhash_is_the_bitwise_majority():
    from evalframe.llm.decontaminate import simhash
    h = np.random.default_rng(2).integers(0, 2**64, 300, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    for width in (1, 8, 13, 32):
        want = [np.packbits(2 * bits[i:i + width].sum(0) > width).view(np.uint64)[0] for i in range(300 - width + 1)]
        assert simhash(h, width).tolist() == want


def test_token_counts(docs, rows, none):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    from evalframe.llm.token_counts import MARK, PieceCounts, default_vocabulary, read_vocabulary, token_counts
    vocab = read_vocabulary(default_vocabulary())
    for fallback in (True, False):
        lib = Tokenizer(models.Unigram([(" ", 0.0), *vocab], unk_id=0, byte_fallback=fallback))
        lib.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"),
            pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=False)])
        got = token_counts(docs, byte_fallback=fallback).collect()
        want = collections.Counter((i, len(WORD.findall(t or "")), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
        assert collections.Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == want
    assert token_counts(none).count() == 0
    tied = [("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), (MARK, -1.0), (MARK + "a", -2.0)]
    lib = Tokenizer(models.Unigram([(" ", 0.0), *tied], unk_id=0))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=False)
    model = PieceCounts(tied, byte_fallback=False)
    for w in ("abc", "abab", "cab", "xabx", "xx", "bcbcabc", "axxb"):
        assert model.count(w.encode())[1] == len(lib.encode(w, add_special_tokens=False).ids)


def test_license_scan(spark, none):
    from evalframe.llm.license_scan import TEMPLATES, license_scan, wording
    prose = " ".join(some_words(8, 60))
    mit = TEMPLATES["MIT"].split()
    wrapped = "\n".join(" ".join(mit[i:i + 9]) for i in range(0, len(mit), 9))
    edited = TEMPLATES["Apache-2.0-statement"].replace("Licensed", "LICENSED").replace("Apache", "Apache  ")
    rows = [(1, f"{prose}\n{TEMPLATES['MIT-statement']}\n{prose}"), (2, f"{prose}\n{wrapped}\n{prose}"), (3, edited), (4, prose),
            (5, None), (6, ""), (7, "he has a license to drive and permission to park"), (None, TEMPLATES["CC-BY-NC-4.0-statement"]),
            (8, f"{TEMPLATES['GPL-3.0-statement']}\n{TEMPLATES['MIT-statement']}"), (9, wrapped.replace("merge,", "join,"))]
    got = [(r.doc_id, r.license, r.n_differences) for r in license_scan(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT-statement", 0), (2, "MIT", 0), (3, "Apache-2.0-statement", 0),
                                           (None, "CC-BY-NC-4.0-statement", 0), (8, "GPL-3.0-statement", 0),
                                           (8, "MIT-statement", 0), (9, "MIT", 1)], key=str)
    said = [r.differences for r in license_scan(frame(spark, rows)).where("doc_id = 9").collect()]
    assert said == ["merge -> join"]
    assert license_scan(none).count() == 0
    assert wording("The (\"Software\"), IS") == ["the", "software", "is"]
    with pytest.raises(ValueError):
        license_scan(none, {"x": "nothing to see"})


def test_license_scan_finds_notices_anywhere_in_a_long_line():
    from evalframe.llm.license_scan import TEMPLATES, Scanner
    scanner = Scanner(TEMPLATES)
    line = some_words(8, 14000)
    assert len(" ".join(line)) >= 1 << 16
    for name, notice in TEMPLATES.items():
        for k in (0, 7000, 14000):
            text = " ".join([*line[:k], notice, *line[k:]])
            assert [(h[0], h[4]) for h in scanner.scan(text.encode())] == [(name, 0)]


def test_license_scan_finds_wrapped_and_repeated_notices():
    from evalframe.llm.license_scan import TEMPLATES, Scanner
    scanner = Scanner(TEMPLATES)
    prose = " ".join(some_words(9, 40))
    a, b = TEMPLATES["MIT-statement"], TEMPLATES["CC-BY-NC-4.0-statement"]

    def found(text):
        return [(h[0], h[1], h[4]) for h in scanner.scan(text.encode())]

    for name, notice in TEMPLATES.items():
        words = notice.split()
        for k in range(1, len(words)):
            wrapped = f"{prose}\n{' '.join(words[:k])}\n  {' '.join(words[k:])}\n{prose}"
            assert found(wrapped) == [(name, 1, 0)]
    assert found(f"{a} {a}") == [("MIT-statement", 0, 0)] * 2
    assert found(f"{a} {prose} {a}\n{a}") == [("MIT-statement", 0, 0)] * 2 + [("MIT-statement", 1, 0)]
    assert found(f"{a}\n{a}\n{b}") == [("MIT-statement", 0, 0), ("MIT-statement", 1, 0), ("CC-BY-NC-4.0-statement", 2, 0)]
    for name, notice in TEMPLATES.items():
        assert found(f"{notice}\n{notice}\n{notice.upper()}") == [(name, j, 0) for j in range(3)]


def test_toxicity(spark, docs, rows, none):
    from evalframe.llm.toxicity import WINDOW, Network, Words, drop_toxic, held_out, toxicity, train
    rng = np.random.default_rng(1)
    texts, label = [], []
    for k in range(160):
        w = some_words(2000 + k, 60)
        if k % 4 == 0:
            for p in rng.integers(0, 60, 6):
                w[p] = ["scoundrel", "badword"][int(rng.integers(2))]
        texts.append(" ".join(w))
        label.append(int(k % 4 == 0))
    net = train([t.encode() for t in texts[:120]], label[:120])
    score = net.score([t.encode() for t in texts[120:]])
    assert ((score >= 0.7) == (np.array(label[120:]) == 1)).mean() > 0.95
    assert net.score([b"", b" \n", b"..."]).tolist() == [0, 0, 0]
    train_docs = frame(spark, [*rows, *[(1000 + i, t) for i, t in enumerate(texts)]])
    labels = spark.createDataFrame([(1000 + i, y) for i, y in enumerate(label)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity(train_docs, labels).collect()
    assert len(got) == len(rows) + len(texts)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert sum(r.predicted == label[r.doc_id - 1000] for r in out) >= 0.9 * len(out)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    kept = drop_toxic(docs, docs, labels)  # none of the labelled rows is there: nothing is learned
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity(none, labels).count() == 0 and all(r.score == 0 for r in toxicity(docs, labels.where("false")).collect())
    # a window starts at every word that has a whole window from it on
    w = Words([" ".join(some_words(5, 100)).encode(), b"", b"a"])
    places, text = w.windows()
    assert places[text == 0].tolist() == [w.index[i:i + WINDOW].tolist() for i in range(100 - WINDOW + 1)]
    assert places[text == 2].tolist() == [[w.index[100]] + [w.count] * (WINDOW - 1)] and not (text == 1).any()
    assert Network().run(Network().embed(w), places).shape == (100 - WINDOW + 2,)


def plain_score(net, words_):
    """Worst window of a text, word by word and number by number."""
    from evalframe.llm.toxicity import GRAM_BITS, GRAMS, HIDDEN, WINDOW, WORD_BITS, _MULT, LOWER, mix
    from evalframe.llm.wordhash import words
    p, worst = {k: v.astype(np.float64) for k, v in net.p.items()}, -math.inf

    def vector(word):
        h = words([word.encode()])[0]
        top = np.uint64(64 - WORD_BITS)
        marked = b"\x01" + bytes(LOWER[list(word.encode())].tolist()) + b"\x01"
        rows = []
        for n in GRAMS:
            for i in range(len(marked) - n + 1):
                g = (n + sum(b * int(k) for b, k in zip(marked[i:i + n], _MULT))) % 2**64
                rows.append(p["g"][int(mix(np.array([g], np.uint64))[0]) >> (64 - GRAM_BITS)])
        return [*p["wa"][int((h >> top)[0])], *p["wb"][int((mix(h ^ _MULT[7]) >> top)[0])], *np.mean(rows, axis=0)]

    def soft(v):
        return v / (1 + abs(v))

    def states(xs, d):
        h, out = [0.0] * HIDDEN, []
        for x in xs:
            a = [p["c" + d][j] + sum(v * p["x" + d][i][j] for i, v in enumerate(x)) for j in range(3 * HIDDEN)]
            b = [sum(v * p["u" + d][i][j] for i, v in enumerate(h)) for j in range(3 * HIDDEN)]
            z = [(1 + soft(a[j] + b[j])) / 2 for j in range(2 * HIDDEN)]
            c = [soft(a[2 * HIDDEN + j] + z[HIDDEN + j] * b[2 * HIDDEN + j]) for j in range(HIDDEN)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(HIDDEN)]
            out.append(h)
        return out

    xs = [vector(w) for w in words_]
    for i in range(max(1, len(xs) - WINDOW + 1)):
        part = xs[i:i + WINDOW]
        both = [f + b for f, b in zip(states(part, "f"), states(part[::-1], "b")[::-1])]
        weight = [math.exp(sum(v * q for v, q in zip(h, p["att"]))) for h in both]
        pooled = [sum(k * h[j] for k, h in zip(weight, both)) / sum(weight) for j in range(2 * HIDDEN)]
        worst = max(worst, sum(v * q for v, q in zip(pooled, p["out"])) + p["bias"][0])
    return 1 / (1 + math.exp(-worst))


def test_toxicity_scores_every_window_as_plain_arithmetic_does():
    from evalframe.llm.toxicity import BLOCK, WINDOW, Network, Words
    net = Network(5)
    for k in ("wa", "wb"):
        net.p[k] = np.random.default_rng(4).normal(0, 1, net.p[k].shape).astype(np.float32)
    lists = [some_words(60 + k, n) for k, n in enumerate((1, 3, WINDOW - 1, WINDOW, WINDOW + 1, 37))]
    got = net.score([" ".join(w).encode() for w in lists])
    assert got == pytest.approx([plain_score(net, w) for w in lists], abs=1e-5)
    # blocks of windows, several texts, padding between them: the same logits as window by window
    w = Words([" ".join(some_words(9, 2 * BLOCK + 50)).encode(), b"", b"one two", " ".join(some_words(8, 30)).encode()])
    seq, start, _ = w.sequence()
    x, (places, _) = net.embed(w), w.windows()
    assert net.logits(x, seq)[start] == pytest.approx(net.run(x, places), abs=1e-4)
    # one bad word anywhere moves the score of a long text: no window is left out
    long_text = some_words(11, 3 * WINDOW)
    base = net.score([" ".join(long_text).encode()])[0]
    moved = [net.score([" ".join([*long_text[:i], "zzyzx" * 3, *long_text[i + 1:]]).encode()])[0] for i in range(0, len(long_text), 7)]
    assert moved == pytest.approx([plain_score(net, [*long_text[:i], "zzyzx" * 3, *long_text[i + 1:]])
                                   for i in range(0, len(long_text), 7)], abs=1e-5) and 0 <= base <= 1


def test_toxicity_task_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from evalframe.llm import shared
    from evalframe.llm.toxicity import CHUNK_BYTES, Network, scored
    net, rng = Network(), np.random.default_rng(1)
    texts = [" ".join(f"w{x:06x}" for x in rng.integers(0, 1 << 17, 250)) for _ in range(1000)]
    net.score([b"one word"])
    tracemalloc.start()
    scores = net.score([t.encode() for t in texts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * sum(map(len, texts))  # 48 times with all words' temporaries at once
    # what another operator left in the worker goes; rows leave chunk by chunk, in their order, with all columns
    shared.kept("words of an earlier stage", dict)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2100)), "score": [7.0] * 2100, "text": [*texts, None, *texts, *[""] * 99]})
    got = list(scored(iter([batch, batch.slice(0, 0)]), net, ["doc_id", "score", "text"], "score"))
    assert not shared._kept and len(got) > 1 and max(b.nbytes for b in got) < 1.2 * CHUNK_BYTES
    whole = pa.Table.from_batches(got)
    assert whole["doc_id"].to_pylist() == list(range(2100)) and whole["text"].to_pylist() == batch["text"].to_pylist()
    assert whole["score"].to_pylist() == pytest.approx([*scores, 0, *scores, *[0] * 99], abs=1e-5)


def test_word_hashes_do_not_depend_on_the_span(monkeypatch):
    from evalframe.llm import wordhash
    texts = [b"", b"  one Two  " + b"x" * 300 + b"\n", b" ", " ".join(some_words(3, 500)).encode(), b"last"]
    want = [x.tolist() for x in wordhash.words(texts)]
    assert want[0][:2] == [wordhash.words([w])[0][0] for w in (b"one", b"two")] and want[0][-1] == wordhash.words([b"last"])[0][0]
    for span in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(wordhash, "SPAN", span)
        assert [x.tolist() for x in wordhash.words(texts)] == want


def test_gradients_match_differences():
    from evalframe.llm.toxicity import Network, Words
    net = Network(3)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64) + (np.random.default_rng(9).normal(0, 0.1, v.shape) if k in ("wa", "wb") else 0)
    w = Words([b"alpha beta gamma delta alpha", b"beta epsilon"])
    places, _ = w.windows()

    def loss():
        return float((net.run(net.embed(w).astype(np.float64), places) * [1.0, -0.5]).sum())

    x = net.embed(w).astype(np.float64)
    grads = net.gradients(w, x, places, net.run(x, places, keep=True), np.array([1.0, -0.5]))
    for k in ("uf", "xb", "cf", "att", "out", "wa", "wb", "g"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        eps = 1e-3
        net.p[k][at] += eps
        more = loss()
        net.p[k][at] -= 2 * eps
        less = loss()
        net.p[k][at] += eps
        assert (more - less) / (2 * eps) == pytest.approx(float(grads[k][at]), rel=2e-2, abs=1e-4)
