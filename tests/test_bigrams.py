"""Bigram perplexity by blocks: same sums as plain counting, few bytes on disk."""

import collections
import os

import numpy as np
import pyarrow as pa
import pytest

from evalframe.operators import bigrams as B
from evalframe.operators.quality import bigram_perplexity


def by_hand(docs):
    toks = [(k, (t or "").split()) for k, t in docs]
    bi = collections.Counter(b for _, t in toks for b in zip(t, t[1:]))
    ctx = collections.Counter(w for _, t in toks for w in t[:-1])
    vocab = len({w for _, t in toks for w in t})
    lps = collections.defaultdict(list)
    for k, t in toks:
        lps[k] += [np.log((bi[b] + 1) / (ctx[b[0]] + vocab)) for b in zip(t, t[1:])] if k is not None else []
    return sorted(((k is None, k or 0, len(lps[k]), np.exp(-np.mean(lps[k])) if lps[k] else -1.0) for k, _ in docs))


def words(rng, n, vocab):
    return " ".join(f"w{min(x, vocab)}" for x in rng.zipf(1.3, n))


@pytest.mark.parametrize("block, bucket", [(7, 3), (1 << 21, 1 << 20)])
def test_perplexity_of_small_and_large_blocks(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(B, "BLOCK_TOKENS", block)
    monkeypatch.setattr(B, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(B, "BUCKET_TOKENS", bucket)
    rng = np.random.default_rng(5)
    docs = [(i % 60, words(rng, int(rng.integers(0, 12)), 40)) for i in range(80)]
    docs += [(None, "w1 w2"), (900, None), (901, ""), (902, "alone"), (903, words(rng, 50, 40)), (904, "w1 w1 w1 w1")]
    got = bigram_perplexity(spark.createDataFrame(docs, "k long, text string").repartition(3), "k", "text").collect()
    got = sorted((r.k is None, r.k or 0, r.n_bigrams, -1.0 if r.perplexity is None else r.perplexity) for r in got)
    want = by_hand(docs)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_perplexity_of_no_texts(spark):
    for docs in ([], [(1, None), (2, "...")]):
        got = bigram_perplexity(spark.createDataFrame(docs, "k long, text string"), "k", "text").collect()
        assert sorted(map(tuple, got)) == [(k, None, 0) for k, _ in docs]


def test_perplexity_takes_less_disk_than_its_texts(spark):
    rng = np.random.default_rng(6)
    docs = [(i, words(rng, 600, 20_000)) for i in range(600)]

    def files():
        jvm = spark.sparkContext._jsc.sc()
        found = [f.getPath() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            jvm.env().blockManager().diskBlockManager().getAllFiles())]
        shared = jvm.getCheckpointDir().get().removeprefix("file:")
        found += [os.path.join(d, f) for d, _, fs in os.walk(shared) for f in fs]
        return {f: os.path.getsize(f) for f in found if os.path.exists(f)}

    before = files()
    df = bigram_perplexity(spark.createDataFrame(docs, "k long, text string").repartition(2), "k", "text")
    assert len(df.collect()) == len(docs)
    dealt = 1.2 * sum(len(t) for _, t in docs)  # the texts themselves are dealt over two partitions here
    assert sum(n for f, n in files().items() if f not in before) < dealt + sum(len(t) for _, t in docs)


def test_pack_keeps_numbers_and_words():
    for numbers in ([], [0], [3, 0, 255], [256, 1], [1 << 40, 7], [(1 << 64) - 1, 0]):
        a = np.array(numbers, np.uint64)
        assert B.unpack(B.pack(a)).tolist() == a.tolist()
    for some in ([], ["a"], ["b", "", "b", "é"]):
        assert B.unpack_words(B.pack_words(pa.array(some, pa.string()))).to_pylist() == some
