"""Prefix tries, vector joins and spelling variants against brute force, and on awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from evalframe.llm import spelling, vector_join as vj
from evalframe.llm.prefix_trie import prefix_trie
from evalframe.llm.spelling import acceptor, composed, spelling_variants
from evalframe.llm.vector_join import plan, same_cell, vector_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
CONV = ("conv_id long, turn long, role string, text string, depth long, k long, p1 long, p2 long, a long, b long, words int, "
        "ends boolean, rep long, band long")
VEC = "vec_id long, embedding array<double>, label int, v long, node long, m long, t int, code long, fine boolean, rep long"
DOC = "doc_id long, text string, word string, n long, key string, size int, lo int, hi int, d string, form string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def wide(spark, rows, schema):
    extra = schema.count(",") + 1 - len(rows[0]) if rows else 0
    return spark.createDataFrame([(*r, *[None] * extra) for r in rows], schema).repartition(3)


# --- prefix trie


def plain_trie(turns):
    conv = collections.defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    seq = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in conv.items()}
    new = {}
    for c, v in seq.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        new[c] = seq.get(base, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(new[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def turns():
    rng = np.random.default_rng(5)
    out = []
    for c in [*range(-25, 60, 3), 0, 20, 40]:
        for t in range(int(rng.choice([1, 2, 3, 40, 130]))):
            role = "u" if t % 9 != 8 else [None, "u", "a"][rng.integers(3)]
            out.append((c, t, role, "w " * (t % 4) if t % 7 else None))
    out += [(7, None, "u", "x y")] * 2 + [(None, 1, "u", "q"), (None, None, None, None), (3, 5, "u", "w w"), (3, 5, "u", "w w"),
                                         (3, 5, "u", "v"), (8, None, None, None), (100, 0, "a", "word " * 100_000)]
    out += [(c, t, "s", f"hello {t}") for c in range(1000, 1400) for t in range(2)]  # copies of one conversation
    out += [(c, 0, "s", "hello 0") for c in range(2000, 2300)] + [(c, 1, "s", f"own {c}") for c in range(2000, 2300)]
    return out


@pytest.mark.parametrize("height", [16, 3])
def test_trie_equals_brute_force(spark, turns, height):
    assert rows_of(prefix_trie(wide(spark, turns, CONV), height)) == plain_trie(turns)


def test_trie_of_a_deep_conversation(spark):
    turns = [(c, t, "u", f"t{t}" if c == 20 or t < 500 else f"other {t}") for c in (20, 21, 40) for t in range(700)]
    assert rows_of(prefix_trie(wide(spark, turns, CONV), 8)) == plain_trie(turns)


def test_trie_of_nothing(spark):
    none = wide(spark, [], CONV)
    assert prefix_trie(none).collect() == []
    assert prefix_trie(wide(spark, [(None, 1, "u", "x")], CONV)).collect() == []


def test_trie_keeps_turnless_conversations(spark):
    # conversations whose own turns all fall to a head that their absent base cannot give
    ids = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 2][:5]
    turns = [(c, t, "u", "x") for c in ids for t in range(2)]
    got = rows_of(prefix_trie(wide(spark, turns, CONV)))
    assert got == plain_trie(turns) and len(got) == 1 and got[0][3] == len(ids)


# --- vectors


def plain_links(rows, cosine=0.95):
    n, adj, dims = len(rows), np.zeros((len(rows),) * 2, bool), collections.defaultdict(list)
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            dims[len(v)].append(k)
    for ks in dims.values():
        m = np.array([rows[k][1] for k in ks], float)
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        adj[np.ix_(ks, ks)] = m @ m.T >= cosine
    np.fill_diagonal(adj, False)
    comp = np.arange(n)
    while True:
        low = np.array([min([comp[k], *comp[adj[k]]]) for k in range(n)])
        if (low == comp).all():
            break
        comp = low
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    return sorted(((i, int(adj[k].sum()), (c := least.get(comp[k])), None if None in (i, c) else i == c)
                   for k, (i, _) in enumerate(rows)), key=repr)


def vectors(seed=1, groups=60, dim=16):
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 5))):
            out.append(base + rng.standard_normal(dim) * rng.choice([0.01, 0.1, 0.2]))
    return [(i, v.tolist()) for i, v in enumerate(rng.permutation(np.array(out)))]


def test_vectors_recall(spark):
    rows = vectors(seed=3, groups=300)
    got, want = rows_of(vector_join(wide(spark, rows, VEC))), plain_links(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 500 and 0.99 * there <= found <= there
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_hot_groups_and_awkward_rows(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = vectors(groups=10)
    rows += [(1000 + i, (base + rng.standard_normal(16) * 0.02).tolist()) for i in range(150)]  # near copies
    rows += [(2000 + i, [1.0] * 16) for i in range(200)] + [(1990, [2.0] * 16)]  # copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None, *[1.0] * 15]), (3004, [float("nan")] * 16),
             (3005, [float("inf")] * 16), (3006, [1e200] * 16), (3007, [1e-200] * 16), (3008, [1.0] * 8), (3009, [1.0] * 8),
             (None, [1.0] * 16), (None, [-5.0] * 8), (None, [-5.0] * 8), (3010, [1.0, 2.0]), (3010, [1.0, 2.0]), (3010, [9.0, -9.0]),
             (3002, [0.0] * 16)]
    assert rows_of(vector_join(wide(spark, rows, VEC), block=block)) == plain_links(rows)


def test_vectors_nothing(spark):
    assert vector_join(wide(spark, [], VEC)).collect() == []


def test_vector_plan_follows_the_size():
    assert plan(10)[0] < plan(10**6)[0] < plan(10**9)[0]
    for n in (100, 10**6, 10**9):
        k, tables = plan(n)
        assert 1 - (1 - same_cell(np.sqrt(0.1)) ** k) ** tables >= vj.RECALL
        assert n * same_cell(np.sqrt(2)) ** k <= vj.CHANCE or k == 4


# --- words


def plain_words(rows):
    count = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    vocab = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}
    return vocab, plain_forms(vocab)


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(vocab):
    near = {w: [x for x in vocab if abs(len(x) - len(w)) <= 1 and is_near(w, x)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        if near[w] and vocab[b := min(near[w], key=lambda x: (-vocab[x], x))] >= 10 * n:
            form[w] = b
    out = []
    for w, n in vocab.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), vocab[form[w]] if w in form else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(9)
    stems = ["kitchen", "running", "aaaaaaaa", "señoría", "bookkeeper", "x" * 40, "abcabcabc", "ÀÿÖØöÞß", "y" * 3000]
    words = []
    for s in stems:
        words += [s] * 400
        for _ in range(25):
            k = int(rng.integers(0, len(s)))
            c = "abkxÿe"[rng.integers(6)]
            v = [s[:k] + s[k + 1:], s[:k] + c + s[k:], s[:k] + c + s[k + 1:]][rng.integers(3)]
            words += [v] * int(rng.integers(1, 45))
    words += ["kitchem"] * 38 + ["kitchemx"] * 3  # a chain of forms
    words += ["kitchenn" + "n" * i for i in range(5) for _ in range(2 + 3 * i)]
    words = rng.permutation([w.upper() if i % 3 == 0 and w.isascii() else w for i, w in enumerate(words)])
    rows = [(int(i), " ".join(words[a:a + 40])) for i, a in enumerate(range(0, len(words), 40))]
    return rows + [(1, None), (2, ""), (None, "kitchen-running's kitchen"), (None, None), (4, "short ones only"), rows[3], rows[3]]


@pytest.mark.parametrize("limit", [spelling.LIMIT, 2])
def test_words_equal_brute_force(spark, texts, limit):
    vocab, want = plain_words(texts)
    assert rows_of(spelling_variants(wide(spark, texts, DOC), limit)) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])


def test_words_nothing(spark):
    assert spelling_variants(wide(spark, [], DOC)).collect() == []
    assert spelling_variants(wide(spark, [(1, None), (2, "a b c")], DOC)).collect() == []


def language(states, q):
    return ({""} if states[q][0] else set()) | {c + z for c, to in states[q][1].items() for z in language(states, to)}


def test_acceptor_is_minimal_and_composition_complete():
    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 300):
        words = sorted({"".join("abc"[i] for i in rng.integers(0, 3, rng.integers(0, 6))) for _ in range(size)})
        states, start = acceptor(words)
        languages = [frozenset(language(states, q)) for q in range(len(states))]
        assert languages[start] == set(words) and len(set(languages)) == len(languages)
        got = list(composed(states, start))
        want = {frozenset(p) for p in ((a, b) for a in words for b in words if a < b) if is_near(*p)}
        assert len(got) == len(want) and {frozenset(p) for p in got} == want
