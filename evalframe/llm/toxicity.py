"""Operator 6: toxicity by a bidirectional gated recurrent network, trained in numpy.

Inputs of a word (runs of letters, digits and non-ASCII bytes, lower-cased A-Z): two hashed
word embeddings and the mean of hashed embeddings of its character 3- and 5-grams (UTF-8
bytes, with marks at both ends).  A GRU reads a window of ``WINDOW`` words in each
direction (gates and candidates by softsign, x / (1 + |x|), which needs no exponential),
attention pools the states and a logistic unit scores the window.  Every window
is scored: one starts at each word that has ``WINDOW`` words from it on, and a shorter text
is one window.  A text's score is that of its worst window.

Training: a text is the bag of all its windows, its logit that of the worst one.  A step
scores all of them; the gradient goes to ``DRAWN`` of them, drawn by their share in the
smooth maximum (with Gumbel noise), so none is left out; Adam, a fixed seed.  The rows it
learns from are a bounded sample of the labelled ones (``MAX_TOXIC`` and ``MAX_CLEAN`` rows,
those with the least hash of their id); rows of the held-out fold (crc32 of the id as text, modulo 3, equal to 1)
are never learned from.  Everything else covers all rows and whole texts.  Neither labels
nor id, language or source are inputs.

Defined results: null, empty and word-less texts score 0; without labelled rows of both
kinds every score is 0; several labels of one id count as toxic if any is; a null id is
held out; equal rows return equal rows; a very long text is scored in blocks of windows;
equally bad windows give the same score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shared import release, text_chunks
from evalframe.llm.wordhash import WS, mix, words

WINDOW, BLOCK = 10, 2048  # words of a window; windows scored at once
CHUNK_BYTES = 2_000_000  # of text scored at once
PART = 1 << 13  # distinct words whose grams are made at once
WORD_BITS, GRAM_BITS = 16, 16
WORD_DIM, GRAM_DIM, HIDDEN = 4, 8, 8
GRAMS = (3, 5)
MAX_TOXIC, MAX_CLEAN, DRAWN = 1500, 2500, 24
EPOCHS, BATCH, RATE, SHRINK = 5, 48, 0.01, 2.0
THRESHOLD = 0.7
SEED = 6

BLANK = WS.copy()
BLANK[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULT = np.random.default_rng(SEED).integers(1, 2**64, 8, dtype=np.uint64) | np.uint64(1)


class Words:
    """The distinct words of some texts: table rows of their embeddings and where each
    word of the texts is among them (the last entry stands for padding)."""

    def __init__(self, texts: list[bytes]) -> None:
        h, self.bounds, start, end = words(texts, BLANK)
        _, first, self.index = np.unique(h, return_index=True, return_inverse=True)
        own = h[first]
        self.count = len(first)
        top = np.uint64(64 - WORD_BITS)
        self.word_a, self.word_b = (own >> top).astype(np.int64), (mix(own ^ _MULT[7]) >> top).astype(np.int64)
        a = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        sizes, starts = (end - start)[first], start[first]
        del h, own, start, end, first
        ends = np.cumsum([np.maximum(0, sizes + 3 - n).sum() for n in GRAMS])
        self.gram, self.owner = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64)
        filled = [0, *ends[:-1].tolist()]
        for low in range(0, self.count, PART):
            size = sizes[low:low + PART]
            begin = np.cumsum(size + 2) - size - 2
            marked = np.full(int((size + 2).sum()), 1, np.uint8)  # byte 1 marks both ends
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            marked[np.repeat(begin + 1, size) + inside] = a[np.repeat(starts[low:low + PART], size) + inside]
            owner = np.repeat(np.arange(low, low + len(size)), size + 2)
            for k, n in enumerate(GRAMS):
                m = max(0, len(marked) - n + 1)
                g = np.full(m, n, np.uint64)
                for j in range(n):
                    g += marked[j:j + m].astype(np.uint64) * _MULT[j]
                whole = owner[:m] == owner[n - 1:]
                to = slice(filled[k], filled[k] + int(whole.sum()))
                self.gram[to] = mix(g[whole]) >> np.uint64(64 - GRAM_BITS)
                self.owner[to] = owner[:m][whole]
                filled[k] = to.stop
        self.share = (1.0 / np.maximum(1, np.bincount(self.owner, minlength=self.count))).astype(np.float32)

    def sequence(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word places of all texts one after the other, each padded to a window at least;
        where each window starts in them; text of each window)."""
        n = np.diff(self.bounds)
        size = np.where(n > 0, np.maximum(n, WINDOW), 0)
        base = np.cumsum(size) - size
        seq = np.full(int(size.sum()), self.count)
        seq[np.arange(len(self.index)) + np.repeat(base - self.bounds[:-1], n)] = self.index
        per = np.where(n > 0, size - WINDOW + 1, 0)
        text = np.repeat(np.arange(len(n)), per)
        return seq, np.arange(len(text)) - np.repeat(np.cumsum(per) - per - base, per), text

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word places of each window, text of each window)."""
        seq, start, text = self.sequence()
        return seq[start[:, None] + np.arange(WINDOW)], text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        inputs = 2 * WORD_DIM + GRAM_DIM

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {"wa": np.zeros((1 << WORD_BITS, WORD_DIM), np.float32), "wb": np.zeros((1 << WORD_BITS, WORD_DIM), np.float32),
                  "g": normal(1 << GRAM_BITS, GRAM_DIM, scale=0.1), "att": normal(2 * HIDDEN, scale=0.3),
                  "out": normal(2 * HIDDEN, scale=0.5), "bias": np.full(1, -2, np.float32)}
        for d in "fb":
            self.p |= {"x" + d: normal(inputs, 3 * HIDDEN, scale=0.4), "u" + d: normal(HIDDEN, 3 * HIDDEN, scale=0.3),
                       "c" + d: np.zeros(3 * HIDDEN, np.float32)}

    def embed(self, w: Words) -> np.ndarray:
        """Inputs of the distinct words, and zeros for padding."""
        p = self.p
        # one column of the grams' rows at a time: all of them are the largest array here
        mean = np.stack([np.bincount(w.owner, np.ascontiguousarray(p["g"][:, j])[w.gram], w.count)
                         for j in range(GRAM_DIM)], 1) * w.share[:, None]
        x = np.concatenate([p["wa"][w.word_a], p["wb"][w.word_b], mean.astype(np.float32)], 1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])

    def run(self, x: np.ndarray, places: np.ndarray, keep: bool = False):
        """Logits of windows; with ``keep`` also what the backward pass needs."""
        p, n, H = self.p, len(places), HIDDEN
        real = (places < len(x) - 1).astype(np.float32)
        states, tape = np.zeros((WINDOW, n, 2 * H), np.float32), {}
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            pre = x @ p["x" + d] + p["c" + d]
            h, steps, u = np.zeros((n, H), np.float32), [], p["u" + d]
            for t in order:
                a, m = pre[places[:, t]], real[:, t:t + 1]
                hu = h @ u
                zr = (1 + softsign(a[:, :2 * H] + hu[:, :2 * H])) / 2
                z, r = zr[:, :H], zr[:, H:]
                c = softsign(a[:, 2 * H:] + r * hu[:, 2 * H:])
                new = h + m * (1 - z) * (c - h)
                if keep:
                    steps.append((t, h, z, r, c, hu[:, 2 * H:], m))
                h = new
                states[t, :, H * (d == "b"):H * (1 + (d == "b"))] = h
            tape[d] = steps
        e = states @ p["att"] + (real.T - 1) * 1e4
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = (w[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, states, w, pooled, tape) if keep else logit

    def logits(self, x: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Logit of the window that starts at each place of ``seq``: all windows of a block
        take their t-th step together, on the block's words shifted by t, so nothing is
        gathered per window.  Same numbers as ``run``: a padding word holds the state (its
        update gate is 1) and has no weight, and of a state only its attention and its
        output are kept, which leave the product that the next step needs anyway."""
        p, H, n = self.p, HIDDEN, len(seq) - WINDOW + 1
        out = np.empty(max(0, n), x.dtype)
        pad = ((seq == len(x) - 1) * -1e4).astype(x.dtype)
        ways = []
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            pre, u = x @ p["x" + d] + p["c" + d], p["u" + d].T.copy()
            pre[-1, :H] = 1e30
            u[2 * H:] /= 2
            own = slice(H * (d == "b"), H * (1 + (d == "b")))
            ways.append((order, pre, np.concatenate([u, p["att"][None, own], p["out"][None, own]])))
        for i in range(0, n, BLOCK):
            m = min(BLOCK, n - i)
            here = seq[i:i + m + WINDOW - 1]
            seen = np.zeros((WINDOW, 2, m), x.dtype)
            size = np.empty((2 * H, m), x.dtype)
            for order, pre, u in ways:
                a, h = np.ascontiguousarray(pre[here].T), np.zeros((H, m), x.dtype)
                hu, before = u @ h, None
                for t in order:
                    if before is not None:
                        np.matmul(u, h, out=hu)
                        seen[before] += hu[3 * H:]
                    zr, z, r, c = hu[:2 * H], hu[:H], hu[H:2 * H], hu[2 * H:3 * H]
                    zr += a[:2 * H, t:t + m]
                    np.abs(zr, out=size)
                    size += 1
                    zr /= size
                    r += 1
                    c *= r
                    c += a[2 * H:, t:t + m]
                    np.abs(c, out=r)
                    r += 1
                    c /= r
                    c -= h
                    z -= 1
                    c *= z
                    c *= 0.5
                    h -= c
                    before = t
                seen[before] += u[3 * H:] @ h
            e = seen[:, 0]
            for t in range(WINDOW):
                e[t] += pad[i + t:i + t + m]
            e -= e.max(axis=0)
            np.exp(e, out=e)
            out[i:i + m] = (e * seen[:, 1]).sum(axis=0) / e.sum(axis=0) + p["bias"][0]
        return out

    def gradients(self, words_: Words, x: np.ndarray, places: np.ndarray, kept, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        p, H = self.p, HIDDEN
        _, states, w, pooled, tape = kept
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["out"]
        de = (states * dpool).sum(axis=2)
        de = w * (de - (w * de).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", de, states)
        dstates = w[:, :, None] * dpool + de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for d in "fb":
            dh, u, dpre = np.zeros((len(places), H), np.float32), p["u" + d], np.zeros((len(x), 3 * H), np.float32)
            gu = np.zeros_like(u)
            flat_at, flat_da = [], []
            for t, h, z, r, c, hc, m in reversed(tape[d]):
                dh = dh + dstates[t, :, H * (d == "b"):H * (1 + (d == "b"))]
                dc = dh * m * (1 - z)
                dz = -dh * m * (c - h) * (1 - np.abs(2 * z - 1)) ** 2 / 2
                da_c = dc * (1 - np.abs(c)) ** 2
                dr = da_c * hc * (1 - np.abs(2 * r - 1)) ** 2 / 2
                da = np.concatenate([dz, dr, da_c], 1)
                dhu = np.concatenate([dz, dr, da_c * r], 1)
                gu += h.T @ dhu
                dh = dh - dc + dhu @ u.T
                flat_at.append(places[:, t])
                flat_da.append(da)
            at, da = np.concatenate(flat_at), np.concatenate(flat_da)
            for j in range(3 * H):
                dpre[:, j] = np.bincount(at, da[:, j], len(x))
            dpre[-1] = 0
            g["u" + d], g["x" + d], g["c" + d] = gu, x.T @ dpre, da.sum(axis=0)
            dx += dpre @ p["x" + d].T
        dx = dx[:-1]

        def scatter(rows, values, size):
            return np.stack([np.bincount(rows, values[:, j], size) for j in range(values.shape[1])], 1).astype(np.float32)

        g["wa"] = scatter(words_.word_a, dx[:, :WORD_DIM], 1 << WORD_BITS)
        g["wb"] = scatter(words_.word_b, dx[:, WORD_DIM:2 * WORD_DIM], 1 << WORD_BITS)
        g["g"] = scatter(words_.gram, (dx[:, 2 * WORD_DIM:] * words_.share[:, None])[words_.owner], 1 << GRAM_BITS)
        return g

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text: the worst of all its windows."""
        w = Words(texts)
        seq, start, text = w.sequence()
        out = np.zeros(len(texts))
        if len(start):
            x = self.embed(w)
            del w
            logits = self.logits(x, seq)[start].astype(np.float64)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            out[text[first]] = sigmoid(np.maximum.reduceat(logits, first))
        return out


def train(texts: list[bytes], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    label = np.array(toxic, np.float32)
    steps, total = 0, max(epochs, -(-200 * BATCH // max(1, len(texts)))) * -(-len(texts) // BATCH)
    while steps < total:
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            w = Words([texts[k] for k in pick])
            seq, start, bag = w.sequence()
            if not len(start):
                steps += 1
                continue
            x = net.embed(w)
            logit = net.logits(x, seq)[start].astype(np.float64)
            first_of = np.flatnonzero(np.diff(bag, prepend=-1))
            wrong = sigmoid(np.maximum.reduceat(logit, first_of)) - label[pick[bag[first_of]]]
            size = np.diff(np.append(first_of, len(bag)))
            by_key = np.lexsort((-logit - rng.gumbel(size=len(bag)), bag))
            drawn = by_key[np.arange(len(bag)) - np.repeat(first_of, size) < DRAWN]
            share = np.repeat(wrong / np.minimum(size, DRAWN) / len(size), np.minimum(size, DRAWN))
            places = seq[start[drawn][:, None] + np.arange(WINDOW)]
            grads = net.gradients(w, x, places, net.run(x, places, keep=True), share.astype(np.float32))
            steps += 1
            rate = RATE * min(1.0, 2 * (1 - steps / (total + 1)))
            for k, v in grads.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                if v.shape[0] > 1 << 12:  # the hashed tables shrink, or rare words learn texts by heart
                    net.p[k] *= 1 - rate * SHRINK
                net.p[k] -= rate * (first[k] / (1 - 0.9 ** steps)) / (np.sqrt(second[k] / (1 - 0.99 ** steps)) + 1e-6)
            if steps >= total:
                break
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> list:
    """(text, toxic) of a bounded sample of the labelled rows outside the held-out fold."""
    known = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = (known.where("toxic = 1").orderBy(*order).limit(max_toxic)
           .unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean)))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    rows = one.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [((r["text"] or "").encode(), r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    rows = training_rows(docs, labels)
    if len({t for _, t in rows}) < 2:
        return None
    return train([x for x, _ in rows], [t for _, t in rows])


def scored(batches: Iterator[pa.RecordBatch], net: Network, names: list[str], column: str) -> Iterator[pa.RecordBatch]:
    """The batches with the scores of their texts as ``column``, a chunk of rows at a time."""
    release()
    for batch in batches:
        for first, texts in text_chunks(batch, limit=CHUNK_BYTES):
            part = batch.slice(first, len(texts))
            columns = [c for c, f in zip(part.columns, part.schema.names) if f != column]
            columns.insert(names.index(column), pa.array(net.score(texts), pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names)


def score_rows(docs: DataFrame, net: Network | None, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``column``, the score of the row's whole text."""
    if net is None:
        return docs.withColumn(column, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(net)
    out = docs.withColumn(column, F.lit(0.0)).schema
    names = [f.name for f in out]
    return docs.mapInArrow(lambda batches: scored(batches, sent.value, names, column), out)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score_rows(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, learn_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    score = "__score"
    while score in docs.columns:
        score += "_"
    return score_rows(docs, fit(learn_docs, labels), score).where(F.col(score) < threshold).drop(score)
