"""Language-model scoring with a log-bilinear model trained by noise contrast.

The model predicts a word's vector from the CONTEXT words before it by one matrix for
each place, and scores a word by the dot product plus its bias. The VOCABULARY most
frequent words have vectors. Probabilities have two levels, each normalised by matrix
products over batches of contexts: of symbols (the HEAD most frequent words, GROUPS
groups of the others by their endings, CLASSES classes of all words beyond the
vocabulary), and of the words within a group.

It is trained on all documents in ROUNDS rounds, each on its share of the rows: every
task makes one pass from the same start, and the tasks' parameters are averaged by their
words. Training tells each symbol, and each word of a group, from noise, so needs no sum
over them; noise and first biases come from the word counts of all documents.

Within its class, every word beyond the vocabulary that occurs LEAST times has the
probability of its own count: these words grow with the corpus, so they are a table that
is joined. Rarer words share what is left by their spelling: bytes from the last to the
first, each given the two after it, normalised over all strings of the class that aren't
counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written
from tessera.llm.words import WORD, U, Words, _classes, _tables, mix, pieces, text_bytes, tokens

#: Words that have vectors of their own.
VOCABULARY = 50_000
#: The most frequent of these are symbols; the others are parted among so many groups.
HEAD, GROUPS = 126, 160
#: Classes of all words beyond the vocabulary.
CLASSES = 32
#: A word counted as often has a probability of its own in its class; rarer ones are spelled.
LEAST = 2
BEGIN = 0
CONTEXT = 2
DIMS = 16
NOISE = 32
BATCH = 4096
RATE = 0.15
ROUNDS = 3
#: Input partitions that one training task takes at most.
TOGETHER = 16
SEED = 5
#: The lowest bits of a hash, by which words are looked up.
SLOTS = U((1 << 19) - 1)


def folded(col: pa.Array, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all rows as they are hashed, and the first byte and the end of each word in them."""
    data, offs = text_bytes(col)
    base = offs[w.row]
    return (_classes(data)[1] if len(data) else data), base + w.start, base + w.end


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, sorted; what sorts all of them; and where each one begins in that order."""
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[first], order, first


def endings(col: pa.Array, w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``folded``, but of the last 4 bytes of the words ``which`` only. No letter that
    has two forms is longer than 3 bytes, so the last two bytes are as in the whole text."""
    data, offs = text_bytes(col)
    base = offs[w.row[which]]
    end = base + w.end[which]
    size = np.minimum(end - base - w.start[which], 4)
    out = np.full(5 * len(which) + 1, 32, np.uint8)
    to = np.arange(len(which)) * 5 + 4
    for j in range(1, 5):
        has = size >= j
        out[to[has] - j] = data[end[has] - j]
    return _classes(out)[1], to - size, to


def class_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word, by its last two bytes."""
    if len(end) == 0:
        return np.zeros(0, np.int64)
    last = data[end - 1].astype(U)
    before = np.where(end - start > 1, data[end - 2], 0).astype(U)
    return (mix(last | (before << U(8))) % U(classes)).astype(np.int64)


class Vocabulary:
    """Ids of words: BEGIN is 0; then the ``head`` most frequent words, the other words by
    their endings, and the classes of all others. ``share`` is each id's part of the corpus."""

    def __init__(self, top: list[tuple[int, int, bytes]], rest: np.ndarray, head: int = HEAD, groups: int = GROUPS):
        """``top``: (hash, count, ending) of the words, the most frequent first; ``rest``: counts of the classes."""
        tail = sorted(top[head:], key=lambda r: (r[2][::-1], r[0]))
        rows = [*top[:head], *tail]
        h = np.array([r[0] for r in rows], np.int64).view(U)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.arange(1, len(rows) + 1)[order]
        #: By the lowest bits of a hash, where it may be in ``hashes``; and whether others have these bits as well.
        slot = (self.hashes & SLOTS).astype(np.int64)
        self.slot = np.zeros(int(SLOTS) + 1, np.int32)
        self.slot[slot] = np.arange(len(rows))
        self.shared = np.bincount(slot, minlength=len(self.slot)) > 1
        self.head, self.words, self.classes = min(head, len(top)), len(rows), len(rest)
        share = np.concatenate(([0.0], np.array([r[1] for r in rows], float) + 1, np.asarray(rest, float) + 1))
        self.share = share / share.sum()
        #: Of each group, its first word and the end, counted from the head.
        n = min(groups, len(tail))
        self.edges = np.linspace(0, len(tail), n + 1).astype(np.int64) if n else np.zeros(1, np.int64)
        self.group = np.repeat(np.arange(n), np.diff(self.edges))
        #: The symbol of each id; BEGIN has none.
        self.symbol = np.concatenate(([-1], np.arange(self.head), self.head + self.group, self.head + n + np.arange(self.classes))).astype(np.int64)
        self.symbols = self.head + n + self.classes
        self.symbol_share = np.bincount(self.symbol[1:], self.share[1:], self.symbols)

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        """-1 for words beyond the vocabulary."""
        if len(self.hashes) == 0:
            return np.full(len(h), -1, np.int64)
        low = (h & SLOTS).astype(np.int64)
        at = self.slot[low]
        out = np.where(self.hashes[at] == h, self.ids[at], -1)
        again = np.flatnonzero(self.shared[low])
        h = h[again]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out[again] = np.where(self.hashes[at] == h, self.ids[at], -1)
        return out

    def stream(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, the ids of their contexts (words x CONTEXT), and their rows."""
        return self.stream_of(col, tokens(col))

    def stream_of(self, col: pa.Array, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.ids_of(w.hash)
        rest = np.flatnonzero(x < 0)
        if len(rest):
            x[rest] = 1 + self.words + class_of(*endings(col, w, rest), self.classes)
        before = np.full((len(x), CONTEXT), BEGIN, np.int64)
        for j in range(1, CONTEXT + 1):
            if len(x) > j:
                same = w.row[j:] == w.row[:-j]
                before[j:, j - 1][same] = x[:-j][same]
        return x, before, w.row


@dataclass
class Parameters:
    context: np.ndarray  # ids x dims: words as context
    turn: np.ndarray  # CONTEXT x dims x dims
    symbol: np.ndarray  # symbols x dims
    symbol_bias: np.ndarray
    word: np.ndarray  # words of groups x dims
    word_bias: np.ndarray

    @staticmethod
    def start(v: Vocabulary, dims: int, seed: int = SEED) -> Parameters:
        rng = np.random.default_rng(seed)
        turn = np.stack([np.eye(dims) / (j + 1) for j in range(CONTEXT)])
        context, symbol, word = (rng.normal(0, 0.1, (n, dims)) for n in (len(v.share), v.symbols, v.words - v.head))
        word *= 0.1
        bias = [np.log(np.maximum(s, 1e-12)) for s in (v.symbol_share, v.share[1 + v.head : 1 + v.words])]
        return Parameters(*(a.astype(np.float32) for a in (context, turn, symbol, bias[0], word, bias[1])))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.turn, self.symbol, self.symbol_bias, self.word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Parameters(*out)

    def hidden(self, before: np.ndarray) -> np.ndarray:
        """The predicted vectors of contexts."""
        return sum(self.context.take(before[:, j], axis=0) @ self.turn[j] for j in range(CONTEXT))


def _order(ids: np.ndarray) -> np.ndarray:
    """What sorts ``ids``; if none needs more than two bytes, they are sorted by these."""
    return np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")


def _sums(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the sums of their ``rows``."""
    if len(ids) == 0:
        return ids, rows
    order = _order(ids)
    s = ids[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    rows = rows.take(order, axis=0)
    if rows.dtype == np.float32 and rows.shape[1] % 2 == 0:
        # Two columns at a time, which complex numbers add apart.
        return s[at], np.add.reduceat(rows.view(np.complex64), at, axis=0).view(np.float32)
    return s[at], np.add.reduceat(rows, at, axis=0)


class Noise:
    """Draws from a distribution, and the logarithms that training compares with."""

    def __init__(self, share: np.ndarray, many: int):
        share = share / max(share.sum(), 1e-300)
        self.many, self.cumulative = many, np.cumsum(share)
        self.log = (np.log(np.maximum(share, 1e-12)) + np.log(many)).astype(np.float32)

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        return np.minimum(np.searchsorted(self.cumulative, rng.random(self.many)), len(self.cumulative) - 1)


class Trainer:
    """Noise-contrastive estimation with Adagrad, from given parameters. A step costs as much for any vocabulary."""

    def __init__(self, start: Parameters, v: Vocabulary, noise: int = NOISE, rate: float = RATE, seed: int = SEED):
        # Words that are seen once in a batch must move as well.
        self.v, self.turn, self.turn_square = v, start.turn.copy(), np.full_like(start.turn, 1e-4)
        # The bias is one more dimension, and beside a vector is what Adagrad has summed of it, as they move together.
        beside = lambda rows, least: np.hstack((rows, np.full_like(rows, least)))
        self.context = beside(start.context, 1e-6)
        self.symbol, self.word = beside(np.column_stack((start.symbol, start.symbol_bias)), 1e-4), beside(np.column_stack((start.word, start.word_bias)), 1e-6)
        self.rate, self.rng = rate, np.random.default_rng(seed)
        self.symbol_noise = Noise(v.symbol_share, noise)
        self.word_noise = Noise(v.share[1 + v.head : 1 + v.words], noise)
        self.seen = 0

    @property
    def p(self) -> Parameters:
        n = len(self.turn[0])
        return Parameters(self.context[:, :n], self.turn, self.symbol[:, :n], self.symbol[:, n], self.word[:, :n], self.word[:, n])

    def _contrast(self, h: np.ndarray, x: np.ndarray, vectors: np.ndarray, noise: Noise) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What targets ``x`` against noise give: changes of h, the targets, changes of their vectors."""
        n, drawn = h.shape[1], noise.draw(self.rng)
        target, other = vectors.take(x, axis=0)[:, :n], vectors.take(drawn, axis=0)[:, :n]
        with np.errstate(over="ignore"):  # far beyond any doubt: 1 / inf is the 0 that is meant
            real = np.einsum("ij,ij->i", h, target)
            real -= noise.log[x]
            g = 1 / (1 + np.exp(real))  # 1 - sigma: of real words
            q = h @ other.T
            np.subtract(noise.log[drawn], q, out=q)
            np.exp(q, out=q)
            q += 1
            np.divide(-1, q, out=q)  # - sigma: of noise words
        target *= g[:, None]
        target += q @ other
        # An even number of columns, for the sums.
        rows = np.zeros((len(x) + len(drawn), n + n % 2), h.dtype)
        np.multiply(h, g[:, None], out=rows[: len(x), :n])
        rows[len(x) :, :n] = q.T @ h
        at, d = _sums(np.concatenate((x, drawn)), rows)
        return target, at, np.ascontiguousarray(d[:, :n])

    def _step(self, d: np.ndarray, square: np.ndarray) -> np.ndarray:
        square += d * d
        return self.rate * d / np.sqrt(square)

    def _move(self, table: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        rows, n = table.take(at, axis=0), d.shape[1]
        rows[:, :n] += self._step(d, rows[:, n:])
        table[at] = rows

    def step(self, x: np.ndarray, before: np.ndarray) -> None:
        # A few words move little: they count as a batch that is empty but for them.
        v, n = self.v, np.float32(max(len(x), BATCH))
        dims = len(self.turn[0])
        ctx = [self.context.take(before[:, j], axis=0)[:, :dims] for j in range(CONTEXT)]
        h = np.ones((len(x), dims + 1), np.float32)
        h[:, :-1] = sum(c @ t for c, t in zip(ctx, self.turn, strict=True))
        dh, at, d = self._contrast(h, v.symbol[x], self.symbol, self.symbol_noise)
        grouped = np.flatnonzero((x > v.head) & (x <= v.words))
        if len(grouped):
            more, w, dw = self._contrast(h.take(grouped, axis=0), x[grouped] - 1 - v.head, self.word, self.word_noise)
            dh[grouped] += more
            dw /= n
            self._move(self.word, w, dw)
        d /= n
        self._move(self.symbol, at, d)
        dh = np.ascontiguousarray(dh[:, :-1])
        dh /= n
        seen, dctx = _sums(before.T.ravel(), np.vstack([dh @ t.T for t in self.turn]))
        dturn = np.stack([c.T @ dh for c in ctx])
        self._move(self.context, seen, dctx)
        self.turn += self._step(dturn, self.turn_square)
        self.seen += len(x)

    def learn(self, x: np.ndarray, before: np.ndarray, batch: int = BATCH) -> None:
        for i in range(0, len(x), batch):
            self.step(x[i : i + batch], before[i : i + batch])


def _log_sums(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exp of each row of ``h @ w``."""
    s = h @ w
    # Scores are near log probabilities, as noise contrast trains them, so that exp overflows hardly ever.
    with np.errstate(over="ignore"):
        z = np.exp(s, out=s) @ np.ones(s.shape[1], s.dtype)
    if np.isfinite(z).all() and (z > 0).all():
        return np.log(z)
    s = (h @ w).astype(np.float64)
    top = s.max(axis=1, keepdims=True)
    return np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]


class Scorer:
    """Normalised log probabilities of ids (words of the vocabulary, classes of others)."""

    def __init__(self, p: Parameters, v: Vocabulary):
        self.p, self.v = p, v
        # The bias is one more dimension, so that a matrix product adds it.
        self.symbol = np.ascontiguousarray(np.column_stack((p.symbol, p.symbol_bias)).T)
        self.word = np.ascontiguousarray(np.column_stack((p.word, p.word_bias)).T)

    def log_probs(self, x: np.ndarray, before: np.ndarray, chunk: int = 512) -> np.ndarray:
        p, v = self.p, self.v
        if not len(x):
            return np.zeros(0)
        key = before[:, 0].copy()
        for j in range(1, CONTEXT):
            key = key * len(v.share) + before[:, j]
        order = np.argsort(key)
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        first, at = order[new], np.empty(len(key), np.int64)
        at[order] = np.cumsum(new) - 1
        h = p.hidden(before[first])
        h = np.column_stack((h, np.ones(len(h), h.dtype)))
        norm = np.concatenate([_log_sums(h[i : i + chunk], self.symbol) for i in range(0, len(h), chunk)])
        s = v.symbol[x]
        out = np.einsum("ij,ij->i", h.take(at, axis=0)[:, :-1], p.symbol.take(s, axis=0)) + p.symbol_bias[s] - norm[at]
        # Words of one group share a matrix product.
        w = x - 1 - v.head
        rows = np.flatnonzero((w >= 0) & (x <= v.words))
        if len(rows):
            g = v.group[w[rows]]
            order = _order(g)
            rows, g = rows[order], g[order]
            near, w = h.take(at[rows], axis=0), w[rows]
            own = np.einsum("ij,ij->i", near[:, :-1], p.word.take(w, axis=0)) + p.word_bias[w]
            cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = self.word[:, v.edges[g[a]] : v.edges[g[a] + 1]]
                for i in range(a, b, chunk):
                    j = min(b, i + chunk)
                    own[i:j] -= _log_sums(near[i:j], part)
            out[rows] += own
        return out


def count_words(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(k, w, g, c): hash, bytes and class of every word of ``docs`` (t) and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(col):
            t = tokens(col)
            k, order, at = distinct(t.hash)
            # Any occurrence will do: words of one hash are folded alike.
            first, c = order[at], np.diff(np.append(at, len(order)))
            data, start, end = folded(col, t)
            start, end = start[first], end[first]
            offs = np.concatenate(([0], np.cumsum(end - start)))
            own = data[np.repeat(start - offs[:-1], end - start) + np.arange(offs[-1])]
            spelt = pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(own)])
            return k, c, spelt, class_of(data, start, end, classes)

        def summed(held):
            k, order, at = distinct(np.concatenate([h[0] for h in held]))
            first = order[at]
            c = np.add.reduceat(np.concatenate([h[1] for h in held])[order], at) if len(k) else np.zeros(0, np.int64)
            return k, c, pa.concat_arrays([h[2] for h in held]).take(pa.array(first)), np.concatenate([h[3] for h in held])[first]

        def given(k, c, spelt, g):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), spelt.cast(pa.binary()), pa.array(g.astype(np.int32)), pa.array(c)], ["k", "w", "g", "c"])

        held, size = [], 0
        for whole in batches:
            for b in pieces(whole, "t"):
                held.append(counted(b.column("t")))
                # Long words count by their bytes.
                size += len(held[-1][0]) + held[-1][2].nbytes // 32
                if size > 2_000_000:
                    held = [summed(held)]
                    if len(held[0][0]) + held[0][2].nbytes // 32 > 1_000_000:
                        yield given(*held[0])
                        held = []
                    size = sum(len(h[0]) for h in held)
        if held:
            yield given(*summed(held))

    return docs.mapInArrow(run, "k long, w binary, g int, c long").groupBy("k", "w", "g").agg(F.sum("c").alias("c"))


def symbols_of(counts: DataFrame, size: int, classes: int, head: int = HEAD, groups: int = GROUPS) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of ``counts`` (by ``count_words``): the most frequent words, equally
    frequent ones by hash. And ``counts`` with ``top``: whether a word is in it."""
    # Each task keeps ``size`` words, one task those of all.
    top = counts.orderBy(F.desc("c"), "k").limit(size).select("k", "c", "g", F.expr("substring(w, -8, 8)").alias("e")).toArrow()
    k, c, g = (top.column(x).to_numpy() for x in ("k", "c", "g"))
    rest = np.zeros(classes)
    for r in counts.groupBy("g").agg(F.sum("c").alias("c")).collect():
        rest[r["g"]] = r["c"]
    rest -= np.bincount(g, c, classes)
    # At most ``size`` rows.
    known = counts.sparkSession.createDataFrame(pa.table({"k": pa.array(k, pa.int64()), "top": pa.array(np.ones(len(k), bool))}))
    marked = counts.join(F.broadcast(known), "k", "left").withColumn("top", F.col("top").isNotNull())
    return Vocabulary(list(zip(k.tolist(), c.tolist(), top.column("e").to_pylist(), strict=True)), rest, head, groups), marked


EDGE = 256


class Spelling:
    """Probabilities of words by their bytes, from the last to the first and an edge, each
    given the two after it; interpolated with those given one and none."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, draw: float = 4.0):
        """``keys``: a byte, and the two after it, as digits to the base 257; the byte is the lowest."""
        n = EDGE + 1
        order = np.argsort(keys)
        self.draw, self.keys, self.counts = draw, keys[order], counts[order].astype(float)
        x, one = self.keys % n, self.keys // n % n
        base = np.zeros(n)
        base[:256][_tables()[0] == WORD] = 1.0
        base[65:91] = 0.0  # folded
        base[EDGE] = 1.0
        base /= base.sum()
        alone = np.bincount(x, self.counts, n)
        alone = (alone + draw * base) / (alone.sum() + draw)
        pair = np.bincount(one * n + x, self.counts, n * n).reshape(n, n)
        self.pair = (pair + draw * alone) / (pair.sum(axis=1, keepdims=True) + draw)
        self.total = np.bincount(self.keys // n, self.counts, n * n)

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        n = EDGE + 1
        c = np.zeros(len(keys))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            c = np.where(self.keys[at] == keys, self.counts[at], 0.0)
        before = keys // n
        with np.errstate(divide="ignore"):  # bytes that no word has
            return np.log((c + self.draw * self.pair[before % n, keys % n]) / (self.total[before] + self.draw))

    def class_mass(self, classes: int) -> np.ndarray:
        """The probability of all words of each class: of the pairs of last bytes that it has."""
        last = np.repeat(np.arange(256), 257)
        before = np.tile(np.arange(257), 256)
        n = EDGE + 1
        p = np.exp(self.log_probs(last + n * EDGE + n * n * EDGE) + self.log_probs(before + n * last + n * n * EDGE))
        one = before == EDGE
        g = (mix(last.astype(U) | (np.where(one, 0, before).astype(U) << U(8))) % U(classes)).astype(np.int64)
        return np.bincount(g, p, classes)


def spelling_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of every byte of ``words`` and of their edges, and the word of each."""
    n = EDGE + 1
    words = words.cast(pa.large_binary())
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    size = np.diff(offs)
    # Of each word: an edge, its bytes, and two edges.
    row = np.repeat(np.arange(len(size)), size + 3)
    x = np.full(len(row), EDGE, np.int64)
    first = np.cumsum(size + 3) - (size + 3)
    x[np.repeat(first + 1 - (offs[:-1] - offs[0]), size) + np.arange(len(data))] = data
    real = np.ones(len(x), bool)
    real[first + size + 1] = real[first + size + 2] = False
    at = np.flatnonzero(real)
    return x[at] + n * x[at + 1] + n * n * x[at + 2], row[at]


def word_probs(marked: DataFrame, classes: int = CLASSES, least: int = LEAST) -> DataFrame:
    """(k, lp): the log probability in its class of each word of ``marked`` (by ``symbols_of``) that is no symbol."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 20_000):
                b = whole.slice(i, 20_000)
                key, row = spelling_keys(b.column("w"))
                k, at = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(at, b.column("c").to_numpy()[row], len(k)))], ["x", "n"])

    rare = marked.filter((~F.col("top")) & (F.col("c") < least))
    # As many rows as triples of bytes that words have.
    grams = rare.select("w", "c").mapInArrow(keyed, "x long, n double").groupBy("x").agg(F.sum("n").alias("n")).toArrow()
    spelling = Spelling(grams.column("x").to_numpy().astype(np.int64), grams.column("n").to_numpy())
    held = marked.sparkSession.sparkContext.broadcast(spelling)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 20_000):
                b = whole.slice(i, 20_000)
                key, row = spelling_keys(b.column("w"))
                lp = np.bincount(row, held.value.log_probs(key), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("k", "g", "c", "top")] + [pa.array(lp)], ["k", "g", "c", "top", "s"])

    words = written(marked.select("k", "w", "g", "c", "top").mapInArrow(spelt, "k long, g int, c long, top boolean, s double"), "spelt")
    common = F.col("top") | (F.col("c") >= least)
    of = {
        r["g"]: r
        for r in words.groupBy("g")
        .agg(F.sum(F.when(~F.col("top"), F.col("c"))).alias("n"), F.sum(F.when(~common, F.col("c"))).alias("r"), F.sum(F.when(common, F.exp("s"))).alias("m"))
        .collect()
    }
    mass = spelling.class_mass(classes)
    table = []
    for g, r in of.items():
        # One occurrence more stands for all words never seen.
        total, rest = (r["n"] or 0) + 1, (r["r"] or 0) + 1
        table.append((g, float(np.log(total)), float(np.log(rest) - np.log(total) - np.log(max(mass[g] - (r["m"] or 0.0), 1e-300)))))
    by_class = marked.sparkSession.createDataFrame(table, "g int, total double, rest double")
    lp = F.when(F.col("c") >= least, F.log(F.col("c").cast("double")) - F.col("total")).otherwise(F.col("s") + F.col("rest"))
    return words.filter(~F.col("top")).join(F.broadcast(by_class), "g").select("k", lp.alias("lp"))


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of parameter rows (w, p), with the sum of the weights; one row in memory at a time."""
    total, weight = None, 0.0
    for b in batches:
        for w, raw in zip(b.column("w").to_pylist(), b.column("p"), strict=True):
            row = np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * w
            total = row if total is None else total + row
            weight += w
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["w", "p"])


def train(docs: DataFrame, vocab: Vocabulary, dims: int = DIMS, noise: int = NOISE, rate: float = RATE, rounds: int = ROUNDS) -> Parameters:
    """Parameters learnt from all texts of ``docs`` (t), each of them in one of the rounds."""
    p, spark = Parameters.start(vocab, dims), docs.sparkSession
    parts = docs.rdd.getNumPartitions()
    tasks = max(1, min(parts, max(spark.sparkContext.defaultParallelism, ceil(parts / TOGETHER))))
    kind = "w double, p binary"
    for r in range(rounds):
        held = spark.sparkContext.broadcast((vocab, p))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            v, start = held.value
            trainer = Trainer(start, v, noise, rate)
            rest: list[tuple[np.ndarray, np.ndarray]] = []
            for whole in batches:
                for b in pieces(whole, "t"):
                    x, before, _ = v.stream(b.column("t"))
                    rest.append((x, before))
                    if sum(len(y[0]) for y in rest) >= BATCH:
                        trainer.learn(np.concatenate([y[0] for y in rest]), np.concatenate([y[1] for y in rest]))
                        rest = []
            if rest:
                trainer.learn(np.concatenate([y[0] for y in rest]), np.concatenate([y[1] for y in rest]))
            if trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(trainer.seen)]), pa.array([trainer.p.flat().tobytes()], pa.binary())], ["w", "p"])

        mine = docs.filter(F.pmod(F.monotonically_increasing_id(), F.lit(rounds)) == r).coalesce(tasks)
        # Means of means, so that no task reads more than about the root of all tasks' rows.
        means = mine.mapInArrow(run, kind).repartition(max(1, ceil(sqrt(tasks)))).mapInArrow(_mean, kind).coalesce(1).mapInArrow(_mean, kind)
        row = means.first()
        held.destroy()
        if row is not None:
            p = p.like(np.frombuffer(row["p"], np.float32))
    return p


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_size: int = VOCABULARY,
    dims: int = DIMS,
    noise: int = NOISE,
    rate: float = RATE,
    classes: int = CLASSES,
    least: int = LEAST,
    head: int = HEAD,
    groups: int = GROUPS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row under a model of all rows.

    * log_prob is the sum of the words' natural log probabilities, of each word itself:
      words beyond the vocabulary have their class's by the context times their own in
      the class. perplexity is exp(-log_prob / n_tokens).
    * A null text has nulls. A text without words has 0, 0.0 and a null perplexity.
    * Repeated rows and ids are scored row by row, and count as often as they occur.
    * A text of any length is scored whole. Other columns are not read. An empty table
      gives no rows.

    Words with vectors, and so parameters, have a fixed number, so what is broadcast doesn't
    grow; the words beyond them do, and are joined.
    """
    slim = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = slim.select("t").filter("t is not null")
    vocab, marked = symbols_of(written(count_words(texts, classes), "words"), vocabulary_size, classes, head, groups)
    words = word_probs(marked, classes, least)
    held = docs.sparkSession.sparkContext.broadcast((vocab, train(texts, vocab, dims, noise, rate, rounds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = held.value
        scorer = Scorer(p, v)
        for whole in batches:
            for b in pieces(whole, "t"):
                w = tokens(b.column("t"))
                x, before, row = v.stream_of(b.column("t"), w)
                lp = scorer.log_probs(x, before)
                n = np.bincount(row, minlength=b.num_rows)
                total = np.bincount(row, lp, b.num_rows)
                null = np.asarray(b.column("t").is_null())
                rest = np.flatnonzero(x > v.words)
                k, r = w.hash[rest].view(np.int64), row[rest]
                order = np.lexsort((k, r))
                k, r = k[order], r[order]
                first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))) if len(k) else np.zeros(0, np.int64)
                pairs = pa.StructArray.from_arrays([pa.array(k[first]), pa.array(np.diff(np.append(first, len(k))).astype(np.int32))], ["k", "c"])
                offs = np.concatenate(([0], np.cumsum(np.bincount(r[first], minlength=b.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(n, pa.int64(), mask=null), pa.array(total, pa.float64(), mask=null), pa.ListArray.from_arrays(pa.array(offs), pairs)], ["d", "n", "lp", "rest"])

    rows = slim.mapInArrow(run, f"d {kind}, n long, lp double, rest array<struct<k:long,c:int>>").withColumn("r", F.monotonically_increasing_id())
    rows = written(rows, "symbols")
    pairs = rows.select("r", F.explode("rest").alias("x")).select("r", "x.k", "x.c")
    own = pairs.join(words, "k").groupBy("r").agg(F.sum(F.col("c") * F.col("lp")).alias("own"))
    total = F.col("lp") + F.coalesce("own", F.lit(0.0))
    out = rows.select("d", "n", "lp", "r").join(own, "r", "left").select(F.col("d").alias("doc_id"), F.col("n").alias("n_tokens"), total.alias("log_prob"))
    return out.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))))
