"""Benchmark decontamination by an FM-index of each shard of training text.

Test items are cut into phrases of PHRASE adjacent words. A shard (part of an Arrow
batch) is the sequence of its words over the benchmark's alphabet: any word that no
phrase holds becomes a break, as no match can cross it, and stretches between breaks
that are shorter than the shortest phrase are left out for the same reason. Of the
rest a suffix array is sorted (breaks are all distinct), and from it the
Burrows-Wheeler transform, a wavelet matrix for its ranks, and sampled positions.
All phrases are searched backwards at once; occurrences are located by stepping
to sampled positions; their spans are merged per text.

A benchmark is searched in parts of about PART_BYTES of distinct item texts, so that what
is broadcast has a bound whatever the benchmark's size: each part goes over the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tessera.llm.shared import fresh, written
from tessera.llm.words import Words, pieces, text_bytes, tokens

#: Words of a phrase; an item of fewer words is one phrase.
PHRASE = 8
#: An item of fewer words counts only where it stands as whole lines of a text.
WITHIN = 5
SAMPLE_RATE = 8
#: Bytes of item texts that are searched at once.
PART_BYTES = 8 << 20


class Wavelet:
    """Wavelet matrix over small integers: rank and access in one step per bit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for bit in range(self.bits - 1, -1, -1):
            b = (cur >> bit) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate((cur[b == 0], cur[b == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before each place i."""
        lo, hi = np.zeros_like(i), i
        for level in range(self.bits):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self.ones[level][lo], self.ones[level][hi]
            lo = np.where(one, self.zeros[level] + a, lo - a)
            hi = np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            a = self.ones[level][i]
            one = self.ones[level][i + 1] - a
            out = (out << 1) | one
            i = np.where(one == 1, self.zeros[level] + a, i - a)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling. Zeros are breaks: all distinct, the earlier the smaller."""
    n = len(seq)
    _, rank = np.unique(np.where(seq == 0, np.arange(n), n + seq.astype(np.int64)), return_inverse=True)
    rank, k = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        k *= 2
    return order


class FMIndex:
    """Of a sequence over 0 (break) to sigma - 1, which ends in a break."""

    def __init__(self, seq: np.ndarray, sigma: int, rate: int = SAMPLE_RATE):
        self.n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.tree = Wavelet(bwt, sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        # Beside every rate-th position, those after a break: stepping back never crosses one.
        marked = (sa % rate == 0) | (bwt == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples = sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases (one per row, all of one length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of suffixes, given their places in the order."""
        out, steps, todo, at = np.zeros(len(at), np.int64), 0, np.arange(len(at)), at.astype(np.int64)
        while len(todo):
            m = self.marks[at + 1] > self.marks[at]
            out[todo[m]] = self.samples[self.marks[at[m]]] + steps
            todo, at = todo[~m], at[~m]
            c = self.tree.access(at)
            at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The phrases of test items over the alphabet of their words. ``items``: (ids, text)."""

    def __init__(self, items: list[tuple[list, str | None]], phrase: int = PHRASE):
        w = tokens(pa.array([t for _, t in items], pa.string()))
        self.alphabet, s = np.unique(w.hash, return_inverse=True)
        s = s.astype(np.int64) + 1
        size, first = w.counts(), w.firsts()
        #: By length: distinct phrases, and the ids of each one's items.
        self.by: dict[int, tuple[np.ndarray, list[list]]] = {}
        for n in sorted({min(phrase, k) for k in size.tolist() if k}):
            own = np.flatnonzero(size == n) if n < phrase else np.flatnonzero(size >= n)
            many = size[own] - n + 1
            at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            grams, which = np.unique(s[at[:, None] + np.arange(n)], axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack((which.ravel(), np.repeat(own, many))), axis=0)
            cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            self.by[n] = grams, [ordered({i for k in x.tolist() for i in items[k][0]}) for x in np.split(pairs[:, 1], cuts)]
        self.shortest = min(self.by, default=0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 1, 0)

    def find(self, col: pa.Array) -> dict[int, list[tuple[int, int, list]]]:
        """By row: merged spans (first byte, end, items)."""
        if not self.by or len(col) == 0:
            return {}
        w = tokens(col)
        if len(w.hash) == 0:
            return {}
        s = self.symbols(w.hash)
        # Stretches of benchmark words within one row, as long as a phrase at least.
        fresh_run = np.ones(len(s), bool)
        fresh_run[1:] = (w.row[1:] != w.row[:-1]) | (s[:-1] == 0) | (s[1:] == 0)
        begin = np.flatnonzero(fresh_run)
        size = np.diff(np.append(begin, len(s)))
        good = (s[begin] > 0) & (size >= self.shortest)
        begin, size = begin[good], size[good]
        if len(begin) == 0:
            return {}
        # Each stretch, then a break.
        total = int((size + 1).sum())
        place = np.repeat(begin - np.concatenate(([0], np.cumsum(size + 1)[:-1])), size + 1) + np.arange(total)
        ends = np.cumsum(size + 1) - 1
        seq = s[np.minimum(place, len(s) - 1)]
        seq[ends] = 0
        index = FMIndex(seq, len(self.alphabet) + 1)
        spans: dict[int, list] = {}
        for n, (grams, items) in self.by.items():
            lo, hi = index.search(grams)
            many = hi - lo
            which = np.repeat(np.arange(len(grams)), many)
            if len(which) == 0:
                continue
            offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            at = place[index.locate(lo[which] + offset)]
            if n < WITHIN:
                whole = [k for k, a in enumerate(at.tolist()) if self._lines(col, w, a, a + n)]
                which, at = which[whole], at[whole]
            for g, a in zip(which.tolist(), at.tolist(), strict=True):
                spans.setdefault(int(w.row[a]), []).append((int(w.start[a]), int(w.end[a + n - 1]), items[g]))
        return {row: merged(found) for row, found in spans.items()}


    @staticmethod
    def _lines(col: pa.Array, w: Words, a: int, b: int) -> bool:
        """Whether the words from a to b are all words of their lines."""
        row = w.row[a]
        data, offs = text_bytes(col.slice(int(row), 1))
        before = w.end[a - 1] if a and w.row[a - 1] == row else -1
        after = w.start[b] if b < len(w.row) and w.row[b] == row else -1
        ends = (b"\n", b"\r")
        return (before < 0 or any(x in data[before : w.start[a]].tobytes() for x in ends)) and (after < 0 or any(x in data[w.end[b - 1] : after].tobytes() for x in ends))


def ordered(ids: set) -> list:
    """Sorted, a null last."""
    return sorted(ids, key=lambda x: (x is None, x if x is not None else 0))


def merged(spans: list[tuple[int, int, list]]) -> list[tuple[int, int, list]]:
    """Overlapping and touching spans as one, with all their items."""
    out: list[list] = []
    for s, e, items in sorted(spans, key=lambda x: (x[0], x[1])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2].update(items)
        else:
            out.append([s, e, set(items)])
    return [(s, e, ordered(items)) for s, e, items in out]


def span_column(spark: SparkSession, phrases: Phrases, text: Column, known: Column, item: DataType) -> Column:
    """Merged spans of each text in characters from 0, with those ``known``; null for none. It
    is evaluated once, wherever it is used."""
    held = spark.sparkContext.broadcast(phrases)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("items", pa.list_(to_arrow_type(item)))]))

    def find(col: pa.Array, old: pa.Array) -> pa.Array:
        out: list = old.to_pylist()
        at = 0
        for b in pieces(pa.RecordBatch.from_arrays([col], ["t"]), "t", 2 << 20):
            for row, spans in held.value.find(b.column("t")).items():
                raw = b.column("t")[row].as_py().encode()
                places = [(len(raw[:s].decode()), len(raw[:e].decode()), items) for s, e, items in spans]
                places += [(x["s"], x["e"], x["items"]) for x in out[at + row] or ()]
                out[at + row] = [{"s": s, "e": e, "items": i} for s, e, i in merged(places)]
            at += b.num_rows
        return pa.array(out, kind)

    @F.arrow_udf(spans_of(item))
    def spans(col: pa.Array, old: pa.Array) -> pa.Array:
        return find(col, old)

    return spans.asNondeterministic()(text, known)


def spans_of(item: DataType) -> str:
    return f"array<struct<s:int,e:int,items:array<{item.simpleString()}>>>"


def phrase_parts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", phrase: int = PHRASE, part_bytes: int = PART_BYTES) -> Iterator[Phrases]:
    """The phrases of the items with a text, part by part; of equal texts all ids are together."""
    items = benchmark.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("t")).agg(F.collect_set(item_col).alias("ids"), F.max(F.col(item_col).isNull()).alias("none"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = ceil(size / part_bytes)
    for p in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("t", F.lit(3)), F.lit(parts)) == p).toArrow().to_pylist()
        if rows:
            yield Phrases([(r["ids"] + [None] * r["none"], r["t"]) for r in rows], phrase)


def with_spans(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str, phrase: int, part_bytes: int) -> DataFrame:
    """``docs`` with the merged spans of each text in the column ``name``."""
    item = benchmark.schema["item_id"].dataType
    known, rows = F.lit(None).cast(spans_of(item)), docs
    for k, phrases in enumerate(phrase_parts(benchmark, phrase=phrase, part_bytes=part_bytes)):
        if k:
            rows, known = written(rows, "part-spans"), F.col(name)
        rows = rows.withColumn(name, span_column(docs.sparkSession, phrases, F.col(text_col), known, item))
    return rows if name in rows.columns else docs.withColumn(name, known)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase: int = PHRASE, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, span_start, span_end, item_ids): one row for each merged span of a text
    that repeats phrases of test items; places count characters from 0.

    * Case, punctuation and spacing are ignored. A span goes from its first word's
      first character to its last word's end.
    * Null and empty texts, and items, match nothing. An item of fewer than PHRASE words
      is searched whole; one of fewer than WITHIN words counts where it is all the words
      of one or more lines.
    * Items with the same phrase are all named, one without id as a null at the end.
    * Repeated rows and ids each give their own spans; a null id stays null.
    * A text is searched as a whole, however long. Other columns are not read. An
      empty table on either side gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    rows = with_spans(rows, benchmark, "spans", "t", phrase, part_bytes).select("doc_id", "spans").filter("spans is not null")
    rows = rows.select("doc_id", F.explode("spans").alias("x"))
    return rows.select("doc_id", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"), F.col("x.items").alias("item_ids"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars", phrase: int = PHRASE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with the contaminated spans cut out of the texts.

    * What counts as contaminated is as in ``contaminated``.
    * A text that has nothing but blanks and punctuation left goes. Where a text
      changes, ``length_col`` (if there) becomes its new length. All else stays: null
      and empty texts, repeated rows (each is cut alike), all other columns whatever
      their names.
    * A text is searched as a whole, however long. Empty tables give or change nothing.
    """
    k, t = fresh(docs, "spans"), fresh(docs, "cut")
    rows = with_spans(docs, benchmark, k, text_col, phrase, part_bytes)
    starts = F.concat(F.array(F.lit(0)), F.col(k)["e"])
    ends = F.concat(F.col(k)["s"], F.array(F.length(text_col)))
    parts = F.zip_with(starts, ends, lambda s, e: F.substring(F.col(text_col), s + 1, e - s))
    rows = rows.withColumn(t, F.when(F.col(k).isNull(), F.col(text_col)).otherwise(F.array_join(parts, "")))
    rows = rows.filter(F.col(k).isNull() | F.col(t).rlike(r"[\p{L}\p{N}]"))
    new = {text_col: F.col(t)}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col(k).isNull(), F.col(length_col)).otherwise(F.length(t).cast(docs.schema[length_col].dataType))
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
