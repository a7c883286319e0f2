"""Tokens of whole Arrow batches as numpy arrays, without a Python object per word.

A token is a run of word bytes (ASCII letters, digits, ``_`` and any letter beyond
ASCII) or, if asked for, a run of other printable bytes. Letters are folded to lower
case where both forms have as many bytes. Every token has a 64-bit hash of its folded bytes. Work
goes in blocks of whole tokens, so a text of any length needs little memory beside
its own bytes. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 16
SEP, WORD, PUNCT = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cls = np.zeros(256, np.uint8)
    for b in range(33, 127):
        cls[b] = WORD if chr(b).isalnum() or b == 95 else PUNCT
    cls[128:] = WORD
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return cls, low, salts(256, 7), salts(64, 11)


@lru_cache(1)
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower case of letters of two, and of three bytes."""
    two, three = np.arange(0x800), np.arange(0x10000)
    for table, least in ((two, 0x80), (three, 0x800)):
        for c in range(least, len(table)):
            low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
            if len(low) == 1 and least <= ord(low) < len(table):
                table[c] = ord(low)
    return two, three


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = 0x5851F42D4C957F2D
    inv = pow(p, -1, 1 << 64)
    out = []
    for q in (p, inv):
        a = np.full(n, q, U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


@dataclass
class Words:
    """Tokens in order: hash, row of the batch, first byte and end within the row's text, kind."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def firsts(self) -> np.ndarray:
        """Index of each row's first token; one more at the end."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and each row's offset in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string_view(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    buf = col.buffers()
    offs = np.frombuffer(buf[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if buf[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buf[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cls, low, _, _ = _tables()
    c, b = cls[data], low[data]
    if (data > 127).any():
        two, three = _folds()
        at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF))
        if len(at):
            cp = two[((data[at] & 31).astype(np.int64) << 6) | (data[at + 1] & 63)]
            b[at], b[at + 1] = 0xC0 | (cp >> 6), 0x80 | (cp & 63)
        at = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] <= 0xEF))
        if len(at):
            cp = three[((data[at] & 15).astype(np.int64) << 12) | ((data[at + 1] & 63).astype(np.int64) << 6) | (data[at + 2] & 63)]
            b[at], b[at + 1], b[at + 2] = 0xE0 | (cp >> 12), 0x80 | ((cp >> 6) & 63), 0x80 | (cp & 63)
        at = np.flatnonzero(data[:-1] == 0xC2)
        nxt = data[at + 1]
        mark = at[(nxt != 0xAA) & (nxt != 0xB5) & (nxt != 0xBA)]
        c[mark] = PUNCT
        c[mark + 1] = PUNCT
        blank = at[nxt == 0xA0]
        c[blank] = SEP
        c[blank + 1] = SEP
        for lead, follow in ((0xE2, (0x80,)), (0xE3, (0x80,))):
            at = np.flatnonzero(data[:-2] == lead)
            at = at[np.isin(data[at + 1], follow)]
            for k in range(3):
                c[at + k] = PUNCT
    return c, b


def tokens(col: pa.Array, punct: bool = False) -> Words:
    data, offs = text_bytes(col)
    rows = len(offs) - 1
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, z, np.zeros(0, np.uint8), rows)
    c, b = _classes(data)
    if not punct:
        c[c == PUNCT] = SEP
    edge = np.empty(n + 1, bool)
    edge[1:n] = c[1:] != c[:-1]
    edge[offs] = True
    edge[[0, n]] = True
    # A CJK sign stands alone: a new token begins at each three-byte lead E3 to ED.
    wide = np.flatnonzero((data >= 0xE3) & (data <= 0xED))
    if len(wide):
        wide = wide[c[wide] == WORD]
        edge[wide] = True
        edge[np.minimum(wide + 3, n)] = True
    at = np.flatnonzero(edge)
    s, e = at[:-1], at[1:]
    kind = c[s]
    keep = kind != SEP
    s, e, kind = s[keep], e[keep], kind[keep]
    h = np.empty(len(s), U)
    _, _, value, _ = _tables()
    i = 0
    with np.errstate(over="ignore"):
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, "right")))
            lo, hi = s[i], e[j - 1]
            size = 1 << max(12, int(hi - lo).bit_length())
            power, inverse = _powers(size)
            run = np.zeros(hi - lo + 1, U)
            np.cumsum(value[b[lo:hi]] * power[: hi - lo], out=run[1:])
            h[i:j] = mix((run[e[i:j] - lo] - run[s[i:j] - lo]) * inverse[s[i:j] - lo] + (e[i:j] - s[i:j]).astype(U))
            i = j
    row = np.searchsorted(offs, s, "right") - 1
    base = offs[row]
    return Words(h, row, s - base, e - base, kind, rows)


def word_hash(text: str, punct: bool = False) -> np.ndarray:
    return tokens(pa.array([text], pa.string()), punct).hash


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k adjacent tokens of a row, and their rows. A row of fewer
    tokens, but at least one, gives one shingle of all of them."""
    a = _tables()[3]
    with np.errstate(over="ignore"):
        n = len(w.hash)
        count = w.counts()
        if n >= k:
            s = np.zeros(n - k + 1, U)
            for j in range(k):
                s += w.hash[j : n - k + 1 + j] * a[j]
            ok = w.row[: n - k + 1] == w.row[k - 1 :]
            s, r = s[ok], w.row[: n - k + 1][ok]
        else:
            s, r = np.zeros(0, U), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = w.firsts()
            extra = np.zeros(len(short), U)
            for j in range(k - 1):
                has = count[short] > j
                extra[has] += w.hash[first[short[has]] + j] * a[j]
            s, r = np.concatenate((s, extra)), np.concatenate((r, short))
            order = np.argsort(r, kind="stable")
            s, r = s[order], r[order]
        return mix(s), r


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``limit`` bytes of text; a longer text is a part of its own.
    What Arrow holds beyond the parts in use is given back after each batch."""
    if batch.num_rows == 0:
        return
    _, offs = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    pa.default_memory_pool().release_unused()
