"""Near duplicates by fast similarity sketches, banding and exact verification.

A document is the set of its hashed word 3-grams. The sketch has ``BANDS * ROWS``
bins. In round i < t each element draws a bin and a value above those of all
earlier rounds; in round t + i every element goes to bin i, so each bin fills at
the latest then; a bin keeps its least value, and rounds end when all are full.
(Dahlgaard, Knudsen and Thorup, FOCS 2017.) Documents that agree in all rows of a
band share a bucket. Pairs of a bucket are verified by the exact Jaccard similarity
of the sets; groups are the connected components of verified pairs.

Texts of one sequence of words are one text here; what follows is done once for them. No
bucket is capped. First each member is compared with its bucket's least member; what
this unites needs no more comparison among itself, as it is one group already. Then
every pair of a bucket whose members are still in different groups is compared, in
blocks of BLOCK members by as many, so that no bucket is one task's work. So the groups
are those of all verified candidate pairs, while a bucket of n copies costs n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, written
from tessera.llm.words import U, Words, mix, pieces, salts, shingles, tokens

SHINGLE = 3
BANDS, ROWS = 48, 4
THRESHOLD = 0.5
#: Members of a bucket that meet as many others in one join key.
BLOCK = 256


def sketch(s: np.ndarray, row: np.ndarray, rows: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Fast similarity sketches (rows x t) of the elements ``s``; second, which rows have any."""
    full = np.iinfo(U).max
    out = np.full(rows * t, full, U)
    some = np.bincount(row, minlength=rows) > 0
    seed = salts(2 * t, 101)
    for i in range(2 * t):
        if len(s) == 0:
            break
        x = mix(s ^ seed[i])
        at = ((x >> U(44)) * U(t)) >> U(20) if i < t else np.full(len(s), i - t, U)
        np.minimum.at(out, row * t + at.astype(np.int64), (U(i) << U(44)) | (x & U((1 << 44) - 1)))
        lacking = (out.reshape(rows, t) == full).any(axis=1)[row]
        if not lacking.all():
            s, row = s[lacking], row[lacking]
    return out.reshape(rows, t), some


def fingerprints(w: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's whole sequence of tokens; of all its signs but outer blanks if it has no token."""
    first = w.firsts()
    place = np.arange(len(w.hash)) - first[w.row] if len(w.hash) else np.zeros(0, np.int64)
    out = []
    with np.errstate(over="ignore"):
        for seed in (201, 202):
            part = mix(w.hash ^ mix(place.astype(U) * U(0x9E3779B97F4A7C15) + U(seed)))
            total = np.concatenate((np.zeros(1, U), np.cumsum(part, dtype=U)))
            out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    for r in np.flatnonzero(first[1:] == first[:-1]).tolist():
        raw = blake2b((texts[r].as_py() or "").strip().encode(), digest_size=16).digest()
        out[0][r], out[1][r] = np.frombuffer(raw, np.int64)
    return out[0], out[1]


def _band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        part = mix(sk).reshape(len(sk), bands, rows) * salts(rows, 301)
        return mix(part.sum(axis=2, dtype=U) ^ salts(bands, 302)).view(np.int64)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "t"):
                w = tokens(b.column("t"))
                s, r = shingles(w, k)
                sk, some = sketch(s, r, b.num_rows, bands * rows)
                keys = _band_keys(sk, bands, rows)[some]
                a, z = fingerprints(w, b.column("t"))
                offs = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("n"), b.column("d"), pa.array(a), pa.array(z), lists], ["n", "d", "a", "z", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "t"):
                s, r = shingles(tokens(b.column("t")), k)
                parts = np.split(s, np.cumsum(np.bincount(r, minlength=b.num_rows))[:-1])
                parts = [np.unique(p).view(np.int64) for p in parts]
                offs = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([b.column("n"), lists], ["n", "s"])

    return run


def node_id(id_col: str, text_col: str):
    """What tells rows apart: id and text. Rows that agree in both are one node."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def components(edges: DataFrame) -> DataFrame:
    """(n, c): each node of ``edges`` (u, v) with the least node that it is joined to.

    Every round takes the least label among a node's neighbours and then the label of
    that label, so the rounds needed grow with the logarithm of a chain's length."""
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("n", "v"), "v").select(F.col("u").alias("n"), "c", F.lit(None).cast("long").alias("old"))
        step = near.union(labels.select("n", "c", F.col("c").alias("old"))).groupBy("n").agg(F.min("c").alias("m"), F.max("old").alias("old"))
        up = labels.select(F.col("n").alias("m"), F.col("c").alias("p"))
        now = written(step.join(up, "m").select("n", F.least("m", "p").alias("c"), "old"), "labels")
        labels = now.select("n", "c")
        if now.filter("c <> old").isEmpty():
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity."""
    left = sets.select(F.col("n").alias("u"), F.col("s").alias("su"))
    right = sets.select(F.col("n").alias("v"), F.col("s").alias("sv"))
    # |A & B| / |A | B| >= t needs min(|A|, |B|) >= t * max(|A|, |B|): sizes alone rule out many pairs.
    both = pairs.join(left, "u").join(right, "v")
    small, large = F.least(F.size("su"), F.size("sv")), F.greatest(F.size("su"), F.size("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - common
    return both.filter(small >= threshold * large).filter(common >= threshold * union).select("u", "v")


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(n, d, links, head_n, head): every node of a group of near duplicates, the verified
    links of its text to others, and the group's head: its least id, among equal ids the least node."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), node_id(id_col, text_col).alias("n")).filter("t is not null")
    sk = written(slim.mapInArrow(_sketches(shingle, bands, rows), f"n long, d {kind}, a long, z long, bands array<long>"), "sketches")
    # One node stands for all of its sequence of words.
    reps = sk.groupBy("a", "z").agg(F.min(F.struct("n", "bands")).alias("r"), F.max("n").alias("last"))
    reps = written(reps.select("a", "z", F.col("r.n").alias("rep"), F.col("r.bands").alias("bands"), (F.col("last") > F.col("r.n")).alias("several")), "reps")

    key = reps.select(F.explode("bands").alias("b"), "rep")
    least = F.expr("min(rep) over (partition by b)")
    most = F.expr("max(rep) over (partition by b)")
    buckets = written(key.select("b", "rep", least.alias("least"), most.alias("most")).filter("least <> most").select("b", "rep", "least"), "buckets")
    inside = buckets.select(F.col("rep").alias("n")).distinct()
    sets = written(slim.join(inside, "n", "left_semi").dropDuplicates(["n"]).select("n", "t").mapInArrow(_sets(shingle), "n long, s array<long>"), "sets")

    stars = buckets.filter("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct()
    first = written(_verified(stars, sets, threshold), "first")
    part = components(first)
    held = written(buckets.join(part.withColumnRenamed("n", "rep"), "rep", "left").select("b", "rep", "least", F.coalesce("c", "rep").alias("c")), "held")
    open_ = held.groupBy("b").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("c0 <> c1")
    open_ = open_.select("b", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    placed = held.join(open_, "b").filter("rep <> least").withColumn("at", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("k")).cast("int"))
    one = placed.select("b", F.col("rep").alias("u"), F.col("c").alias("cu"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("k") - 1)).alias("j"))
    two = placed.select("b", F.col("rep").alias("v"), F.col("c").alias("cv"), F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"))
    cross = one.join(two, ["b", "i", "j"]).filter("cu <> cv and (i < j or u < v)").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    # A pair may have been compared in another bucket before.
    links = written(first.union(_verified(cross, sets, threshold)).distinct(), "links")

    part = components(links).withColumnRenamed("n", "rep")
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    members = sk.select("n", "d", "a", "z").distinct().join(reps.select("a", "z", "rep", "several"), ["a", "z"]).join(part, "rep", "left").join(degree, "rep", "left")
    members = members.filter("several or c is not null").select("n", "d", F.coalesce("c", "rep").alias("c"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    members = written(members, "members")
    order = F.struct(F.col("d").isNull().alias("none"), "d", "n")
    heads = members.groupBy("c").agg(F.min(order).alias("h")).select("c", F.col("h.d").alias("head"), F.col("h.n").alias("head_n"))
    return members.join(heads, "c").select("n", "d", "links", "head_n", "head")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, group_id, n_links): one row for each document of every group of two or more
    near duplicates; group_id is the group's least doc_id, which is the document that
    stays. n_links counts the verified links of its text to different texts: those that
    hold the group together, as what is united already isn't compared again. It is 0
    where the group is one text and its copies.

    * Texts that differ only in case, punctuation or spacing are copies. Case is that of
      letters whose two forms have as many bytes.
    * A null text is in no group. Texts without any word are copies if all their signs
      but outer blanks agree.
    * Texts of fewer than three words are duplicates if all their words agree.
    * A null id comes after all others; a group of null ids only has a null group_id.
    * Repeated rows (same id, same text) are one member, and no group by themselves;
      one id with several texts is a member for each of them.
    * A text of any length counts as a whole. Other columns are not read. An empty table
      gives no rows.
    """
    return groups(docs, id_col, text_col, **params).select(F.col("d").alias("doc_id"), F.col("head").alias("group_id"), F.col("links").alias("n_links"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one row of each group of near duplicates (see ``near_duplicates``).

    All columns stay as they are. Rows with a null text all stay, repeated ones too;
    of repeated rows with a text one stays."""
    n, k = fresh(docs, "node"), fresh(docs, "place")
    gone = groups(docs, id_col, text_col, **params).filter("n <> head_n").select(F.col("n").alias(n))
    # Rows without a text are told apart by their place; of repeated rows all but one go before rows move.
    node = F.when(F.col(text_col).isNull(), -F.monotonically_increasing_id() - 1).otherwise(node_id(id_col, text_col))
    one = docs.withColumn(n, node).withColumn(k, F.expr(f"row_number() over (partition by `{n}` order by `{n}`)")).filter(F.col(k) == 1)
    return one.join(gone, n, "left_anti").drop(n, k)
