"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the unit vectors onto DIMS random orthogonal directions, shifts
them by a random offset, and orders them by the Hilbert key of their cells. A bounded
sample of keys (SAMPLE rows, more where there are more parts) splits each curve into
ranges of about PART_ROWS rows, by which Spark partitions the rows; only ids, keys and
vectors rounded to bytes travel with the curves. Within a range every query meets the
REACH rows on either side of its key, and those next to the border of the two
neighbouring ranges. REACH follows from the data: of PROBES sampled rows the true
neighbours are found by comparison with all rows, and it is large enough that TARGET of
these are within reach on some curve. The curves' candidates are merged, and the best by
the rounded vectors are ranked again by exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.shared import written

K = 10
#: Queries are the rows whose id is divisible by EVERY.
EVERY = 50
CURVES = 16
DIMS, BITS = 16, 3
#: Low bits of a key that spread rows of one cell, by a hash of their ids.
SPREAD = 15
PART_ROWS = 1 << 18
#: Parts of a curve at most; beyond that, they grow.
MAX_PARTS = 1 << 16
SAMPLE = 1 << 17
SEED = 20
#: Rows whose true neighbours are looked up, and the part of these that must be in reach.
PROBES = 256
TARGET = 0.92
#: Rows on either side that a query meets at least.
LEAST_REACH = 128
#: Candidates of a query that are ranked by exact similarity, as a multiple of k.
KEPT = 3
#: Rows, and elements, of a similarity matrix made at once.
CHUNK = 1024
ELEMENTS = 1 << 22


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (rows of ``cells``), by Skilling's transposition."""
    x = cells.astype(np.uint32).T.copy()
    m = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(m):
            on = (x[i] & np.uint32(q)) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[m - 1] & np.uint32(q)) > 0, t ^ np.uint32(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return key


def curve_keys(unit: np.ndarray, ids: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors on one curve. Projections of a unit vector have a spread of
    about 1 / sqrt(length); cells cover four spreads either way and the shift. Below the
    Hilbert key are SPREAD bits of a hash of the id, so that no cell is too large to split."""
    rng = np.random.default_rng([seed, curve])
    d = unit.shape[1]
    m = min(dims, d)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :m]
    shift = rng.uniform(0, 1, m)
    y = np.clip((unit @ turn * np.sqrt(d) + 4 + shift) / 9, 0, 1 - 1e-9)
    with np.errstate(over="ignore"):
        low = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SPREAD)
    return (hilbert_keys(y * (1 << bits), bits) << SPREAD) | low.astype(np.int64)


def matrix(col: pa.Array) -> np.ndarray:
    """A list column whose lists have one length as a matrix of doubles."""
    if len(col) == 0:
        return np.zeros((0, 1))
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def units(col: pa.Array) -> np.ndarray:
    """The vectors of a list column at unit length, in doubles."""
    m = matrix(col)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best(ids: np.ndarray, rows: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of rows: ids, the k best others of another place, and exact similarities."""
    a, b = rows.astype(np.float32), others.astype(np.float32)
    chunk = max(1, min(CHUNK, ELEMENTS // max(1, len(b))))
    for i in range(0, len(a), chunk):
        sim = a[i : i + chunk] @ b.T
        sim[ids[i : i + chunk, None] == other_ids[None, :]] = -np.inf
        # Whatever may be among the k best by exact similarity, however many that is; 1e-5 is
        # more than float32 can be wrong by at these lengths.
        take = min(k, len(b))
        least = np.partition(sim, len(b) - take, axis=1)[:, len(b) - take] - np.float32(max(1e-5, 2e-7 * a.shape[1]))
        at, near = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
        exact = np.concatenate([np.zeros(0)] + [(rows[i + at[c : c + 65_536]] * others[near[c : c + 65_536]]).sum(axis=1) for c in range(0, len(at), 65_536)])
        exact = np.minimum(exact, 1.0)
        order = np.lexsort((other_ids[near], -exact, at))
        at, near, exact = at[order], near[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        ok = place < k
        found_ids = np.zeros((len(sim), k), np.int64)
        found = np.full((len(sim), k), -np.inf)
        found_ids[at[ok], place[ok]], found[at[ok], place[ok]] = other_ids[near[ok]], exact[ok]
        yield ids[i : i + chunk], found_ids, found


def in_windows(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray, at: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, reach: int, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, rough similarities) for queries with the keys ``at`` among rows
    sorted by key: the ``keep`` best of the rows within reach. Queries next to one another
    share a matrix product, so some rows a little beyond are met as well."""
    pos = np.searchsorted(keys, at)
    order = np.argsort(pos, kind="stable")
    i = 0
    while i < len(order):
        first = pos[order[i]]
        lo = max(0, first - reach)
        j = int(np.searchsorted(pos[order], first + max(1, reach // 2), "right"))
        j = max(i + 1, min(j, i + max(1, ELEMENTS // (3 * reach + 1))))
        q = order[i:j]
        hi = min(len(keys), pos[q[-1]] + reach)
        i = j
        if hi <= lo:
            continue
        block = codes[lo:hi].astype(np.float32)
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-30)
        sim = queries[q] @ block.T
        sim[query_ids[q][:, None] == ids[None, lo:hi]] = -np.inf
        n = min(keep, hi - lo)
        top = np.argpartition(sim, hi - lo - n, axis=1)[:, hi - lo - n :]
        for r, x in enumerate(q.tolist()):
            s = sim[r, top[r]]
            ok = s > -np.inf
            yield int(query_ids[x]), ids[lo + top[r][ok]], s[ok]


def id_key(df: DataFrame, id_col: str) -> Column:
    """Integer ids as longs, all others by a hash."""
    kind = df.schema[id_col].dataType
    c = F.col(id_col)
    return c.cast("long") if isinstance(kind, IntegralType) else F.when(c.isNotNull(), F.xxhash64(c.cast("string")))


def comparable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(d, h, v): id, hash of the vector, vector of the rows that can be compared."""
    v = F.col(vec_col)
    length = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(id_key(vectors, id_col).alias("d"), v.alias("v"), length.alias("l"))
    rows = rows.filter("d is not null and l > 0 and l < double('Infinity')")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (sizes["n"] if sizes else 0)).select("d", F.xxhash64("v").alias("h"), "v")


class Curves:
    """What rows need to find their places: the projections' parameters, and each curve's borders."""

    def __init__(self, curves: int, dims: int, bits: int, borders: list[np.ndarray]):
        self.curves, self.dims, self.bits, self.borders = curves, dims, bits, borders
        self.parts = len(borders[0]) + 1 if borders else 1

    def keys(self, unit: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        for c in range(self.curves):
            yield curve_keys(unit, ids, c, self.dims, self.bits)


def sampled_keys(rows: DataFrame, n: int, want: int, curves: Curves) -> np.ndarray:
    """Sorted keys of about ``want`` of the ``n`` rows, by a hash of their ids; one row for each curve."""
    share = min(1.0, want / max(1, n))
    part = rows.filter(F.pmod(F.xxhash64("d", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = list(curves.keys(units(b.column("v")), b.column("d").to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(range(len(keys)), pa.int32())], ["k", "c"])

    got: list[list[np.ndarray]] = [[] for _ in range(curves.curves)]
    for r in part.mapInArrow(run, "k binary, c int").toArrow().to_pylist():
        got[r["c"]].append(np.frombuffer(r["k"], np.int64))
    return np.stack([np.sort(np.concatenate(x)) for x in got]) if got[0] else np.zeros((curves.curves, 0), np.int64)


def needed_reach(rows: DataFrame, n: int, keys: np.ndarray, curves: Curves, k: int, probes: int = PROBES, target: float = TARGET) -> int:
    """How many rows on either side bring ``target`` of the true neighbours of a sample of
    ``rows`` in reach. Distances along a curve are counted in sampled ``keys``."""
    sample = rows.select("d", "v").orderBy(F.xxhash64("d", F.lit(SEED + 1)), "d").limit(probes).toArrow()
    if not keys.shape[1] or sample.num_rows < 2:
        return 1
    ids, unit = sample.column("d").to_numpy(), units(sample.column("v").combine_chunks())
    held = rows.sparkSession.sparkContext.broadcast((ids, unit))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, v = held.value
        found_s, found_j = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                got = list(best(q, v, units(part.column("v")), part.column("d").to_numpy(), k))
                found_s = np.hstack((found_s, np.concatenate([s for _, _, s in got])))
                found_j = np.hstack((found_j, np.concatenate([j for _, j, _ in got])))
                top = np.argsort(-found_s, axis=1, kind="stable")[:, :k]
                found_s, found_j = np.take_along_axis(found_s, top, 1), np.take_along_axis(found_j, top, 1)
        ok = found_s > -np.inf
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, ok.sum(axis=1))), pa.array(found_j[ok]), pa.array(found_s[ok])], ["q", "d", "s"])

    found = rows.select("d", "v").mapInArrow(near, "q long, d long, s double").withColumn("n", F.expr("row_number() over (partition by q order by s desc, d)")).filter(F.col("n") <= k)
    true = found.select("q", "d").toArrow()
    # PROBES times k ids at most.
    some = rows.sparkSession.createDataFrame(pa.table({"d": pa.array(sorted(set(true.column("d").to_pylist())), pa.int64())}))
    others = rows.select("d", "v").join(F.broadcast(some), "d").toArrow()
    other_ids, other_unit = others.column("d").to_numpy(), units(others.column("v").combine_chunks())
    at = {int(d): i for i, d in enumerate(other_ids)}
    mine = {int(d): i for i, d in enumerate(ids)}
    a = np.array([mine[q] for q in true.column("q").to_pylist()], np.int64)
    b = np.array([at[d] for d in true.column("d").to_pylist()], np.int64)
    apart = None
    for c, (ka, kb) in enumerate(zip(curves.keys(unit, ids), curves.keys(other_unit, other_ids), strict=True)):
        x = np.abs(np.searchsorted(keys[c], ka)[a] - np.searchsorted(keys[c], kb)[b])
        apart = x if apart is None else np.minimum(apart, x)
    x = np.sort(apart)
    # One more, as a place between two sampled keys is uncertain by that much.
    steps = int(x[min(len(x) - 1, ceil(target * len(x)))]) + 1
    return ceil(steps * n / keys.shape[1])


def rounded(unit: np.ndarray) -> np.ndarray:
    """Vectors as bytes, each by its own largest element."""
    return np.rint(unit * (127 / np.maximum(np.abs(unit).max(axis=1, keepdims=True), 1e-30))).astype(np.int8)


def candidates(rows: DataFrame, curves: Curves, reach: int, part_rows: int, keep: int) -> DataFrame:
    """(q, c): for every query (``ask``) the candidates of all curves, the ``keep`` best by the rounded vectors."""
    held = rows.sparkSession.sparkContext.broadcast(curves)
    # Ranges on either side that a query's reach may extend into.
    side = ceil(reach / part_rows) if curves.parts > 1 else 0

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cv = held.value
        for b in batches:
            if not b.num_rows:
                continue
            unit, ids = units(b.column("v")), b.column("d").to_numpy()
            code, asks = rounded(unit), np.flatnonzero(b.column("ask").to_numpy(zero_copy_only=False))
            exact = unit[asks].astype(np.float32)
            for c, keys in enumerate(cv.keys(unit, ids)):
                part = np.searchsorted(cv.borders[c], keys, "right")
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                out: list[tuple[int, int, bytes, bytes, bytes]] = []
                for x in np.split(order, cuts):
                    out.append((c * cv.parts + int(part[x[0]]), 0, keys[x].tobytes(), ids[x].tobytes(), code[x].tobytes()))
                for j in range(-side, side + 1):
                    to = part[asks] + j
                    for p in np.unique(to[(to >= 0) & (to < cv.parts)]).tolist():
                        x = np.flatnonzero(to == p)
                        out.append((c * cv.parts + p, 1, keys[asks[x]].tobytes(), ids[asks[x]].tobytes(), exact[x].tobytes()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[2:])], ["slot", "ask", "k", "d", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes, bytes]]] = {0: [], 1: []}
        for b in batches:
            for ask, *x in zip(*(b.column(c).to_pylist() for c in ("ask", "k", "d", "v")), strict=True):
                got[ask].append(tuple(x))
        if not got[0] or not got[1]:
            return
        keys, ids = (np.frombuffer(b"".join(x[n] for x in got[0]), np.int64) for n in (0, 1))
        code = np.frombuffer(b"".join(x[2] for x in got[0]), np.int8).reshape(len(ids), -1)
        at, asked = (np.frombuffer(b"".join(x[n] for x in got[1]), np.int64) for n in (0, 1))
        exact = np.frombuffer(b"".join(x[2] for x in got[1]), np.float32).reshape(len(asked), -1)
        order = np.lexsort((ids, keys))
        held_q, held_n, held_s = [], [], []
        for q, near, s in in_windows(keys[order], ids[order], code[order], at, asked, exact, reach, keep):
            held_q.append(q)
            held_n.append(near)
            held_s.append(s)
        if held_q:
            offs = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in held_n]))).astype(np.int32))
            found = pa.StructArray.from_arrays([pa.array(-np.concatenate(held_s).astype(np.float32)), pa.array(np.concatenate(held_n))], ["s", "j"])
            yield pa.RecordBatch.from_arrays([pa.array(held_q, pa.int64()), pa.ListArray.from_arrays(offs, found)], ["q", "near"])

    blobs = rows.select("d", "v", "ask").mapInArrow(placed, "slot int, ask int, k binary, d binary, v binary")
    near = blobs.groupBy("slot").applyInArrow(compared, "q long, near array<struct<s:float,j:long>>")
    # A rough similarity is that of two rows, whatever the curve, up to the order of additions.
    merged = near.select("q", F.explode("near").alias("x")).groupBy("q", F.col("x.j").alias("c")).agg(F.min("x.s").alias("s"))
    return merged.withColumn("n", F.expr("row_number() over (partition by q order by s, c)")).filter(F.col("n") <= keep).select("q", "c")


def cosine(a: str, b: str) -> Column:
    """Of two array columns, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.least(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), F.lit(1.0))


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    every: int = EVERY,
    curves: int = CURVES,
    dims: int = DIMS,
    bits: int = BITS,
    part_rows: int = PART_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): for every vector whose id is divisible by
    ``every``, its k nearest others of all by cosine, as far as the curves find them.

    * Vectors of another length than most, null or zero vectors, vectors with a null,
      NaN or infinite element, and rows with a null id are left out. (Of lengths that
      are equally frequent the larger counts.)
    * Repeated rows are one vector; of an id's several vectors that of the least hash is taken.
    * Equal similarities are ordered by id, and of equal vectors, however many, the
      least ids count. Fewer than k others give fewer rows.
    * Tables of up to LEAST_REACH rows are compared in full, so the result is then exact.
    * Ids that aren't integers are divided, and ordered, by a hash.
    * Other columns are not read. An empty table, or one vector, gives no rows.
    """
    rows = comparable(vectors, id_col, vec_col)
    # Ids and hashes tell repetitions; vectors move only if there are some.
    slim = rows.select("d", "h")
    several = slim.groupBy("d").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    n, repeated = several.agg(F.count("*"), F.max("n")).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"vec_id {vectors.schema[id_col].dataType.simpleString()}, neighbour_id {vectors.schema[id_col].dataType.simpleString()}, rank int, similarity double")
    if repeated > 1:
        rows = written(rows.join(several.select("d", "h"), ["d", "h"]).groupBy("d", "h").agg(F.first("v").alias("v")), "one-each")
        slim = rows.select("d", "h")
    asked = F.pmod("d", F.lit(every)) == 0
    # Equal vectors are searched once, by the least id, if any of their ids is a query.
    shared = slim.groupBy("h").agg(F.count("*").alias("m"), F.min("d").alias("rep"), F.max(asked).alias("any"))
    shared = written(shared.filter("m > 1").select("h", "rep", "any", "m"), "shared")
    many = shared.agg(F.sum(F.col("m") - 1)).first()[0] or 0
    reps = rows.select("d", "v", asked.alias("ask"))
    if many:
        reps = rows.join(shared, "h", "left").filter("rep is null or rep = d").select("d", "v", F.coalesce("any", asked).alias("ask"))
        reps = written(reps, "reps")
    n -= many
    # With the borders comes the sample that measures distances along the curves.
    space = Curves(curves, dims, bits, [])
    parts = min(MAX_PARTS, ceil(n / part_rows))
    keys = sampled_keys(reps, n, max(sample, 32 * parts), space)
    space = Curves(curves, dims, bits, [x[np.arange(1, parts) * keys.shape[1] // parts] if keys.shape[1] else x for x in keys])
    reach = max(LEAST_REACH, needed_reach(reps, n, keys, space, k))
    found = candidates(reps, space, reach, ceil(n / parts), KEPT * k)
    one = reps.filter("ask").select(F.col("d").alias("q"), F.col("v").alias("a"))
    other = reps.select(F.col("d").alias("c"), F.col("v").alias("b"))
    near = found.join(one, "q").join(other, "c").select("q", F.col("c").alias("j"), cosine("a", "b").alias("s"))
    if many:
        # k + 1 ids of a vector are enough; the limit is taken in each task before rows move.
        few = slim.join(shared.select("h", "rep"), "h").withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("d"))).filter(F.col("n") <= k + 1).select("rep", F.col("d").alias("i"))
        near = near.join(few, near["j"] == few["rep"], "left").select("q", F.coalesce("i", "j").alias("j"), "s")
        near = near.unionByName(few.select(F.col("rep").alias("q"), F.col("i").alias("j"), F.lit(1.0).alias("s")))
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "j"))).filter(F.col("n") <= k + 1).drop("n")
        asks = slim.filter(asked).join(shared.select("h", "rep"), "h", "left").select("d", F.coalesce("rep", "d").alias("q"))
        near = near.join(asks, "q").filter("j <> d").select(F.col("d").alias("q"), "j", "s")
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "j"))).filter(F.col("rank") <= k)
    if isinstance(vectors.schema[id_col].dataType, IntegralType):
        kind = vectors.schema[id_col].dataType
        return out.select(F.col("q").cast(kind).alias("vec_id"), F.col("j").cast(kind).alias("neighbour_id"), "rank", F.col("s").alias("similarity"))
    names = vectors.select(id_key(vectors, id_col).alias("d"), F.col(id_col).alias("name")).filter("d is not null").dropDuplicates(["d"])
    out = out.join(names.select(F.col("d").alias("q"), F.col("name").alias("vec_id")), "q").join(names.select(F.col("d").alias("j"), F.col("name").alias("neighbour_id")), "j")
    return out.select("vec_id", "neighbour_id", "rank", F.col("s").alias("similarity"))
