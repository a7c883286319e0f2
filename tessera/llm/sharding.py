"""Sharding over fixed virtual slots.

Every record hashes to one of SLOTS slots, for ever. Bytes are added up per slot, and
a versioned table maps slots to shards. The first version cuts the slots, in order,
into ranges of about equal bytes. ``rebalance`` writes a next version that moves as
few slots as needed; no record's slot changes, so only the moved slots' data moves.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.llm.shared import fresh, shared_dir

SLOTS = 4096
SHARDS = 64
#: A shard may hold this many times the mean before slots leave it.
SLACK = 1.05


def slot_of(id_col: str) -> Column:
    """The first three hex digits of the id's MD5; a null id hashes as ''."""
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, bytes) for all SLOTS slots, empty ones too; a null text has no bytes."""
    spark = docs.sparkSession
    got = docs.select(slot_of(id_col).alias("slot"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("b"))
    got = got.groupBy("slot").agg(F.sum("b").alias("b"))
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return every.join(got, "slot", "left").select("slot", F.coalesce("b", F.lit(0)).alias("bytes"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(slot, shard, bytes): a slot goes where the middle of its bytes lies on the
    whole; without any bytes, slots are spread evenly."""
    upto = F.sum("bytes").over(Window.orderBy("slot"))
    total = F.sum("bytes").over(Window.partitionBy())
    middle = (2 * F.col("upto") - F.col("bytes")) * shards
    shard = F.when(F.col("total") > 0, F.least(F.floor(middle / (2 * F.col("total"))), F.lit(shards - 1))).otherwise(F.floor(F.col("slot") * shards / F.lit(SLOTS)))
    return sizes.withColumn("upto", upto).withColumn("total", total).select("slot", shard.cast("int").alias("shard"), "bytes")


class SlotMap:
    """The versions of a slot-to-shard map: one folder per version under ``path``.

    A version is written once and never changed, so readers of an older one are safe."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        import uuid

        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def write(self, rows: DataFrame, version: int) -> None:
        rows.select("slot", "shard", "bytes").coalesce(1).write.mode("errorifexists").parquet(self._at(version))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int, bytes long").parquet(self._at(version)).withColumn("version", F.lit(version))

    def latest(self) -> int:
        """The last version, 0 if there is none."""
        v = 0
        while True:
            try:
                self.spark.read.parquet(self._at(v + 1))
            except AnalysisException:
                return v
            v += 1

    def balanced(self, sizes: DataFrame, version: int, shards: int, slack: float = SLACK) -> bool:
        """Whether a version has so many shards, and all are within ``slack`` or have only one slot with bytes."""
        load = sizes.join(self.read(version).select("slot", "shard"), "slot").groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.when(F.col("bytes") > 0, 1)).alias("n")).collect()
        limit = slack * sum(r["b"] for r in load) / shards
        return {r["shard"] for r in load} == set(range(shards)) and all(r["b"] <= limit or r["n"] <= 1 for r in load)

    def rebalance(self, sizes: DataFrame, shards: int, slack: float = SLACK) -> int:
        """Write the next version for new sizes or another number of shards, and return
        its number. Slots of shards that are gone, and the largest slots that fit of
        shards above ``slack`` times the mean, go to the least loaded shard; all
        other slots stay. It is SLOTS rows of work, whatever the data's size."""
        version = self.latest()
        old = {r["slot"]: r["shard"] for r in self.read(version).collect()}
        size = {r["slot"]: r["bytes"] for r in sizes.collect()}
        load, of = [0] * shards, {}
        homeless = []
        for slot in range(SLOTS):
            if old.get(slot, shards) < shards:
                of[slot] = old[slot]
                load[old[slot]] += size.get(slot, 0)
            else:
                homeless.append(slot)
        limit = slack * sum(size.values()) / shards
        for slot in sorted(homeless, key=lambda s: (-size.get(s, 0), s)):
            to = min(range(shards), key=lambda k: (load[k], k))
            of[slot] = to
            load[to] += size.get(slot, 0)
        for shard in sorted(range(shards), key=lambda k: -load[k]):
            for slot in sorted((s for s, k in of.items() if k == shard), key=lambda s: (-size.get(s, 0), s)):
                if load[shard] <= limit:
                    break
                to = min(range(shards), key=lambda k: (load[k], k))
                if load[to] + size.get(slot, 0) < load[shard]:
                    of[slot] = to
                    load[to] += size.get(slot, 0)
                    load[shard] -= size.get(slot, 0)
        # A shard without slots gets the smallest one of the shard that has most.
        for shard in range(shards):
            if shard not in of.values():
                many = Counter(of.values()).most_common(1)[0][0]
                of[min((s for s, k in of.items() if k == many), key=lambda s: (size.get(s, 0), s))] = shard
        rows = self.spark.createDataFrame([(s, of[s], size.get(s, 0)) for s in range(SLOTS)], "slot int, shard int, bytes long")
        self.write(rows, version + 1)
        return version + 1


def assign(docs: DataFrame, slots: SlotMap, version: int, id_col: str = "doc_id") -> DataFrame:
    """``docs`` and, after its columns, slot, shard and map_version. If ``docs`` has a
    column of such a name, the new one is called ``new_<name>`` (as often as needed)."""

    def free(name: str) -> str:
        while name.lower() in {c.lower() for c in docs.columns}:
            name = f"new_{name}"
        return name

    k = fresh(docs, "slot")
    names = {c: free(c) for c in ("slot", "shard", "map_version")}
    held = slots.read(version).select(F.col("slot").alias(k), F.col("shard").alias(names["shard"]), F.col("version").alias(names["map_version"]))
    # The map always has SLOTS rows, so the broadcast has a fixed size.
    out = docs.withColumn(k, slot_of(id_col)).join(F.broadcast(held), k)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(k).alias(names["slot"]), names["shard"], names["map_version"])


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its slot and shard.

    Without a path, or where it has no map yet, version 1 of a new map is written. A map
    that is there is kept: its latest version is used if it has as many shards and none
    holds more than SLACK times the mean (or one slot), else it is rebalanced, and the
    next version is used.

    * A null id has the slot of ''; equal ids and repeated rows share a slot.
    * A null or empty text has no bytes, and its row is assigned like any other.
    * An empty table writes a map of even ranges and gives no rows.
    * A very long text counts with all its bytes; a slot is never split.
    """
    slots, sizes = SlotMap(docs.sparkSession, path), slot_bytes(docs, id_col, text_col)
    version = slots.latest() if path else 0
    if not version:
        version = 1
        slots.write(first_map(sizes, shards), version)
    elif not slots.balanced(sizes, version, shards):
        version = slots.rebalance(sizes, shards)
    return assign(docs, slots, version, id_col)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3))::INTEGER AS slot,
    coalesce(strlen(text), 0) AS b FROM documents),
s AS (
  SELECT r.slot, coalesce(b, 0) AS b FROM (SELECT CAST(range AS INTEGER) AS slot FROM range({SLOTS})) r
  LEFT JOIN (SELECT slot, sum(b) AS b FROM d GROUP BY slot) USING (slot)),
m AS (
  SELECT slot, CAST(least(floor(CAST((2 * sum(b) OVER (ORDER BY slot) - b) * {SHARDS} AS DOUBLE) / (2 * sum(b) OVER ())), {SHARDS - 1}) AS INTEGER) AS shard
  FROM s)
SELECT doc_id, slot, shard, 1 AS map_version FROM d JOIN m USING (slot)
"""
