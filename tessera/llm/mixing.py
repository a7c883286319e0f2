"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a shuffled order (by a hash of the id). A document's
virtual finish time is the cumulative tokens of its source, itself included, divided
by the source's weight. Sorted by finish time, every prefix holds tokens of each
source in proportion to its weight for as long as its documents last. The mix is the
longest such prefix within the budget.

The sums are taken in two levels, so that no source and no range of the order is
one task's work: totals per virtual bucket, a running sum over the buckets' totals
(a small table of fixed size), and running sums within buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, written

#: Shares of a mix: one weight for each named source, DEFAULT_WEIGHT for any other.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}
DEFAULT_WEIGHT = 1.0
#: The part of all tokens that the mix may hold.
BUDGET_SHARE = 0.8
#: Hex digits of the shuffle hash that name a bucket within a source.
DIGITS = 3
#: Ranges of the finish time, of which only the one that the budget ends in is sorted exactly.
RANGES = 4096
#: Rows of a range that are sorted exactly in one task.
SORTED = 100_000


def token_count(text_col: str) -> Column:
    """Words as separated by single blanks: blanks, line ends and tabs, plus one; 0 for null and ''."""
    t = F.col(text_col)
    return F.coalesce(F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.translate(t, " \n\t", "")) + 1), F.lit(0)).cast("long")


def weight_of(source: Column, weights: dict[str, float], default: float) -> Column:
    w = F.lit(float(default))
    for k, v in weights.items():
        w = F.when(source == k, F.lit(float(v))).otherwise(w)
    return w


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(d, s, n, h, x): id, source, tokens, shuffle hash, and a hash to order equal ids by."""
    return docs.select(
        F.col(id_col).alias("d"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
        token_count(text_col).alias("n"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"),
        F.xxhash64(F.col(text_col)).alias("x"),
    )


def _sum_before(part: list[str], order: list[str]):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def finish_times(docs: DataFrame, weights: dict[str, float], default: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(d, s, n, h, x, f): keys and the finish time of every row. Rows that agree in
    all keys share the finish time of the last of them."""
    rows = _keys(docs, id_col, text_col, source_col).withColumn("b", F.substring("h", 1, DIGITS))
    rows = written(rows, "mix-keys")
    totals = rows.groupBy("s", "b").agg(F.sum("n").alias("t"))
    before = totals.select("s", "b", F.coalesce(F.sum("t").over(_sum_before(["s"], ["b"])), F.lit(0)).alias("o"))
    within = F.sum("n").over(Window.partitionBy("s", "b").orderBy("h", "d", "n", "x"))
    summed = rows.withColumn("c", within).join(before, ["s", "b"])
    return summed.select("d", "s", "n", "h", "x", ((F.col("c") + F.col("o")).cast("double") / weight_of(F.col("s"), weights, default)).alias("f"))


def _admitted(times: DataFrame, share: float | None, budget: int | None) -> DataFrame:
    """The rows of ``times`` (already written) within the budget, with their finish times."""
    top, total = times.agg(F.max("f"), F.sum("n")).first()
    if top is None:
        return times
    limit = int(budget) if budget is not None else int(total * share)
    # Ranges are parted again until the one that the limit falls into is small, or one finish
    # time: of that, each source has one document with tokens, and rows alike in all keys.
    low, high, room, cut = 0.0, float(top), limit, times
    while True:
        width = (high - low) / RANGES
        if not width or low + width == low:
            break
        ranged = cut.withColumn("r", F.greatest(F.least(F.floor((F.col("f") - F.lit(low)) / F.lit(width)), F.lit(RANGES - 1)), F.lit(0)).cast("long"))
        # RANGES rows at most come to the driver.
        totals = sorted(tuple(r) for r in ranged.groupBy("r").agg(F.sum("n"), F.count("*"), F.min("f"), F.max("f")).collect())
        over = None
        for r, t, many, least, most in totals:
            if t > room:
                over = r, many, least, most
                break
            room -= t
        if over is None:
            return times
        r, many, low, high = over
        cut = times.filter((F.col("f") >= F.lit(low)) & (F.col("f") <= F.lit(high)))
        if many <= SORTED:
            break
    inside = cut.withColumn("c", F.sum("n").over(Window.orderBy("f", "s", "h", "d", "n", "x"))).filter(F.col("c") <= room)
    return times.filter(F.col("f") < F.lit(low)).unionByName(inside.drop("c"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = DEFAULT_WEIGHT,
    budget_share: float = BUDGET_SHARE,
    budget_tokens: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, n_tokens, finish_time) of the admitted documents, sorted by
    finish time over the whole table.

    * A null source is the source ''. A source without a weight has the default one.
    * A null or empty text has 0 tokens: it finishes with the document before it.
    * A null id is shuffled as ''. Equal ids are ordered by tokens and a hash of the
      text; rows that agree in these too finish together, and stay or go together.
    * Equal finish times are ordered by source and shuffle hash.
    * A very long text counts with all its tokens.
    * Other columns are not read. An empty table gives no rows.
    * Weights must be positive.
    """
    weights = WEIGHTS if weights is None else weights
    times = written(finish_times(docs, weights, default_weight, id_col, text_col, source_col), "mix-times")
    out = _admitted(times, budget_share, budget_tokens).orderBy("f", "s", "h", "d", "n", "x")
    return out.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("n").alias("n_tokens"), F.col("f").alias("finish_time"))


def take_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = DEFAULT_WEIGHT,
    budget_share: float = BUDGET_SHARE,
    budget_tokens: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` without the documents that ``mix`` leaves out; all columns stay.

    Within a source the admitted documents are the first ones of the shuffled order,
    so one key per source tells them: texts are not moved for the decision."""
    weights = WEIGHTS if weights is None else weights
    times = written(finish_times(docs, weights, default_weight, id_col, text_col, source_col), "mix-times")
    last = F.max(F.struct("h", "d", "n", "x"))
    cuts = _admitted(times, budget_share, budget_tokens).groupBy("s").agg(last.alias("cut"))
    s, c = fresh(docs, "source_key"), fresh(docs, "cut")
    cuts = written(cuts.select(F.col("s").alias(s), F.col("cut").alias(c)), "mix-cuts")
    key = F.struct(
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"), F.col(id_col).alias("d"), token_count(text_col).alias("n"), F.xxhash64(F.col(text_col)).alias("x")
    )
    marked = docs.withColumn(s, F.coalesce(F.col(source_col).cast("string"), F.lit(""))).join(cuts, s)
    return marked.filter(key <= F.col(c)).select(*[F.col(f"`{x}`") for x in docs.columns])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
    CASE WHEN text IS NULL OR length(text) = 0 THEN 0
      ELSE length(text) - length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), '')) + 1 END AS n_tokens,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
f AS (
  SELECT doc_id, source, n_tokens, h,
    CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id, n_tokens) AS DOUBLE)
      / CASE source {" ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE {DEFAULT_WEIGHT} END AS finish_time
  FROM d),
g AS (SELECT *, sum(n_tokens) OVER (ORDER BY finish_time, source, h, doc_id) AS c FROM f)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, finish_time FROM g
WHERE c <= (SELECT CAST(floor(CAST(sum(n_tokens) AS DOUBLE) * {BUDGET_SHARE}) AS BIGINT) FROM d)
"""
