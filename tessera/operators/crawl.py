"""The frontier as relations, and a crawl by levels.

A level is a DataFrame of URLs; expanding it is a join with the pages, an explode of
their links, and an anti-join with what was visited. Depth is the least level at which
a URL is met; within a level the order is that of the parents, then of the links on
the page. So results don't depend on timing or on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import url as U
from tessera.operators import pages as P
from tessera.session import written


@dataclass(frozen=True)
class CrawlConfig:
    follow_selector: str = ""
    follow_pattern: str = ""
    same_domain: bool = True
    max_depth: int = 1
    next_selector: str = ""
    max_pages: int = 0
    max_urls: int = 0
    extract_from_seeds: bool = False
    min_content: int = 200

    @property
    def follows(self) -> bool:
        return bool(self.follow_selector or self.follow_pattern)


def admit(found: DataFrame, visited: DataFrame, order: tuple[str, ...] = ("depth", "seq")) -> DataFrame:
    """(url, depth, seq) of ``found`` (url, depth, seq) that weren't met before: normalised,
    '' left out, of equal ones the first. ``seq`` may be of any type that can be ordered."""
    w = Window.partitionBy("url").orderBy(*order)
    new = found.withColumn("url", U.normalize(F.col("url"))).filter("url is not null and url <> ''")
    new = new.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return new.join(visited.select("url"), "url", "left_anti")


def levels(seeds: DataFrame, edges: DataFrame, max_depth: int = 1, same_domain: bool = True, max_urls: int = 0, numbered: bool = True) -> DataFrame:
    """(url, depth, seq): breadth first over ``edges`` (src, dst, pos) from ``seeds`` (url, seq).

    URLs of both tables are normalised once; each is given once, at its least depth. A
    URL's order is that of the path of places that leads to it, so rows are numbered at the
    end, or not at all: without ``numbered`` the result is (url, depth), and paths are kept
    only where ``max_urls`` needs them."""
    spark = edges.sparkSession
    ordered = numbered or bool(max_urls)
    e = edges.filter(U.leads_on(F.col("src"), F.col("dst"), same_domain))
    e = e.select(U.normalize(F.col("src")).alias("src"), U.normalize(F.col("dst")).alias("dst"), *([F.col("pos").cast("long").alias("pos")] if ordered else []))
    e = written(e, "edges")

    def first(found: DataFrame) -> DataFrame:
        # The least of arrays takes sorting by URL, before and after the shuffle.
        return found.groupBy("url").agg(F.min("path").alias("path")) if ordered else found.select("url").distinct()

    start = seeds.select(U.normalize(F.col("url")).alias("url"), F.array(F.col("seq").cast("long")).alias("path")).filter("url <> ''")
    now, held, taken = first(start), [], 0
    for depth in range(max_depth + 1):
        if depth:
            found = now.join(e, now["url"] == e["src"])
            found = found.select(F.col("dst").alias("url"), *([F.concat("path", F.array("pos")).alias("path")] if ordered else []))
            seen = held[0].select("url")
            for x in held[1:]:
                seen = seen.union(x.select("url"))
            now = first(found).join(seen, "url", "left_anti")
        if max_urls:
            now = now.orderBy("path", "url").limit(max_urls - taken)
        now = written(now, f"level-{depth}")
        many = now.count()
        if not many:
            break
        held.append(now)
        taken += many
        if max_urls and taken >= max_urls:
            break
    out = spark.createDataFrame([], "url string, path array<long>, depth int")
    for depth, x in enumerate(held):
        x = x.withColumn("depth", F.lit(depth))
        out = x if not depth else out.unionByName(x)
    if not numbered:
        return out.select("url", "depth")
    return _numbered(out.select("url", "depth", F.struct("depth", "path").alias("seq")), 0)[0]


def _numbered(level: DataFrame, before: int, limit: int = 0) -> tuple[DataFrame, int]:
    """A level's rows (url, depth, seq) numbered in their order after ``before`` others, up
    to number ``limit``, and how many they are.

    The rows are sorted by ranges and counted per partition, so no task sorts the
    level; only the partitions' counts come to the driver. They are written before, as
    ranges need a pass over them, and after, so that lineage ends."""
    spark = level.sparkSession
    rows = written(level, "found").repartitionByRange("seq", "url").sortWithinPartitions("seq", "url").withColumn("m", F.monotonically_increasing_id())
    rows = written(rows, "level")
    part = F.shiftrightunsigned("m", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], before
    for p in sorted(counts):
        starts.append((p, at - (p << 33) + 1))
        at += counts[p]
    # One row for each partition.
    shift = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "p long, shift long"))
    out = rows.withColumn("p", part).join(shift, "p").select("url", "depth", (F.col("m") + F.col("shift")).alias("seq"))
    if limit:
        out, at = out.filter(F.col("seq") <= limit), max(before, min(at, limit))
    return out, at - before


def page_edges(pages: DataFrame, selector: str = "a[href]", pattern: str | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, pos): the links of each page."""
    links = P.extract_links(F.col(html_col), F.col(url_col), P.selector_list(selector) or "a[href]", pattern or None)
    return pages.select(F.col(url_col).alias("src"), F.posexplode(links).alias("pos", "dst")).select("src", "dst", "pos")


def crawl(seeds: list[str], pages: DataFrame, config: CrawlConfig | None = None, clean: str = "default", on_queued: Callable[[int], None] | None = None) -> DataFrame:
    """(url, depth, seq, content, error, extract): the pages that a crawl of the snapshot
    ``pages`` (url, html) visits.

    Pages that aren't in the snapshot, and pages to be extracted whose cleaned content
    has fewer than ``min_content`` bytes, have an error and aren't followed. Follow
    links are admitted before a page's next link; that stays at depth 0 and is looked
    for at depth 0 only. ``max_pages`` bounds the visited pages of depth 0, ``max_urls``
    all visited ones. ``on_queued`` is told how many URLs were ever admitted."""
    c = config or CrawlConfig()
    spark = pages.sparkSession
    snap = pages.select(U.normalize(F.col("url")).alias("url"), F.col("url").alias("page_url"), "html")
    snap = snap.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("page_url"))).filter("k = 1").drop("k")
    first = spark.createDataFrame([(u, 0, k) for k, u in enumerate(seeds)], "url string, depth int, seq long")
    todo, admitted = _numbered(admit(first, first.select("url").limit(0)), 0)
    visited = todo.select("url")
    if on_queued:
        on_queued(admitted)
    out, taken, top_pages = None, 0, 0
    while True:
        depth0 = todo.filter("depth = 0")
        if c.max_pages:
            depth0 = depth0.orderBy("seq").limit(max(c.max_pages - top_pages, 0))
        now = depth0.unionByName(todo.filter("depth > 0"))
        if c.max_urls:
            now = now.orderBy("seq").limit(c.max_urls - taken)
        rows = now.join(snap, "url", "left")
        extract = F.lit(not c.follows) | (F.col("depth") > 0) | F.lit(c.extract_from_seeds)
        rows = rows.withColumn("extract", extract).withColumn("content", F.when(F.col("extract"), P.clean_html(F.col("html"), clean, output="markdown")))
        short = F.col("extract") & ~P.enough_content(F.col("content"), c.min_content)
        error = F.when(F.col("html").isNull(), F.lit("fetch error: not in the snapshot")).when(short, F.lit("insufficient content"))
        rows = written(rows.withColumn("error", error), "crawled")
        many = rows.count()
        if not many:
            break
        taken += many
        top_pages += rows.filter("depth = 0").count()
        done = rows.select("url", "depth", "seq", "content", "error", "extract")
        out = done if out is None else out.unionByName(done)
        if c.max_urls and taken >= c.max_urls:
            break
        open_ = rows.filter("error is null")
        found = None
        if c.follows and c.max_depth > 0:
            links = P.extract_links(F.col("html"), F.col("page_url"), P.selector_list(c.follow_selector) or "a[href]", c.follow_pattern or None)
            found = open_.filter(F.col("depth") < c.max_depth).select("url", "depth", "seq", F.posexplode(links).alias("pos", "dst"))
            if c.same_domain:
                found = found.filter(U.same_domain(F.col("url"), F.col("dst")))
            found = found.select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"), F.struct("seq", F.lit(0).alias("last"), "pos").alias("seq"))
        if c.next_selector:
            nxt = P.find_next_page(F.col("html"), F.col("page_url"), c.next_selector)
            more = open_.filter("depth = 0").select("seq", nxt.alias("url")).filter("url is not null")
            more = more.select("url", F.lit(0).alias("depth"), F.struct("seq", F.lit(1).alias("last"), F.lit(0).alias("pos")).alias("seq"))
            found = more if found is None else found.unionByName(more)
        if found is None:
            break
        # Of a URL that is met twice the first meeting counts, whatever its depth.
        todo, many = _numbered(admit(found, visited, ("seq",)), admitted)
        if not many:
            break
        admitted += many
        visited = visited.union(todo.select("url"))
        if on_queued:
            on_queued(admitted)
    return out if out is not None else spark.createDataFrame([], "url string, depth int, seq long, content string, error string, extract boolean")


def crawl_many(seeds: list[str], pages: DataFrame, **options) -> DataFrame:
    return crawl(seeds, pages, CrawlConfig(**options))
