"""Page operators: one parse per page in an Arrow function, only the outputs asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from tessera.functions import text as T
from tessera.functions import url as U
from tessera.functions.html import Node, parse
from tessera.functions.selectors import select
from tessera.operators.cleaning import Config, clean, config
from tessera.operators.markdown import headings_of

PHASE = "struct<name:string,enabled:boolean,elements_removed:int,details:map<string,int>>"
STATS = (
    f"struct<input_bytes:bigint,output_bytes:bigint,phases:array<{PHASE}>,elements_removed:map<string,int>,elements_kept:int,"
    "attributes_removed:int,selector_matches:map<string,int>,link_density_removals:int,short_text_removals:int,hidden_removals:int,empty_removals:int>"
)
METADATA = "struct<images:array<struct<id:string,url:string,alt:string>>,headings:array<struct<level:int,text:string,id:string>>,links_count:int>"
RESULT = f"struct<content:string,stats:{STATS},metadata:{METADATA},warnings:array<struct<phase:string,message:string,context:string>>>"
FETCHED = "struct<title:string,text:string,links:array<string>>"


#: Bytes of pages whose results are Python objects at once; what a page counts at least; nodes that are so.
PART, LEAST, NODES_HELD = 1 << 20, 1 << 9, 1 << 14


def parts(texts: pa.Array, limit: int = PART) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of about ``limit`` bytes. A batch has up to 64 MB of pages, and results as objects take many times that."""
    at = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += max(n, LEAST)
        if size >= limit:
            yield at, k + 1 - at
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts) - at


def _column(ddl: str, fn: Callable[..., object], *cols: Column) -> Column:
    """A row function of texts as an Arrow column of type ``ddl``; null where the first column is null."""
    kind = to_arrow_type(StructType.fromDDL(f"x {ddl}")["x"].dataType)

    @F.arrow_udf(ddl)
    def run(first: pa.Array, *rest: pa.Array) -> pa.Array:
        out = [pa.array([], kind)]
        for at, n in parts(first):
            others = [r.slice(at, n).to_pylist() for r in rest]
            out.append(pa.array([None if x is None else fn(x, *(o[k] for o in others)) for k, x in enumerate(first.slice(at, n).to_pylist())], kind))
        return pa.concat_arrays(out)

    # Else a filter that Spark infers or pushes below would parse the pages once more.
    return run.asNondeterministic()(*cols)


def clean_html(html: Column, c: str | Config = "default", **changes) -> Column:
    """The cleaned page as text of the configured output."""
    from dataclasses import replace

    c = replace(config(c), **changes)
    return _column("string", lambda h: clean(h, c).content, html)


def _as_dict(r) -> dict:
    s = r.stats
    return {
        "content": r.content,
        "stats": {
            "input_bytes": s.input_bytes,
            "output_bytes": s.output_bytes,
            "phases": [{"name": p.name, "enabled": p.enabled, "elements_removed": p.removed, "details": list(p.details.items())} for p in s.phases],
            "elements_removed": list(s.elements_removed.items()),
            "elements_kept": s.elements_kept,
            "attributes_removed": s.attributes_removed,
            "selector_matches": list(s.selector_matches.items()),
            "link_density_removals": s.link_density_removals,
            "short_text_removals": s.short_text_removals,
            "hidden_removals": s.hidden_removals,
            "empty_removals": s.empty_removals,
        },
        "metadata": None
        if r.metadata is None
        else {
            "images": [{"id": k, "url": u, "alt": a} for k, (u, a) in r.metadata.images.items()],
            "headings": [{"level": v, "text": t, "id": i} for v, t, i in r.metadata.headings],
            "links_count": r.metadata.links_count,
        },
        "warnings": [{"phase": p, "message": m, "context": x} for p, m, x in r.warnings],
    }


def clean_html_with_stats(html: Column, c: str | Config = "default", **changes) -> Column:
    """The cleaned page with statistics by phase, metadata and warnings."""
    from dataclasses import replace

    c = replace(config(c), **changes)
    return _column(RESULT, lambda h: _as_dict(clean(h, c)), html)


def clean_stats(html: Column, c: str | Config = "default", **changes) -> Column:
    """The statistics alone: the content stays where it is made."""
    from dataclasses import replace

    c = replace(config(c), **changes)
    return _column(STATS, lambda h: _as_dict(clean(h, c))["stats"], html)


def fetched(html: Column, url: Column) -> Column:
    """Title, text and links of a page as a fetcher gives them: scripts, styles, noscript,
    iframes and drawings left out; links absolute, repeated ones too."""

    def one(h: str, base: str | None) -> dict:
        doc = parse(h)
        title = doc.first("title")
        name = T.trim(title.text()) if title is not None else ""
        for n in [n for n in doc.elements() if n.tag in ("script", "style", "noscript", "iframe", "svg")]:
            n.detach()
        body = doc.first("body")
        links = []
        for a in doc.elements():
            href = a.attrs.get("href", "") if a.tag == "a" else ""
            if href and not href.startswith("#"):
                links.append(U.resolve(base or "", href) if U.parses(href) else href)
        return {"title": name, "text": " ".join(T.fields(body.text() if body is not None else "")), "links": links}

    return _column(FETCHED, one, html, url)


def page_links(doc: Node, base: str, selector: str = "a[href]", pattern: str | None = None) -> list[str]:
    """Absolute links of a page without fragments, each once, in order of appearance."""
    import re

    want, out = re.compile(pattern) if pattern else None, {}
    if not U.parses(base):
        return []
    for n in select(doc, selector or "a[href]"):
        href = n.attrs.get("href", "")
        if not href or href.startswith(("#", "javascript:")) or not U.parses(href):
            continue
        full = U.resolve(base, href).partition("#")[0]
        if want is None or want.search(full):
            out[full] = None
    return list(out)


def next_link(doc: Node, base: str, selector: str) -> str | None:
    """The absolute link of the first element that matches, if it has a usable one."""
    for n in select(doc, selector)[:1]:
        href = n.attrs.get("href", "")
        if href and not href.startswith(("#", "javascript:")) and U.parses(href) and U.parses(base):
            return U.resolve(base, href)
    return None


def selector_list(selectors: str) -> str:
    """Selectors on lines of their own as one list; lines that are empty are left out."""
    return ", ".join(x for x in (T.trim(line).rstrip(",") for line in selectors.split("\n")) if x)


def extract_links(html: Column, url: Column, selector: str = "a[href]", pattern: str | None = None) -> Column:
    """``page_links`` as an array column."""
    if pattern:
        U.checked_pattern(pattern)
    return _column("array<string>", lambda h, b: page_links(parse(h), b or "", selector, pattern), html, url)


def find_next_page(html: Column, url: Column, selector: str) -> Column:
    """``next_link`` as a column; null if there is none."""
    return _column("string", lambda h, b: next_link(parse(h), b or "", selector), html, url)


def headings(html: Column) -> Column:
    """Headings of a page: level, text and id, the empty ones left out."""
    return _column("array<struct<level:int,text:string,id:string>>", lambda h: [{"level": v, "text": t, "id": i} for v, t, i in headings_of(parse(h))], html)


ATTRIBUTES = ArrayType(StructType().add("k", "string").add("v", "string"))
NODE = StructType().add("pre", "integer").add("post", "integer").add("parent", "integer").add("depth", "integer").add("kind", "string").add("tag", "string").add("attrs", ATTRIBUTES).add("data", "string")


def node_rows(html: str) -> list[dict]:
    """The nodes of a page in document order. An element contains what lies between its
    ``pre`` and ``post``; the document itself is not a row, its children have parent -1."""
    doc, out = parse(html), []
    todo: list[tuple[Node, int, int, bool]] = [(n, -1, 0, False) for n in reversed(doc.children)]
    at: dict[int, int] = {}
    while todo:
        n, parent, depth, done = todo.pop()
        if done:
            out[at[id(n)]]["post"] = len(out)
            continue
        pre = len(out)
        at[id(n)] = pre
        kind = "element" if n.element else n.tag[1:]
        out.append({"pre": pre, "post": pre + 1, "parent": parent, "depth": depth, "kind": kind, "tag": n.tag if n.element else None, "attrs": [{"k": k, "v": v} for k, v in n.attrs.items()], "data": None if n.element else n.data})
        todo.append((n, parent, depth, True))
        todo.extend((c, pre, depth + 1, False) for c in reversed(n.children))
    return out


def node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of pages (page_id, html) in batches that end with a page, once they have ``NODES_HELD`` nodes."""
    kind = to_arrow_type(NODE)

    def batch(ids: pa.Array, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *pa.array(rows, kind).flatten()], ["page_id", *(f.name for f in kind)])

    for b in batches:
        ids, html = b.column(0), b.column(1)
        at, rows = [], []
        for start, n in parts(html):
            for k, h in enumerate(html.slice(start, n).to_pylist(), start):
                if h is not None:
                    new = node_rows(h)
                    at += [k] * len(new)
                    rows += new
                if len(rows) >= NODES_HELD:
                    yield batch(ids, at, rows)
                    at, rows = [], []
        yield batch(ids, at, rows)


def dom_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each node of each page: id, pre, post, parent, depth, kind, tag, attrs, data."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return p.mapInArrow(node_batches, StructType([StructField("page_id", p.schema["page_id"].dataType), *NODE]))


def challenge_class(title: Column, html: Column) -> Column:
    """What kind of challenge page a page is, '' if none. The rules are tried in order."""
    t, h = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(html, F.lit("")))
    anywhere = lambda c, *words: _any(c.contains(w) for w in words)
    return (
        F.when(anywhere(t, "just a moment", "attention required") | anywhere(h, "cf-challenge", "cf_chl_opt"), "cloudflare")
        .when(anywhere(h, "challenges.cloudflare.com/turnstile", "cf-turnstile"), "cloudflare-turnstile")
        .when(anywhere(h, "hcaptcha.com", "h-captcha"), "hcaptcha")
        .when(anywhere(h, "google.com/recaptcha", "g-recaptcha"), "recaptcha")
        .when(anywhere(t, "access denied", "blocked", "bot detection") | anywhere(h, "robot or human"), "anti-bot")
        .otherwise("")
    )


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def reduction_percent(before: Column, after: Column) -> Column:
    """By how much a page shrank, in percent; 0 for an empty page."""
    return F.when(before == 0, F.lit(0.0)).otherwise((before - after).cast("double") / before * 100)


def compare_presets(pages: DataFrame, presets: tuple[str, ...] = ("default", "minimal", "aggressive"), id_col: str = "page_id", html_col: str = "html", **changes) -> DataFrame:
    """For each page and preset: bytes in and out, elements removed, reduction."""
    each = F.array(*(F.struct(F.lit(p).alias("preset"), clean_stats(F.col(html_col), p, **changes).alias("s")) for p in presets))
    out = pages.select(F.col(id_col).alias("page_id"), each.alias("x")).select("page_id", F.explode("x").alias("x")).select("page_id", "x.*")
    removed = F.aggregate(F.map_values("s.elements_removed"), F.lit(0), lambda a, x: a + x)
    return out.select("page_id", "preset", F.col("s.input_bytes").alias("input_bytes"), F.col("s.output_bytes").alias("output_bytes"), removed.alias("removed"), reduction_percent(F.col("s.input_bytes"), F.col("s.output_bytes")).alias("reduction_pct"))


def top_details(details: Column, n: int = 5) -> Column:
    """The n largest counts of a map, equal ones by key."""
    order = lambda a, b: (
        F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return F.slice(F.array_sort(F.map_entries(details), order), 1, n)


def enough_content(content: Column, least: int = 200) -> Column:
    """Whether cleaned content has ``least`` bytes; too short pages are neither extracted nor followed."""
    return F.coalesce(F.octet_length(content), F.lit(0)) >= least
