"""Command line: clean one page, compare presets on it, or crawl a snapshot of pages.

    python -m tessera clean [FILE|URL|-] [--preset P] [--output html|text|markdown] [--stats text|json]
    python -m tessera compare [FILE|URL|-]
    python -m tessera crawl --pages DIR --seed URL... [--follow S] [--next S] [--schema F --rules JSON]
                            [--format json|jsonl|yaml] [--out PATH] [--training PATH]
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from dataclasses import replace

from tessera.operators.cleaning import PRESETS, Config, clean

UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}


def parse_size(s: str) -> int:
    """Bytes of a size like 100KB."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*", s)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a size: {s}")
    return int(float(m[1]) * UNITS[m[2].lower()])


def read_input(source: str) -> str:
    """A file, a URL (answered with 200) or, for -, standard input; an empty one is an error."""
    if source.startswith(("http://", "https://")):
        from tessera.sources.http import FetchOptions, fetch

        page = fetch(source, FetchOptions())
        if page["error"] or page["status"] != 200:
            raise SystemExit(page["error"] or f"{source}: status {page['status']}")
        html = page["html"]
    elif source == "-":
        html = sys.stdin.read()
    else:
        with open(source, encoding="utf-8", errors="replace") as f:
            html = f.read()
    if not html:
        raise SystemExit("the input is empty")
    return html


def configured(a: argparse.Namespace) -> Config:
    c = PRESETS[a.preset]()
    return replace(c, output=a.output, remove=(*c.remove, *a.remove), keep=(*c.keep, *a.keep), frontmatter=a.frontmatter, resolve_urls=bool(a.base_url), base_url=a.base_url)


def do_clean(a: argparse.Namespace) -> None:
    r = clean(read_input(a.source), configured(a))
    print(r.content)
    if a.stats == "text":
        print(r.stats.summary(), file=sys.stderr)
    elif a.stats == "json":
        s = r.stats
        phases = [{"name": p.name, "enabled": p.enabled, "elements_removed": p.removed, "details": dict(p.details)} for p in s.phases]
        print(json.dumps({"source": a.source, "stats": {"input_bytes": s.input_bytes, "output_bytes": s.output_bytes, "elements_kept": s.elements_kept, "phases": phases}, "reduction_percent": s.reduction}), file=sys.stderr)


def do_compare(a: argparse.Namespace) -> None:
    html = read_input(a.source)
    for name in PRESETS:
        s = clean(html, replace(PRESETS[name](), output=a.output)).stats
        print(f"{name:12} {s.output_bytes:10d} bytes {s.total_removed:6d} removed {s.reduction:6.1f} %")


def do_crawl(a: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from tessera.operators import crawl, extract
    from tessera.session import local_session
    from tessera.sources import sinks, tables

    spark = local_session(name="tessera-crawl")
    c = crawl.CrawlConfig(a.follow, a.pattern, not a.any_domain, a.max_depth, a.next, a.max_pages, a.max_urls, a.extract_seeds, parse_size(a.min_content))
    rows = crawl.crawl(a.seed, tables.read_pages(spark, a.pages), c, a.preset)
    if not a.schema:
        out = rows.select("url", "depth", "content", "error")
    else:
        rules = extract.RuleExtractor(json.loads(a.rules))
        got = rows.filter("extract and error is null").join(tables.read_pages(spark, a.pages).select("url", "html"), "url")
        out = got.select("url", extract.extracted(F.col("html"), rules, tables.read_schema(a.schema)).alias("r")).select("url", "r.*")
        if a.training:
            sinks.write(sinks.training_pairs(out), a.training, "jsonl", mode="overwrite")
        out = out.select("url", "data", "error")
    sinks.write(out, a.out, a.format, mode="overwrite")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)
    for name, fn in (("clean", do_clean), ("compare", do_compare)):
        q = sub.add_parser(name)
        q.add_argument("source", nargs="?", default="-")
        q.add_argument("--output", choices=("html", "text", "markdown"), default="html")
        q.set_defaults(fn=fn)
        if name == "clean":
            q.add_argument("--preset", choices=sorted(PRESETS), default="default")
            q.add_argument("--remove", action="append", default=[], metavar="SELECTOR")
            q.add_argument("--keep", action="append", default=[], metavar="SELECTOR")
            q.add_argument("--frontmatter", action="store_true")
            q.add_argument("--base-url", default="")
            q.add_argument("--stats", choices=("text", "json"))
    q = sub.add_parser("crawl")
    q.set_defaults(fn=do_crawl)
    q.add_argument("--pages", required=True)
    q.add_argument("--seed", action="append", required=True)
    for o, d in (("--follow", ""), ("--pattern", ""), ("--next", ""), ("--preset", "default"), ("--min-content", "200B"), ("--schema", ""), ("--rules", "{}"), ("--training", ""), ("--out", "crawl.json")):
        q.add_argument(o, default=d)
    for o, d in (("--max-depth", 1), ("--max-pages", 0), ("--max-urls", 0)):
        q.add_argument(o, type=int, default=d)
    q.add_argument("--format", choices=("json", "jsonl", "yaml"), default="json")
    q.add_argument("--any-domain", action="store_true")
    q.add_argument("--extract-seeds", action="store_true")
    a = p.parse_args(args)
    a.fn(a)


if __name__ == "__main__":
    main()
