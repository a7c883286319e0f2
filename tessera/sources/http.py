"""Pages by HTTP: a DataFrame of URLs in, a DataFrame of fetched pages out.

Fetching is a map over partitions, so the number of partitions is the concurrency, and
``delay`` is slept between the fetches of one partition. A failed fetch is a row with
an error. Tasks that are retried fetch again: write the result before using it twice.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "url string, html string, title string, text string, links array<string>, status int, content_type string, fetched_at timestamp, error string"


@dataclass(frozen=True)
class FetchOptions:
    user_agent: str = "Mozilla/5.0 (compatible; tessera)"
    timeout: float = 30.0
    headers: dict[str, str] = field(default_factory=dict)
    cookies: dict[str, str] = field(default_factory=dict)
    delay: float = 0.0


def fetch(url: str, o: FetchOptions) -> dict:
    """One page: html, status and content type, or an error. Any status that the server answers with is a page."""
    head = {"User-Agent": o.user_agent, **o.headers}
    if o.cookies:
        head["Cookie"] = "; ".join(f"{k}={v}" for k, v in o.cookies.items())
    out = {"url": url, "html": None, "status": None, "content_type": None, "error": None, "fetched_at": datetime.now(timezone.utc).replace(tzinfo=None)}
    try:
        try:
            r = urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=o.timeout)
        except urllib.error.HTTPError as e:
            r = e
        with r:
            charset = r.headers.get_content_charset() or "utf-8"
            out |= {"html": r.read().decode(charset, "replace"), "status": r.status, "content_type": r.headers.get("Content-Type", "")}
    except (OSError, ValueError, LookupError) as e:
        out["error"] = f"fetch error: {e}"
    return out


def fetch_pages(urls: DataFrame, options: FetchOptions | None = None, url_col: str = "url") -> DataFrame:
    """The pages of ``urls``, with title, text and links; null URLs are left out."""
    from tessera.operators.pages import fetched

    o = options or FetchOptions()
    raw = "url string, html string, status int, content_type string, error string, fetched_at timestamp"
    names = ("url", "html", "status", "content_type", "error", "fetched_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us", tz="UTC"))
        first = True
        for b in batches:
            for url in b.column(0).to_pylist():
                if not first and o.delay:
                    time.sleep(o.delay)
                first = False
                row = fetch(url, o)
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds, strict=True)], list(names))

    got = urls.select(F.col(url_col).alias("url")).filter("url is not null").mapInArrow(run, raw)
    page = got.withColumn("p", fetched(F.col("html"), F.col("url")))
    return page.select("url", "html", "p.title", "p.text", "p.links", "status", "content_type", "fetched_at", "error")
