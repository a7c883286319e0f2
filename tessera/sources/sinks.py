"""Sinks: JSON, JSON lines, YAML, training pairs, the envelope with metadata, and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "jsonl", "yaml")


def json_column(df: DataFrame) -> Column:
    """Each row as JSON, nulls too; of ``_metadata`` only a null retry_count is left out."""
    row = lambda **new: F.to_json(F.struct(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns)), {"ignoreNullFields": "false"})
    kind = df.schema["_metadata"].dataType if "_metadata" in df.columns else None
    if kind is None or "retry_count" not in kind.fieldNames():
        return row()
    m = F.col("_metadata")
    return F.when(m["retry_count"].isNull(), row(_metadata=m.dropFields("retry_count"))).otherwise(row())


def _items(df: DataFrame) -> Iterator[Any]:
    """Rows as plain values, a partition at a time. JSON and YAML documents are one file, so made on the driver."""
    return (json.loads(r[0]) for r in df.select(json_column(df)).toLocalIterator())


def json_parts(items: Iterable[Any], pretty: bool = True, indent: int = 2) -> Iterator[str]:
    """One item bare, several as an array, none as [], in pieces as the items come."""
    dump = lambda x: json.dumps(x, indent=indent, ensure_ascii=False) if pretty else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    it, none = iter(items), object()
    one, two = next(it, none), next(it, none)
    if two is none:
        yield dump([] if one is none else one) + "\n"
        return
    pad, gap = (" " * indent, "\n") if pretty else ("", "")
    inner = lambda x: gap + "".join(pad + line for line in dump(x).splitlines(keepends=True)) if pretty else dump(x)
    yield "[" + inner(one)
    for x in chain([two], it):
        yield "," + inner(x)
    yield gap + "]\n"


def json_text(items: Iterable[Any], pretty: bool = True, indent: int = 2) -> str:
    return "".join(json_parts(items, pretty, indent))


def yaml_parts(items: Iterable[Any]) -> Iterator[str]:
    import yaml

    dump = lambda x: yaml.safe_dump(x, sort_keys=False, allow_unicode=True, indent=2)
    it, none = iter(items), object()
    one, two = next(it, none), next(it, none)
    if two is none:
        yield dump([] if one is none else one)
        return
    for x in chain([one, two], it):
        yield dump([x])


def yaml_text(items: Iterable[Any]) -> str:
    return "".join(yaml_parts(items))


def jsonl_column(df: DataFrame) -> Column:
    return json_column(df)


def write(df: DataFrame, path: str, form: str = "json", pretty: bool = True, indent: int = 2, mode: str = "errorifexists") -> None:
    """Write rows as ``form``: jsonl goes out in parallel as a folder of part files, json and yaml as one file."""
    if form == "jsonl":
        df.select(jsonl_column(df).alias("value")).write.mode(mode).text(path)
        return
    if form not in FORMATS:
        raise ValueError(f"unknown output format: {form}")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json_parts(_items(df), pretty, indent) if form == "json" else yaml_parts(_items(df)))


def envelope(results: DataFrame) -> DataFrame:
    """(_metadata, data): data is the record's JSON as VARIANT; a retry count of 0 is left out by JSON writers, as null."""
    meta = F.struct(
        "url",
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("fetched_at"),
        "model",
        "provider",
        "input_tokens",
        "output_tokens",
        "fetch_duration_ms",
        "extract_duration_ms",
        F.nullif("retry_count", F.lit(0)).alias("retry_count"),
    )
    return results.filter("error is null and data is not null").select(meta.alias("_metadata"), F.try_parse_json("data").alias("data"))


def training_pairs(results: DataFrame) -> DataFrame:
    """(url, input, output) of the successful results whose content isn't empty."""
    ok = results.filter("error is null and data is not null and raw_content is not null and raw_content <> ''")
    return ok.select("url", F.col("raw_content").alias("input"), F.col("data").alias("output"))


def stats_report(cleaned: DataFrame, source_col: str = "url", result_col: str = "r") -> DataFrame:
    """(source, stats, reduction_percent) of pages cleaned with statistics."""
    from tessera.operators.pages import reduction_percent

    s = F.col(result_col)["stats"]
    return cleaned.select(F.col(source_col).alias("source"), s.alias("stats"), reduction_percent(s["input_bytes"], s["output_bytes"]).alias("reduction_percent"))
