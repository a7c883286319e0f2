"""Extraction: a protocol for extractors, retries, fallback, pipeline, and rows of results.

Extractors run in an Arrow function, one call for each page; what a call costs is
added up in its row. A task that is retried calls again, so calls should be idempotent
or the results be written once (``written`` results are read, not recomputed).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.html import parse
from tessera.functions.selectors import select
from tessera.operators import costs
from tessera.operators.pages import _column
from tessera.operators.schemas import AGAIN, FIX, PROMPT, Schema


class ExtractError(Exception):
    """A failed call. ``result`` has what is known of it."""

    def __init__(self, message: str, result: Result | None = None):
        super().__init__(message)
        self.result = result or Result()


class NoneAvailable(ExtractError):
    def __init__(self) -> None:
        super().__init__("no extractor available")


@dataclass
class Result:
    data: Any = None
    raw: str = ""
    raw_content: str = ""
    errors: list[tuple[str, str]] = field(default_factory=list)
    input_tokens: int = 0
    output_tokens: int = 0
    model: str = ""
    provider: str = ""
    generation_id: str = ""
    finish_reason: str = ""
    retry_count: int = 0

    @property
    def truncated(self) -> bool:
        return self.finish_reason == "length"


class Extractor(Protocol):
    name: str

    def available(self) -> bool: ...

    def extract(self, content: str, schema: Schema) -> Result: ...


@dataclass
class Call:
    """What a provider is asked, and which attempt it is."""

    prompt: str
    json_schema: dict
    temperature: float = 0.1
    max_tokens: int = 4096
    strict: bool = False
    attempt: int = 0


@dataclass
class Answer:
    content: str = ""
    input_tokens: int = 0
    output_tokens: int = 0
    model: str = ""
    finish_reason: str = "stop"
    generation_id: str = ""


def strip_fence(s: str) -> str:
    s = T.trim(s)
    for head in ("```json", "```"):
        if s.startswith(head):
            return T.trim(s[len(head) :].removesuffix("```"))
    return s


def cut(s: str, limit: int, mark: str = T.TRUNCATED) -> str:
    raw = s.encode()
    return s if limit <= 0 or len(raw) <= limit else raw[:limit].decode(errors="ignore") + mark


def build_prompt(content: str, schema: Schema, error: str | None, limit: int) -> str:
    out = [PROMPT, schema.prompt_description()]
    if error is not None:
        out += [AGAIN, error, FIX]
    return "".join((*out, "\n## Webpage Content\n```\n", cut(content, limit), "\n```\n"))


@dataclass
class ModelExtractor:
    """Asks a model by ``call`` and validates its answer; a wrong record, or a rate limit,
    is tried again with the error in the prompt. Usage is summed over attempts."""

    name: str
    call: Callable[[Call], Answer]
    max_retries: int = 3
    limit: int = 100_000
    ready: bool = True
    observers: tuple[Callable[[dict], None], ...] = ()

    def available(self) -> bool:
        return self.ready

    def once(self, content: str, schema: Schema, error: str | None, attempt: int) -> Result:
        request = Call(build_prompt(content, schema, error, self.limit), schema.json_schema(), attempt=attempt)
        result = Result(provider=self.name, raw_content=content)
        try:
            a = self.call(request)
        except Exception as e:
            self.tell(request, None, str(e))
            raise ExtractError(str(e), result) from e
        self.tell(request, a, None)
        result = replace(result, raw=a.content, input_tokens=a.input_tokens, output_tokens=a.output_tokens, model=a.model, finish_reason=a.finish_reason, generation_id=a.generation_id)
        try:
            data = json.loads(strip_fence(a.content))
        except ValueError as e:
            raise ExtractError(f"failed to parse response: {e}; response: {cut(a.content, 200, '...')}", result) from e
        if data is not None and not isinstance(data, dict):
            raise ExtractError("failed to parse response: not an object", result)
        result.data = data or {}
        return result

    def tell(self, request: Call, answer: Answer | None, error: str | None) -> None:
        for o in self.observers:
            o({"provider": self.name, "attempt": request.attempt, "request": request, "answer": answer, "error": error})

    def extract(self, content: str, schema: Schema) -> Result:
        used_in = used_out = 0
        error, last = None, Result(provider=self.name)
        for attempt in range(self.max_retries + 1):
            again = True
            try:
                last = self.once(content, schema, error, attempt)
                last.errors = schema.validate(last.data)
                failed = bool(last.errors)
                error = "; ".join(f"{f}: {m}" for f, m in last.errors)
            except ExtractError as e:
                last, failed, error = e.result, True, str(e)
                again = "rate limit" in error or "429" in error
            used_in, used_out = used_in + last.input_tokens, used_out + last.output_tokens
            if not failed:
                return replace(last, input_tokens=used_in, output_tokens=used_out, retry_count=attempt)
            if not again:
                break
        kept = Result(provider=self.name, model=last.model, generation_id=last.generation_id, finish_reason=last.finish_reason, input_tokens=used_in, output_tokens=used_out, retry_count=self.max_retries)
        raise ExtractError(f"extraction failed after {self.max_retries + 1} attempts: {error}", kept)


@dataclass
class RuleExtractor:
    """Fields by selectors, from cleaned HTML: 'selector' gives the text of the first
    match, 'selector@name' an attribute; array fields take all matches."""

    rules: dict[str, str]
    name: str = "rules"

    def available(self) -> bool:
        return True

    def extract(self, content: str, schema: Schema) -> Result:
        doc, data = parse(content), {}
        for f in schema.fields:
            if f.name not in self.rules:
                continue
            selector, _, attr = self.rules[f.name].partition("@")
            found = [n.attrs.get(attr) if attr else T.trim(n.text()) for n in select(doc, selector)]
            found = [self.typed(f.items.type if f.type == "array" and f.items else f.type, x) for x in found if x is not None]
            if f.type == "array":
                data[f.name] = found
            elif found:
                data[f.name] = found[0]
        result = Result(data=data, raw=json.dumps(data, ensure_ascii=False), raw_content=content, provider=self.name, model="rules", errors=schema.validate(data))
        if result.errors:
            raise ExtractError("; ".join(f"{f}: {m}" for f, m in result.errors), result)
        return result

    @staticmethod
    def typed(kind: str, s: str) -> Any:
        if kind in ("integer", "number"):
            try:
                return int(s) if kind == "integer" else float(s)
            except ValueError:
                return s
        return s


@dataclass
class Fallback:
    """The first available extractor that succeeds."""

    extractors: tuple[Extractor, ...]

    @property
    def name(self) -> str:
        return "fallback(" + "->".join(e.name for e in self.extractors) + ")"

    def available(self) -> bool:
        return any(e.available() for e in self.extractors)

    def first(self) -> Extractor | None:
        return next((e for e in self.extractors if e.available()), None)

    def extract(self, content: str, schema: Schema) -> Result:
        tried, last = [], None
        for e in self.extractors:
            if e.available():
                tried.append(e.name)
                try:
                    return e.extract(content, schema)
                except ExtractError as x:
                    last = x
        if last is None:
            raise NoneAvailable
        raise ExtractError(f"all extractors failed (tried: {', '.join(tried)}): {last}", last.result)


@dataclass
class Pipeline:
    """Every available extractor in turn gets the same content; the last result stays,
    usage and retries are summed. Without an available one the result is None."""

    extractors: tuple[Extractor, ...]

    @property
    def name(self) -> str:
        return "pipeline(" + "->".join(e.name for e in self.extractors) + ")"

    def available(self) -> bool:
        return any(e.available() for e in self.extractors)

    def extract(self, content: str, schema: Schema) -> Result | None:
        last, used_in, used_out, retries = None, 0, 0, 0
        for e in self.extractors:
            if not e.available():
                continue
            last = e.extract(content, schema)
            if last is not None:
                used_in, used_out, retries = used_in + last.input_tokens, used_out + last.output_tokens, retries + last.retry_count
        return None if last is None else replace(last, input_tokens=used_in, output_tokens=used_out, retry_count=retries, provider=self.name)


#: Names of extractors and what makes them; providers are added with ``register``.
REGISTRY: dict[str, Callable[..., Extractor]] = {"rules": RuleExtractor}


def register(name: str, make: Callable[..., Extractor]) -> None:
    REGISTRY[name] = make


def create(name: str, *args, **options) -> Extractor:
    if name not in REGISTRY:
        raise KeyError(f"unknown extractor: {name}")
    return REGISTRY[name](*args, **options)


def detect(env: dict[str, str]) -> str:
    """The provider whose key the environment has, in order of preference; ollama needs none."""
    for key, name in (("OPENROUTER_API_KEY", "openrouter"), ("ANTHROPIC_API_KEY", "anthropic"), ("OPENAI_API_KEY", "openai"), ("HELICONE_API_KEY", "helicone")):
        if env.get(key):
            return name
    return "ollama"


RESULT = (
    "struct<data:string,raw:string,raw_content:string,errors:array<struct<field:string,message:string>>,input_tokens:int,output_tokens:int,"
    "model:string,provider:string,generation_id:string,finish_reason:string,retry_count:int,error:string>"
)


def extracted(content: Column, extractor: Extractor, schema: Schema) -> Column:
    """The result of each page's content, failed ones with ``error``; data as JSON text."""

    def one(text: str) -> dict | None:
        error = None
        try:
            r = extractor.extract(text, schema)
        except ExtractError as e:
            r, error = e.result, str(e)
        if r is None:
            return None
        keep = ("raw", "raw_content", "input_tokens", "output_tokens", "model", "provider", "generation_id", "finish_reason", "retry_count")
        out = {k: getattr(r, k) for k in keep}
        data = None if r.data is None or error else json.dumps(r.data, ensure_ascii=False)
        return out | {"data": data, "errors": [{"field": f, "message": m} for f, m in r.errors], "error": error}

    return _column(RESULT, one, content)


def extract_pages(pages: DataFrame, extractor: Extractor, schema: Schema, clean: str = "default", output: str = "markdown", min_content: int = 0) -> DataFrame:
    """``pages`` (url, html) cleaned and extracted: url and the result's columns.

    With ``min_content``, pages with fewer bytes of content have an error and the
    extractor isn't called for them."""
    from tessera.operators.pages import clean_html, enough_content

    content = clean_html(F.col("html"), clean, output=output)
    rows = pages.select("url", content.alias("content"))
    if not min_content:
        return rows.select("url", extracted(F.col("content"), extractor, schema).alias("r")).select("url", "r.*")
    # A page is cleaned once; too short ones go by the extractor as null.
    asked = rows.select("url", F.when(enough_content(F.col("content"), min_content), F.col("content")).alias("content"))
    done = asked.select("url", F.col("content").isNull().alias("short"), extracted(F.col("content"), extractor, schema).alias("r")).select("url", "short", "r.*")
    return done.withColumn("error", F.when(F.col("short"), F.lit("insufficient content")).otherwise(F.col("error"))).drop("short")


def extract_many(urls: DataFrame, pages: DataFrame, extractor: Extractor, schema: Schema, **options) -> DataFrame:
    """One row for each row of ``urls`` (url); those without a page have an error only."""
    got = extract_pages(pages.join(urls.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"]), extractor, schema, **options)
    out = urls.select("url").join(got, "url", "left")
    return out.withColumn("error", F.when(F.col("provider").isNull() & F.col("error").isNull(), F.lit("fetch error: not in the snapshot")).otherwise(F.col("error")))


def first_success(attempts: DataFrame, key: str, order: str = "priority") -> DataFrame:
    """Of recorded attempts (key, priority, available, error, ...) the first available one without an error."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    return attempts.filter("available and error is null").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def with_cost(results: DataFrame) -> DataFrame:
    """Results with the cost of their tokens at their provider, router tiers for unknown models."""
    known = costs.known_cost(results, costs.prices(results.sparkSession))
    tier = costs.tier_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return known.withColumn("cost", F.coalesce("cost", tier))
