"""Adapters of model providers: what is sent for a call, and what an answer says.

Each is two functions over plain values, so they need no network: ``request`` makes the
JSON body, ``answer`` reads the reply. ``caller`` joins them with a ``send`` function
(url, headers, body) -> (status, reply) to a ``call`` for ``extract.ModelExtractor``."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.operators import costs, extract
from tessera.operators.extract import Answer, Call

MAX_TOKENS = 4096
TOOL, NAME = "extract_data", "extraction_result"
Send = Callable[[str, dict, dict | None], tuple[int, dict]]


class ProviderError(Exception):
    """A reply that can't be used; the status is in the text, so that rate limits are told."""


def tool_request(call: Call, model: str) -> dict:
    """Messages with one tool that must be used."""
    body = {"model": model, "max_tokens": call.max_tokens or MAX_TOKENS, "temperature": call.temperature, "messages": [{"role": "user", "content": call.prompt}]}
    return body | {"tools": [{"name": TOOL, "description": "Extract structured data", "input_schema": call.json_schema}], "tool_choice": {"type": "tool", "name": TOOL}}


def tool_answer(reply: dict) -> Answer:
    """Of several blocks the last one counts."""
    text = ""
    for block in reply.get("content", []):
        if block.get("type") == "text":
            text = block.get("text", "")
        elif block.get("type") == "tool_use":
            text = json.dumps(block.get("input"), ensure_ascii=False)
    used = reply.get("usage", {})
    return Answer(text, used.get("input_tokens", 0), used.get("output_tokens", 0), reply.get("model", ""), reply.get("stop_reason") or "", "")


def chat_request(call: Call, model: str) -> dict:
    """A chat whose answer has a JSON schema."""
    body = {"model": model, "max_tokens": call.max_tokens or MAX_TOKENS, "temperature": call.temperature, "messages": [{"role": "user", "content": call.prompt}]}
    return body | {"response_format": {"type": "json_schema", "json_schema": {"name": NAME, "strict": call.strict, "schema": call.json_schema}}}


def gateway_request(call: Call, model: str) -> dict:
    """The same; a temperature of 0 isn't sent."""
    body = chat_request(call, model)
    return body if call.temperature > 0 else {k: v for k, v in body.items() if k != "temperature"}


def chat_answer(reply: dict) -> Answer:
    if not reply.get("choices"):
        raise ProviderError("no choices in the reply")
    first, used = reply["choices"][0], reply.get("usage", {})
    return Answer(first.get("message", {}).get("content") or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0), reply.get("model", ""), first.get("finish_reason") or "", reply.get("id", ""))


def local_request(call: Call, model: str) -> dict:
    options = {"temperature": call.temperature} | ({"num_predict": call.max_tokens} if call.max_tokens else {})
    return {"model": model, "stream": False, "messages": [{"role": "user", "content": call.prompt}], "format": call.json_schema, "options": options}


def local_answer(reply: dict) -> Answer:
    return Answer(reply.get("message", {}).get("content", ""), reply.get("prompt_eval_count", 0), reply.get("eval_count", 0), reply.get("model", ""), "stop", "")


@dataclass(frozen=True)
class Adapter:
    url: str
    request: Callable[[Call, str], dict]
    answer: Callable[[dict], Answer]
    key: str | None  # environment variable
    headers: Callable[[str], dict] = field(default=lambda key: {"Authorization": f"Bearer {key}"})
    #: Whether the reply's tokens give the cost by the price table.
    cost_included: bool = True
    generation: str = ""  # where a generation's cost is looked up


ADAPTERS = {
    "anthropic": Adapter("https://api.anthropic.com/v1/messages", tool_request, tool_answer, "ANTHROPIC_API_KEY", lambda key: {"x-api-key": key, "anthropic-version": "2023-06-01"}),
    "openai": Adapter("https://api.openai.com/v1/chat/completions", chat_request, chat_answer, "OPENAI_API_KEY"),
    "openrouter": Adapter("https://openrouter.ai/api/v1/chat/completions", chat_request, chat_answer, "OPENROUTER_API_KEY", cost_included=False, generation="https://openrouter.ai/api/v1/generation?id="),
    "helicone": Adapter("https://ai-gateway.helicone.ai/v1/chat/completions", gateway_request, chat_answer, "HELICONE_API_KEY", cost_included=False),
    "ollama": Adapter("http://localhost:11434/api/chat", local_request, local_answer, None, lambda key: {}),
}


def caller(name: str, send: Send, key: str = "", model: str = "", url: str = "") -> Callable[[Call], Answer]:
    """A ``call`` by the adapter of that name."""
    a, model = ADAPTERS[name], model or costs.DEFAULT_MODELS[name]

    def call(request: Call) -> Answer:
        status, reply = send(url or a.url, a.headers(key), a.request(request, model))
        if status != 200:
            raise ProviderError(f"HTTP {status}: {extract.cut(json.dumps(reply), 200, '...')}")
        return a.answer(reply)

    return call


def extractor(name: str, send: Send, env: dict[str, str], **options) -> extract.ModelExtractor:
    """A model extractor of a provider, available if the environment has its key."""
    a, given = ADAPTERS[name], {k: options.pop(k) for k in ("model", "url") if k in options}
    key = env.get(a.key, "") if a.key else ""
    return extract.ModelExtractor(name, caller(name, send, key, **given), ready=not a.key or bool(key), **options)


def chain(send: Send, env: dict[str, str], preferred: str = "", order: tuple[str, ...] = ("openrouter", "anthropic", "openai", "helicone", "ollama"), **options) -> extract.Fallback:
    """The preferred provider, then the others in order; those without a key are left out."""
    names = dict.fromkeys(([preferred] if preferred else []) + list(order))
    return extract.Fallback(tuple(e for e in (extractor(n, send, env, **options) for n in names) if e.available()))


class Listing:
    """A provider's list of models, fetched once an hour."""

    def __init__(self, fetch: Callable[[], list[dict]], ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.ttl, self.clock = fetch, ttl, clock
        self.at, self.models = 0.0, None

    def all(self) -> list[dict]:
        if self.models is None or self.clock() - self.at >= self.ttl:
            self.models, self.at = self.fetch(), self.clock()
        return self.models

    def info(self, model: str) -> dict | None:
        return next((m for m in self.all() if m.get("id") == model), None)


def generation_cost(name: str, generation: str, send: Send, key: str = "", waits: tuple[float, ...] = (0.2, 0.5, 1.0), sleep: Callable[[float], None] = time.sleep) -> float:
    """What a generation cost. It may not be known at once: after a 404 it is asked for again."""
    a = ADAPTERS[name]
    for wait in (*waits, None):
        status, reply = send(a.generation + generation, a.headers(key), None)
        if status == 200:
            return float(reply.get("data", {}).get("total_cost", 0.0))
        if status != 404 or wait is None:
            raise ProviderError(f"HTTP {status}: cost of {generation}")
        sleep(wait)
    raise AssertionError
