"""Requests and replies of the providers, without a network."""

import pytest

from tessera.operators import extract, providers, schemas
from tessera.operators.extract import Call

ONE = schemas.Schema("s", "", (schemas.Field("a", "string", required=True),))
CALL = Call("P", {"type": "object"}, temperature=0.0, max_tokens=0, strict=True)
REPLIES = {
    "anthropic": {"model": "m", "stop_reason": "tool_use", "usage": {"input_tokens": 3, "output_tokens": 2}, "content": [{"type": "text", "text": "hm"}, {"type": "tool_use", "input": {"a": "é"}}]},
    "openai": {"id": "g1", "model": "m", "choices": [{"finish_reason": "length", "message": {"content": '{"a": "é"}'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}},
    "ollama": {"model": "m", "message": {"content": '{"a": "é"}'}, "prompt_eval_count": 3, "eval_count": 2},
}


def test_requests():
    a = providers.tool_request(CALL, "m")
    assert a["max_tokens"] == 4096 and a["tool_choice"] == {"type": "tool", "name": "extract_data"} and a["tools"][0]["input_schema"] == {"type": "object"}
    o = providers.chat_request(CALL, "m")
    assert o["response_format"]["json_schema"] == {"name": "extraction_result", "strict": True, "schema": {"type": "object"}} and o["temperature"] == 0
    assert "temperature" not in providers.gateway_request(CALL, "m")
    assert providers.local_request(CALL, "m")["format"] == {"type": "object"} and "num_predict" not in providers.local_request(CALL, "m")["options"]


@pytest.mark.parametrize("name", sorted(providers.ADAPTERS))
def test_extraction_by_each_adapter(name):
    reply = REPLIES.get(name, REPLIES["openai"])
    seen = []

    def send(url, headers, body):
        seen.append((url, headers, body))
        return 200, reply

    r = providers.extractor(name, send, {providers.ADAPTERS[name].key or "": "k"}).extract("content", ONE)
    assert r.data == {"a": "é"} and (r.input_tokens, r.output_tokens, r.provider) == (3, 2, name)
    assert r.finish_reason == {"anthropic": "tool_use", "ollama": "stop"}.get(name, "length") and len(seen) == 1
    assert providers.ADAPTERS[name].key is None or "k" in " ".join(seen[0][1].values())


def test_errors_and_retries():
    replies = [(429, {"e": 1}), (200, {"choices": []}), (200, REPLIES["openai"])]
    with pytest.raises(extract.ExtractError, match="no choices"):
        providers.extractor("openai", lambda *a: replies.pop(0), {"OPENAI_API_KEY": "k"}).extract("c", ONE)
    assert len(replies) == 1


def test_chain_leaves_out_providers_without_a_key():
    c = providers.chain(lambda *a: (200, REPLIES["ollama"]), {"OPENAI_API_KEY": "k"}, preferred="ollama")
    assert [e.name for e in c.extractors] == ["ollama", "openai"] and c.extract("c", ONE).provider == "ollama"


def test_listing_is_kept_for_an_hour():
    now, calls = [0.0], []
    listing = providers.Listing(lambda: calls.append(1) or [{"id": "m", "n": len(calls)}], clock=lambda: now[0])
    assert listing.info("m")["n"] == 1 and listing.info("x") is None
    now[0] = 3599
    assert listing.info("m")["n"] == 1
    now[0] = 3600
    assert listing.info("m")["n"] == 2


def test_cost_of_a_generation_is_asked_for_again():
    replies, slept = [(404, {}), (404, {}), (200, {"data": {"total_cost": 0.5}})], []
    assert providers.generation_cost("openrouter", "g", lambda *a: replies.pop(0), sleep=slept.append) == 0.5 and slept == [0.2, 0.5]
    with pytest.raises(providers.ProviderError):
        providers.generation_cost("openrouter", "g", lambda *a: (404, {}), sleep=slept.append)
    assert slept[2:] == [0.2, 0.5, 1.0]
    with pytest.raises(providers.ProviderError):
        providers.generation_cost("openrouter", "g", lambda *a: (500, {}), sleep=slept.append)
