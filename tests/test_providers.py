"""The adapters against stand-ins for the services' packages: what they send, and what they make of the answer."""

import json
import sys
import types
from types import SimpleNamespace as NS

import pytest

from pairloom.model import metrics, required_fields
from pairloom.operators import providers
from pairloom.operators.providers import Anthropic, Base, Gemini, OpenAI

SAID = [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hello"}]
FUNCTION = {"name": "hold", "description": "keep a table", "parameters": {"type": "object"}}


@pytest.fixture
def openai(monkeypatch):
    sent = []

    def create(**kw):
        sent.append(kw)
        call = NS(id="c1", function=NS(name="hold", arguments='{"table": 3}'))
        message = NS(content=None if "tools" in kw else '{"a": 1}' if "response_format" in kw else "hi", tool_calls=[call] if "tools" in kw else None)
        return NS(choices=[NS(message=message)], usage=NS(prompt_tokens=5, completion_tokens=None))

    class Client:
        def __init__(self, api_key):
            self.api_key = api_key
            self.chat = NS(completions=NS(create=create))

    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=Client))
    monkeypatch.setenv("OPENAI_API_KEY", " k ")
    return sent


def test_openai(openai):
    p = OpenAI()
    assert p.chat_completion("m", SAID, max_tokens=None, top_p=0.5) == {"content": "hi", "usage": {"prompt_tokens": 5, "completion_tokens": 0, "total_tokens": 5}}
    assert openai[0] == {"model": "m", "messages": SAID, "temperature": 0.2, "top_p": 0.5} and p.client().api_key == "k"
    called = p.function_call("m", SAID, [FUNCTION])
    assert called["content"] == "" and called["tool_calls"] == [{"id": "c1", "function": {"name": "hold", "arguments": '{"table": 3}'}}]
    assert openai[1]["tools"] == [{"type": "function", "function": FUNCTION}]
    assert p.structured_output("m", SAID, {})["parsed"] == {"a": 1} and openai[2]["response_format"] == {"type": "json_object"}


def test_anthropic(monkeypatch):
    sent = []

    def create(**kw):
        sent.append(kw)
        blocks = [NS(type="text", text="hi "), NS(type="thinking", text="no"), NS(type="tool_use", id="t", name="hold", input={"table": 3}), NS(type="text", text="there")]
        return NS(content=blocks, usage=NS(input_tokens=2, output_tokens=3))

    monkeypatch.setitem(sys.modules, "anthropic", types.SimpleNamespace(Anthropic=lambda api_key: NS(messages=NS(create=create))))
    monkeypatch.setenv("ANTHROPIC_API_KEY", "k")
    p = Anthropic()
    assert p.chat_completion("m", [SAID[0], *SAID]) == {"content": "hi there", "usage": {"prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 5}}
    assert sent[0]["system"] == "be brief" and sent[0]["messages"] == [SAID[1]] and sent[0]["max_tokens"] == 4096
    called = p.function_call("m", SAID, [FUNCTION], max_tokens=9)
    assert json.loads(called["tool_calls"][0]["function"]["arguments"]) == {"table": 3} and sent[1]["max_tokens"] == 9
    assert sent[1]["tools"] == [{"name": "hold", "description": "keep a table", "input_schema": {"type": "object"}}]


def test_gemini(monkeypatch):
    sent = []

    def generate(**kw):
        sent.append(kw)
        return NS(text=None, usage_metadata=None)

    genai = types.SimpleNamespace(Client=lambda api_key: NS(models=NS(generate_content=generate)))
    monkeypatch.setitem(sys.modules, "google", types.SimpleNamespace(genai=genai))
    monkeypatch.setitem(sys.modules, "google.genai", genai)
    monkeypatch.setenv("GEMINI_API_KEY", "k")
    assert Gemini().chat_completion("m", SAID, temperature=1.0) == {"content": "", "usage": {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}}
    assert sent == [{"model": "m", "contents": "SYSTEM: be brief\nUSER: hello"}]


def test_what_a_provider_has_not(monkeypatch):
    p = Base()
    for call in (lambda: p.function_call("m", SAID, []), lambda: p.structured_output("m", SAID, {}), lambda: p.vision("m", SAID, [])):
        with pytest.raises(NotImplementedError):
            call()
    assert OpenAI().supports("structured_output") and not Gemini().supports("function_call")
    monkeypatch.setenv("OPENAI_API_KEY", "  ")
    with pytest.raises(ValueError):
        OpenAI().key()
    with pytest.raises(ValueError):
        providers.provider("ollama")


def test_own_providers_can_be_registered():
    class Own(Base):
        key_env = "OWN"

    providers.register("own", Own)
    try:
        assert isinstance(providers.provider("own")(), Own) and providers.provider("own", "OTHER")().key_env == "OTHER"
    finally:
        del providers.REGISTRY["own"]


def test_facts_of_a_capability():
    assert required_fields("Chat") == ("turns",) and "win_rate" in metrics("chat_completion")
    with pytest.raises(ValueError):
        metrics("smell")
