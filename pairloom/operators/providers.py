"""Model calls as DataFrame stages.

A provider is an object with `chat_completion(model, messages, **options) -> {"content", "usage"}`, made on the worker,
once per task. A call stage is a `mapInPandas`, so that Spark neither repeats nor reorders the calls of a row, and its
result is written before anything else reads it: a paid answer is never asked for twice by a second action. Adapters
for real services need their SDKs and keys and are not tested here.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.functions.verdict import read_verdict, unreadable
from pairloom.model import ADAPTERS
from pairloom.session import materialize

Message = dict[str, str]


class Provider(Protocol):
    features: tuple[str, ...]

    def chat_completion(self, model: str, messages: list[Message], **options: Any) -> dict: ...


class Base:
    """What all adapters share: features and the key from the environment, looked up where the call is made."""

    features: tuple[str, ...] = ("chat_completion",)
    key_env = ""

    def __init__(self, key_env: str | None = None):
        self.key_env = key_env or self.key_env
        self._client: Any = None

    def supports(self, feature: str) -> bool:
        return feature in self.features

    def key(self) -> str:
        found = os.environ.get(self.key_env, "").strip()
        if not found:
            raise ValueError(f"{self.key_env} is not set")
        return found

    def function_call(self, model: str, messages: list[Message], functions: list[dict], **options: Any) -> dict:
        raise NotImplementedError(f"{type(self).__name__} has no function calls")

    def structured_output(self, model: str, messages: list[Message], schema: dict, **options: Any) -> dict:
        raise NotImplementedError(f"{type(self).__name__} has no structured output")

    def vision(self, model: str, messages: list[Message], images: list[bytes], **options: Any) -> dict:
        raise NotImplementedError(f"{type(self).__name__} has no vision")


def usage(prompt: int | None, completion: int | None) -> dict:
    return {"prompt_tokens": prompt or 0, "completion_tokens": completion or 0, "total_tokens": (prompt or 0) + (completion or 0)}


class OpenAI(Base):
    features = ("chat_completion", "function_call", "structured_output")
    key_env = "OPENAI_API_KEY"

    def client(self) -> Any:
        if self._client is None:
            import openai

            self._client = openai.OpenAI(api_key=self.key())
        return self._client

    def ask(self, model: str, messages: list[Message], options: dict) -> Any:
        return self.client().chat.completions.create(model=model, messages=messages, **{k: v for k, v in options.items() if v is not None})

    def chat_completion(self, model: str, messages: list[Message], **options: Any) -> dict:
        got = self.ask(model, messages, {"temperature": 0.2, **options})
        spent = got.usage
        return {"content": got.choices[0].message.content or "", "usage": usage(spent.prompt_tokens, spent.completion_tokens) if spent else usage(0, 0)}

    def function_call(self, model: str, messages: list[Message], functions: list[dict], **options: Any) -> dict:
        got = self.ask(model, messages, {"temperature": 0.2, **options, "tools": [{"type": "function", "function": f} for f in functions]})
        said = got.choices[0].message
        calls = [{"id": c.id, "function": {"name": c.function.name, "arguments": c.function.arguments}} for c in said.tool_calls or ()]
        return {"content": said.content or "", "tool_calls": calls, "usage": usage(got.usage.prompt_tokens, got.usage.completion_tokens) if got.usage else usage(0, 0)}

    def structured_output(self, model: str, messages: list[Message], schema: dict, **options: Any) -> dict:
        got = self.chat_completion(model, messages, **options, response_format={"type": "json_object"})
        try:
            parsed = json.loads(got["content"])
        except ValueError:
            parsed = None
        return got | {"parsed": parsed}


class Anthropic(Base):
    features = ("chat_completion", "function_call")
    key_env = "ANTHROPIC_API_KEY"

    def client(self) -> Any:
        if self._client is None:
            import anthropic

            self._client = anthropic.Anthropic(api_key=self.key())
        return self._client

    def ask(self, model: str, messages: list[Message], options: dict) -> Any:
        system = [m["content"] for m in messages if m["role"] == "system"]
        rest = [m for m in messages if m["role"] != "system"]
        extra = {"system": system[-1]} if system else {}
        return self.client().messages.create(model=model, messages=rest, max_tokens=options.get("max_tokens") or 4096, temperature=options.get("temperature", 0.2), **extra, **options.get("more", {}))

    def chat_completion(self, model: str, messages: list[Message], **options: Any) -> dict:
        got = self.ask(model, messages, options)
        return {"content": "".join(b.text for b in got.content if b.type == "text"), "usage": usage(got.usage.input_tokens, got.usage.output_tokens)}

    def function_call(self, model: str, messages: list[Message], functions: list[dict], **options: Any) -> dict:
        tools = [{"name": f["name"], "description": f.get("description", ""), "input_schema": f.get("parameters", {})} for f in functions]
        got = self.ask(model, messages, options | {"more": {"tools": tools}})
        calls = [{"id": b.id, "function": {"name": b.name, "arguments": json.dumps(b.input)}} for b in got.content if b.type == "tool_use"]
        return {"content": "".join(b.text for b in got.content if b.type == "text"), "tool_calls": calls, "usage": usage(got.usage.input_tokens, got.usage.output_tokens)}


class Gemini(Base):
    key_env = "GEMINI_API_KEY"

    def client(self) -> Any:
        if self._client is None:
            from google import genai

            self._client = genai.Client(api_key=self.key())
        return self._client

    def chat_completion(self, model: str, messages: list[Message], **options: Any) -> dict:
        text = "\n".join(f"{m['role'].upper()}: {m['content']}" for m in messages)
        got = self.client().models.generate_content(model=model, contents=text)
        spent = getattr(got, "usage_metadata", None)
        return {"content": got.text or "", "usage": usage(getattr(spent, "prompt_token_count", 0), getattr(spent, "candidates_token_count", 0))}


class Simulated(Base):
    """Answers made from a digest of the request: the same request has the same answer everywhere."""

    features = ("chat_completion", "function_call", "structured_output")

    def chat_completion(self, model: str, messages: list[Message], **options: Any) -> dict:
        asked = json.dumps([model, messages], sort_keys=True, ensure_ascii=False)
        number = int(hashlib.md5(asked.encode()).hexdigest()[:8], 16)
        content = f"{model} answers {len(messages)} messages, variant {number % 97}."
        return {"content": content, "usage": usage(len(asked) // 4, 5 + number % 60)}


class SimulatedJudge(Base):
    """Prefers the longer answer and, a little, the one shown first; every seventh verdict comes in a fence."""

    def chat_completion(self, model: str, messages: list[Message], **options: Any) -> dict:
        asked = json.loads(messages[0]["content"])
        a, b = len(asked["response_a"]) % 11 + 0.5, len(asked["response_b"]) % 11
        verdict = {"winner": "A" if a > b else "B" if a < b else "tie", "score_A": min(10, a), "score_B": min(10, b), "reasons": [f"{max(a, b)} of 10"]}
        text = json.dumps(verdict)
        return {"content": f"```json\n{text}\n```" if len(text) % 7 == 0 else text, "usage": usage(10, 10)}


REGISTRY: dict[str, Callable[[], Provider]] = {"openai": OpenAI, "anthropic": Anthropic, "gemini": Gemini, "simulated": Simulated, "simulated_judge": SimulatedJudge}


def register(name: str, make: Callable[[], Provider]) -> None:
    """Add a provider; `make` is called on the workers."""
    REGISTRY[name] = make


def provider(name: str, key_env: str | None = None) -> Callable[[], Provider]:
    """What makes a provider on a worker; `key_env` names the environment variable of its key, if not the usual one."""
    if name not in REGISTRY:
        raise ValueError(f"no adapter for {name!r}; there are: {', '.join((*ADAPTERS, *sorted(set(REGISTRY) - set(ADAPTERS))))}")
    return functools.partial(REGISTRY[name], key_env) if key_env else REGISTRY[name]


def pause(name: str, seconds: float) -> float:
    """How long to wait after a call: as asked for with services, not at all with providers on this machine."""
    return seconds if name in ADAPTERS else 0.0


@dataclass(frozen=True)
class Route:
    """How one model of a run is called."""

    name: str  # display name
    model: str
    make: Callable[[], Provider]
    temperature: float = 0.2
    max_tokens: int | None = None
    pause: float = 0.0  # seconds after each call


def respond(grid: DataFrame, routes: list[Route]) -> DataFrame:
    """Answer every row (idx, capability, slot, messages): adds response, latency_ms, tokens. Calls run as many at a time
    as there are partitions; a task waits as the called route says. Written before it is returned."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Provider] = {}
        for pdf in batches:
            out = []
            for idx, capability, slot, messages in zip(pdf["idx"], pdf["capability"], pdf["slot"], pdf["messages"]):
                route = routes[slot]
                client = made.setdefault(slot, route.make())
                asked = [{"role": m["role"], "content": m["content"]} for m in messages]
                began = time.perf_counter()
                got = client.chat_completion(route.model, asked, temperature=route.temperature, max_tokens=route.max_tokens)
                out.append((idx, capability, slot, route.name, got["content"], (time.perf_counter() - began) * 1000, got.get("usage", {}).get("total_tokens", 0)))
                if route.pause:
                    time.sleep(route.pause)
            yield pd.DataFrame(out, columns=["idx", "capability", "slot", "model_name", "response", "latency_ms", "tokens"])

    shape = "idx bigint, capability string, slot int, model_name string, response string, latency_ms double, tokens bigint"
    return materialize(grid.select("idx", "capability", "slot", "messages").mapInPandas(call, shape), "responses")


NUDGE = "That was not the JSON object asked for. Reply with the JSON object alone."


def ask_judge(client: Provider, model: str, request: str, retries: int = 2) -> tuple[tuple[str, float, float, list[str]], int]:
    """A verdict and the number of attempts: unreadable answers are shown back with a nudge, then a tie stands."""
    messages, text = [{"role": "user", "content": request}], ""
    for attempt in range(1, retries + 2):
        text = client.chat_completion(model, messages, temperature=0.0)["content"]
        if (found := read_verdict(text)) is not None:
            return found, attempt
        messages += [{"role": "assistant", "content": text}, {"role": "user", "content": NUDGE}]
    return unreadable(text), retries + 1


def judge(pairs: DataFrame, model: str, make: Callable[[], Provider], role: str = "a helpful assistant", retries: int = 2, pause: float = 0.0) -> DataFrame:
    """Judge every row (idx, capability, conversation, response_a, response_b) in both orders: adds raw_ab and raw_ba. A task
    waits `pause` seconds after each verdict. Written before it is returned."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            out = []
            for idx, capability, *requests in zip(pdf["idx"], pdf["capability"], pdf["ask_ab"], pdf["ask_ba"]):
                told = []
                for request in requests:
                    told.append(ask_judge(client, model, request, retries))
                    if pause:
                        time.sleep(pause)
                (ab, n), (ba, m) = told
                names = ("winner", "score_a", "score_b", "reasons")
                out.append((idx, capability, dict(zip(names, ab)), dict(zip(names, ba)), n + m))
            yield pd.DataFrame(out, columns=["idx", "capability", "raw_ab", "raw_ba", "attempts"])

    verdict = "struct<winner: string, score_a: double, score_b: double, reasons: array<string>>"
    asked = pairs.select("idx", "capability", *(text.judge_request(F.col("conversation"), F.col(f"response_{o[0]}"), F.col(f"response_{o[1]}"), role).alias(f"ask_{o}") for o in ("ab", "ba")))
    return materialize(asked.mapInPandas(call, f"idx bigint, capability string, raw_ab {verdict}, raw_ba {verdict}, attempts int"), "verdicts")
