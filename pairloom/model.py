"""Configuration and domain objects. They live on the driver; data lives in DataFrames."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

#: Providers a model may come from, and those that have an adapter.
PROVIDERS = ("openai", "anthropic", "gemini", "ollama", "custom")
ADAPTERS = ("openai", "anthropic", "gemini")

#: Providers that answer from a digest, without any service: for trying out a run.
OFFLINE = ("simulated", "simulated_judge")

#: Capabilities by name, with their aliases, metrics and the fields a case must have.
CAPABILITIES = {"chat_completion": {"aliases": ("chat",), "metrics": ("win_rate", "avg_score", "latency_ms", "tokens"), "required": ("turns",)}}


@dataclass(frozen=True)
class Model:
    provider: str
    model: str
    alias: str | None = None
    temperature: float = 0.2
    max_tokens: int | None = None
    api_key_env: str | None = None

    def __post_init__(self) -> None:
        if self.provider not in (*PROVIDERS, *OFFLINE):
            raise ValueError(f"unknown provider {self.provider!r}; known: {', '.join((*PROVIDERS, *OFFLINE))}")

    @property
    def display_name(self) -> str:
        return self.alias or f"{self.provider}/{self.model}"

    @staticmethod
    def parse(spec: str) -> Model:
        """provider/model, split at the first slash; the provider in any case."""
        provider, slash, name = spec.partition("/")
        if not slash or not name:
            raise ValueError(f"{spec!r} is not provider/model")
        return Model(provider.lower(), name, alias=name)


@dataclass(frozen=True)
class Judge:
    # fixed values: the defaults of the configuration format
    provider: str = "openai"
    model: str = "gpt-4o"
    temperature: float = 0.0
    api_key_env: str | None = None


@dataclass(frozen=True)
class Settings:
    # fixed values: the defaults of the configuration format
    runs_per_test: int = 1
    parallel_execution: bool = False
    save_raw_responses: bool = True
    seed: int | None = None
    sleep_between_calls: float = 0.2
    max_items: int | None = None

    def __post_init__(self) -> None:
        if self.max_items is not None and self.max_items < 0:
            raise ValueError("max_items must not be negative; 0 and null mean no limit")


@dataclass(frozen=True)
class Metrics:
    accuracy: bool = True
    latency: bool = True
    cost: bool = True
    tokens: bool = True


@dataclass(frozen=True)
class Output:
    # fixed values: the defaults of the configuration format
    formats: tuple[str, ...] = ("json",)
    directory: str = "./results"
    include_raw_responses: bool = True


@dataclass(frozen=True)
class Domain:
    """A domain as runs use it: other keys of its file are dropped on load."""

    name: str
    description: str = ""
    system_prompt: str = ""
    version: str = "1.0"
    personas: tuple[dict, ...] = ()
    evaluation_criteria: tuple[dict, ...] = ()
    functions: tuple[dict, ...] = ()


@dataclass(frozen=True)
class DomainSchema(Domain):
    """A domain with everything its file may hold."""

    test_scenarios: tuple[dict, ...] = ()
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        weights = [float(c.get("weight", 0.0)) for c in self.evaluation_criteria]
        if any(w < 0 for w in weights):
            raise ValueError("criteria weights must not be negative")

    def to_domain(self) -> Domain:
        return build(Domain, asdict(self))

    @staticmethod
    def from_yaml(path: str | Path) -> DomainSchema:
        return build(DomainSchema, lifted(read_yaml(path)))

    def to_yaml(self, path: str | Path) -> None:
        write_yaml({"domain": plain(asdict(self))}, path)


@dataclass(frozen=True)
class Benchmark:
    name: str
    models: tuple[Model, ...]
    domain: str | None = None
    description: str = ""
    capabilities: tuple[str, ...] = ("chat_completion",)
    domain_config: Domain | None = None
    judge: Judge = field(default_factory=Judge)
    metrics: Metrics = field(default_factory=Metrics)
    settings: Settings = field(default_factory=Settings)
    output: Output = field(default_factory=Output)

    def check(self) -> Benchmark:
        """All that can be known to be wrong before data is read or a call is paid for."""
        if len(self.models) != 2:
            raise ValueError(f"a run compares exactly two models, not {len(self.models)}")
        if self.models[0].display_name == self.models[1].display_name:
            raise ValueError("the two models must have different display names")
        for c in self.capabilities:
            capability(c)
        return self

    @staticmethod
    def from_yaml(path: str | Path) -> Benchmark:
        raw = read_yaml(path)
        raw = dict(raw.get("benchmark", raw))
        parts = {"models": lambda v: tuple(build(Model, m) for m in v), "judge": lambda v: build(Judge, v), "metrics": lambda v: build(Metrics, v), "settings": lambda v: build(Settings, v), "output": lambda v: build(Output, v), "domain_config": lambda v: v and build(Domain, v)}
        return build(Benchmark, {k: parts.get(k, lambda v: v)(v) for k, v in raw.items() if v is not None})

    def to_yaml(self, path: str | Path) -> None:
        """Plain values only, so that from_yaml reads the file back."""
        write_yaml({"benchmark": plain(asdict(self))}, path)


def capability(name: str) -> str:
    """The capability's own name, from it or an alias, in any case."""
    for own, facts in CAPABILITIES.items():
        if name.lower() in (own, *facts["aliases"]):
            return own
    raise ValueError(f"unknown capability {name!r}; known: {', '.join(CAPABILITIES)}")


def metrics(name: str) -> tuple[str, ...]:
    """What is measured for a capability."""
    return CAPABILITIES[capability(name)]["metrics"]


def required_fields(name: str) -> tuple[str, ...]:
    """What a case needs for a capability."""
    return CAPABILITIES[capability(name)]["required"]


def build(kind: type, values: dict) -> Any:
    """An instance from the keys it knows; lists become tuples."""
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def lifted(raw: dict) -> dict:
    """The domain's keys, with its system prompt taken out of `context`."""
    raw = dict(raw.get("domain", raw))
    context = raw.pop("context", None) or {}
    if "system_prompt" in context:
        raw["system_prompt"] = context["system_prompt"]
    return raw


def read_yaml(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def write_yaml(value: dict, path: str | Path) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(value, f, allow_unicode=True, sort_keys=False)
