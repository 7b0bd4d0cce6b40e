"""A whole run: cases, both models' answers, verdicts in both orders, sums, and the result document."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text, verdict
from pairloom.model import Benchmark, capability
from pairloom.operators import evaluate
from pairloom.operators.providers import Route, judge, pause, provider, respond
from pairloom.sources.files import read_domain


@dataclass
class Run:
    """What a run leaves: one row per case and capability, and the facts of the run."""

    config: Benchmark
    benchmark_id: str
    started: datetime.datetime
    seconds: float
    pairs: DataFrame  # idx, id, category, capability, model_a, model_b, answers, winner, score_a, score_b, reasons
    n_cases: int

    def summary(self) -> dict:
        """The summary as a document; its size is that of models x (capabilities + categories)."""
        names = [m.display_name for m in self.config.models]
        rows = evaluate.summary(self.pairs).collect()
        of = {(r.level, r.model_name, r.capability, r.category): r for r in rows}
        order = [r.category for r in self.pairs.groupBy("category").agg(F.min("idx").alias("i")).orderBy("i").collect()]
        models: dict[str, dict] = {}
        for n in names:
            r = of.get(("model", n, None, None))
            caps = {c: of.get(("capability", n, c, None)) for c in map(capability, self.config.capabilities)}
            models[n] = {"total_wins": r.wins if r else 0, "total_ties": r.ties if r else 0, "total_losses": r.losses if r else 0, "avg_score": round(r.avg_score, 2) if r and r.avg_score is not None else 0}
            models[n]["by_capability"] = {c: {"wins": x.wins if x else 0, "ties": x.ties if x else 0, "losses": x.losses if x else 0, "avg_score": round(x.avg_score, 2) if x and x.avg_score is not None else 0} for c, x in caps.items()}
        by_category = {c: {n: {"wins": x.wins if (x := of.get(("category", n, None, c))) else 0, "ties": x.ties if x else 0} for n in names} for c in order}
        a, b = (models[n]["total_wins"] for n in names)
        winner = names[0] if a > b else names[1] if b > a else "tie"
        return {"total_test_cases": self.n_cases, "models": models, "by_capability": {}, "by_category": by_category, "overall_winner": winner}

    def details(self) -> DataFrame:
        """One row per case and capability in the shape of a result record."""
        answer = lambda s: F.struct(F.col(f"response_{s}").alias("response"), F.col(f"latency_{s}").alias("latency_ms"), F.col(f"tokens_{s}").alias("tokens"), F.col(f"score_{s}").alias("score"))
        both = F.map_from_arrays(F.array("model_a", "model_b"), F.array(answer("a"), answer("b")))
        return self.pairs.select(F.col("id").alias("test_id"), "category", "capability", F.struct("id", "category", "turns").alias("input"), both.alias("responses"), "winner", F.col("reasons").alias("judge_reasons"), "raw_ab", "raw_ba")

    def document(self) -> dict:
        """Everything but the details."""
        c = self.config
        models = [{"provider": m.provider, "model": m.model, "alias": m.alias} for m in c.models]
        config = {"domain": c.domain, "capabilities": list(c.capabilities), "models": models, "judge": {"provider": c.judge.provider, "model": c.judge.model}}
        return {"benchmark_id": self.benchmark_id, "benchmark_name": c.name, "timestamp": self.started.isoformat(), "duration_seconds": self.seconds, "config": config, "summary": self.summary()}


def run(cases: DataFrame, config: Benchmark, routes: list[Route] | None = None, judge_make=None) -> Run:
    """Run both models and the judge over cases (idx, id, category, turns). Wrong settings fail before any call.

    Answers and verdicts are written when they are made, so later steps and retries read them; a limit is applied first.
    """
    config.check()
    started = datetime.datetime.now()
    wait = config.settings.sleep_between_calls
    routes = routes or [Route(m.display_name, m.model, provider(m.provider, m.api_key_env), m.temperature, m.max_tokens, pause(m.provider, wait)) for m in config.models]
    judge_make = judge_make or provider(config.judge.provider, config.judge.api_key_env)
    prompt = config.domain_config.system_prompt if config.domain_config else read_domain(config.domain).system_prompt if config.domain else ""
    names = [capability(c) for c in config.capabilities]
    kept = evaluate.first_items(cases, "idx", config.settings.max_items).select("idx", "id", "category", "turns")
    asked = evaluate.grid(kept.withColumn("messages", text.messages(F.col("turns"), prompt)), names, [r.name for r in routes])
    answers = respond(asked, routes)
    sides = evaluate.both_sides(answers, ["idx", "capability"], "slot", F.struct("response", "latency_ms", "tokens"))
    flat = [F.col(f"{s}.{c}").alias(f"{n}_{s}") for s in "ab" for c, n in (("response", "response"), ("latency_ms", "latency"), ("tokens", "tokens"))]
    paired = kept.withColumn("conversation", text.conversation(F.col("turns"))).join(sides.select("idx", "capability", *flat), "idx")
    verdicts = judge(paired, config.judge.model, judge_make, pause=pause(config.judge.provider, wait))
    both = paired.join(verdicts, ["idx", "capability"]).withColumn("v", verdict.reconciled(F.col("raw_ab"), F.col("raw_ba")))
    rounded = [verdict.py_round(F.col(f"v.score_{s}"), 1).alias(f"score_{s}") for s in "ab"]
    out = both.select("*", F.lit(routes[0].name).alias("model_a"), F.lit(routes[1].name).alias("model_b"), "v.winner", *rounded, "v.reasons").drop("v")
    seconds = (datetime.datetime.now() - started).total_seconds()
    return Run(config, str(uuid.uuid4()), started, seconds, out, kept.count())
