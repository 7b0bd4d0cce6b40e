"""Verdicts of a judge: reading, repairing, clamping, and reconciling both orders of presentation.

`parse_verdict` follows Python's JSON reading exactly and is a vectorised UDF, because Spark's readers differ on repeated
keys, NaN, trailing text and quotes. `native_verdict` is the same on well-formed objects and stays in the JVM.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICT = "winner string, score_a double, score_b double, reasons array<string>"
WINNERS = ("A", "B", "tie")
PER_PASS, PER_PAIR = 8, 6  # most reasons kept


def fenced(text: str) -> str:
    """The text inside the first fence: a json fence if there is one, else any; the whole text without a closed fence."""
    for mark in ("```json", "```"):
        at = text.find(mark)
        if at >= 0:
            start = at + len(mark)
            end = text.find("```", start)
            return text[start:end].strip() if end > start else text.strip()
    return text.strip()


def clamp(x: object) -> float:
    """A score in 0..10; what is no number gives 0, NaN stays."""
    try:
        value = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return value if math.isnan(value) else min(10.0, max(0.0, value))


def read_verdict(text: str | None) -> tuple[str, float, float, list[str]] | None:
    """The verdict in a judge's text; None if there is no JSON in it and the judge should be asked again."""
    try:
        found = json.loads(fenced(text or ""))
    except (ValueError, RecursionError):
        return None
    if found is None:
        return None
    if not isinstance(found, dict):
        return "tie", 0.0, 0.0, ["the verdict is not an object"]
    reasons = found.get("reasons", [])
    reasons = reasons if isinstance(reasons, list) else [reasons]
    winner = found.get("winner")
    return (winner if winner in WINNERS else "tie"), clamp(found.get("score_A", 0)), clamp(found.get("score_B", 0)), [str(r) for r in reasons][:PER_PASS]


def unreadable(text: str | None) -> tuple[str, float, float, list[str]]:
    """What stands for a verdict when all attempts failed."""
    return "tie", 0.0, 0.0, [f"no readable verdict: {(text or '')[:200]}"]


def parse_verdict(text: Column) -> Column:
    """The verdict in a judge's text, or what stands for one that cannot be read."""

    def parse(told: pd.Series) -> pd.DataFrame:
        rows = [read_verdict(t) or unreadable(t) for t in told]
        return pd.DataFrame(rows, columns=["winner", "score_a", "score_b", "reasons"])

    return F.pandas_udf(parse, VERDICT)(text)


def py_round(x: Column, digits: int) -> Column:
    """Python's rounding: right on the binary value, halves to even; neither of Spark's roundings is. For |x| below 2^40.

    2 * 10^digits * x is taken as a sum of two doubles without error, and compared with the odd number in the middle."""
    scale = 10.0**digits
    size = F.abs(x)
    t = size * 134217729.0
    high = t - (t - size)  # the upper half of the bits
    a, b = high * (2 * scale), (size - high) * (2 * scale)
    p = a + b
    e = (a - p) + b
    k = F.floor(p / 2).cast("double")
    k = F.when((p == 2 * k) & (e < 0), k - 1).otherwise(k)
    over = (p - (2 * k + 1)) + e
    whole = F.when((over > 0) | ((over == 0) & (k % 2 == 1)), k + 1).otherwise(k)
    rounded = F.signum(x) * (whole / scale)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(rounded)


def fence_body(text: Column) -> Column:
    """`fenced` as an expression."""
    tagged, plain = F.instr(text, "```json"), F.instr(text, "```")
    start = F.when(tagged > 0, tagged + 7).when(plain > 0, plain + 3)
    rest = F.substr(text, start)
    end = F.instr(rest, "```")
    body = F.when(start.isNotNull() & (end > 1), F.substr(rest, F.lit(1), end - 1)).otherwise(text)
    return F.regexp_replace(body, r"(?U)^\s+|\s+$", "")


def native_clamp(x: Column) -> Column:
    number = F.when(x.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), x.try_cast("double")).when(x == "true", 1.0).otherwise(0.0)
    return F.when(F.isnan(number), number).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(10.0)))


def native_verdict(text: Column) -> Column:
    """A verdict from well-formed JSON text, in the JVM. Text behind the object makes it none: it is read as the only entry of
    an array, as Spark's reader passes over what follows a value."""
    body = fence_body(text)
    entries = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    alone = F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")) & F.try_variant_get(entries, "$[1]", "variant").isNull()
    v = F.when(alone, F.try_variant_get(entries, "$[0]", "variant"))
    winner = F.try_variant_get(v, "$.winner", "string")
    reasons = F.coalesce(F.try_variant_get(v, "$.reasons", "array<string>"), F.array(F.try_variant_get(v, "$.reasons", "string")))
    return F.struct(
        F.when(winner.isin(*WINNERS), winner).otherwise(F.lit("tie")).alias("winner"),
        native_clamp(F.try_variant_get(v, "$.score_A", "string")).alias("score_a"),
        native_clamp(F.try_variant_get(v, "$.score_B", "string")).alias("score_b"),
        F.slice(F.array_compact(reasons), 1, PER_PASS).alias("reasons"),
    )


def swapped(winner: Column) -> Column:
    """A verdict given with the answers in the other order, in terms of the first order."""
    return F.when(winner == "A", "B").when(winner == "B", "A").otherwise(winner)


def agreed(ab: Column, ba: Column) -> Column:
    """The winner both orders agree on; else a tie."""
    back = swapped(ba)
    return F.when(ab.isin("A", "B") & (ab == back), ab).otherwise(F.lit("tie"))


def merged_reasons(ab: Column, ba: Column) -> Column:
    """Reasons of both orders, each once, first come first, at most PER_PAIR."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(ab, none), F.coalesce(ba, none))), 1, PER_PAIR)


def reconciled(ab: Column, ba: Column) -> Column:
    """Winner, mean scores (unrounded) and reasons of both orders; null where either verdict is missing."""
    return F.when(
        ab.isNotNull() & ba.isNotNull(),
        F.struct(
            agreed(ab["winner"], ba["winner"]).alias("winner"),
            ((ab["score_a"] + ba["score_b"]) / 2).alias("score_a"),
            ((ab["score_b"] + ba["score_a"]) / 2).alias("score_b"),
            merged_reasons(ab["reasons"], ba["reasons"]).alias("reasons"),
        ),
    )


def total_tokens(usage: Column) -> Column:
    """Prompt and completion tokens together; 0 where usage is missing."""
    return F.coalesce(usage["prompt_tokens"], F.lit(0)) + F.coalesce(usage["completion_tokens"], F.lit(0))
