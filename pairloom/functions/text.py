"""Text and array expressions over cases, messages and responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All blanks that Python's str.strip removes, for which Spark's trim (spaces only) is not enough.
BLANK_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANK_ENDS, "")


def display_name(provider: Column, model: Column, alias: Column) -> Column:
    """The alias, or provider/model where the alias is null or empty."""
    return F.coalesce(F.nullif(alias, F.lit("")), F.concat_ws("/", provider, model))


def conversation(turns: Column) -> Column:
    """USER[i]: text, one line per turn, counted from 1; a null turn reads None; no turns give an empty text."""
    line = F.transform(turns, lambda t, i: F.concat(F.lit("USER["), (i + 1).cast("string"), F.lit("]: "), F.coalesce(t, F.lit("None"))))
    return F.coalesce(F.array_join(line, "\n"), F.lit(""))


def messages(turns: Column, system_prompt: str | None = None) -> Column:
    """Role and content of each message: the system prompt unless empty, then every turn as the user's."""
    said = F.transform(F.coalesce(turns, F.array().cast("array<string>")), lambda t: F.struct(F.lit("user").alias("role"), t.alias("content")))
    if not system_prompt:
        return said
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))), said)


def transcript(msgs: Column) -> Column:
    """ROLE: content, one line per message."""
    return F.array_join(F.transform(msgs, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def system_of(msgs: Column) -> Column:
    """The content of the last system message, or null."""
    return F.try_element_at(F.filter(msgs, lambda m: m["role"] == "system"), F.lit(-1))["content"]


def without_system(msgs: Column) -> Column:
    return F.filter(msgs, lambda m: m["role"] != "system")


def text_blocks(blocks: Column) -> Column:
    """The text of all blocks of type text, joined; other blocks are left out."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def tool(function: Column) -> Column:
    """A function definition in the shape chat interfaces take."""
    return F.struct(F.lit("function").alias("type"), function.alias("function"))


def named_tool(function: Column) -> Column:
    """The same for interfaces that take name, description and the schema of the input; missing parts are empty."""
    return F.struct(function["name"].alias("name"), F.coalesce(function["description"], F.lit("")).alias("description"), function["parameters"].alias("input_schema"))


def judge_request(conversation: Column, a: Column, b: Column, role: str = "a helpful assistant") -> Column:
    """The judge's task as one JSON text: nothing in an answer can be read as part of the task."""
    task = f'Compare two answers of {role} to the conversation. Reply with JSON only: {{"winner": "A", "B" or "tie", "score_A": 0-10, "score_B": 0-10, "reasons": [up to 8 short texts]}}'
    none = F.lit("")
    return F.to_json(F.struct(F.lit(task).alias("task"), F.coalesce(conversation, none).alias("conversation"), F.coalesce(a, none).alias("response_a"), F.coalesce(b, none).alias("response_b")))


def both_orders(first: Column, second: Column) -> Column:
    """The two orders in which a pair is shown, as an array of (order, shown_first, shown_second)."""
    one = lambda o, x, y: F.struct(F.lit(o).alias("order"), x.alias("shown_first"), y.alias("shown_second"))
    return F.array(one("ab", first, second), one("ba", second, first))


def spec_parts(spec: Column) -> Column:
    """provider/model split at the first slash: the provider in lower case, the alias as the model was written."""
    parts = F.split(spec, "/", 2)
    model = F.get(parts, F.lit(1))
    return F.struct(F.lower(F.get(parts, F.lit(0))).alias("provider"), model.alias("model"), model.alias("alias"))


def case_id(prefix: str, number: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", number)


def is_case(turns: Column) -> Column:
    """A case is valid if it has at least one turn."""
    return F.coalesce(F.size(turns) > 0, F.lit(False))


def exact_match(response: Column, expected: Column) -> Column:
    """1 if both are the same text but for blanks around it; an empty or null expectation matches nothing."""
    return F.when((F.length(expected) > 0) & (strip(response) == strip(expected)), 1.0).otherwise(0.0)


def keyword_coverage(response: Column, keywords: Column) -> Column:
    """Share of the keywords that the response holds, case ignored; no keywords give 0."""
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(response), F.lower(k))))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, F.coalesce(found, F.lit(0)) / F.size(keywords)).otherwise(0.0)


def rule_result(response: Column, expected: Column, keywords: Column) -> Column:
    """Score (the better of both rules), passed from one half on, and the reasons."""
    exact, cover = exact_match(response, expected), keyword_coverage(response, keywords)
    score = F.greatest(exact, cover)
    reasons = F.array_compact(F.array(F.when(exact == 1.0, F.lit("exact match")), F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, F.concat(F.lit("keywords "), F.format_number(cover, 2)))))
    return F.struct(score.alias("score"), (score >= 0.5).alias("passed"), reasons.alias("reasons"))
