"""Queries over the parts of the evaluation engine that the sums do not touch: files, prompts, tools, rules and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairloom.functions import text, verdict
from pairloom.model import ADAPTERS, CAPABILITIES, read_yaml
from pairloom.operators import evaluate, generate, report
from pairloom.plans.evaluation import _ONCE, _PAIRS, _list, cases, pairs
from pairloom.session import read, tables_dir
from pairloom.sources import files


def scratch(spark, name: str) -> str:
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def jsonl_scan(spark, sf_dir):
    """Cases written as JSON lines without their nulls, in order, and read again: ids and categories that are missing are filled."""
    at = scratch(spark, "cases")
    lines = cases(spark, sf_dir).repartitionByRange("case_key").sortWithinPartitions("case_key")
    lines.select(F.to_json(F.struct("id", "category", "turns", "meta")).alias("value")).write.text(at)
    got = files.read_cases(spark, at)
    return got.select("idx", "id", "category", F.size("turns").cast("bigint").alias("n_turns"), text.conversation(F.col("turns")).alias("conversation"), "meta.meal_time", "meta.party_size")


def jsonl_sink(spark, sf_dir):
    """The lines of a written file: nulls are kept, all texts as they are."""
    at = scratch(spark, "lines")
    files.write_lines(cases(spark, sf_dir).select("case_key", "id", "category", "turns"), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


def result_scan(spark, sf_dir):
    """Result documents of all runs, written as JSON, read again and flattened by model."""
    at = scratch(spark, "documents")
    evaluate.documents(pairs(spark, sf_dir), read(spark, sf_dir, "bench_runs")).write.option("ignoreNullFields", "false").json(at)
    docs = spark.read.schema(files.RESULT_DOCUMENT).json(at)
    each = docs.select("benchmark_id", "benchmark_name", F.col("summary.total_test_cases").alias("n"), F.col("summary.overall_winner").alias("winner"), F.explode("summary.models").alias("model_name", "s"))
    return each.select("benchmark_id", "benchmark_name", "n", "winner", "model_name", "s.total_wins", "s.total_ties", "s.total_losses", "s.avg_score")


def result_categories(spark, sf_dir):
    """Wins and ties by category and model, from the documents."""
    docs = evaluate.documents(pairs(spark, sf_dir), read(spark, sf_dir, "bench_runs"))
    each = docs.select("benchmark_id", F.explode("summary.by_category").alias("category", "m")).select("benchmark_id", "category", F.explode("m").alias("model_name", "s"))
    return each.select("benchmark_id", "category", "model_name", "s.wins", "s.ties")


def compared(spark, sf_dir):
    docs = evaluate.documents(pairs(spark, sf_dir), read(spark, sf_dir, "bench_runs"))
    return evaluate.compare(docs.withColumn("file", F.col("benchmark_id")))


def compare_documents(spark, sf_dir):
    return compared(spark, sf_dir)


def compare_markdown(spark, sf_dir):
    return report.markdown_rows(compared(spark, sf_dir))


def compare_json(spark, sf_dir):
    return report.json_rows(compared(spark, sf_dir))


def answered(spark, sf_dir):
    """Answers of each result with the conversation of its case."""
    schema = "result_id bigint, benchmark_id string, case_key bigint, received_at timestamp_ntz, responses map<string, struct<response: string, latency_ms: double, tokens: bigint>>"
    once = evaluate.once(read(spark, sf_dir, "results", schema), "benchmark_id", "case_key", "responses")
    told = cases(spark, sf_dir).select("case_key", text.conversation(F.col("turns")).alias("conversation"))
    return evaluate.sided(once, read(spark, sf_dir, "bench_runs")).join(told, "case_key")


def judge_prompts(spark, sf_dir):
    """The judge's task for each result, in both orders."""
    sides = F.explode(text.both_orders(F.col("a.response"), F.col("b.response"))).alias("o")
    held = answered(spark, sf_dir).select("result_id", "conversation", sides)
    return held.select("result_id", F.col("o.order").alias("order"), text.judge_request(F.col("conversation"), F.col("o.shown_first"), F.col("o.shown_second")).alias("prompt"))


def both_orders(spark, sf_dir):
    named = evaluate.run_names(read(spark, sf_dir, "bench_runs"))
    return named.select("benchmark_id", F.inline(text.both_orders(F.col("model_a"), F.col("model_b"))))


def functions(spark, sf_dir):
    """Function definitions made from the catalog of models."""
    size = F.struct(F.lit("integer").alias("type"), F.col("max_tokens").alias("maximum"))
    return read(spark, sf_dir, "model_catalog").select("model_id", F.struct(F.col("model").alias("name"), F.nullif(F.col("alias"), F.lit("")).alias("description"), F.struct(size.alias("size")).alias("parameters")).alias("f"))


def tool_shapes(spark, sf_dir):
    shown = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return functions(spark, sf_dir).select("model_id", shown(text.tool(F.col("f"))).alias("tool"), shown(text.named_tool(F.col("f"))).alias("named_tool"))


def content_blocks(spark, sf_dir):
    """Turns as content blocks of changing type; the text of the text blocks."""
    kind = lambda i: F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("text")), (i % 3 + 1).cast("int"))
    blocks = F.transform(F.coalesce("turns", F.array().cast("array<string>")), lambda t, i: F.struct(kind(i).alias("type"), t.alias("text")))
    return cases(spark, sf_dir).select("case_key", text.text_blocks(blocks).alias("content"))


def token_sums(spark, sf_dir):
    """Prompt and completion tokens of each result's first answer."""
    usage = F.struct(F.length("conversation").alias("prompt_tokens"), F.col("a.tokens").alias("completion_tokens"))
    return answered(spark, sf_dir).select("result_id", verdict.total_tokens(usage).cast("bigint").alias("tokens"))


def unreadable_verdicts(spark, sf_dir):
    """What stands for a verdict where the whole line is no JSON: a tie, with the beginning of the text."""
    lines = read(spark, sf_dir, "result_lines").filter(F.try_parse_json("payload").isNull())
    held = lines.withColumn("v", verdict.parse_verdict(F.col("payload")))
    return held.select("line_id", "v.winner", "v.score_a", "v.score_b", F.array_join("v.reasons", "|").alias("reasons"))


def rounded_scores(spark, sf_dir):
    """Mean scores of both orders as Python rounds them."""
    held = evaluate.once(read(spark, sf_dir, "results", "result_id bigint, received_at timestamp_ntz, raw_ab struct<score_a: double>, raw_ba struct<score_b: double>"), "raw_ab", "raw_ba")
    mean = (F.col("raw_ab.score_a") + F.col("raw_ba.score_b")) / 2
    return held.select("result_id", verdict.py_round(mean, 1).alias("one"), verdict.py_round(mean / 7, 2).alias("two"))


def rule_results(spark, sf_dir):
    """The rules' whole result: score, passed and reasons, for the first answer against the second and three keywords."""
    rules = evaluate.Rules(F.array(F.lit("Table"), F.lit("bill"), F.lit("kitchen")))
    held = answered(spark, sf_dir).withColumn("v", rules.evaluate(F.col("a.response"), F.col("b.response")))
    return held.select("result_id", F.round("v.score", 6).alias("score"), "v.passed", F.array_join("v.reasons", "|").alias("reasons"))


def capability_lookup(spark, sf_dir):
    """Names of capabilities in any case, and what a case needs for them; unknown ones have nothing."""
    own = F.create_map(*(F.lit(x) for name, facts in CAPABILITIES.items() for alias in (name, *facts["aliases"]) for x in (alias, name)))
    needs = F.create_map(*(F.lit(x) for name, facts in CAPABILITIES.items() for x in (name, ",".join(facts["required"]))))
    said = read(spark, sf_dir, "results", "result_id bigint, capability string").withColumn("name", own[F.lower(F.upper("capability"))])
    return said.groupBy("capability").agg(F.first("name").alias("name"), F.first(needs[F.col("name")]).alias("required"), F.countDistinct("result_id").alias("n"))


def provider_lookup(spark, sf_dir):
    return read(spark, sf_dir, "model_catalog").select("model_id", F.coalesce(F.lower("provider").isin(*ADAPTERS), F.lit(False)).alias("has_adapter"))


def template_expansion(spark, sf_dir):
    """The templates of the built-in domain with every combination of their variables."""
    scenarios = read_yaml(files.domain_path("dining_room"))["domain"]["test_scenarios"]
    rows = [(s["id"], s["templates"], s["variables"]) for s in scenarios]
    return generate.expand(spark.createDataFrame(rows, "id string, templates array<string>, variables map<string, array<string>>"))


def static_cases(spark, sf_dir):
    return files.static_cases(spark).select("idx", "id", "category", F.size("turns").cast("bigint").alias("n_turns"), text.conversation(F.col("turns")).alias("conversation"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_scan, jsonl_sink, result_scan, result_categories, compare_documents, compare_markdown, compare_json, judge_prompts, both_orders, tool_shapes, content_blocks, token_sums, unreadable_verdicts, rounded_scores,
        rule_results, capability_lookup, provider_lookup, template_expansion, static_cases,
    )
}

_SAID = "coalesce(array_to_string(list_transform(turns, lambda t, i: 'USER[' || i || ']: ' || coalesce(t, 'None')), chr(10)), '')"
_TOLD = f"told as (select case_key, {_SAID} as conversation from test_cases), answered as (select o.result_id, o.case_key, p.a, p.b, conversation from once o join pairs p using (result_id) join told t on t.case_key = o.case_key)"
_DOCS = """w as (select benchmark_id, any_value(benchmark_name) as benchmark_name, any_value(model_a) as model_a, any_value(model_b) as model_b, count(*) as n, count(*) filter (winner = 'A') as wa, count(*) filter (winner = 'B') as wb, count(*) filter (winner = 'tie') as t, count(*) filter (winner is not null) as judged,
  avg(score_a) filter (winner is not null) as sa, avg(score_b) filter (winner is not null) as sb from pairs group by 1), d as (select *, case when judged = 0 then null when wa > wb then model_a when wa < wb then model_b else 'tie' end as overall from w)"""
_COMPARED = f"with {_PAIRS}, {_DOCS}, k as (select benchmark_id as file, benchmark_name, overall as winner, model_a as model_1, wa as wins_1, model_b as model_2, wb as wins_2, t as ties from d)"
_JUDGED = 'Compare two answers of a helpful assistant to the conversation. Reply with JSON only: {"winner": "A", "B" or "tie", "score_A": 0-10, "score_B": 0-10, "reasons": [up to 8 short texts]}'


def _expanded() -> str:
    parts = []
    for s in read_yaml(files.domain_path("dining_room"))["domain"]["test_scenarios"]:
        for t in s["templates"]:
            names = [n for n in s["variables"] if "{" + n + "}" in t]
            out = _list([t])[1:-1]
            for n in names:
                out = f"replace({out}, '{{{n}}}', {n})"
            given = ", ".join(f"(select unnest({_list(s['variables'][n])}) as {n})" for n in names) or "(select 1)"
            parts.append(f"select '{s['id']}' as id, {out} as text from {given}")
    return " union all ".join(parts)


def _hand() -> str:
    rows = [f"({k}, '{c['id']}', '{c['category']}', {_list(c['turns'])})" for k, c in enumerate(read_yaml(files.BUILTIN / "dining_room_cases.yaml")["cases"])]
    return f"select cast(idx as bigint) as idx, id, category, len(turns) as n_turns, {_SAID} as conversation from (values {', '.join(rows)}) v(idx, id, category, turns)"


SQL = {
    "jsonl_scan": f"select row_number() over (order by case_key) - 1 as idx, coalesce(id, 'case_' || (row_number() over (order by case_key) - 1)) as id, coalesce(category, 'unknown') as category, coalesce(len(turns), 0) as n_turns, {_SAID} as conversation, meta.meal_time as meal_time, meta.party_size as party_size from test_cases",
    "jsonl_sink": "select to_json({'case_key': case_key, 'id': id, 'category': category, 'turns': turns})::varchar as line from test_cases",
    "result_scan": f"with {_PAIRS}, {_DOCS} select benchmark_id, benchmark_name, n, overall as winner, model_a as model_name, wa as total_wins, t as total_ties, wb as total_losses, format('{{:.2f}}', coalesce(sa, 0.0))::double as avg_score from d where judged > 0 union all select benchmark_id, benchmark_name, n, overall, model_b, wb, t, wa, format('{{:.2f}}', coalesce(sb, 0.0))::double from d where judged > 0",
    "result_categories": f"with {_PAIRS}, l as (select benchmark_id, category, model_a as model_name, winner = 'A' as won, winner = 'tie' as tied from pairs where winner is not null union all select benchmark_id, category, model_b, winner = 'B', winner = 'tie' from pairs where winner is not null) select benchmark_id, category, model_name, count(*) filter (won) as wins, count(*) filter (tied) as ties from l where category is not null group by all",
    "compare_documents": f"{_COMPARED} select * from k",
    "compare_markdown": f"{_COMPARED} select file, '| ' || concat_ws(' | ', coalesce(benchmark_name, 'None'), coalesce(winner, 'None'), model_1, wins_1, model_2, wins_2, ties) || ' |' as line from k",
    "compare_json": f"{_COMPARED} select file, to_json({{'benchmark_name': benchmark_name, 'winner': winner, 'model_1': model_1, 'wins_1': wins_1, 'model_2': model_2, 'wins_2': wins_2, 'ties': ties}})::varchar as line from k",
    "judge_prompts": f"with {_PAIRS}, {_TOLD}, o as (select result_id, 'ab' as \"order\", conversation, coalesce(a.response, '') as x, coalesce(b.response, '') as y from answered union all select result_id, 'ba', conversation, coalesce(b.response, ''), coalesce(a.response, '') from answered) select result_id, \"order\", to_json({{'task': '{_JUDGED}', 'conversation': conversation, 'response_a': x, 'response_b': y}})::varchar as prompt from o",
    "both_orders": f"with {_PAIRS}, n as (select * from runs) select benchmark_id, 'ab' as \"order\", model_a as shown_first, model_b as shown_second from n union all select benchmark_id, 'ba', model_b, model_a from n",
    "tool_shapes": """with f as (select model_id, model as name, nullif(alias, '') as description, {'size': {'type': 'integer', 'maximum': max_tokens}} as parameters from model_catalog)
        select model_id, to_json({'type': 'function', 'function': {'name': name, 'description': description, 'parameters': parameters}})::varchar as tool, to_json({'name': name, 'description': coalesce(description, ''), 'input_schema': parameters})::varchar as named_tool from f""",
    "content_blocks": "select case_key, coalesce(array_to_string(list_filter(turns, lambda t, i: (i - 1) % 3 <> 1), ''), '') as content from test_cases",
    "token_sums": f"with {_PAIRS}, {_TOLD} select result_id, cast(length(conversation) + coalesce(a.tokens, 0) as bigint) as tokens from answered",
    "unreadable_verdicts": "select line_id, 'tie' as winner, 0.0::double as score_a, 0.0::double as score_b, 'no readable verdict: ' || left(coalesce(payload, ''), 200) as reasons from result_lines where payload is null or not json_valid(payload)",
    "rounded_scores": f"with {_ONCE} select result_id, format('{{:.1f}}', (raw_ab.score_a + raw_ba.score_b) / 2)::double as one, format('{{:.2f}}', (raw_ab.score_a + raw_ba.score_b) / 2 / 7)::double as two from once",
    "rule_results": f"""with {_PAIRS}, {_TOLD}, s as (select result_id, case when length(b.response) > 0 and regexp_replace(a.response, '^\\s+|\\s+$', '', 'g') = regexp_replace(b.response, '^\\s+|\\s+$', '', 'g') then 1.0 else 0.0 end::double as exact,
        coalesce((contains(lower(a.response), 'table')::int + contains(lower(a.response), 'bill')::int + contains(lower(a.response), 'kitchen')::int) / 3.0, 0.0)::double as cover from answered)
        select result_id, round(greatest(exact, cover), 6) as score, greatest(exact, cover) >= 0.5 as passed, case when exact = 1 then 'exact match|' else '' end || 'keywords ' || format('{{:.2f}}', cover) as reasons from s""",
    "capability_lookup": "select capability, case when lower(capability) in ('chat_completion', 'chat') then 'chat_completion' end as name, case when lower(capability) in ('chat_completion', 'chat') then 'turns' end as required, count(distinct result_id) as n from results group by 1",
    "provider_lookup": "select model_id, coalesce(lower(provider) in ('openai', 'anthropic', 'gemini'), false) as has_adapter from model_catalog",
    "template_expansion": _expanded(),
    "static_cases": _hand(),
}
