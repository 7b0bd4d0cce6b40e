"""Queries over recorded evaluations, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text, verdict
from pairloom.model import Benchmark, Judge, Model
from pairloom.operators import evaluate, generate, report
from pairloom.operators.providers import Route, Simulated, SimulatedJudge
from pairloom.session import read

CAPABILITIES = ["chat_completion", "function_calling", "structured_output"]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "test_cases")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result once with both display names and both scores, category and capability."""
    schema = "result_id bigint, benchmark_id string, category string, capability string, received_at timestamp_ntz, responses map<string, struct<score: double>>, winner string"
    once = evaluate.once(read(spark, sf_dir, "results", schema), "benchmark_id", "category", "capability", "responses", "winner")
    both = evaluate.sided(once, read(spark, sf_dir, "bench_runs"))
    return both.select("result_id", "benchmark_id", "category", "capability", "model_a", "model_b", "winner", F.col("a.score").alias("score_a"), F.col("b.score").alias("score_b"))


def test_case_scan(spark, sf_dir):
    return cases(spark, sf_dir).select("case_key", F.coalesce(F.size("turns"), F.lit(0)).cast("bigint").alias("n_turns"), text.conversation(F.col("turns")).alias("conversation"))


def case_messages(spark, sf_dir):
    msgs = text.messages(F.col("turns"), "Be brief.")
    return cases(spark, sf_dir).select("case_key", F.size(msgs).cast("bigint").alias("n_messages"), text.transcript(msgs).alias("transcript"), text.system_of(msgs).alias("system"), F.size(text.without_system(msgs)).cast("bigint").alias("n_user"))


def validate_cases(spark, sf_dir):
    return cases(spark, sf_dir).select("case_key", text.is_case(F.col("turns")).alias("valid"))


def max_items(spark, sf_dir):
    return evaluate.first_items(cases(spark, sf_dir).select("case_key", "category"), "case_key", 100)


def display_names(spark, sf_dir):
    return read(spark, sf_dir, "model_catalog").select("model_id", text.display_name(F.col("provider"), F.col("model"), F.col("alias")).alias("display_name"))


def model_specs(spark, sf_dir):
    spec = F.concat(F.upper("provider"), F.lit("/"), F.col("model"), F.lit("/x"))
    return read(spark, sf_dir, "model_catalog").select("model_id", text.spec_parts(spec).alias("p")).select("model_id", "p.*")


def case_capability_grid(spark, sf_dir):
    crossed = evaluate.grid(cases(spark, sf_dir).select("case_key", "category"), CAPABILITIES, ["first", "second"])
    return crossed.groupBy("category", "capability", "model_name").agg(F.count("*").alias("n"), F.sum("case_key").alias("keys"))


def pair_responses(spark, sf_dir):
    schema = "result_id bigint, benchmark_id string, received_at timestamp_ntz, responses map<string, struct<response: string, latency_ms: double, tokens: bigint>>"
    once = evaluate.once(read(spark, sf_dir, "results", schema), "benchmark_id", "responses")
    both = evaluate.sided(once, read(spark, sf_dir, "bench_runs"))
    return both.select("result_id", "model_a", F.col("a.response").alias("response_a"), F.col("a.tokens").alias("tokens_a"), "model_b", F.col("b.response").alias("response_b"), F.col("b.tokens").alias("tokens_b"))


def raw_verdicts(spark, sf_dir):
    v = "struct<winner: string, score_a: double, score_b: double, reasons: array<string>>"
    return evaluate.once(read(spark, sf_dir, "results", f"result_id bigint, received_at timestamp_ntz, raw_ab {v}, raw_ba {v}"), "raw_ab", "raw_ba")


def swap_reconcile(spark, sf_dir):
    held = raw_verdicts(spark, sf_dir).withColumn("v", verdict.reconciled(F.col("raw_ab"), F.col("raw_ba"))).filter("v is not null")
    return held.select("result_id", "v.winner", F.round("v.score_a", 4).alias("score_a"), F.round("v.score_b", 4).alias("score_b"))


def reason_dedupe(spark, sf_dir):
    held = raw_verdicts(spark, sf_dir)
    return held.select("result_id", F.array_join(verdict.merged_reasons(F.col("raw_ab.reasons"), F.col("raw_ba.reasons")), "|").alias("reasons"))


def judge_texts(spark, sf_dir):
    """The verdicts that stand in result lines as JSON text, fenced or not."""
    v = F.try_parse_json("payload")
    raw = F.coalesce(F.try_variant_get("v", "$.raw_ab", "variant"), F.try_variant_get("v", "$.data.raw_ab", "variant"))
    lines = read(spark, sf_dir, "result_lines").withColumn("v", v).withColumn("raw", raw)
    return lines.filter(F.schema_of_variant("raw") == "STRING").select("line_id", F.try_variant_get("raw", "$", "string").alias("said"))


def judge_parse(spark, sf_dir):
    held = judge_texts(spark, sf_dir).withColumn("v", verdict.parse_verdict(F.col("said")))
    return held.select("line_id", "v.winner", "v.score_a", "v.score_b", F.size("v.reasons").cast("bigint").alias("n_reasons"))


def judge_parse_native(spark, sf_dir):
    held = judge_texts(spark, sf_dir).withColumn("v", verdict.native_verdict(F.col("said")))
    return held.select("line_id", "v.winner", "v.score_a", "v.score_b")


def win_loss_by_model(spark, sf_dir):
    sums = evaluate.summary(pairs(spark, sf_dir)).filter("level = 'model'")
    return sums.select("model_name", "wins", "ties", "losses", F.round("avg_score", 6).alias("avg_score"))


def win_loss_by_capability(spark, sf_dir):
    sums = evaluate.summary(pairs(spark, sf_dir)).filter("level = 'capability'")
    return sums.select("model_name", "capability", "wins", "ties", "losses", F.round("avg_score", 6).alias("avg_score"))


def win_loss_by_category(spark, sf_dir):
    return evaluate.summary(pairs(spark, sf_dir)).filter("level = 'category'").select("model_name", "category", "wins", "ties")


def summary_levels(spark, sf_dir):
    """The flagship: all three levels from one pass."""
    sums = evaluate.summary(pairs(spark, sf_dir))
    return sums.withColumn("avg_score", F.round("avg_score", 6))


def overall_winner(spark, sf_dir):
    return evaluate.overall(pairs(spark, sf_dir), "benchmark_id").select("benchmark_id", "wins_a", "wins_b", "ties", "overall_winner")


def compare_runs(spark, sf_dir):
    """One row per run with its name: what comparing their result documents shows."""
    won = evaluate.overall(pairs(spark, sf_dir), "benchmark_id")
    runs = read(spark, sf_dir, "bench_runs").select("benchmark_id", "benchmark_name")
    return won.join(runs, "benchmark_id").select("benchmark_name", F.col("overall_winner").alias("winner"), "model_a", "wins_a", "model_b", "wins_b", "ties")


def case_counts(spark, sf_dir):
    return read(spark, sf_dir, "results").groupBy("benchmark_id").agg(F.countDistinct("case_key").alias("total_test_cases"), F.countDistinct("result_id").alias("n_results"))


def rule_exact_match(spark, sf_dir):
    both = pair_responses(spark, sf_dir)
    return both.groupBy(text.exact_match(F.col("response_a"), F.col("response_b")).alias("score")).agg(F.count("*").alias("n"))


def rule_keywords(spark, sf_dir):
    both = pair_responses(spark, sf_dir)
    score = text.keyword_coverage(F.col("response_a"), F.array(F.lit("Table"), F.lit("bill"), F.lit("kitchen")))
    return both.select("result_id", F.round(score, 6).alias("score"), (score >= 0.5).alias("passed"))


def token_totals(spark, sf_dir):
    schema = "result_id bigint, received_at timestamp_ntz, responses map<string, struct<latency_ms: double, tokens: bigint>>"
    each = evaluate.once(read(spark, sf_dir, "results", schema), "responses").select(F.explode("responses").alias("model_name", "a"))
    ms = F.when(F.col("a.latency_ms") > 0, F.col("a.latency_ms"))
    return each.groupBy("model_name").agg(F.sum(F.coalesce("a.tokens", F.lit(0))).alias("tokens"), F.count("*").alias("answers"), F.round(F.avg(ms), 3).alias("mean_ms"))


def generate_cases(spark, sf_dir):
    made = generate.generate(spark, 1000, 42)
    return made.select("id", "category", F.size("turns").cast("bigint").alias("n_turns"), F.array_join("turns", " ").alias("said"), "meta.meal_time", "meta.party_size")


def generate_draws(spark, sf_dir):
    """The digests behind the generated cases."""
    draws = generate.Draws(42, F.col("id"))
    return spark.range(1, 1001).select(text.case_id("dn", F.col("id")).alias("id"), draws.number("keep").alias("keep"), draws.pick(generate.scenes()["pools"]["drink"], "drink").alias("drink"), draws.other(generate.scenes()["pools"]["drink"], "drink").alias("other_drink"), F.array_join(draws.sample(generate.scenes()["pools"]["dish"], 3, "menu"), "|").alias("menu"), draws.chance(generate.PUSH, "push").alias("push"))


def category_balance(spark, sf_dir):
    return generate.generate(spark, 1000, 42).groupBy("category").agg(F.count("*").alias("n"))


def jsonl_render(spark, sf_dir):
    """Result records as JSON lines, with the summary of all as their first line."""
    held = pairs(spark, sf_dir)
    body = report.lines(held.select("result_id", "category", "capability", "winner", "score_a", "score_b"))
    head = held.agg(F.count("*").alias("n"), *(F.count_if(F.col("winner") == w).alias(f"n_{w.lower()}") for w in ("A", "B", "tie")))
    return head.select(F.lit(0).alias("place"), F.to_json(F.struct(F.lit("summary").alias("type"), "*")).alias("line")).union(body.select(F.lit(1), "value"))


def simulated_run(spark, sf_dir):
    """Cases, simulated answers and verdicts, reconciled and summed up: the whole engine."""
    from pairloom.operators import engine

    models = (Model("custom", "one"), Model("custom", "two"))
    held = cases(spark, sf_dir).select(F.col("case_key").alias("idx"), "id", "category", "turns")
    routes = [Route(m.display_name, m.model, Simulated) for m in models]
    done = engine.run(held, Benchmark("simulated", models, judge=Judge("custom", "judge")), routes, SimulatedJudge)
    return evaluate.summary(done.pairs).withColumn("avg_score", F.round("avg_score", 6))


QUERIES = {
    f.__name__: f
    for f in (
        summary_levels, test_case_scan, case_messages, validate_cases, max_items, display_names, model_specs, case_capability_grid, pair_responses, swap_reconcile, reason_dedupe, judge_parse, judge_parse_native,
        win_loss_by_model, win_loss_by_capability, win_loss_by_category, overall_winner, compare_runs, case_counts, rule_exact_match, rule_keywords, token_totals, generate_cases, generate_draws, category_balance, jsonl_render, simulated_run,
    )
}

_NAME = "coalesce(nullif({m}.alias, ''), {m}.provider || '/' || {m}.model)"
_RUNS = f"runs as (select benchmark_id, benchmark_name, {_NAME.format(m='models[1]')} as model_a, {_NAME.format(m='models[2]')} as model_b from bench_runs)"
_ONCE = "once as (select * from (select *, row_number() over (partition by result_id order by received_at) as rn from results) where rn = 1)"
_PAIRS = f"{_RUNS}, {_ONCE}, pairs as (select result_id, o.benchmark_id, benchmark_name, category, capability, model_a, model_b, winner, responses[model_a].score as score_a, responses[model_b].score as score_b, responses[model_a] as a, responses[model_b] as b from once o join runs using (benchmark_id))"
_LONG = f"{_PAIRS}, long as (select category, capability, model_a as model_name, case winner when 'A' then 'win' when 'B' then 'loss' else 'tie' end as outcome, score_a as score from pairs where winner is not null union all select category, capability, model_b, case winner when 'B' then 'win' when 'A' then 'loss' else 'tie' end, score_b from pairs where winner is not null)"
_COUNTS = "cast(count(*) filter (outcome = 'win') as bigint) as wins, cast(count(*) filter (outcome = 'tie') as bigint) as ties, cast(count(*) filter (outcome = 'loss') as bigint) as losses"
_CONVERSATION = "coalesce(array_to_string(list_transform(turns, lambda t, i: 'USER[' || i || ']: ' || coalesce(t, 'None')), chr(10)), '')"
_AGREED = "case when raw_ab.winner = 'A' and raw_ba.winner = 'B' then 'A' when raw_ab.winner = 'B' and raw_ba.winner = 'A' then 'B' else 'tie' end"

SQL = {
    "summary_levels": f"with {_LONG} select case when grouping(capability) = 0 then 'capability' when grouping(category) = 0 then 'category' else 'model' end as level, model_name, capability, category, {_COUNTS}, round(avg(score), 6) as avg_score from long group by grouping sets ((model_name), (model_name, capability), (model_name, category))",
    "test_case_scan": f"select case_key, coalesce(len(turns), 0) as n_turns, {_CONVERSATION} as conversation from test_cases",
    "case_messages": "select case_key, coalesce(len(turns), 0) + 1 as n_messages, array_to_string(list_concat(['SYSTEM: Be brief.'], list_transform(coalesce(turns, []), lambda t: 'USER: ' || coalesce(t, ''))), chr(10)) as transcript, 'Be brief.' as system, coalesce(len(turns), 0) as n_user from test_cases",
    "validate_cases": "select case_key, coalesce(len(turns) > 0, false) as valid from test_cases",
    "max_items": "select case_key, category from test_cases order by case_key limit 100",
    "display_names": f"select model_id, {_NAME.format(m='c')} as display_name from model_catalog c",
    "model_specs": "select model_id, lower(provider) as provider, model || '/x' as model, model || '/x' as alias from model_catalog",
    "case_capability_grid": "select category, capability, model_name, count(*) as n, cast(sum(case_key) as bigint) as keys from test_cases, (values ('chat_completion'), ('function_calling'), ('structured_output')) c(capability), (values ('first'), ('second')) m(model_name) group by all",
    "pair_responses": f"with {_PAIRS} select result_id, model_a, a.response as response_a, a.tokens as tokens_a, model_b, b.response as response_b, b.tokens as tokens_b from pairs",
    "swap_reconcile": f"with {_ONCE} select result_id, {_AGREED} as winner, round((raw_ab.score_a + raw_ba.score_b) / 2, 4) as score_a, round((raw_ab.score_b + raw_ba.score_a) / 2, 4) as score_b from once where raw_ab is not null and raw_ba is not null",
    "win_loss_by_model": f"with {_LONG} select model_name, {_COUNTS}, round(avg(score), 6) as avg_score from long group by 1",
    "win_loss_by_capability": f"with {_LONG} select model_name, capability, {_COUNTS}, round(avg(score), 6) as avg_score from long group by 1, 2",
    "win_loss_by_category": f"with {_LONG} select model_name, category, cast(count(*) filter (outcome = 'win') as bigint) as wins, cast(count(*) filter (outcome = 'tie') as bigint) as ties from long group by 1, 2",
    "case_counts": "select benchmark_id, count(distinct case_key) as total_test_cases, count(distinct result_id) as n_results from results group by 1",
    "rule_keywords": f"with {_PAIRS}, s as (select result_id, coalesce((contains(lower(a.response), 'table')::int + contains(lower(a.response), 'bill')::int + contains(lower(a.response), 'kitchen')::int) / 3.0, 0.0) as score from pairs) select result_id, round(score::double, 6) as score, score >= 0.5 as passed from s",
    "token_totals": f"with {_ONCE}, e as (select unnest(map_keys(responses)) as model_name, unnest(map_values(responses)) as a from once) select model_name, cast(sum(coalesce(a.tokens, 0)) as bigint) as tokens, count(*) as answers, round(avg(case when a.latency_ms > 0 then a.latency_ms end), 3) as mean_ms from e group by 1",
}
_WON = "select benchmark_id, any_value(benchmark_name) as benchmark_name, any_value(model_a) as model_a, any_value(model_b) as model_b, count(*) filter (winner = 'A') as wins_a, count(*) filter (winner = 'B') as wins_b, count(*) filter (winner = 'tie') as ties from pairs where winner is not null group by 1"
_WINNER = "case when wins_a > wins_b then model_a when wins_a < wins_b then model_b else 'tie' end"
SQL["overall_winner"] = f"with {_PAIRS}, won as ({_WON}) select benchmark_id, wins_a, wins_b, ties, {_WINNER} as overall_winner from won"
SQL["compare_runs"] = f"with {_PAIRS}, won as ({_WON}) select benchmark_name, {_WINNER} as winner, model_a, wins_a, model_b, wins_b, ties from won"
SQL["rule_exact_match"] = f"with {_PAIRS}, s as (select case when length(b.response) > 0 and regexp_replace(a.response, '^\\s+|\\s+$', '', 'g') = regexp_replace(b.response, '^\\s+|\\s+$', '', 'g') then 1.0 else 0.0 end as score from pairs) select score::double as score, count(*) as n from s group by 1"
SQL["reason_dedupe"] = f"with {_ONCE}, r as (select result_id, list_concat(coalesce(raw_ab.reasons, []), coalesce(raw_ba.reasons, [])) as x from once) select result_id, coalesce(array_to_string(list_filter(x, lambda v, i: v is not null and list_position(x, v) = i)[:6], '|'), '') as reasons from r"


def _number(slot: str) -> str:
    """The generator's draw of a slot for the row i, in SQL."""
    return f"('0x' || substr(md5('42|' || i || '|{slot}'), 1, 8))::bigint"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _picked(pools: dict, slot: str, other: bool = False) -> str:
    n = len(pools[slot])
    at = f"({_number(slot)} + 1 + {_number(slot + '|other')} % {n - 1}) % {n}" if other else f"{_number(slot)} % {n}"
    return f"({_list(pools[slot])})[({at} + 1)::int]"


def _filled(template: str, pools: dict) -> str:
    out = _list([template])[1:-1]
    for m in dict.fromkeys(m[0] for m in generate.SLOT.finditer(template)):
        other, slot = generate.SLOT.fullmatch(m).groups()
        out = f"replace({out}, '{m}', {_picked(pools, slot, bool(other))})"
    return out


def _generated() -> str:
    """The generator in SQL, written out from the scenes."""
    raw = generate.scenes()
    cases = []
    for name, steps in raw["scenes"].items():
        parts = []
        for k, step in enumerate(steps):
            said = f"([{', '.join(_filled(t, raw['pools']) for t in step['say'])}])[({_number(f'{name}|{k}')} % {len(step['say'])} + 1)::int]"
            parts.append(f"case when {_number(f'{name}|{k}|in')} < {int(step['chance'] * (1 << 32))} then {said} end" if "chance" in step else said)
        parts.append(f"case when {_number('push')} < {int(generate.PUSH * (1 << 32))} then ({_list(raw['pushes'])})[({_number('which')} % {len(raw['pushes'])} + 1)::int] end")
        cases.append(f"when '{name}' then [{', '.join(parts)}]")
    names = _list(raw["scenes"])
    return f"""with r as (select i, row_number() over (order by {_number('order')}, i) - 1 as place from range(1, 1001) r(i)),
c as (select i, ({names})[(place % {len(raw['scenes'])} + 1)::int] as category from r),
t as (select i, category, list_filter(case category {' '.join(cases)} end, lambda x: x is not null)[1:({generate.LEAST} + {_number('keep')} % {generate.MOST - generate.LEAST + 1})::int] as turns from c)
select 'dn_' || lpad(i::varchar, 4, '0') as id, category, len(turns) as n_turns, array_to_string(turns, ' ') as said, {_picked(raw['pools'] | {'meta_time': raw['pools']['season']}, 'meta_time')} as meal_time, cast({_number('meta_size')} % 6 + 1 as integer) as party_size from t"""


_SCENES = generate.scenes()
SQL["generate_cases"] = _generated()
SQL["category_balance"] = f"with c as (select unnest({_list(_SCENES['scenes'])}) as category, unnest(range({len(_SCENES['scenes'])})) as k) select category, cast(1000 // {len(_SCENES['scenes'])} + (k < 1000 % {len(_SCENES['scenes'])})::int as bigint) as n from c"
_MENU = ", ".join("{'d': " + _number(f"menu|{n}") + f", 'n': {n}, 'v': '{v}'" + "}" for n, v in enumerate(_SCENES["pools"]["dish"]))
SQL["generate_draws"] = f"select 'dn_' || lpad(i::varchar, 4, '0') as id, {_number('keep')} as keep, {_picked(_SCENES['pools'], 'drink')} as drink, {_picked(_SCENES['pools'], 'drink', True)} as other_drink, array_to_string(list_transform(list_sort([{_MENU}])[1:3], lambda x: x.v), '|') as menu, {_number('push')} < {int(generate.PUSH * (1 << 32))} as push from range(1, 1001) r(i)"
SQL["jsonl_render"] = f"with {_PAIRS} select 0 as place, '{{\"type\":\"summary\",\"n\":' || count(*) || ',\"n_a\":' || count(*) filter (winner = 'A') || ',\"n_b\":' || count(*) filter (winner = 'B') || ',\"n_tie\":' || count(*) filter (winner = 'tie') || '}}' as line from pairs union all select 1, to_json({{'type': 'result', 'result_id': result_id, 'category': category, 'capability': capability, 'winner': winner, 'score_a': score_a, 'score_b': score_b}})::varchar from pairs"
_DUMPED = "coalesce(to_json(t)::varchar, 'null')"
SQL["simulated_run"] = f"""with recursive c as (select case_key, category, coalesce(turns, []) as turns from test_cases),
a as (select *, array_to_string(list_transform(turns, lambda t: '{{"content": ' || {_DUMPED} || ', "role": "user"}}'), ', ') as said from c),
n as (select case_key, category, len(turns) as n, ('0x' || substr(md5('["one", [' || said || ']]'), 1, 8))::bigint % 97 as x, ('0x' || substr(md5('["two", [' || said || ']]'), 1, 8))::bigint % 97 as y from a),
l as (select case_key, category, length('one answers ' || n || ' messages, variant ' || x || '.') % 11 as a, length('two answers ' || n || ' messages, variant ' || y || '.') % 11 as b from n),
v as (select *, case when a + 0.5 > b then 'A' when a + 0.5 < b then 'B' else 'tie' end as ab, case when b + 0.5 > a then 'B' when b + 0.5 < a then 'A' else 'tie' end as ba, (least(10, a + 0.5) + least(10, a))::double / 2 as sa, (least(10, b) + least(10, b + 0.5))::double / 2 as sb from l),
w as (select category, case when ab = ba then ab else 'tie' end as winner, format('{{:.1f}}', sa)::double as score_a, format('{{:.1f}}', sb)::double as score_b from v),
long as (select category, 'chat_completion' as capability, 'custom/one' as model_name, case winner when 'A' then 'win' when 'B' then 'loss' else 'tie' end as outcome, score_a as score from w union all select category, 'chat_completion', 'custom/two', case winner when 'B' then 'win' when 'A' then 'loss' else 'tie' end, score_b from w)
select case when grouping(capability) = 0 then 'capability' when grouping(category) = 0 then 'category' else 'model' end as level, model_name, capability, category, {_COUNTS}, round(avg(score), 6) as avg_score from long group by grouping sets ((model_name), (model_name, capability), (model_name, category))"""
_SAID = r"""with v as (select line_id, payload::json as j from result_lines where json_valid(payload)), x as (select line_id, coalesce(json_extract(j, '$.raw_ab'), json_extract(j, '$.data.raw_ab')) as x from v),
o as (select line_id, try_cast(regexp_replace(x ->> '$', '^\s*```(json)?\s*|\s*```\s*$', '', 'g') as json) as o from x where json_type(x) = 'VARCHAR'),
p as (select line_id, o, case when o ->> '$.winner' in ('A', 'B', 'tie') then o ->> '$.winner' else 'tie' end as winner, coalesce(least(greatest(try_cast(o ->> '$.score_A' as double), 0.0), 10.0), 0.0) as score_a, coalesce(least(greatest(try_cast(o ->> '$.score_B' as double), 0.0), 10.0), 0.0) as score_b from o)"""
SQL["judge_parse_native"] = f"{_SAID} select line_id, winner, score_a, score_b from p"
SQL["judge_parse"] = f"{_SAID} select line_id, winner, score_a, score_b, cast(case when o is null then 1 when json_type(o, '$.reasons') is null then 0 when json_type(o, '$.reasons') = 'ARRAY' then least(8, json_array_length(o, '$.reasons')) else 1 end as bigint) as n_reasons from p"
