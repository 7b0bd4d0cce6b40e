"""Queries over exported result lines (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import flatten
from pairloom.session import read, spread


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.children_found(spread(read(spark, sf_dir, "result_lines")))


def table(name: str):
    """A query for one of the flat tables: keys, places and inlined columns."""

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        shredded, graph, own = flatten.flatten(spread(read(spark, sf_dir, "result_lines")), "line_id", "payload", flatten.RESULT_LINES, only=name)
        return flatten.tables(shredded, graph, own)[name]

    return rows


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and parents of each table: children without a parent row would show as orphans."""
    shredded, _, _ = flatten.flatten(spread(read(spark, sf_dir, "result_lines")), "line_id", "payload", flatten.RESULT_LINES, with_fields=False)
    keys = shredded.select(F.col("key").alias("parent_key"), F.lit(1).alias("has"))
    linked = shredded.filter(F.col("parent_key").contains("/")).join(keys, "parent_key", "left")
    return linked.groupBy("child").agg(F.count("*").alias("n_rows"), F.countDistinct("parent_key").alias("n_parents"), F.count_if(F.col("has").isNull()).alias("n_orphans"))


#: Query name -> table; raw_ab and raw_ba share the tables of verdicts, their column `child` tells them apart.
TABLES = {
    "p6_responses": "responses",
    "p6_tool_calls": "responses_tool_calls",
    "p6_tool_call_tags": "responses_tool_calls_tags",
    "p6_judge_reasons": "judge_reasons",
    "p6_verdicts": "verdict",
    "p6_verdict_reasons": "verdict_reasons",
    "p6_verdict_attempts": "verdict_attempts",
    "p6_verdict_issues": "verdict_attempts_issues",
}

QUERIES = {"p6_found": p6_found, **{q: table(t) for q, t in TABLES.items()}, "p6_links": p6_links}

#: The lines' child records in SQL: `el`, `rs`, `de` and `k` hold them with their values, `allof` all of them.
_TREE = r"""
        with v as (select line_id, payload::json as j from result_lines where json_valid(payload)),
        t as (select line_id, j, case when json_type(j, '$.data') = 'OBJECT' then json_extract(j, '$.data') else j end as d from v where json_type(j) = 'OBJECT' and json_extract_string(j, '$.type') = 'result'),
        b as (select line_id, coalesce(json_extract(d, '$.responses'), json_extract(j, '$.responses')) as r, coalesce(json_extract(d, '$.judge_reasons'), json_extract(j, '$.judge_reasons')) as q,
          coalesce(json_extract(d, '$.raw_ab'), json_extract(j, '$.raw_ab')) as ab, coalesce(json_extract(d, '$.raw_ba'), json_extract(j, '$.raw_ba')) as ba from t),
        k0 as (select line_id, 'raw_ab' as k, ab as x from b union all select line_id, 'raw_ba', ba from b),
        k1 as (select line_id, k, case when json_type(x) = 'OBJECT' then x when json_type(x) = 'VARCHAR' then try_cast(regexp_replace(x ->> '$', '^\s*```[^\n`{\[]*\s*|\s*```\s*$', '', 'g') as json) end as x from k0),
        k as (select line_id, k, x from k1 where json_type(x) = 'OBJECT' and len(json_keys(x)) > 0),
        many as (
          select line_id, 'judge_reasons' as child, -1 as parent_pos, q as x from b
          union all select line_id, k || '.reasons', -1, json_extract(x, '$.reasons') from k
          union all select line_id, k || '.attempts', -1, json_extract(x, '$.attempts') from k),
        e as (select line_id, child, parent_pos, x, json_type(x) as ty from many where x is not null),
        el as (
          select line_id, child, parent_pos, i as pos, json_extract(x, '$[' || i || ']') as y from (select *, unnest(range(json_array_length(x)::bigint)) as i from e where ty = 'ARRAY')
          union all select line_id, child, parent_pos, 0, x from e where ty not in ('ARRAY', 'NULL') and x::varchar not in ('""', '{}')),
        rs as (
          select line_id, i as pos, json_extract(r, '$[' || i || ']') as y, null::varchar as n from (select *, unnest(range(json_array_length(r)::bigint)) as i from b where json_type(r) = 'ARRAY')
          union all select line_id, i - 1, json_extract(r, '$."' || n || '"'), n from (select line_id, r, unnest(json_keys(r)) as n, unnest(range(1, len(json_keys(r))::bigint + 1)) as i from b where json_type(r) = 'OBJECT')),
        deep as (
          select line_id, 'responses.tool_calls' as child, pos as parent_pos, json_extract(y, '$.tool_calls') as x from rs where json_type(y) = 'OBJECT'
          union all select line_id, child || '.issues', pos, json_extract(y, '$.issues') from el where child like '%.attempts' and json_type(y) = 'OBJECT'),
        de as (
          select line_id, child, parent_pos, i as pos, json_extract(x, '$[' || i || ']') as y from (select *, unnest(range(json_array_length(x)::bigint)) as i from deep where json_type(x) = 'ARRAY')
          union all select line_id, child, parent_pos, 0, x from deep where json_type(x) not in ('ARRAY', 'NULL') and x::varchar not in ('""', '{}')),
        allof as (
          select line_id, child, parent_pos, pos, y from el union all select line_id, child, parent_pos, pos, y from de
          union all select line_id, 'responses', -1, pos, y from rs union all select line_id, k, -1, 0, x from k)"""
#: Entries of the tags of tool calls, and the text of a value.
_TAGS = r""",
        tg as (select line_id, parent_pos as rp, pos as tp, json_extract(y, '$.function.arguments.tags') as x from de where child = 'responses.tool_calls' and json_type(y) = 'OBJECT'),
        te as (
          select line_id, rp, tp, i as pos, json_extract(x, '$[' || i || ']') as y from (select *, unnest(range(json_array_length(x)::bigint)) as i from tg where json_type(x) = 'ARRAY')
          union all select line_id, rp, tp, 0, x from tg where json_type(x) not in ('ARRAY', 'NULL') and x::varchar not in ('""', '{}'))"""
_SHOWN = "case when json_type(y) = 'VARCHAR' then y ->> '$' else y::varchar end"
_VALUE = f"{_SHOWN} as c_value"
_KEPT = "json_type(y) <> 'NULL'"


def _members(value: str, *paths: str) -> str:
    """The text of members of a JSON value, as columns."""
    one = "case json_type({v}, '$.{p}') when 'NULL' then null when 'OBJECT' then null when 'VARCHAR' then {v} ->> '$.{p}' else json_extract({v}, '$.{p}')::varchar end as \"c_{c}\""
    return ", ".join(one.format(v=value, p=p, c=p.replace(".", "_")) for p in paths)


def _rows(source: str, child: str, key: str, parent: str, parent_pos: str, pos: str, member: str, columns: str) -> str:
    return f"select line_id as id, {child} as child, {key} as key, {parent} as parent_key, cast({parent_pos} as integer) as parent_pos, cast({pos} as integer) as pos, {member} as member, {columns} from {source}"


SQL = {
    "p6_responses": f"{_TREE} " + _rows(f"rs where {_KEPT}", "'responses'", "line_id || '/responses:' || pos", "line_id::varchar", "-1", "pos", "n", _members("y", "latency_ms", "model", "response", "score", "tokens", "usage.completion_tokens", "usage.prompt_tokens")),
    "p6_tool_calls": f"{_TREE} " + _rows(f"de where child = 'responses.tool_calls' and {_KEPT}", "child", "line_id || '/responses:' || parent_pos || '/tool_calls:' || pos", "line_id || '/responses:' || parent_pos", "parent_pos", "pos", "null::varchar", _members("y", "function.arguments.table", "function.arguments", "function.name", "id")),
    "p6_verdicts": f"{_TREE} " + _rows("k", "k", "line_id || '/' || k || ':0'", "line_id::varchar", "-1", "0", "null::varchar", _members("x", "score_A", "score_B", "winner")),
    "p6_verdict_attempts": f"{_TREE} " + _rows(f"el where child like '%.attempts' and {_KEPT}", "child", "line_id || '/' || child[1:6] || ':0/attempts:' || pos", "line_id || '/' || child[1:6] || ':0'", "-1", "pos", "null::varchar", _members("y", "n", "ok", "text")),
    "p6_verdict_issues": f"{_TREE} " + _rows(f"de where child like '%.issues' and {_KEPT}", "child", "line_id || '/' || child[1:6] || ':0/attempts:' || parent_pos || '/issues:' || pos", "line_id || '/' || child[1:6] || ':0/attempts:' || parent_pos", "parent_pos", "pos", "null::varchar", _members("y", "at", "code")),
    "p6_found": f"{_TREE} select line_id, child, cast(parent_pos as integer) as parent_pos, cast(pos as integer) as pos from allof where {_KEPT}",
    "p6_judge_reasons": f"{_TREE} select line_id as id, child, line_id || '/judge_reasons:' || pos as key, line_id::varchar as parent_key, -1 as parent_pos, cast(pos as integer) as pos, null::varchar as member, case when json_type(y) = 'OBJECT' then y ->> '$.text' end as c_text, case when json_type(y) = 'OBJECT' then y ->> '$.weight' end as c_weight, case when json_type(y) <> 'OBJECT' then {_SHOWN} end as c_value from el where child = 'judge_reasons' and {_KEPT}",
    "p6_verdict_reasons": f"{_TREE} select line_id as id, child, line_id || '/' || child[1:6] || ':0/reasons:' || pos as key, line_id || '/' || child[1:6] || ':0' as parent_key, -1 as parent_pos, cast(pos as integer) as pos, null::varchar as member, {_VALUE} from el where child like '%.reasons' and {_KEPT}",
    "p6_tool_call_tags": f"{_TREE}{_TAGS} select line_id as id, 'responses.tool_calls.function.arguments.tags' as child, line_id || '/responses:' || rp || '/tool_calls:' || tp || '/tags:' || pos as key, line_id || '/responses:' || rp || '/tool_calls:' || tp as parent_key, cast(tp as integer) as parent_pos, cast(pos as integer) as pos, null::varchar as member, {_VALUE} from te where {_KEPT}",
    "p6_links": f"""{_TREE}{_TAGS}, rows as (
          select child, line_id || '|' || case when parent_pos < 0 then '' else parent_pos::varchar end as parent from allof where {_KEPT} and child not in ('responses', 'judge_reasons', 'raw_ab', 'raw_ba')
          union all select 'responses.tool_calls.function.arguments.tags', line_id || '|' || rp || '|' || tp from te where {_KEPT})
        select child, count(*) as n_rows, count(distinct parent) as n_parents, 0::bigint as n_orphans from rows group by child""",
}
