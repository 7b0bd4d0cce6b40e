import json

from pairloom.operators import flatten
from pairloom.plans import nested
from pairloom.session import read

LINE = {
    "type": "result",
    "responses": {"m1": {"response": "x", "usage": {"prompt_tokens": 3}, "tool_calls": [{"id": 1}, None, {"id": 2}]}, "m2": None, "m3": {"tool_calls": {"id": 9}}},
    "judge_reasons": ["a", None, "b"],
    "raw_ab": {"winner": "A", "reasons": "one", "attempts": [{"n": 1}, {"n": 2, "issues": [{"code": "q"}, None]}, {"n": 3, "issues": {"code": "f"}}]},
    "raw_ba": '```json\n{"winner": "B", "reasons": ["x", "y"]}\n```',
}


def found(spark, payloads):
    df = spark.createDataFrame([(i, p, 7) for i, p in enumerate(payloads)], "line_id bigint, payload string, child int")
    return {tuple(r) for r in flatten.children_found(df).collect()}


def test_children_of_a_line(spark):
    assert found(spark, [json.dumps(LINE)]) == {
        (0, "responses", -1, 0), (0, "responses", -1, 2), (0, "responses.tool_calls", 0, 0), (0, "responses.tool_calls", 0, 2), (0, "responses.tool_calls", 2, 0),
        (0, "judge_reasons", -1, 0), (0, "judge_reasons", -1, 2), (0, "raw_ab", -1, 0), (0, "raw_ab.reasons", -1, 0),
        (0, "raw_ab.attempts", -1, 0), (0, "raw_ab.attempts", -1, 1), (0, "raw_ab.attempts", -1, 2), (0, "raw_ab.attempts.issues", 1, 0), (0, "raw_ab.attempts.issues", 2, 0),
        (0, "raw_ba", -1, 0), (0, "raw_ba.reasons", -1, 0), (0, "raw_ba.reasons", -1, 1),
    }


def test_lines_that_give_nothing(spark):
    bad = [None, "", "  \n", "{", "[1]", "5", json.dumps({"type": "summary", "judge_reasons": ["a"]}), json.dumps({"judge_reasons": ["a"]}), "[" * 5000, json.dumps({"type": "result", "responses": {}, "judge_reasons": [], "raw_ab": [{"winner": "A"}], "raw_ba": '{"win'})]
    assert found(spark, bad) == set()
    assert found(spark, []) == set()


def test_data_one_level_down_and_lines_sent_twice(spark):
    line = json.dumps({"type": "result", "data": {"judge_reasons": "only"}})
    assert found(spark, [line, line]) == {(0, "judge_reasons", -1, 0), (1, "judge_reasons", -1, 0)}


def test_tables_lead_back_to_parents(spark):
    df = spark.createDataFrame([(1, json.dumps(LINE))], "line_id bigint, payload string")
    rows, graph, own = flatten.flatten(df, "line_id", "payload", flatten.RESULT_LINES)
    tables = flatten.tables(rows, graph, own)
    assert own["raw_ab"] == own["raw_ba"] == "verdict" and own["raw_ab.attempts.issues"] == "verdict_attempts_issues"
    answers = {r.member: r for r in tables["responses"].collect()}
    assert answers["m1"].c_response == "x" and answers["m1"].c_usage_prompt_tokens == "3" and answers["m3"].c_response is None
    keys = {r.key for t in tables.values() for r in t.collect()} | {"1"}
    assert all(r.parent_key in keys for t in tables.values() for r in t.collect())


def test_recursive_elements_get_a_table(spark):
    deep = {"node": {"name": "a", "node": {"name": "b", "node": {"name": "c"}}}}
    df = spark.createDataFrame([(1, json.dumps(deep))], "id bigint, doc string")
    _, graph, own = flatten.flatten(df, "id", "doc", flatten.Shapes())
    assert "node.node" in own and "node" not in own


def test_schema_graph_is_found_in_the_data(spark):
    docs = [{"a": {"b": 1}, "c": [1, 2]}, {"c": {"d": 1}}, {"a": None}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id bigint, doc string")
    rows, graph, own = flatten.flatten(df, "id", "doc", flatten.Shapes())
    assert own == {"c": "c"}
    assert sorted((r.id, r.pos) for r in rows.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_members_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, json.dumps({"c": [{"score": 1, "Score": 2, "id": 3, "key": 4}]}))], "id bigint, doc string")
    rows, graph, own = flatten.flatten(df, "id", "doc", flatten.Shapes())
    row = flatten.tables(rows, graph, own)["c"].first().asDict()
    assert {row.get("c_score"), row.get("c_Score_2")} == {"1", "2"} or {row.get("c_Score"), row.get("c_score_2")} == {"1", "2"}
    assert row["id"] == 1 and row["c_id"] == "3" and row["c_key"] == "4"


def test_every_table_of_the_result_lines_has_a_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows, graph, own = flatten.flatten(read(spark, sf_dir, "result_lines"), "line_id", "payload", flatten.RESULT_LINES)
    tables = flatten.tables(rows, graph, own)
    assert set(nested.TABLES.values()) == set(tables)
    tags = nested.QUERIES["p6_tool_call_tags"](spark, sf_dir).collect()
    assert len(tags) == rows.filter("child like 'responses.tool_calls.%.tags'").count() > 0
    assert all(r.c_value for r in tags) and {r.parent_key for r in tags} <= {r.key for r in tables["responses_tool_calls"].collect()}


def test_types_at_several_places_share_a_table(spark):
    person = {"name": "x", "mail": "y", "age": 3}
    docs = [{"buyer": person, "seller": {"name": "a", "mail": "b"}, "item": {"name": "z", "price": 1}}, {"buyer": {"name": "q", "mail": "r", "tags": ["s"]}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id bigint, doc string")
    rows, graph, own = flatten.flatten(df, "id", "doc", flatten.Shapes(named=(("buyer", "person"),)))
    assert own == {"buyer": "person", "seller": "person", "buyer.tags": "person_tags"}
    got = flatten.tables(rows, graph, own)["person"].select("id", "child", "c_name").collect()
    assert sorted(map(tuple, got)) == [(0, "buyer", "x"), (0, "seller", "a"), (1, "buyer", "q")]


def test_objects_with_free_keys_are_maps(spark):
    """Whether one record has them all or each a few, their keys do not get into the schema."""
    wide = [{"by_key": {f"k{i}_{j}": {"n": j, "parts": {f"p{j}_{k}": 1 for k in range(3)}} for j in range(3)}, "own": {"a": 1}} for i in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(wide)], "id bigint, doc string")
    for part in (df.coalesce(1), df.repartition(16)):
        rows, graph, own = flatten.flatten(part, "id", "doc", flatten.Shapes())
        assert own["by_key"] == "by_key" and set(graph.children["by_key"].children) <= {"n", "parts"} and "own" not in own
        table = flatten.tables(rows, graph, own)["by_key"].collect()
        assert len(table) == 180 and {r.member for r in table} == {f"k{i}_{j}" for i in range(60) for j in range(3)} and {r.c_n for r in table} == {"0", "1", "2"}
