import json

import pytest

from pairloom.functions import text
from pairloom.model import Benchmark, DomainSchema, Judge, Model, Settings
from pairloom.operators import engine, evaluate, generate, report
from pairloom.operators.providers import NUDGE, Route, Simulated, SimulatedJudge, ask_judge
from pairloom.sources import files
from pairloom.streaming import lines as streaming
from pyspark.sql import functions as F

MODELS = (Model("custom", "one", "First"), Model("custom", "two"))


def config(**more):
    return Benchmark("t", MODELS, judge=Judge("custom", "j"), **more)


def run(spark, judge=SimulatedJudge, **more):
    cases = generate.generate(spark, 30, 1).select("idx", "id", "category", "turns")
    return engine.run(cases, config(**more), [Route(m.display_name, m.model, Simulated) for m in MODELS], judge)


class ShownFirst:
    def chat_completion(self, model, messages, **options):
        return {"content": '{"winner": "A", "score_A": 9, "score_B": 1, "reasons": []}'}


def test_a_run_adds_up(spark):
    done = run(spark)
    doc = done.document()
    models = doc["summary"]["models"]
    a, b = models["First"], models["custom/two"]
    assert a["total_wins"] == b["total_losses"] and a["total_ties"] == b["total_ties"]
    assert a["total_wins"] + a["total_ties"] + a["total_losses"] == 30 == doc["summary"]["total_test_cases"]
    assert sum(x["First"]["wins"] for x in doc["summary"]["by_category"].values()) == a["total_wins"]
    assert "First" in report.markdown(doc) and "winner:" in report.console(doc)


def test_a_judge_that_prefers_the_first_place_makes_ties(spark):
    s = run(spark, ShownFirst).document()["summary"]
    assert s["models"]["First"]["total_ties"] == 30 and s["overall_winner"] == "tie"


def test_each_answer_is_asked_for_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    class Counting(Simulated):
        def chat_completion(self, model, messages, **options):
            import uuid

            (log / uuid.uuid4().hex).touch()
            return super().chat_completion(model, messages, **options)

    cases = generate.generate(spark, 12, 1).select("idx", "id", "category", "turns")
    done = engine.run(cases, config(), [Route(m.display_name, m.model, Counting) for m in MODELS], SimulatedJudge)
    done.summary()
    done.pairs.filter("tokens_a > 0").count()
    assert len(list(log.iterdir())) == 24


def test_limits_and_settings_are_checked_first(spark):
    assert run(spark, settings=Settings(max_items=5)).n_cases == 5
    assert run(spark, settings=Settings(max_items=0)).n_cases == 30
    for bad in (lambda: Settings(max_items=-1), lambda: Benchmark("x", MODELS[:1]).check(), lambda: Benchmark("x", (MODELS[0], MODELS[0])).check(), lambda: config(capabilities=("smell",)).check(), lambda: Model.parse("none/x"), lambda: Model.parse("openai")):
        with pytest.raises(ValueError):
            bad()


def test_the_judge_is_asked_again():
    class Late:
        said = 0

        def chat_completion(self, model, messages, **options):
            self.said += 1
            assert messages[-1]["content"] == (NUDGE if self.said > 1 else "q")
            return {"content": "hm" if self.said < 3 else '{"winner": "B"}'}

    assert ask_judge(Late(), "m", "q") == (("B", 0.0, 0.0, []), 3)
    verdict, n = ask_judge(type("Never", (), {"chat_completion": lambda *a, **k: {"content": "no"}})(), "m", "q")
    assert verdict[0] == "tie" and n == 3 and "no" in verdict[3][0]


def test_reports_and_comparison(spark, tmp_path):
    done = run(spark)
    at = report.save(done, ("json", "jsonl", "markdown"), str(tmp_path), "r")
    told = spark.read.text(at["jsonl"]).collect()
    assert len(told) == 31 and sum(json.loads(r.value)["type"] == "summary" for r in told) == 1
    first = min(p for p in __import__("pathlib").Path(at["jsonl"]).iterdir() if p.name[0] not in "._")
    assert json.loads(first.read_text().splitlines()[0])["type"] == "summary"
    assert "orderBy" not in report.lines(done.details())._jdf.queryExecution().toString() and report.lines(done.details()).count() == 30
    rows = evaluate.compare(files.read_results(spark, at["json"]))
    assert rows.first().model_1 == "First" and rows.first().wins_1 == done.summary()["models"]["First"]["total_wins"]
    for form in ("table", "json", "markdown"):
        assert "First" in report.comparison(rows, form)
    with pytest.raises(FileNotFoundError):
        files.read_results(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        report.save(done, ("pdf",), str(tmp_path), "r")


def test_no_cases(spark):
    cases = generate.generate(spark, 3, 1).select("idx", "id", "category", "turns").filter("false")
    done = engine.run(cases, config(), [Route(m.display_name, m.model, Simulated) for m in MODELS], SimulatedJudge)
    s = done.summary()
    assert s["models"]["First"]["total_wins"] == 0 and s["overall_winner"] == "tie" and s["total_test_cases"] == 0
    assert [tuple(r)[0] for r in evaluate.with_zeros(evaluate.summary(done.pairs), ["First", "custom/two"]).orderBy("slot").collect()] == ["First", "custom/two"]


def test_reading_cases(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"turns": ["a", "ü"], "extra": 1}\n\n   \n{"id": null, "category": null, "turns": []}\n{"id": "x", "category": "c", "turns": "abc", "meta": {"party_size": 4}}\n', encoding="utf-8")
    got = files.read_cases(spark, str(f)).orderBy("idx").collect()
    assert [(r.idx, r.id, r.category, r.turns) for r in got] == [(0, "case_0", "unknown", ["a", "ü"]), (1, None, None, []), (2, "x", "c", [])]
    assert got[2].meta.party_size == 4
    files.write_lines(spark.createDataFrame([(None, "ü")], "a string, b string"), str(tmp_path / "o"), single=True)
    assert json.loads(spark.read.text(str(tmp_path / "o")).first().value) == {"a": None, "b": "ü"}
    f.write_text("{", encoding="utf-8")
    with pytest.raises(Exception):
        files.read_cases(spark, str(f)).collect()


def test_domains_and_settings_files(tmp_path, spark):
    assert files.domains() == ["dining_room"] and files.read_domain("dining_room").system_prompt
    assert files.domain_catalog(spark).count() == 1
    with pytest.raises(ValueError):
        files.read_domain("nowhere")
    strict = DomainSchema.from_yaml(files.domain_path("dining_room"))
    strict.to_yaml(tmp_path / "d.yaml")
    assert DomainSchema.from_yaml(tmp_path / "d.yaml") == strict and strict.to_domain().name == "dining_room"
    config(settings=Settings(max_items=3)).to_yaml(tmp_path / "b.yaml")
    assert Benchmark.from_yaml(tmp_path / "b.yaml") == config(settings=Settings(max_items=3))


def test_generator(spark, rows):
    one = generate.generate(spark, 100, 7)
    assert rows(one) == rows(generate.generate(spark, 100, 7).repartition(3))
    counts = {r.category: r["count"] for r in one.groupBy("category").count().collect()}
    assert len(counts) == len(generate.scenes()["scenes"]) and sorted(counts.values()) == [12] * 4 + [13] * 4
    assert all(3 <= len(r.turns) <= 6 and not any("{" in t for t in r.turns) for r in one.collect())
    made = spark.createDataFrame([("s", ["{a} and {b}", "plain"], {"a": ["1", "2"], "b": ["x"]})], "id string, templates array<string>, variables map<string,array<string>>")
    assert {r.text for r in generate.expand(made).collect()} == {"1 and x", "2 and x", "plain"}


def test_draws_without_replacement(spark):
    draws = generate.Draws(3, F.col("id"))
    pool = ["a", "b", "c", "d", "e"]
    got = spark.range(200).select(draws.sample(pool, 3, "x").alias("s"), draws.pick(pool, "y").alias("p"), draws.other(pool, "y").alias("o")).collect()
    assert all(len(set(r.s)) == 3 and set(r.s) <= set(pool) and r.p != r.o for r in got) and len({tuple(r.s) for r in got}) > 30


def test_hand_written_cases(spark):
    got = files.static_cases(spark)
    assert got.count() >= 5 and got.filter("size(turns) = 0").isEmpty()


def test_evaluators(spark):
    with pytest.raises(NotImplementedError):
        evaluate.Evaluator().evaluate(F.lit("x"), F.lit("x"))
    got = spark.range(1).select(evaluate.Rules().evaluate(F.lit(" x"), F.lit("x")).alias("v")).first().v
    assert got.score == 1.0 and got.passed and got.reasons == ["exact match"]


def test_calls_to_services_are_spaced_and_use_their_keys(spark, monkeypatch):
    from pairloom.operators import providers

    assert providers.pause("openai", 0.2) == 0.2 and providers.pause("simulated", 0.2) == 0.0
    assert providers.provider("openai", "MY_KEY")().key_env == "MY_KEY" and providers.provider("openai")().key_env == "OPENAI_API_KEY"
    monkeypatch.delenv("MY_KEY", raising=False)
    with pytest.raises(ValueError):
        providers.provider("openai", "MY_KEY")().key()
    import time

    began = time.perf_counter()
    cases = generate.generate(spark, 6, 1).select("idx", "id", "category", "turns").coalesce(1)
    engine.run(cases, config(), [Route(m.display_name, m.model, Simulated, pause=0.1) for m in MODELS], SimulatedJudge).pairs.count()
    assert time.perf_counter() - began > 1.2  # twelve calls


def test_files_come_in_the_order_of_their_names(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("".join(f'{{"id": "b{k}"}}\n' for k in range(3000)), encoding="utf-8")  # Spark takes larger files first
    (tmp_path / "a.jsonl").write_text('{"id": "a0"}\n{"id": "a1"}\n', encoding="utf-8")
    got = files.read_cases(spark, str(tmp_path)).orderBy("idx").select("id").limit(3).collect()
    assert [r.id for r in got] == ["a0", "a1", "b0"]


def test_text_rules(spark):
    df = spark.createDataFrame([("  yes\n", "yes", ["Y", "no"]), ("Yes", "yes", []), (None, None, None), ("x", "", ["x", "X"])], "r string, e string, k array<string>")
    got = df.select(text.rule_result(F.col("r"), F.col("e"), F.col("k")).alias("v")).collect()
    assert [(r.v.score, r.v.passed) for r in got] == [(1.0, True), (0.0, False), (0.0, False), (1.0, True)]


def test_streamed_lines_count_once(spark, tmp_path):
    line = json.dumps({"type": "result", "winner": "A"})
    data = [(1, "b", 1, "2026-01-01 10:00:00", line), (2, "b", 1, "2026-01-01 10:10:00", line), (3, "b", 2, "2026-01-01 11:00:00", json.dumps({"type": "result", "data": {"winner": "tie"}})), (4, "b", 3, "2026-01-03 00:00:00", "{"), (5, "c", 1, "2026-01-05 00:00:00", line)]
    df = spark.createDataFrame(data, "line_id bigint, benchmark_id string, line_no int, received_at string, payload string").withColumn("received_at", F.to_timestamp("received_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streaming.windowed(streaming.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("won").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.benchmark_id, r.n, r.wins_a, r.ties) for r in spark.table("won").collect()] == [("b", 2, 1, 1)]
