import itertools
import json
import math

from hypothesis import given
from hypothesis import strategies as st

from pairloom.functions import verdict
from pyspark.sql import functions as F

GOOD = '{"winner":"A","score_A":7,"score_B":3,"reasons":["x"]}'


def test_reading():
    want = ("A", 7.0, 3.0, ["x"])
    for t in (GOOD, f"```json\n{GOOD}\n```", f"```\n{GOOD}\n```", f"See: ```json {GOOD}```"):
        assert verdict.read_verdict(t) == want
    for t in (None, "", "null", f"```python\n{GOOD}\n```", f"```JSON\n{GOOD}\n```", GOOD + " done", GOOD.replace('"', "'"), f"```json\n{GOOD}"):
        assert verdict.read_verdict(t) is None
    for t in ("5", "[1]", '"A"'):
        assert verdict.read_verdict(t)[:3] == ("tie", 0.0, 0.0)
    assert verdict.read_verdict('{"winner":"a","score_A":1,"winner":"B"}')[0] == "B"
    assert len(verdict.read_verdict(json.dumps({"reasons": list(range(9))}))[3]) == 8
    assert verdict.read_verdict('{"reasons": "one"}')[3] == ["one"]


def test_clamping():
    for x, want in ((-1, 0), (11, 10), ("7.5", 7.5), (True, 1), (None, 0), ("x", 0), ([1], 0), (math.inf, 10)):
        assert verdict.clamp(x) == want
    assert math.isnan(verdict.clamp(math.nan))


@given(st.text())
def test_reading_never_fails(text):
    found = verdict.read_verdict(text)
    assert found is None or found[0] in verdict.WINNERS


def test_reconciling_all_nine(spark):
    both = [(a, b) for a, b in itertools.product(["A", "B", "tie"], repeat=2)]
    df = spark.createDataFrame(both, "ab string, ba string").select("ab", "ba", verdict.agreed(F.col("ab"), F.col("ba")).alias("w"))
    assert {(r.ab, r.ba): r.w for r in df.collect()} == {(a, b): "A" if (a, b) == ("A", "B") else "B" if (a, b) == ("B", "A") else "tie" for a, b in both}


def test_expressions_agree_with_python(spark):
    texts = [GOOD, f"```json\n{GOOD}\n```", f"a ```\n{GOOD}\n```", '{"winner":"B","score_A":"8.5","score_B":-2}', '{"winner":"x","score_A":true,"score_B":99}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    native = df.select(verdict.native_verdict(F.col("t")).alias("v")).collect()
    udf = df.select(verdict.parse_verdict(F.col("t")).alias("v")).collect()
    assert [(n.v.winner, n.v.score_a, n.v.score_b) for n in native] == [(u.v.winner, u.v.score_a, u.v.score_b) for u in udf]


def test_rounding_is_pythons(spark):
    means = sorted({(a + b) / 20 for a in range(0, 101, 3) for b in range(0, 101, 7)})
    got = spark.createDataFrame([(m,) for m in means], "x double").select("x", verdict.py_round(F.col("x"), 1).alias("r")).collect()
    assert all(r.r == round(r.x, 1) for r in got)


def test_reasons_are_merged_in_order(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"] + list("defgh")), (None, ["x"]), (None, None)], "p array<string>, q array<string>")
    got = [r.m for r in df.select(verdict.merged_reasons(F.col("p"), F.col("q")).alias("m")).collect()]
    assert got == [list("abcdef"), ["x"], []]


def test_rounding_as_python_does(spark):
    import random

    from pyspark.sql import functions as F

    from pairloom.functions import verdict

    rng = random.Random(1)
    values = [a / 10 / 2 + b / 10 / 2 for a in range(0, 101, 3) for b in range(101)] + [rng.uniform(-20, 20) for _ in range(3000)] + [0.15, 2.675, 0.05, 0.25, 0.35, 1e9 + 0.05, -0.05, 5e-324, 0.0] + [k / 1000 for k in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    got = df.select("x", verdict.py_round(F.col("x"), 1).alias("one"), verdict.py_round(F.col("x"), 2).alias("two")).collect()
    for r in got:
        if r.x is None or r.x != r.x:
            assert r.one is None or r.one != r.one
        else:
            assert (r.one, r.two) == (round(r.x, 1), round(r.x, 2)), r.x


def test_text_behind_an_object_is_no_verdict(spark):
    from pyspark.sql import functions as F

    from pairloom.functions import verdict

    good = '{"winner": "A", "score_A": 3}'
    df = spark.createDataFrame([(good,), (good + " trailing",), (good + good,), (good + "," + good,), ("```json\n" + good + "\n```",), ("[1]",)], "t string")
    got = [r.v.winner for r in df.select(verdict.native_verdict(F.col("t")).alias("v")).collect()]
    assert got == ["A", "tie", "tie", "tie", "A", "tie"]
