import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import quantiles as q
from pyspark.sql import functions as F


def ranks_of(values, x):
    s = np.sort(values)
    return int(np.searchsorted(s, x, "left")) + 1, int(np.searchsorted(s, x, "right"))


def read(sketch, share):
    rows = list(sketch.rows())
    values = np.concatenate([r[1] for r in rows])
    weights = np.concatenate([np.full(len(r[1]), r[0]) for r in rows])
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    rank = max(1, int(np.ceil(share * upto[-1])))
    return values[order][np.searchsorted(upto, rank)], rank, sum(r[2] for r in rows), int(upto[-1])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=3000), st.sampled_from([0.01, 0.5, 0.9, 1.0]))
def test_the_rank_error_is_within_the_bound(values, share):
    s = q.Sketch(size=16, fan=4)
    for i in range(0, len(values), 37):
        s.add(np.array(values[i : i + 37], float))
    x, rank, err, n = read(s, share)
    low, high = ranks_of(np.array(values, float), x)
    assert n == len(values) and low - err <= rank <= high + err


def test_the_bound_is_small():
    s = q.Sketch()
    rng = np.random.default_rng(1)
    for _ in range(300):
        s.add(rng.lognormal(7, 1, 5000))
    _, _, err, n = read(s, 0.5)
    assert n == 1_500_000 and err / n < 0.004 and sum(len(r[1]) for r in s.rows()) < 64 * q.SIZE


def test_days_merge_into_the_whole(spark):
    rng = np.random.default_rng(2)
    data = [(m, d, float(v)) for m in ("a", None) for d in range(5) for v in rng.integers(0, 1000, 3000)]
    df = spark.createDataFrame(data, "m string, d int, v double").repartition(7)
    days = q.sketch(df, ["m", "d"], "v", size=64, fan=4)
    got = q.quantiles(q.merged(days, ["m"], size=64, fan=4), ["m"], {"p50": 0.5, "p99": 0.99}).collect()
    assert {r.m for r in got} == {"a", None}
    for r in got:
        values = np.array([v for m, _, v in data if m == r.m])
        assert r.n == len(values) == 15000 and r.rank_error < 0.05 * r.n
        for name, share in (("p50", 0.5), ("p99", 0.99)):
            low, high = ranks_of(values, r[name])
            assert low - r.rank_error <= np.ceil(share * r.n) <= high + r.rank_error


def test_small_groups_are_exact_and_odd_values_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("a", None), ("a", float("nan")), ("b", None), ("c", 5.0), ("c", 5.0)], "k string, v double")
    got = {r.k: r for r in q.quantiles(q.sketch(df, ["k"], "v"), ["k"], {"p50": 0.5, "p100": 1.0}).collect()}
    assert set(got) == {"a", "c"} and (got["a"].n, got["a"].p50, got["a"].p100, got["a"].rank_error) == (3, 2.0, 3.0, 0) and got["c"].p50 == 5.0
    assert q.quantiles(q.sketch(df.filter("false"), ["k"], "v"), ["k"], {"p50": 0.5}).count() == 0


def test_answers_count_once(spark):
    row = "result_id bigint, capability string, finished_at timestamp_ntz, received_at timestamp_ntz, responses map<string, struct<latency_ms: double, tokens: bigint>>"
    import datetime as dt

    at = dt.datetime(2026, 1, 1)
    later = dt.datetime(2026, 1, 2)
    data = [(1, "c", at, later, {"m": (9.0, 9)}), (1, "c", at, at, {"m": (5.0, 0)}), (2, "c", at, at, {"m": (0.0, None), "n": (-1.0, 3)}), (3, "c", at, at, {}), (4, "c", None, at, None)]
    got = {(r.model_name, r.metric, r.value) for r in q.measures(spark.createDataFrame(data, row)).collect()}
    assert got == {("m", "latency_ms", 5.0), ("n", "tokens", 3.0)}


def test_days_and_the_whole_period_in_one_result(spark):
    import datetime as dt

    rng = np.random.default_rng(4)
    data = [("m", "c", dt.date(2026, 1, 1 + k % 3), "tokens", float(v)) for k, v in enumerate(rng.integers(1, 500, 30_000))] + [("m", "c", None, "tokens", 7.0)]
    df = spark.createDataFrame(data, "model_name string, capability string, day date, metric string, value double")
    got = q.percentiles(q.sketch(df, ["model_name", "capability", "metric", "day"], "value")).collect()
    assert sorted((r.level, str(r.day), r.n) for r in got) == [("day", "2026-01-01", 10_000), ("day", "2026-01-02", 10_000), ("day", "2026-01-03", 10_000), ("day", "None", 1), ("whole", "None", 30_001)]
    for r in got:
        values = np.array([x[4] for x in data if r.level == "whole" or x[2] == r.day])
        for name, share in q.PERCENTILES.items():
            low, high = ranks_of(values, r[name])
            assert low - r.rank_error <= np.ceil(share * r.n) <= high + r.rank_error


def test_clashing_columns_are_ignored(spark):
    df = spark.range(10).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("weight"), F.lit(2).alias("vals"))
    assert q.quantiles(q.sketch(df, ["k"], "v"), ["k"], {"p50": 0.5}).first().p50 == pytest.approx(4.0)
