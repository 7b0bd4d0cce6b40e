"""Quantiles with a bounded rank error by deterministic buffer collapsing (Manku, Rajagopalan and Lindsay 1998).

A sketch is a set of sorted buffers of `size` values, each standing for `weight` values, and one shorter buffer of
weight 1. When `fan` buffers have one weight w they collapse into one of weight fan * w, which takes the values at
evenly spaced positions of the weighted merged order, starting at its middle. Only buffers of equal weight collapse
(the tree), so n values pass at most log_fan(n / size) collapses. A collapse into weight W moves the rank of any value
by at most W / 2; the sum over all collapses made is kept as `err`, a proven bound, near n / (2 size) for each level.
Merging puts the buffers together, fills up the short ones and collapses again; errors add. So the sketches of
partitions and days merge into that of the whole, and below fan * size values nothing collapses: the result is exact.

A sketch is stored long: one row per buffer with key columns, weight, vals and err (on one row per sketch). Each task
first builds sketches of its own rows; rows of equal key then meet and are merged one by one in a stream, so that a
key with any number of partial sketches needs the memory of one.

The value at quantile q is the one of rank max(1, ceil(q * n)). Defined cases: null and NaN values are left out and a
group without values has no row; ties need no care; null keys are a group; an empty table gives an empty sketch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.evaluate import once
from pairloom.session import materialize

SIZE, FAN = 1024, 8


class Sketch:
    """Buffers by weight; the values of weight 1 that fill no buffer are kept apart."""

    def __init__(self, size: int = SIZE, fan: int = FAN):
        self.size, self.fan, self.err = size, fan, 0
        self.full: dict[int, list[np.ndarray]] = {}
        self.loose: list[np.ndarray] = []
        self.n_loose = 0

    def add(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= 2 * self.size:
            self.settle()

    def settle(self) -> None:
        """Cut the loose values into full buffers and collapse."""
        values = np.concatenate(self.loose) if self.loose else np.zeros(0)
        cut = len(values) - len(values) % self.size
        for i in range(0, cut, self.size):
            self.full.setdefault(1, []).append(np.sort(values[i : i + self.size]))
        self.loose, self.n_loose = [values[cut:]], len(values) - cut
        self.collapse()

    def collapse(self) -> None:
        weight = 1
        while any(w >= weight for w in self.full):
            while len(self.full.get(weight, ())) >= self.fan:
                group, self.full[weight] = self.full[weight][: self.fan], self.full[weight][self.fan :]
                merged = np.sort(np.concatenate(group), kind="stable")
                self.full.setdefault(weight * self.fan, []).append(merged[self.fan // 2 :: self.fan][: self.size])
                self.err += weight * self.fan // 2
            weight *= self.fan

    def merge(self, weight: int, values: np.ndarray) -> None:
        """Take in a stored buffer."""
        if weight == 1 and len(values) < self.size:
            self.add(values)
        else:
            self.full.setdefault(weight, []).append(values)
            self.collapse()

    def rows(self) -> Iterator[tuple[int, np.ndarray, int]]:
        """weight, values, err; the whole err is on the first row."""
        self.settle()
        err = self.err
        for w, buffers in [*self.full.items(), (1, self.loose)]:
            for b in buffers:
                if len(b):
                    yield w, b, err
                    err = 0


def key_schema(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def sketch_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*key_schema(df, keys), T.StructField("weight", T.LongType()), T.StructField("vals", T.ArrayType(T.DoubleType())), T.StructField("err", T.LongType())])


def frame(keys: list[str], sketches: Iterable[tuple[tuple, Sketch]]) -> pd.DataFrame:
    return pd.DataFrame([(*k, *row) for k, s in sketches for row in s.rows()], columns=[*keys, "weight", "vals", "err"])


def stored(keys: list[str], types: list[pa.DataType], held: dict[tuple, Sketch]) -> pa.RecordBatch:
    rows = [(k, *row) for k, s in held.items() for row in s.rows()]
    columns = [pa.array([k[i] for k, *_ in rows], t) for i, t in enumerate(types)]
    last = [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *last], [*keys, "weight", "vals", "err"])


def clean(key: object) -> tuple:
    return tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))


def partial(df: DataFrame, keys: list[str], value: str, size: int = SIZE, fan: int = FAN, block_rows: int = 1 << 20) -> DataFrame:
    """The sketches of each task's own rows, taken in blocks of at most about `block_rows`."""
    names = [f"k{i}" for i in range(len(keys))]

    def take(block: list[pa.RecordBatch], held: dict[tuple, Sketch]) -> None:
        groups = pa.Table.from_batches(block).group_by(names, use_threads=False).aggregate([("v", "list")]).combine_chunks()
        vals = groups.column("v_list").chunk(0) if groups.num_rows else pa.array([], pa.list_(pa.float64()))
        flat, ends = vals.values.to_numpy(), vals.offsets.to_numpy()
        for i, key in enumerate(zip(*(groups.column(n).to_pylist() for n in names))):
            held.setdefault(key, Sketch(size, fan)).add(flat[ends[i] : ends[i + 1]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        block, n, types = [], 0, None
        for batch in batches:
            types = [batch.schema.field(k).type for k in names]
            block.append(batch)
            n += batch.num_rows
            if n >= block_rows:
                take(block, held)
                block, n = [], 0
        if n:
            take(block, held)
        if held:
            yield stored(keys, types, held)

    v = F.col(value).cast("double")
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.mapInArrow(build, sketch_schema(df, keys))


def merged(sketches: DataFrame, keys: list[str], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """One sketch per key, from any sketches that hold these keys."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sketch = None, Sketch(size, fan)
        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False):
                key = clean(tuple(row[: len(keys)]))
                if key != now:
                    if now is not None:
                        done.append((now, sketch))
                    now, sketch = key, Sketch(size, fan)
                sketch.merge(row[-3], np.asarray(row[-2], np.float64))
                sketch.err += row[-1]
            if done:
                yield frame(keys, done)
        if now is not None:
            yield frame(keys, [(now, sketch)])

    rows = sketches.select(*keys, "weight", "vals", "err").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(join, sketch_schema(sketches, keys))


def sketch(df: DataFrame, keys: list[str], value: str, size: int = SIZE, fan: int = FAN) -> DataFrame:
    return merged(partial(df, keys, value, size, fan), keys, size, fan)


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, n, a column per entry of `at`, and rank_error: by how many ranks of n a value may be off. The buffers of a key, which
    are as many as one sketch has, are read in a stream."""
    names = list(at)

    def look(key: tuple, buffers: list[tuple]) -> tuple:
        values = np.concatenate([v for _, v, _ in buffers])
        weights = np.concatenate([np.full(len(v), w, np.int64) for w, v, _ in buffers])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        n = int(upto[-1])
        ranks = [max(1, int(np.ceil(round(at[name] * n, 6)))) for name in names]
        found = values[order][np.searchsorted(upto, ranks)]
        return (*key, n, *found.tolist(), sum(e for *_, e in buffers))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, now, held = None, None, []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*types, pa.int64(), *[pa.float64()] * len(names), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*keys, "n", *names, "rank_error"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            weight, err = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 2).to_pylist()
            vals = batch.column(len(keys) + 1)
            done = []
            for i, key in enumerate(zip(*columns)):
                if key != now:
                    if held:
                        done.append(look(now, held))
                    now, held = key, []
                held.append((weight[i], vals[i].values.to_numpy(), err[i]))
            if done:
                yield told(done)
        if held:
            yield told([look(now, held)])

    fields = [*key_schema(sketches, keys), T.StructField("n", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in names), T.StructField("rank_error", T.LongType())]
    rows = sketches.select(*keys, "weight", "vals", "err").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(read, T.StructType(fields))


PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}

ANSWERS = "result_id bigint, capability string, finished_at timestamp_ntz, received_at timestamp_ntz, responses map<string, struct<latency_ms: double, tokens: bigint>>"


def measures(results: DataFrame) -> DataFrame:
    """model_name, capability, day, metric, value of each answer, every result_id once (its first delivery). Latencies
    and token counts that are null, zero or negative say nothing and are left out; huge ones count."""
    first = once(results, "capability", "finished_at", "responses")
    each = first.select("capability", F.to_date("finished_at").alias("day"), F.explode("responses").alias("model_name", "a"))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("double").alias("value")) for m in ("latency_ms", "tokens")))
    return each.select("model_name", "capability", "day", F.inline(pairs)).filter("value > 0")


def daily(results: DataFrame) -> DataFrame:
    """The stored form: sketches of each model, capability, metric and day."""
    return sketch(measures(results), ["model_name", "capability", "metric", "day"], "value")


def percentiles(days: DataFrame) -> DataFrame:
    """level (day or whole), model_name, capability, metric, day (null for the whole), n, percentiles, rank_error: each day read from
    its sketch, and the whole period from the days' sketches merged, without a value read again."""
    held = materialize(days, "days")
    keys = ["model_name", "capability", "metric"]
    shown = ["level", *keys, "day", "n", *PERCENTILES, "rank_error"]
    each = quantiles(held, [*keys, "day"], PERCENTILES).withColumn("level", F.lit("day"))
    total = quantiles(merged(held, keys), keys, PERCENTILES).withColumns({"level": F.lit("whole"), "day": F.lit(None).cast("date")})
    return each.select(shown).union(total.select(shown))
