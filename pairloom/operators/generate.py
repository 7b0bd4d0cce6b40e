"""Seeded test cases from scenes, as expressions: the same rows whatever the number of partitions.

Every draw is a digest of (seed, row, slot), so rows are independent and need no shared random stream. Categories are
balanced: each appears n // k times, the first n % k once more, in the order of a seeded digest. The scenes stand in a data
file (see domains/dining_room_scenes.yaml).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.functions.text import case_id
from pairloom.model import read_yaml

SCENES = Path(__file__).parent.parent / "domains" / "dining_room_scenes.yaml"
SLOT = re.compile(r"\{(other )?(\w+)\}")

#: How often a push is added, and how many turns a case has at least and at most.
PUSH, LEAST, MOST = 0.25, 3, 6


@cache
def scenes(path: str | Path = SCENES) -> dict:
    """pools, pushes and scenes of a file; every scene has LEAST steps that are never left out."""
    raw = read_yaml(path)
    for name, steps in raw["scenes"].items():
        if sum("chance" not in s for s in steps) < LEAST:
            raise ValueError(f"{name} needs {LEAST} steps without a chance")
    return raw


@dataclass(frozen=True)
class Draws:
    """Draws for the row numbered `i`."""

    seed: int
    i: Column

    def number(self, slot: str | Column) -> Column:
        """32 bits of the digest of seed, row and slot."""
        text = F.concat(F.lit(f"{self.seed}|"), self.i.cast("string"), F.lit("|"), F.lit(slot) if isinstance(slot, str) else slot)
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    def pick(self, pool: list[str], slot: str) -> Column:
        return F.element_at(F.array(*map(F.lit, pool)), (self.number(slot) % len(pool) + 1).cast("int"))

    def other(self, pool: list[str], slot: str) -> Column:
        """A value different from that of `pick` with the same slot."""
        at = (self.number(slot) + 1 + self.number(f"{slot}|other") % (len(pool) - 1)) % len(pool)
        return F.element_at(F.array(*map(F.lit, pool)), (at + 1).cast("int"))

    def sample(self, pool: list[str], k: int, slot: str) -> Column:
        """k different values: the pool in the order of a digest, cut off."""
        keyed = F.array(*(F.struct(self.number(f"{slot}|{n}").alias("d"), F.lit(n).alias("n"), F.lit(v).alias("v")) for n, v in enumerate(pool)))
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["v"])

    def chance(self, p: float, slot: str) -> Column:
        return self.number(slot) < int(p * (1 << 32))


def fill(template: str, pools: dict[str, list[str]], draws: Draws) -> Column:
    out = F.lit(template)
    for mark in dict.fromkeys(m[0] for m in SLOT.finditer(template)):
        other, slot = SLOT.fullmatch(mark).groups()
        out = F.replace(out, F.lit(mark), (draws.other if other else draws.pick)(pools[slot], slot))
    return out


def turns_of(name: str, raw: dict, draws: Draws) -> Column:
    """The steps of a scene, some by chance, and at times a push; LEAST to MOST turns are kept."""
    parts = []
    for k, step in enumerate(raw["scenes"][name]):
        ways = F.array(*(fill(t, raw["pools"], draws) for t in step["say"]))
        said = F.element_at(ways, (draws.number(f"{name}|{k}") % len(step["say"]) + 1).cast("int"))
        parts.append(F.when(draws.chance(step["chance"], f"{name}|{k}|in"), said) if "chance" in step else said)
    parts.append(F.when(draws.chance(PUSH, "push"), draws.pick(raw["pushes"], "which")))
    return F.slice(F.array_compact(F.array(*parts)), F.lit(1), (F.lit(LEAST) + draws.number("keep") % (MOST - LEAST + 1)).cast("int"))


def categories(numbers: DataFrame, names: tuple[str, ...], seed: int, n: int) -> DataFrame:
    """Add category, balanced. Row r of the seeded order takes name r % k; the order is a digest, ranked in blocks."""
    digest = Draws(seed, F.col("i")).number("order")
    blocks = max(1, n // 100_000)
    placed = numbers.withColumn("d", digest).withColumn("block", (F.col("d") * blocks / (1 << 32)).cast("int"))
    counts = placed.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("block", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("d", "i")) - 1
    ranked = placed.withColumn("place", place).join(starts, "block")
    return ranked.select("i", F.element_at(F.array(*map(F.lit, names)), ((F.col("start") + F.col("place")) % len(names) + 1).cast("int")).alias("category"))


def generate(spark: SparkSession, n: int = 100, seed: int = 42, prefix: str = "dn", path: str | Path = SCENES) -> DataFrame:
    """idx, id, category, turns, meta of n cases."""
    raw = scenes(path)
    names = tuple(raw["scenes"])
    rows = categories(spark.range(1, n + 1).select(F.col("id").alias("i")), names, seed, n)
    draws = Draws(seed, F.col("i"))
    turns: Column = F.lit(None)
    for c in names:
        turns = F.when(F.col("category") == c, turns_of(c, raw, draws)).otherwise(turns)
    meta = F.struct(draws.pick(raw["pools"]["season"], "meta_time").alias("meal_time"), (draws.number("meta_size") % 6 + 1).cast("int").alias("party_size"))
    return rows.select((F.col("i") - 1).alias("idx"), case_id(prefix, F.col("i")).alias("id"), "category", turns.alias("turns"), meta.alias("meta"))


def expand(scenarios: DataFrame) -> DataFrame:
    """Every template of a scenario (id, templates, variables map) with every combination of its variables' values."""
    one = scenarios.select("id", F.explode("templates").alias("text"), "variables", F.array_sort(F.map_keys("variables")).alias("names"))

    def step(acc: Column, name: Column) -> Column:
        mark = F.concat(F.lit("{"), name, F.lit("}"))
        return F.flatten(F.transform(acc, lambda t: F.when(F.contains(t, mark), F.transform(F.col("variables")[name], lambda v: F.replace(t, mark, v))).otherwise(F.array(t))))

    return one.select("id", F.explode(F.aggregate("names", F.array("text"), step)).alias("text"))
