"""Cases, results and domains in files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.model import Domain, build, lifted, read_yaml

CASE = "id string, category string, turns array<string>, meta struct<meal_time: string, party_size: int>"
BUILTIN = Path(__file__).parent.parent / "domains"

#: A result document; models and categories are keys, so they are maps.
SUMMARY = "struct<total_test_cases: bigint, overall_winner: string, models: map<string, struct<total_wins: bigint, total_ties: bigint, total_losses: bigint, avg_score: double>>, by_category: map<string, map<string, struct<wins: bigint, ties: bigint>>>>"
RESULT_DOCUMENT = f"benchmark_id string, benchmark_name string, `timestamp` string, duration_seconds double, config struct<domain: string, capabilities: array<string>, models: array<struct<provider: string, model: string, alias: string>>>, summary {SUMMARY}"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file: idx (place in the file, from 0), id, category, turns, meta and raw, the whole record.

    Files come in the order of their names. A missing id is case_<idx> and a missing category `unknown`; explicit nulls stay. Blank lines are skipped. A line
    that is not JSON fails the read. A `turns` that is a string is no list of turns: the case has none.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", place.alias("block"), F.monotonically_increasing_id().alias("at")).filter(~F.col("value").rlike(r"(?U)^\s*$"))
    v = F.parse_json("value")
    held = lines.select("block", "at", v.alias("raw"))

    def field(name: str, kind: str, default) -> F.Column:
        there = F.try_variant_get("raw", f"$.{name}", "variant")
        return F.when(there.isNull(), default).otherwise(F.try_variant_get("raw", f"$.{name}", kind))

    numbered = number(held, "block", "at")
    return numbered.select(
        "idx",
        field("id", "string", F.concat(F.lit("case_"), F.col("idx").cast("string"))).alias("id"),
        field("category", "string", F.lit("unknown")).alias("category"),
        F.coalesce(F.try_variant_get("raw", "$.turns", "array<string>"), F.array().cast("array<string>")).alias("turns"),
        F.struct(F.try_variant_get("raw", "$.meta.meal_time", "string").alias("meal_time"), F.try_variant_get("raw", "$.meta.party_size", "int").alias("party_size")).alias("meta"),
        "raw",
    )


def number(df: DataFrame, block: str, at: str) -> DataFrame:
    """Add idx, 0, 1, 2 ... in the order of blocks (parts of files, in the order of their names) and of `at` inside: counts per
    block, then places inside, whatever the order in which Spark takes the blocks."""
    from pyspark.sql.window import Window

    counts = df.groupBy(block).agg(F.count("*").alias("n__"))
    before = counts.select(block, (F.coalesce(F.sum("n__").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start__"))
    inside = F.row_number().over(Window.partitionBy(block).orderBy(at)) - 1
    return df.withColumn("in__", inside).join(before, block).withColumn("idx", F.col("start__") + F.col("in__")).drop("start__", "in__", at, block)


def write_lines(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines in UTF-8 with nulls kept; `single` puts them into one file, for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result documents with their file names."""
    missing = [p for p in paths if "://" not in p and not Path(p).exists()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return spark.read.option("multiLine", True).schema(RESULT_DOCUMENT).json(list(paths)).withColumn("file", F.input_file_name())


def domain_path(name: str) -> Path:
    """A file, a folder with domain.yaml, or a built-in name."""
    for p in (Path(name), Path(name) / "domain.yaml", BUILTIN / f"{name}.yaml"):
        if p.is_file():
            return p
    raise ValueError(f"no domain {name!r}; built in: {', '.join(domains())}")


def domains() -> list[str]:
    return sorted(p.stem for p in BUILTIN.glob("*.yaml") if not p.stem.endswith(("_scenes", "_cases")))


def read_domain(name: str) -> Domain:
    return build(Domain, lifted(read_yaml(domain_path(name))))


def static_cases(spark: SparkSession, path: str | Path = BUILTIN / "dining_room_cases.yaml") -> DataFrame:
    """idx, id, category, turns of cases written by hand."""
    rows = [(k, c["id"], c.get("category", "unknown"), list(c.get("turns", ()))) for k, c in enumerate(read_yaml(path)["cases"])]
    return spark.createDataFrame(rows, "idx bigint, id string, category string, turns array<string>")


def domain_catalog(spark: SparkSession) -> DataFrame:
    rows = [(d.name, d.description, d.version, len(d.personas)) for d in map(read_domain, domains())]
    return spark.createDataFrame(rows, "name string, description string, version string, n_personas int")
