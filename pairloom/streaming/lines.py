"""Result lines as a stream: delivered again within the watermark they count once, and wins are summed by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, folder: str, schema: str = "line_id bigint, benchmark_id string, line_no int, received_at timestamp, payload string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def winners(lines: DataFrame) -> DataFrame:
    """received_at, benchmark_id, line_no, winner of the lines that are results; works on streams and tables alike."""
    v = F.try_parse_json("payload")
    field = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.try_variant_get("v", f"$.data.{k}", "string"))
    held = lines.withColumn("v", v).filter(F.try_variant_get("v", "$.type", "string") == "result")
    return held.select("received_at", "benchmark_id", "line_no", field("winner").alias("winner"))


def windowed(lines: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Per window and run: results, wins of A and B, ties; a line sent again within `late` counts once."""
    once = winners(lines).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["benchmark_id", "line_no"])
    count = lambda w: F.count_if(F.col("winner") == w)
    return once.groupBy(F.window("received_at", size), "benchmark_id").agg(F.count("*").alias("n"), count("A").alias("wins_a"), count("B").alias("wins_b"), count("tie").alias("ties"))
