from pathlib import Path

from pairloom.session import forget, materialize, small, spread, tables_dir
from pyspark.sql import functions as F


def test_tables_end_lineage_and_can_be_forgotten(spark, rows):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert rows(df) == [(k, 2 * k) for k in range(10)]
    assert "Range" not in df._jdf.queryExecution().toString()
    at = Path(tables_dir(spark).removeprefix("file://"))
    assert at.exists()
    forget(spark)
    assert not at.exists()


def test_only_small_sides_are_broadcast(spark):
    df = materialize(spark.range(1000), "t")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df)) and not hinted(small(df, 10))


def test_tables_of_few_blocks_are_dealt_out(spark, rows):
    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(9)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows(spread(one)) == rows(one)
    assert spread(many) is many
