"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Settings a caller may pass to a new session. Nothing here overrides a running cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench. A cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=DEFAULTS)
    return builder.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none (tests, one machine), one is made and set."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = "file://" + made
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pairloom/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete the tables this application has written to the shared folder; call it when no result is still to be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str, schema: str | None = None) -> DataFrame:
    """One of the driver's tables; `schema` (a DDL string) limits nested fields to those named."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """For steps in Python over a table of few file blocks: its rows dealt out to as many tasks as there are cores. Tables with
    as many blocks are left where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def small(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """Mark df for broadcast only if the optimizer's size statistics, which for files are their sizes, are below the limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit_bytes else df
