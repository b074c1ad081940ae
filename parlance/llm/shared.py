"""What several of the operators need: staging, size-checked broadcasts, reading the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BROADCAST_ROWS = 200_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Written to the folder that all executors share and read back: cuts the lineage,
    survives lost executors, and later reads take only the columns they need."""
    return stage(df)[0]


def stage(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``staged``, with a call that deletes the table, for when all that reads it is written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")  # its shuffle files go when the table is there, not when the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)

    def delete() -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return spark.read.schema(df.schema).parquet(path), delete


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows of a few
    dozen bytes; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *wanted: str) -> str:
    """A prefix that no column of ``df`` starts with, for helper columns."""
    prefix = "x_"
    while any(c.lower().startswith(prefix) for c in (*df.columns, *wanted)):
        prefix = "x" + prefix
    return prefix
