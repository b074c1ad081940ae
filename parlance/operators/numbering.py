"""Dense row numbers in a global order without sending a table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import boundary_number
from ..session import pinned

DAY = 86_400


def running_total(df: DataFrame, value: Column, ts: Column, order: list, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in (ts, order).

    Running sums inside each day, plus what earlier days sum up to; the only
    window over everything has one row per calendar day.
    """
    df = df.withColumn("d_", boundary_number(ts, DAY)).withColumn("v_", value.cast("bigint"))
    inside = W.partitionBy("d_").orderBy(ts, *order).rowsBetween(W.unboundedPreceding, -1)
    days = df.groupBy("d_").agg(F.sum("v_").alias("s_")).select(
        "d_", F.coalesce(F.sum("s_").over(W.orderBy("d_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o_")
    )
    return (
        df.withColumn("r_", F.coalesce(F.sum("v_").over(inside), F.lit(0)))
        .join(days, "d_").withColumn(out, F.col("r_") + F.col("o_")).drop("d_", "v_", "r_", "o_")
    )


def numbered_in_time(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Numbers rows 1, 2, 3 ... by (ts, order). A day or an instant with many rows is spread like any other."""
    return numbered(df, ["ts", *order], out)


def numbered(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Numbers rows 1, 2, 3 ... by columns that identify a row.

    Range partitions are pinned, so that the sizes counted are those numbered.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = pinned(df.repartitionByRange(parts, *order).withColumn("p_", F.spark_partition_id()))
    sizes = ranged.groupBy("p_").agg(F.count(F.lit(1)).alias("n_")).select(
        "p_", F.coalesce(F.sum("n_").over(W.orderBy("p_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o_")
    )
    place = F.row_number().over(W.partitionBy("p_").orderBy(*order))
    return ranged.withColumn("r_", place).join(sizes, "p_").withColumn(
        out, (F.col("r_") + F.col("o_")).cast("bigint")
    ).drop("p_", "r_", "o_")
