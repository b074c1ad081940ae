"""Counts per time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import bucket
from ..model import Chat, Filters
from .scope import count_by, scope


def _unit(granularity: str, allowed: tuple[str, ...]) -> str:
    if granularity not in allowed:
        raise ValueError(f"granularity must be one of {allowed}")
    return granularity


def messages_over_time(chat: Chat, filters=Filters(), granularity="day", metric="messages") -> DataFrame:
    unit = _unit(granularity, ("day", "week", "month"))
    return count_by(scope(chat, filters), [bucket(F.col("ts"), unit).alias("bucket")], metric).orderBy("bucket")


def platform_over_time(chat: Chat, filters=Filters(), granularity="month", metric="messages") -> DataFrame:
    """Every bucket seen has a row for every platform seen."""
    unit = _unit(granularity, ("day", "week", "month", "year"))
    counts = count_by(
        scope(chat, filters), [bucket(F.col("ts"), unit).alias("bucket"), "platform"], metric, "count"
    )
    # From here on rows are calendar buckets times a handful of platforms.
    seen = F.array_sort(F.collect_set("platform").over(W.partitionBy()))
    per_bucket = counts.withColumn("seen", seen).groupBy("bucket").agg(
        F.first("seen").alias("seen"),
        F.map_from_entries(F.collect_list(F.struct("platform", "count"))).alias("counts"),
    )
    return (
        per_bucket.select("bucket", "counts", F.explode("seen").alias("platform"))
        .select(
            "bucket",
            "platform",
            F.coalesce(F.try_element_at("counts", F.col("platform")), F.lit(0)).cast("bigint").alias("count"),
        )
        .orderBy("bucket", "platform")
    )


def calendar(chat: Chat, filters=Filters(), metric="messages") -> DataFrame:
    return count_by(scope(chat, filters), [F.to_date("ts").alias("day")], metric).orderBy("day")


def activity_heatmap(chat: Chat, filters=Filters(), metric="messages") -> DataFrame:
    keys = [(F.weekday("ts") + 1).cast("bigint").alias("weekday"), F.hour("ts").cast("bigint").alias("hour")]
    return count_by(scope(chat, filters), keys, metric).orderBy("weekday", "hour")


def messages_by_month(chat: Chat, filters=Filters(), metric="messages") -> DataFrame:
    return count_by(scope(chat, filters), [bucket(F.col("ts"), "month").alias("month")], metric).orderBy("month")


def messages_by_hour(chat: Chat, filters=Filters(), metric="messages") -> DataFrame:
    return count_by(scope(chat, filters), [F.hour("ts").cast("bigint").alias("hour")], metric).orderBy("hour")


def monthly_totals(platform_counts: DataFrame) -> DataFrame:
    """Totals over platforms of ``platform_over_time``."""
    return platform_counts.groupBy(F.col("bucket").alias("month")).agg(F.sum("count").alias("message_count"))


def hourly_totals(heatmap: DataFrame) -> DataFrame:
    return heatmap.groupBy("hour").agg(F.sum("message_count").alias("message_count"))


def weekday_totals(heatmap: DataFrame) -> DataFrame:
    """One row for each of the seven ISO weekdays, zero where nothing was written."""
    days = heatmap.sparkSession.range(1, 8).select(F.col("id").alias("weekday"))
    sums = heatmap.groupBy("weekday").agg(F.sum("message_count").alias("n"))
    return days.join(sums, "weekday", "left").select(
        "weekday", F.coalesce("n", F.lit(0)).cast("bigint").alias("message_count")
    )
