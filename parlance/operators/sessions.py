"""Gap sessions and longest gaps without ordering the fact table.

All three operators use one observation: two messages of the same fixed-width
time bucket are never further apart than the bucket is wide. Messages are first
aggregated per bucket (combined map-side, so a bucket or channel that holds a
large share of all rows costs nothing extra); gaps are then looked for between
consecutive buckets only, a table bounded by the calendar instead of by the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import boundary_number, micros
from .numbering import running_total

CONVERSATION_GAP_SECONDS = 30 * 60
SESSION_GAP_MINUTES = 15
DAY = 86_400


def _previous(df: DataFrame, value: str, at: str, per_day: int) -> DataFrame:
    """Adds ``prev``: ``value`` of the row before, in the order of the unique bucket number ``at``.

    Lag inside each day, then the last value of the nearest earlier day, so that
    the only unpartitioned window runs over one row per calendar day.
    """
    df = df.withColumn("day_", F.floor(F.col(at) / per_day).cast("bigint"))
    inside = df.withColumn("lag_", F.lag(value).over(W.partitionBy("day_").orderBy(at)))
    days = (
        df.groupBy("day_")
        .agg(F.max_by(value, at).alias("last_"))
        .select("day_", F.lag("last_").over(W.orderBy("day_")).alias("before_"))
    )
    return inside.join(days, "day_").withColumn("prev", F.coalesce("lag_", "before_")).drop("lag_", "before_")


def _by_day(df: DataFrame, seconds: int) -> DataFrame:
    """(day, m): for each day with messages its buckets in order, with their first and last message.

    A day has no more entries than buckets, whatever its number of messages.
    """
    at = boundary_number(F.col("ts"), seconds)
    buckets = df.groupBy(F.floor(at / (DAY // seconds)).alias("day"), at.alias("at")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return buckets.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("at", "first_ts", "last_ts"))).alias("m"))


def _neighbours(items: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of each two items that follow each other."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, 1, n), F.slice(items, 2, n), make)


def longest_gap(df: DataFrame) -> DataFrame:
    """The longest silence between consecutive messages, in whole-second boundaries.

    Columns gap_seconds, prev_ts, ts; no row when there are fewer than two messages.
    Days are summed up as (first, last, best gap inside), and days next to each other
    give the gaps between them: one row a day is all that comes together.
    """

    def gap(before: Column, after: Column) -> Column:
        return F.struct(
            (after["at"] - before["at"]).alias("gap_seconds"), (-micros(before["last_ts"])).alias("earliest"),
            before["last_ts"].alias("prev_ts"), after["first_ts"].alias("ts"),
        )

    days = _by_day(df, 1).select(
        F.struct(
            "day", F.col("m")[0].alias("first"), F.element_at("m", -1).alias("last"), F.array_max(_neighbours(F.col("m"), gap)).alias("best"),
            F.size("m").alias("n"),
        ).alias("d")
    )
    whole = days.agg(F.sort_array(F.collect_list("d")).alias("d"))
    between = _neighbours(F.col("d"), lambda a, b: gap(a["last"], b["first"]))
    inside = F.filter(F.transform("d", lambda x: x["best"]), lambda x: x.isNotNull())
    gaps = whole.select(F.array_max(F.concat(between, inside)).alias("g")).filter(F.col("g").isNotNull()).select("g.gap_seconds", "g.prev_ts", "g.ts")
    # Only when everything was written within one second do the first two messages decide;
    # else this one-row table is empty, and nothing of the second scan passes the join.
    lone = whole.filter((F.size("d") == 1) & (F.col("d")[0]["n"] == 1)).select(F.col("d")[0]["first"]["at"].alias("at"))
    pair = (
        df.select("ts", boundary_number(F.col("ts"), 1).alias("at")).join(F.broadcast(lone), "at").select("ts").orderBy("ts").limit(2)
        .agg(F.min("ts").alias("prev_ts"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
        .filter("n = 2")
        .select(F.lit(0).cast("bigint").alias("gap_seconds"), "prev_ts", "ts")
    )
    return gaps.unionByName(pair)


def activity_sessions(df: DataFrame) -> DataFrame:
    """Sessions over all messages; a new one starts after more than 15 minute boundaries of silence."""
    per_day = 24 * 60
    minutes = df.groupBy(boundary_number(F.col("ts"), 60).alias("minute")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    marked = _previous(minutes, "minute", "minute", per_day).withColumn(
        "opens",
        F.when(F.col("prev").isNull() | (F.col("minute") - F.col("prev") > SESSION_GAP_MINUTES), 1).otherwise(0),
    )
    inside = marked.withColumn(
        "seq_", F.sum("opens").over(W.partitionBy("day_").orderBy("minute").rowsBetween(W.unboundedPreceding, 0))
    )
    days = (
        marked.groupBy("day_").agg(F.sum("opens").alias("n_"))
        .select(
            "day_",
            F.coalesce(
                F.sum("n_").over(W.orderBy("day_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("offset_"),
        )
    )
    return (
        inside.join(days, "day_")
        .groupBy((F.col("seq_") + F.col("offset_")).alias("session_id"))
        .agg(F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts"))
        .withColumn("duration_seconds", boundary_number(F.col("end_ts"), 1) - boundary_number(F.col("start_ts"), 1))
    )


def with_start_message(sessions: DataFrame, df: DataFrame) -> DataFrame:
    """Adds the smallest id among the messages written at the very start of a session."""
    starts = df.select(F.col("ts").alias("start_ts"), "id").join(sessions.select("start_ts"), "start_ts")
    return sessions.join(starts.groupBy("start_ts").agg(F.min("id").alias("start_message_id")), "start_ts")


def longest_session_span(df: DataFrame) -> DataFrame:
    """(duration_seconds, start_ts) of the longest session, the earliest of equal ones; no row without messages.

    A day's minutes make runs, at most one for each quarter of an hour. Runs inside a day are
    finished; its first and last one are open, and are joined with those of the days beside it
    while the days, one row each, are walked in order.
    """
    run = "struct<start:timestamp_ntz,stop:timestamp_ntz,first:bigint,last:bigint>"

    def grow(runs: Column, x: Column) -> Column:
        tail = F.element_at(runs, -1)
        new = F.struct(x["first_ts"].alias("start"), x["last_ts"].alias("stop"), x["at"].alias("first"), x["at"].alias("last"))
        grown = F.struct(tail["start"].alias("start"), x["last_ts"].alias("stop"), tail["first"].alias("first"), x["at"].alias("last"))
        joins = F.when(F.size(runs) > 0, x["at"] - tail["last"] <= SESSION_GAP_MINUTES).otherwise(False)
        return F.when(joins, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(runs, F.array(new)))

    def length(r: Column) -> Column:
        seconds = boundary_number(r["stop"], 1) - boundary_number(r["start"], 1)
        return F.when(r.isNotNull(), F.struct(seconds.alias("seconds"), (-micros(r["start"])).alias("earliest"), r["start"].alias("start")))

    best_type = "struct<seconds:bigint,earliest:bigint,start:timestamp_ntz>"
    runs = _by_day(df, 60).select("day", F.aggregate("m", F.array().cast(f"array<{run}>"), grow).alias("runs"))
    middle = F.slice("runs", 2, F.greatest(F.size("runs") - 2, F.lit(0)))
    days = runs.select(
        F.struct(
            "day", F.size("runs").alias("n"), F.col("runs")[0].alias("head"), F.element_at("runs", -1).alias("tail"),
            F.array_max(F.transform(middle, length)).alias("best"),
        ).alias("d")
    )

    def step(state: Column, d: Column) -> Column:
        joins = F.coalesce(d["head"]["first"] - state["open"]["last"] <= SESSION_GAP_MINUTES, F.lit(False))
        head = F.struct(
            F.when(joins, state["open"]["start"]).otherwise(d["head"]["start"]).alias("start"), d["head"]["stop"].alias("stop"),
            F.when(joins, state["open"]["first"]).otherwise(d["head"]["first"]).alias("first"), d["head"]["last"].alias("last"),
        )
        done = F.greatest(
            state["best"], d["best"], F.when(~joins, length(state["open"])).otherwise(F.lit(None).cast(best_type)),
            F.when(d["n"] > 1, length(head)).otherwise(F.lit(None).cast(best_type)),
        )
        return F.struct(F.when(d["n"] > 1, d["tail"]).otherwise(head).cast(run).alias("open"), done.cast(best_type).alias("best"))

    start = F.struct(F.lit(None).cast(run).alias("open"), F.lit(None).cast(best_type).alias("best"))
    last = days.agg(F.sort_array(F.collect_list("d")).alias("d")).select(
        F.aggregate("d", start, step, lambda s: F.greatest(s["best"], length(s["open"]))).alias("s")
    )
    return last.filter(F.col("s").isNotNull()).select(F.col("s.seconds").alias("duration_seconds"), F.col("s.start").alias("start_ts"))


def longest_session(df: DataFrame) -> DataFrame:
    return with_start_message(longest_session_span(df), df).select("duration_seconds", "start_message_id")


def _half_hour(ts: Column) -> Column:
    return boundary_number(ts, CONVERSATION_GAP_SECONDS)


def conversation_buckets(messages: DataFrame) -> DataFrame:
    """(channel_id, slot, conversation_id) for every half-hour slot with messages.

    A slot is as wide as the allowed gap, so all its messages share a conversation.
    Ids are dense; channels are numbered in the order of their first message, then by id.
    """
    slots = messages.groupBy("channel_id", _half_hour(F.col("ts")).alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    order = W.partitionBy("channel_id").orderBy("slot")
    gap = micros(F.col("first_ts")) - micros(F.lag("last_ts").over(order))
    marked = slots.withColumn(
        "opens", F.when(gap.isNull() | (gap > CONVERSATION_GAP_SECONDS * 1_000_000), 1).otherwise(0)
    )
    seq = F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))
    numbered = marked.withColumn("seq", seq)
    channels = running_total(
        marked.groupBy("channel_id").agg(F.min("first_ts").alias("first_ts"), F.sum("opens").alias("n")),
        F.col("n"), F.col("first_ts"), ["channel_id"], "offset",
    ).select("channel_id", "offset")
    return numbered.join(channels, "channel_id").select(
        "channel_id", "slot", (F.col("seq") + F.col("offset")).cast("bigint").alias("conversation_id")
    )


def assign_conversations(messages: DataFrame) -> DataFrame:
    """Adds conversation_id to messages."""
    slots = conversation_buckets(messages)
    return (
        messages.withColumn("slot", _half_hour(F.col("ts")))
        .join(slots, ["channel_id", "slot"])
        .drop("slot")
    )


def conversation_table(messages: DataFrame, person_keys: tuple[str, ...] = ("person_id",)) -> DataFrame:
    """One row per conversation from messages that carry conversation_id."""
    return (
        messages.groupBy(F.col("conversation_id").alias("id"), "channel_id")
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count(F.lit(1)).alias("message_count"),
            F.count_distinct(F.struct(*person_keys)).alias("participant_count"),
        )
    )


__all__ = [
    "activity_sessions", "assign_conversations", "conversation_buckets", "conversation_table",
    "longest_gap", "longest_session",
]
