"""Headline statistics of a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import bucket, micros
from ..model import Chat, Filters, check_metric
from .scope import count_by, metric_rows, metric_value, scope
from .sessions import longest_gap, longest_session

# --- fixed values: file kinds by extension ----------------------------------
EXTENSIONS = {
    "with_images": "jpg|jpeg|png|webp|bmp|heic|heif|avif",
    "with_gifs": "gif",
    "with_videos": "mp4|mov|webm|mkv|avi|wmv|m4v",
    "with_audio_files": "mp3|wav|m4a|aac|ogg|opus|flac|amr|aif|aiff|mpga",
    "with_documents": "pdf|doc|docx|txt|rtf|odt|xls|xlsx|ods|ppt|pptx|csv",
}
# ----------------------------------------------------------------------------


def total_and_range(chat: Chat, filters=Filters(), metric="messages") -> DataFrame:
    """Total, first and last time stamp, and the average per calendar day."""
    rows = metric_rows(scope(chat, filters), metric)
    days = F.greatest(F.datediff(F.to_date("end_ts"), F.to_date("start_ts")) + 1, F.lit(1))
    return rows.agg(
        F.coalesce(metric_value(metric), F.lit(0)).alias("total_messages"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    ).withColumn("average_per_day", F.coalesce(F.col("total_messages") / days, F.lit(0.0)))


def people_ranking(chat: Chat, filters=Filters(), metric="messages") -> DataFrame:
    counts = count_by(scope(chat, filters), ["person_id"], metric)
    return (
        counts.join(chat.people, F.col("person_id") == F.col("id"))
        .select("id", "display_name", "color", "message_count")
        .orderBy(F.desc("message_count"), "display_name")
    )


def message_kinds(chat: Chat, filters=Filters()) -> DataFrame:
    content = F.trim(F.coalesce("content", F.lit("")))
    before_query = F.split_part(F.coalesce("attachment_preview", F.lit("")), F.lit("?"), F.lit(1))
    path = F.lower(F.regexp_replace(before_query, "#.*$", ""))
    attached = F.coalesce("attachment_count", F.lit(0)) > 0

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")

    known = "|".join(EXTENSIONS.values())
    kinds = {
        "with_text": content != "",
        "with_links": content.rlike(r"(https?://|www\.)"),
        **{name: attached & path.rlike(rf"\.({ext})$") for name, ext in EXTENSIONS.items()},
        "with_stickers": attached & path.contains("sticker"),
        "with_other_files": attached & ~path.rlike(rf"\.({known})$") & ~path.contains("sticker"),
        "edited_messages": F.coalesce("is_edited", F.lit(False)),
    }
    return scope(chat, filters).agg(
        F.count(F.lit(1)).alias("total_messages"), *[total(cond).alias(name) for name, cond in kinds.items()]
    )


def most_active(chat: Chat, filters=Filters(), metric="messages") -> DataFrame:
    """The busiest year, month, day and hour from one pass over the scope; ties go to the earliest.

    Counts are first taken per hour (for conversations: distinct pairs of hour
    and conversation), then rolled up from that smaller table.
    """
    metric = check_metric(metric)
    rows = metric_rows(scope(chat, filters), metric)
    hour = bucket(F.col("ts"), "hour").alias("hour")
    if metric == "conversations":
        base = rows.select(hour, "conversation_id").distinct()
        value = F.count_distinct("conversation_id")
    else:
        base = rows.groupBy(hour).agg(metric_value(metric).alias("n"))
        value = F.sum("n")
    units = ("year", "month", "day", "hour")
    spread = base.withColumn(
        "u",
        F.explode(
            F.array(*[F.struct(F.lit(u).alias("granularity"), bucket(F.col("hour"), u).alias("bucket")) for u in units])
        ),
    )
    counts = spread.groupBy("u.granularity", "u.bucket").agg(value.alias("count"))
    return counts.groupBy("granularity").agg(
        F.max_by("bucket", F.struct(F.col("count"), -micros(F.col("bucket")))).alias("bucket"),
        F.max("count").alias("count"),
    )


def conversation_summary(chat: Chat, filters=Filters()) -> DataFrame:
    per = (
        scope(chat, filters).filter(F.col("conversation_id").isNotNull())
        .groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    )
    return per.agg(
        F.count(F.lit(1)).alias("conversation_count"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_messages"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("longest_conversation"),
    )


def silent_gap(chat: Chat, filters=Filters()) -> DataFrame:
    return longest_gap(scope(chat, filters).select("ts"))


def active_session(chat: Chat, filters=Filters()) -> DataFrame:
    return longest_session(scope(chat, filters).select("id", "ts"))


def overview(chat: Chat, filters=Filters(), metric="messages") -> dict[str, DataFrame]:
    """All parts of the overview, each a DataFrame of its own."""
    return {
        "total": total_and_range(chat, filters, metric),
        "people": people_ranking(chat, filters, metric),
        "kinds": message_kinds(chat, filters),
        "longest_gap": silent_gap(chat, filters),
        "longest_session": active_session(chat, filters),
        "most_active": most_active(chat, filters, metric),
        "conversations": conversation_summary(chat, filters),
    }
