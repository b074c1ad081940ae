"""Rankings of people, chats, themes and membership changes.

Facts are aggregated by id first; names are joined to the small result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..model import Chat, Filters
from .resolve import resolve_themes
from .scope import channel_dim, channels_in_scope, count_by, in_dates, scope, shown_channel


def top_people(chat: Chat, filters=Filters(), metric="messages", limit: int = 10) -> DataFrame:
    counts = count_by(scope(chat, filters), ["person_id"], metric)
    return (
        counts.join(chat.people, F.col("person_id") == F.col("id"))
        .select("id", "display_name", "color", "message_count")
        .orderBy(F.desc("message_count"), "display_name").limit(limit)
    )


def top_chats(chat: Chat, filters=Filters(), metric="messages", limit: int = 10) -> DataFrame:
    """Channels without a theme are not ranked."""
    counts = count_by(scope(chat, filters), ["channel_id"], metric)
    themes = chat.themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme_name"))
    return (
        counts.join(channel_dim(chat), "channel_id").join(themes, "theme_id")
        .orderBy(F.desc("message_count"), "channel_name", "channel_id").limit(limit)
        .select(
            F.col("channel_id").alias("id"),
            shown_channel(chat, F.col("channel_name"), F.col("source_name")).alias("name"),
            "theme_name",
            "message_count",
        )
    )


def top_themes(chat: Chat, filters=Filters(), metric="messages", limit: int = 10) -> DataFrame:
    """Configured themes only, each channel resolved by the theme rules; ties by name."""
    counts = count_by(scope(chat, filters), ["channel_id"], metric).join(channel_dim(chat), "channel_id")
    names = [t.name for t in chat.config.themes]
    return (
        resolve_themes(counts, chat.config).filter(F.col("theme").isin(names))
        .groupBy(F.col("theme").alias("name")).agg(F.sum("message_count").alias("message_count"))
        .orderBy(F.desc("message_count"), "name").limit(limit)
        .select(F.lit(0).alias("id"), "name", "message_count")
    )


def _events(chat: Chat, filters: Filters, kind: str | None) -> DataFrame:
    if kind is not None and kind not in ("added", "removed", "left"):
        raise ValueError(f"unknown kind {kind!r}")
    e = in_dates(chat.member_events, filters)
    if kind:
        e = e.filter(F.col("kind") == kind)
    if filters.people:
        e = e.filter(F.col("actor_person_id").isin(*filters.people) | F.col("target_person_id").isin(*filters.people))
    return e.drop("source_id").join(channels_in_scope(chat, filters), "channel_id")


def _by_person(chat: Chat, events: DataFrame, column: str, limit: int) -> DataFrame:
    """People of the same name count as one; the smallest id stands for them."""
    counts = events.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(chat.people, "id")
        .groupBy(F.lower(F.trim("display_name")).alias("key"))
        .agg(
            F.min(F.struct("id", "display_name", "color")).alias("p"),
            F.sum("n").alias("count"),
            F.min("display_name").alias("first_name"),
        )
        .orderBy(F.desc("count"), "first_name").limit(limit)
        .select("p.id", _you(chat, F.col("p.display_name")).alias("display_name"), "p.color", "count")
    )


def _you(chat: Chat, name):
    """Exports name their owner "You"; show the first configured person instead."""
    owner = chat.config.primary_person
    return F.when(name_key(name) == "you", F.lit(owner)).otherwise(name) if owner else name


def member_events_by_actor(chat: Chat, filters=Filters(), kind=None, limit: int = 10) -> DataFrame:
    return _by_person(chat, _events(chat, filters, kind), "actor_person_id", limit)


def member_events_by_target(chat: Chat, filters=Filters(), kind=None, limit: int = 10) -> DataFrame:
    return _by_person(chat, _events(chat, filters, kind), "target_person_id", limit)


def member_events_by_chat(chat: Chat, filters=Filters(), kind=None, limit: int = 10) -> DataFrame:
    return (
        _events(chat, filters, kind)
        .groupBy("channel_id", "channel_name", "source_name", "platform").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "channel_name", "channel_id").limit(limit)
        .select(
            F.col("channel_id").alias("id"),
            shown_channel(chat, F.col("channel_name"), F.col("source_name")).alias("name"),
            "source_name", "platform", "count",
        )
    )
