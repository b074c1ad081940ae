"""The shared filter of nearly every query, and the metric switch."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MONTH_KEY, Chat, Filters, check_metric
from .resolve import resolve_themes

#: channels that may be broadcast, some 200 bytes each
LISTED_CHANNELS = 100_000


def in_dates(df: DataFrame, filters: Filters, ts: str = "ts") -> DataFrame:
    """Both days inclusive. Plain comparisons, so they reach the Parquet scan.

    Stored messages carry the month they are partitioned by, which prunes folders.
    """
    if filters.start is not None:
        df = df.filter(F.col(ts) >= F.lit(filters.start).cast("timestamp_ntz"))
        if MONTH_KEY in df.columns:
            df = df.filter(F.col(MONTH_KEY) >= filters.start.year * 100 + filters.start.month)
    if filters.end is not None:
        df = df.filter(F.col(ts) < F.lit(filters.end + timedelta(days=1)).cast("timestamp_ntz"))
        if MONTH_KEY in df.columns:
            df = df.filter(F.col(MONTH_KEY) <= filters.end.year * 100 + filters.end.month)
    return df


def bot_people(chat: Chat) -> DataFrame:
    return chat.people.filter(F.col("display_name").isin(chat.config.bot_names)).select("id")


def channel_dim(chat: Chat) -> DataFrame:
    """Channels with their source, one row per channel."""
    s = chat.sources.select(
        F.col("id").alias("source_id"), F.col("platform"), F.col("name").alias("source_name")
    )
    return chat.channels.select(
        F.col("id").alias("channel_id"),
        "source_id",
        "platform_channel_id",
        F.col("name").alias("channel_name"),
        "theme_id",
    ).join(s, "source_id")


def configured_theme_channels(chat: Chat) -> DataFrame:
    """(channel_id, theme) for channels that resolve to a configured theme."""
    resolved = resolve_themes(channel_dim(chat), chat.config)
    return resolved.filter(F.col("theme").isin([t.name for t in chat.config.themes])).select("channel_id", "theme")


def theme_channel_condition(names: list[str], chat: Chat) -> Column:
    """Match channels by name alone: exact, or by prefix for exports that append suffixes."""
    out = F.lit(False)
    for theme in chat.config.themes:
        if theme.name not in names:
            continue
        for source, channel in theme.channels:
            out = out | ((F.col("source_name") == source) & (F.col("channel_name") == channel))
            if source.startswith("Facebook: "):
                out = out | (
                    (F.col("platform") == "facebook")
                    & F.startswith(F.lower("source_name"), F.lower(F.lit(source + "_")))
                    & F.startswith(F.lower("channel_name"), F.lower(F.lit(channel + "_")))
                )
            elif source.startswith("Signal: "):
                out = out | (
                    (F.col("platform") == "signal")
                    & F.startswith(F.lower("source_name"), F.lower(F.lit(source)))
                    & (F.lower("channel_name") == F.lower(F.lit(channel)))
                )
    return out


def channels_in_scope(chat: Chat, filters: Filters, theme_match: str = "resolved") -> DataFrame:
    """Channel dimension cut down by theme and platform.

    ``theme_match`` is how a theme finds its channels: ``resolved`` through the
    resolver, ``names`` by the configured names alone, ``stored`` by the theme id
    of the channel row.
    """
    dim = channel_dim(chat)
    if filters.platforms:
        dim = dim.filter(F.col("platform").isin(*filters.platforms))
    if filters.themes:
        if theme_match == "stored":
            return dim.filter(F.col("theme_id").isin(*filters.themes))
        names = chat.config.theme_names(filters.themes)
        if not chat.config.themes:
            return dim.filter(F.col("theme_id").isin(*filters.themes))  # nothing configured: the ids of the stored themes, dense from 1
        if not names:
            return dim.filter(F.lit(False))
        if theme_match == "names":
            return dim.filter(theme_channel_condition(names, chat))
        hit = configured_theme_channels(chat).filter(F.col("theme").isin(names)).select("channel_id")
        dim = dim.join(hit, "channel_id", "left_semi")
    return dim


def scope(
    chat: Chat,
    filters: Filters = Filters(),
    *,
    system: bool = False,
    excluded: bool = False,
    theme_match: str = "resolved",
) -> DataFrame:
    """Messages a query looks at, with the columns of their channel and source.

    System messages and moderated ids are left out unless asked for.
    """
    m = in_dates(chat.messages, filters)
    if filters.people:
        m = m.filter(F.col("person_id").isin(*filters.people))
    if not system:
        m = m.filter(~F.col("is_system"))
    if not excluded and chat.config.excluded_message_ids:
        m = m.filter(~F.col("id").isin(*sorted(chat.config.excluded_message_ids)))
    if chat.config.bot_names and not filters.include_bots:
        # at most a few ids per configured bot name, so the hint is bounded by the configuration
        m = m.join(F.broadcast(bot_people(chat).withColumnRenamed("id", "person_id")), "person_id", "left_anti")
    dim = channels_in_scope(chat, filters, theme_match)
    # resolving themes hides from the optimizer how short the list is, and messages would be dealt out by channel
    if filters.themes and chat.channels.limit(LISTED_CHANNELS + 1).count() <= LISTED_CHANNELS:
        dim = F.broadcast(dim)
    return m.join(dim, "channel_id")


def metric_rows(df: DataFrame, metric: str) -> DataFrame:
    return df.filter(F.col("conversation_id").isNotNull()) if check_metric(metric) == "conversations" else df


def metric_value(metric: str) -> Column:
    """Messages, summed words, or distinct conversations."""
    metric = check_metric(metric)
    if metric == "words":
        return F.sum(F.coalesce(F.col("word_count"), F.lit(0)).cast("bigint"))
    if metric == "conversations":
        return F.count_distinct("conversation_id")
    return F.count(F.lit(1))


def count_by(df: DataFrame, keys: list, metric: str, name: str = "message_count") -> DataFrame:
    return metric_rows(df, metric).groupBy(*keys).agg(metric_value(metric).alias(name))


def shown_channel(chat: Chat, channel: Column, source: Column) -> Column:
    """Facebook folders are shown under the name kept for them in the configuration."""
    names = chat.config.facebook_names
    if not names:
        return channel
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    known = F.when(F.startswith(source, F.lit("Facebook: ")), F.nullif(F.try_element_at(table, channel), F.lit("")))
    return F.coalesce(known, channel)
