"""Substring search with an inverted trigram index in front of it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_literal
from ..model import MONTH_KEY, Chat, Filters
from .scope import scope


def query_grams(q: str) -> list[str]:
    low = q.casefold()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def messages_with_grams(trigrams: DataFrame, grams: list[str]) -> DataFrame:
    """Ids of messages that hold every gram. Only the listed grams are read; a message has each gram once."""
    month = [MONTH_KEY] if MONTH_KEY in trigrams.columns else []
    return (
        trigrams.filter(F.col("gram").isin(grams))
        .groupBy("message_id", *month).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == len(grams)).select(F.col("message_id").alias("id"), *month)
    )


def search_matches(chat: Chat, q: str, filters=Filters()) -> DataFrame:
    """All matching messages. Bots and system messages are included.

    ASCII queries ignore case, others do not. Grams are literal while % and _ in
    the query are wildcards, so the index narrows those queries further.
    """
    if not q:
        raise ValueError("empty query")
    rows = scope(chat, replace(filters, include_bots=True), system=True)
    ascii_only = all(ord(c) < 128 for c in q)
    if ascii_only and len(q.casefold()) >= 3 and chat.trigrams is not None:
        hits = messages_with_grams(chat.trigrams, query_grams(q))
        keys = [c for c in hits.columns if c in rows.columns]  # the month too, where both have it: partitions without hits are not read
        rows = rows.join(hits.select(*keys), keys, "left_semi")
    pattern = like_literal(q)
    content = F.col("content")
    return rows.filter(content.ilike(pattern) if ascii_only else content.like(pattern))


def search_total(chat: Chat, q: str, filters=Filters()) -> DataFrame:
    return search_matches(chat, q, filters).agg(F.count(F.lit(1)).alias("total"))


def oldest_month(chat: Chat, matches: DataFrame, filters: Filters, wanted: int) -> int:
    """The newest month that, with those after it, holds ``wanted`` matches; the first one if all hold fewer."""
    first = filters.start.year * 100 + filters.start.month if filters.start else 0
    last = filters.end.year * 100 + filters.end.month if filters.end else 999_999
    months = chat.months.filter(F.col(MONTH_KEY).between(first, last)).select(MONTH_KEY)
    keys = sorted((r[0] for r in months.collect()), reverse=True)  # one row a month of the calendar
    found, at, step = 0, 0, 1
    while at < len(keys) and found < wanted:
        span = keys[at : at + step]
        found += matches.filter(F.col(MONTH_KEY).between(span[-1], span[0])).limit(wanted - found).count()
        at, step = at + len(span), step * 2
    return keys[at - 1] if at else 0


def search(chat: Chat, q: str, filters=Filters(), limit: int = 20, offset: int = 0) -> DataFrame:
    """One page, newest first; equal time stamps are ordered by id.

    A build knows its months. They are walked from the newest on, twice as many at a
    time, until they hold a page of matches; older ones are not read.
    """
    matches = search_matches(chat, q, filters)
    if chat.months is not None and MONTH_KEY in matches.columns:
        matches = matches.filter(F.col(MONTH_KEY) >= oldest_month(chat, matches, filters, offset + limit))
    page = matches.orderBy(F.desc("ts"), F.desc("id"))
    page = (page.offset(offset) if offset else page).limit(limit)
    people = chat.people.select(
        F.col("id").alias("person_id"), F.col("display_name").alias("person_name"), F.col("color").alias("person_color")
    )
    return page.join(people, "person_id", "left").select(
        "id", "ts", "content", "person_name", "person_color", "channel_name", "source_name", "platform"
    )
