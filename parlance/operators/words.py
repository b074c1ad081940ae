"""Word frequencies, trends and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import bucket
from ..model import Chat, Filters
from .facts import with_tokens
from .scope import channel_dim, scope, shown_channel

EXAMPLE_COLUMNS = ["message_id", "ts", "content", "person_name", "person_color", "channel_name", "source_name"]


def top_words(chat: Chat, filters=Filters(), q: str | None = None, limit: int | None = 200) -> DataFrame:
    """Words without stop words by use; ``q`` keeps words containing it; ``limit=None`` gives all."""
    words = with_tokens(chat, scope(chat, filters)).filter(~tx.is_stop_word(F.col("token")))
    query = (q or "").strip().casefold()
    if query:
        words = words.filter(F.col("token").like(tx.like_literal(query)))
    ranked = (
        words.groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "word")
    )
    return ranked if limit is None else ranked.limit(limit)


def word_over_time(chat: Chat, word: str, filters=Filters()) -> DataFrame:
    """Monthly uses of a word and its share of all words, stop words included."""
    word = tx.normalise_word(word)
    return (
        with_tokens(chat, scope(chat, filters))
        .groupBy(bucket(F.col("ts"), "month").alias("month"))
        .agg(F.count(F.when(F.col("token") == word, 1)).alias("count"), F.count(F.lit(1)).alias("total_words"))
        .withColumn("percent", F.round(F.col("count") / F.col("total_words") * 100, 4))
        .orderBy("month")
    )


def _uses(chat: Chat, word: str, filters: Filters) -> DataFrame:
    return with_tokens(chat, scope(chat, filters), tx.normalise_word(word))


def word_people(chat: Chat, word: str, filters=Filters(), limit: int = 10) -> DataFrame:
    counts = _uses(chat, word, filters).groupBy("person_id").agg(F.count(F.lit(1)).alias("count"))
    return (
        counts.join(chat.people, F.col("person_id") == F.col("id"))
        .select("id", "display_name", "color", "count")
        .orderBy(F.desc("count"), "display_name").limit(limit)
    )


def word_chats(chat: Chat, word: str, filters=Filters(), limit: int = 10) -> DataFrame:
    counts = _uses(chat, word, filters).groupBy("channel_id").agg(F.count(F.lit(1)).alias("count"))
    return (
        counts.join(channel_dim(chat), "channel_id")
        .orderBy(F.desc("count"), "channel_name", "channel_id").limit(limit)
        .select(
            F.col("channel_id").alias("id"),
            shown_channel(chat, F.col("channel_name"), F.col("source_name")).alias("name"),
            "source_name",
            "count",
        )
    )


def as_examples(chat: Chat, rows: DataFrame, *, newest: bool, limit: int, offset: int = 0) -> DataFrame:
    """One page of messages with author and channel names.

    Messages of unknown authors are left out before the page is cut, by id alone; names are
    looked up for the rows of the page.
    """
    rows = rows.join(chat.people.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    order = [F.desc("ts"), F.desc("id")] if newest else [F.asc("ts"), F.asc("id")]
    page = rows.orderBy(*order)
    page = (page.offset(offset) if offset else page).limit(limit)
    people = chat.people.select(
        F.col("id").alias("person_id"), F.col("display_name").alias("person_name"), F.col("color").alias("person_color")
    )
    return page.join(people, "person_id").orderBy(*order).select(
        F.col("id").alias("message_id"), "ts", "content", "person_name", "person_color",
        shown_channel(chat, F.col("channel_name"), F.col("source_name")).alias("channel_name"), "source_name",
    )


def messages_with_word(chat: Chat, word: str, filters=Filters()) -> DataFrame:
    """Scoped messages that use the word, each once."""
    word = tx.normalise_word(word)
    rows = scope(chat, filters)
    if chat.tokens is not None:
        hits = chat.tokens.filter(F.col("token") == word).select(F.col("message_id").alias("id"))
        return rows.join(hits, "id", "left_semi")
    return rows.filter(F.array_contains(tx.tokens(F.col("content")), word))


def word_examples(chat: Chat, word: str, filters=Filters(), limit: int = 6, offset: int = 0) -> DataFrame:
    return as_examples(chat, messages_with_word(chat, word, filters), newest=True, limit=limit, offset=offset)


def word_first_message(chat: Chat, word: str, filters=Filters()) -> DataFrame:
    return as_examples(chat, messages_with_word(chat, word, filters), newest=False, limit=1)


def has_more(page: DataFrame, limit: int) -> bool:
    """Whether a page of examples is full."""
    return page.count() == limit
