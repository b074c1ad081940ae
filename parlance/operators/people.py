"""Per-person diversity, exclusive words, and display metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import Chat, Filters
from ..session import shares
from .diversity import mtld, mtld_of, word_pieces
from .facts import with_tokens
from .scope import bot_people, scope

STATS_COLUMNS = [
    "person_id", "message_count", "unique_words", "total_words", "mtld", "word_entropy",
    "exclusive_word_count", "channel_count", "theme_count", "platform_count", "channel_hhi",
]


def breadth(rows: DataFrame) -> DataFrame:
    """Messages, channels, themes, platforms and concentration per person.

    Theme and platform follow from the channel, so one aggregation of the facts
    by (person, channel) carries all of it.
    """
    per = rows.groupBy("person_id", "channel_id", "theme_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    # one row per channel of a person
    share = F.col("n") / F.sum("n").over(W.partitionBy("person_id"))
    return per.withColumn("share", share).groupBy("person_id").agg(
        F.sum("n").alias("message_count"),
        F.count(F.lit(1)).alias("channel_count"),
        F.count_distinct("theme_id").alias("theme_count"),
        F.count_distinct("platform").alias("platform_count"),
        F.sum(F.col("share") * F.col("share")).alias("channel_hhi"),
    )


def words_said(chat: Chat, rows: DataFrame) -> DataFrame:
    """(person_id, word) as often as it is said, without stop words."""
    words = with_tokens(chat, rows).filter(~tx.is_stop_word(F.col("token")))
    return words.select("person_id", F.col("token").alias("word"))


def word_counts(chat: Chat, rows: DataFrame) -> DataFrame:
    """(person_id, word, n) without stop words."""
    parts = shares(rows)
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    dealt = rows.select("person_id", "content", part.alias("part")).repartitionById(parts, F.col("part"))
    words = with_tokens(chat, dealt).filter(~tx.is_stop_word(F.col("token")))
    return _counted(words.select("part", "person_id", F.col("token").alias("word")), parts)


def _counted(words: DataFrame, parts: int) -> DataFrame:
    """(person_id, word, n) of words that are dealt out by ``part``.

    Words are counted inside their part, then what is left is dealt out by person and word, both
    into as many tasks as the text takes: what a task holds does not grow with the text, and a
    word said over and over travels once a part.
    """
    inside = words.groupBy("part", "person_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return inside.repartition(parts, "person_id", "word").groupBy("person_id", "word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """Words, different words, and entropy in bits: log2 T - sum(c log2 c) / T."""
    n = F.col("n").cast("double")
    sums = counts.groupBy("person_id").agg(
        F.sum("n").alias("total_words"), F.count(F.lit(1)).alias("unique_words"), F.sum(n * F.log2(n)).alias("s")
    )
    return sums.withColumn("word_entropy", F.log2("total_words") - F.col("s") / F.col("total_words")).drop("s")


def exclusive(words: DataFrame) -> DataFrame:
    """(word, person_id) of words that one person alone uses, from ``words_said``.

    One aggregation by word decides it: the smallest and largest user agree.
    """
    users = words.groupBy("word").agg(F.min("person_id").alias("person_id"), F.max("person_id").alias("other"))
    return users.filter(F.col("person_id") == F.col("other")).drop("other")


def person_stats(chat: Chat, filters: Filters | None = None, shown: DataFrame | None = None) -> DataFrame:
    """All measures per person, unrounded.

    Without filters this is what a build stores: everybody, bots and moderated
    ids included. With filters it is the live view of that scope. ``shown`` holds
    the few ids (person_id) that are asked for; others only count as users of words.
    """
    rows = scope(chat, Filters(include_bots=True), excluded=True) if filters is None else scope(chat, filters)
    if shown is None:
        # the text is joined and cut up once, for both measures
        pieces, parts = word_pieces(rows)
        word = F.explode(F.split("tokens", " ")).alias("word")
        said = pieces.select("person_id", word)
        dealt = pieces.select(F.col("piece").alias("part"), "person_id", "tokens").repartitionById(parts, F.col("part"))
        counts = _counted(dealt.select("part", "person_id", word), parts)
        diverse = mtld_of(pieces)
    else:
        said = words_said(chat, rows)
        rows = rows.join(F.broadcast(shown), "person_id", "left_semi")
        counts, diverse = word_counts(chat, rows), mtld(rows)
    alone = exclusive(said).groupBy("person_id").agg(F.count(F.lit(1)).alias("exclusive_word_count"))
    zero = {"unique_words": 0, "total_words": 0, "word_entropy": 0.0, "exclusive_word_count": 0, "mtld": 0.0}
    return (
        breadth(rows)
        .join(vocabulary(counts), "person_id", "left")
        .join(alone, "person_id", "left")
        .join(diverse, "person_id", "left")
        .na.fill(zero)
        .select(*STATS_COLUMNS)
    )


def person_diversity(chat: Chat, filters=Filters(), limit: int = 50) -> DataFrame:
    """Rounded measures with names, biggest writers first.

    ``source`` tells whether the stored table or a live computation answered:
    dates, themes, platforms, and bots that are asked for need a live one.
    """
    live = bool(
        filters.start or filters.end or filters.themes or filters.platforms
        or (chat.config.bot_names and filters.include_bots) or chat.person_stats is None
    )
    people = chat.people
    if not filters.include_bots and chat.config.bot_names:
        people = people.filter(~F.col("display_name").isin(chat.config.bot_names))
    shown = None
    if not filters.people and chat.config.person_names:
        people = people.filter(F.col("display_name").isin(chat.config.person_names))
        shown = people.select(F.col("id").alias("person_id"))  # bounded by the configuration
    stats = person_stats(chat, filters, shown) if live else chat.person_stats
    if filters.people:
        stats = stats.filter(F.col("person_id").isin(*filters.people))
    avatars = chat.config.people_df(chat.spark).select(
        F.col("person").alias("display_name"), F.col("avatar"), F.col("color").alias("own_color")
    ).dropDuplicates(["display_name"])
    return (
        stats.join(people, F.col("person_id") == F.col("id"))
        .join(avatars, "display_name", "left")
        .orderBy(F.desc("message_count"), "display_name").limit(limit)
        .select(
            "id", "display_name",
            F.coalesce(F.nullif(F.col("color"), F.lit("")), "own_color", F.lit("")).alias("color"),
            F.coalesce("avatar", F.lit("")).alias("avatar"),
            "message_count", "unique_words", "total_words",
            F.round("mtld", 2).alias("mtld"), (F.round("word_entropy", 4) + 0.0).alias("word_entropy"),
            "exclusive_word_count", "channel_count", "theme_count", "platform_count",
            F.round("channel_hhi", 4).alias("channel_hhi"),
            F.lit("live" if live else "materialized").alias("source"),
        )
    )


def exclusive_words(
    chat: Chat, person_id: int, filters=Filters(), limit: int | None = None, dictionary: DataFrame | None = None
) -> DataFrame:
    """Words only this person uses within the scope, in order, flagged by a word list when one is given.

    ``dictionary`` has one column ``word``. All words, unless ``limit`` asks for the first
    ones only; ``truncated`` tells whether there are more.
    """
    words = exclusive(words_said(chat, scope(chat, filters))).filter(F.col("person_id") == person_id).select("word")
    if dictionary is None:
        flagged = words.withColumn("in_dictionary", F.lit(False))
    else:
        known = dictionary_words(dictionary).withColumn("known", F.lit(True))
        flagged = words.join(known, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("in_dictionary"))
    if limit is None:
        return flagged.withColumn("truncated", F.lit(False)).orderBy("word")
    page = flagged.orderBy("word").limit(limit + 1)
    whole = W.partitionBy()  # the page only: limit + 1 rows
    return page.withColumn("truncated", F.count(F.lit(1)).over(whole) > limit).orderBy("word").limit(limit)


def dictionary_words(lines: DataFrame) -> DataFrame:
    """Usable entries of a word list: letters only, at least three."""
    word = F.lower(F.trim("word"))
    return lines.select(word.alias("word")).filter(F.col("word").rlike(r"^\p{L}{3,}$")).distinct()


def people_metadata(chat: Chat) -> DataFrame:
    people = chat.people
    if chat.config.person_names:
        people = people.filter(F.col("display_name").isin(chat.config.person_names))
    extra = chat.config.people_df(chat.spark).select(
        F.col("person").alias("display_name"), F.col("avatar"), F.col("color").alias("own_color")
    ).dropDuplicates(["display_name"])
    bots = bot_people(chat).withColumn("is_bot", F.lit(True))
    return (
        people.join(extra, "display_name", "left").join(bots, "id", "left")
        .select(
            "id", F.col("display_name").alias("name"),
            F.coalesce(F.nullif(F.col("color"), F.lit("")), "own_color", F.lit("")).alias("color"),
            F.coalesce("avatar", F.lit("")).alias("avatar"), F.coalesce("is_bot", F.lit(False)).alias("is_bot"),
        )
        .orderBy("name", "id")
    )


def theme_metadata(chat: Chat) -> DataFrame:
    """Themes in configuration order; those of the data only when none are configured."""
    if chat.config.themes:
        return chat.config.themes_df(chat.spark).orderBy("id")
    return chat.themes.select("id", "name", F.lit("").alias("emoji")).orderBy("id")


def platform_metadata(chat: Chat) -> DataFrame:
    return chat.sources.select("platform").distinct().orderBy("platform")
