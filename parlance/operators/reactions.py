"""Reactions: one row per single reaction, and the rankings built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import bucket
from ..model import Chat, Filters
from .scope import scope, shown_channel

#: details are read as text fields, since exports disagree on their types
DETAIL_SCHEMA = (
    "array<struct<name:string,count:string,emoji_id:string,image_url:string,code:string,is_animated:string,"
    "reactors:string>>"
)
REACTOR_SCHEMA = "array<struct<platform:string,raw_id:string,display_name:string>>"
SUMMARY_PATTERN = r"(\S+)×(\d+)"


def _clean(column):
    return F.nullif(F.trim(F.coalesce(column, F.lit(""))), F.lit(""))


def reaction_items(messages: DataFrame) -> DataFrame:
    """Adds ``items``, the reactions listed for a message.

    The JSON list counts when it is one, even an empty one; otherwise the short
    summary is read.
    """
    details = F.from_json("reaction_details_json", DETAIL_SCHEMA)
    is_list = F.get_json_object("reaction_details_json", "$").isNotNull() & F.trim("reaction_details_json").startswith("[")
    parsed = F.coalesce(F.filter(details, lambda d: d.isNotNull()), F.array().cast(DETAIL_SCHEMA))
    summary = F.coalesce("reaction_summary", F.lit(""))
    names = F.regexp_extract_all(summary, F.lit(SUMMARY_PATTERN), F.lit(1))
    counts = F.regexp_extract_all(summary, F.lit(SUMMARY_PATTERN), F.lit(2))
    text = F.lit(None).cast("string")
    listed = F.transform(
        F.arrays_zip(names.alias("n"), counts.alias("c")),
        lambda x: F.struct(
            x["n"].alias("name"), x["c"].alias("count"), text.alias("emoji_id"), text.alias("image_url"),
            text.alias("code"), text.alias("is_animated"), text.alias("reactors"),
        ),
    )
    return messages.withColumn("items", F.when(is_list, parsed).otherwise(listed))


def reaction_events(messages: DataFrame, identities: DataFrame) -> DataFrame:
    """One row per single reaction, as many as the message's reaction_count.

    Item counts are cut to what is left of the message's count, reactors are cut
    to the item's count, and whatever has no reactor stays anonymous. ``messages``
    needs ``platform``, the one a reactor has when none is given. The work of a
    message stays inside its row, so there is no shuffle before the identity join.
    """
    total = F.greatest(F.coalesce("reaction_count", F.lit(0)), F.lit(0)).cast("bigint")
    rows = reaction_items(messages.select(
        "id", "platform", "reaction_count", "reaction_summary", "reaction_details_json"
    ).filter(F.col("reaction_count") > 0))
    truthy = ~F.lower(F.coalesce(F.col("x.is_animated"), F.lit("false"))).isin("false", "0", "", "null", "[]", "{}")

    wanted = F.transform(
        "items",
        lambda d: F.greatest(F.coalesce(d["count"].try_cast("double").cast("bigint"), F.lit(0)), F.lit(0)),
    )
    rows = rows.withColumn("wanted", wanted)
    # running total of the counts, clamped to the message's own count
    before = F.transform(
        "wanted",
        lambda c, i: F.least(
            F.aggregate(F.slice("wanted", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, b: a + b), total
        ),
    )
    rows = rows.withColumn("before", before)
    rows = rows.withColumn("counts", F.transform("wanted", lambda c, i: F.least(c, total - F.col("before")[i])))
    used = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    none = F.lit(None).cast("string")
    leftover = F.array(
        F.struct(
            none.alias("name"), none.alias("count"), none.alias("emoji_id"), none.alias("image_url"),
            none.alias("code"), none.alias("is_animated"), none.alias("reactors"),
        )
    )
    rows = rows.withColumn("all_items", F.concat("items", leftover)).withColumn(
        "all_counts", F.concat("counts", F.array(F.greatest(total - used, F.lit(0).cast("bigint"))))
    )
    item = rows.select(
        F.col("id").alias("message_id"), "platform", "before", "all_counts",
        F.posexplode("all_items").alias("pos", "x"),
    ).withColumn("n", F.col("all_counts")[F.col("pos")]).filter(F.col("n") > 0)
    start = F.coalesce(
        F.try_element_at("before", F.col("pos") + 1),
        F.aggregate(F.slice("all_counts", F.lit(1), F.col("pos")), F.lit(0).cast("bigint"), lambda a, b: a + b),
    )
    reactors = F.filter(
        F.slice(F.coalesce(F.from_json("x.reactors", REACTOR_SCHEMA), F.array().cast(REACTOR_SCHEMA)), F.lit(1), F.col("n").cast("int")),
        lambda r: _clean(r["raw_id"]).isNotNull(),
    )
    item = item.withColumn("start", start).withColumn("who", reactors)
    single = item.select(
        "message_id", "platform", "start", "who", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")
    ).withColumn("r", F.try_element_at("who", (F.col("k") + 1).cast("int")))
    events = single.select(
        "message_id",
        (F.col("start") + F.col("k")).cast("int").alias("reaction_index"),
        F.coalesce(_clean(F.col("x.name")), F.lit("unknown")).alias("emoji"),
        F.when(
            F.col("r").isNotNull(), F.coalesce(F.nullif(F.col("r.platform"), F.lit("")), F.col("platform"))
        ).alias("reactor_platform"),
        _clean(F.col("r.raw_id")).alias("reactor_raw_id"),
        _clean(F.col("r.display_name")).alias("reactor_display_name"),
        _clean(F.col("x.emoji_id")).alias("emoji_id"),
        _clean(F.col("x.image_url")).alias("image_url"),
        _clean(F.col("x.code")).alias("code"),
        truthy.alias("is_animated"),
    )
    who = identities.select(
        F.col("platform").alias("reactor_platform"), F.col("platform_user_id").alias("reactor_raw_id"),
        F.col("person_id").alias("reactor_person_id"),
    )
    # without a reactor there is no platform either, which finds nobody; the reaction's own number stands in for the
    # id, so that these rows are dealt out and do not meet in one task under a key of nulls
    own = F.concat(F.col("message_id"), F.lit("#"), F.col("reaction_index").cast("string"))
    events = events.withColumn("key", F.coalesce("reactor_raw_id", own))
    return events.join(who.withColumnRenamed("reactor_raw_id", "key"), ["reactor_platform", "key"], "left").select(
        "message_id", "reaction_index", "emoji", "reactor_platform", "reactor_raw_id", "reactor_display_name",
        "reactor_person_id", "emoji_id", "image_url", "code", "is_animated",
    )


def reaction_authors(chat: Chat, filters=Filters(), limit: int = 15) -> DataFrame:
    """Reactions received per author."""
    sums = (
        scope(chat, filters).groupBy("person_id").agg(F.sum(F.col("reaction_count").cast("bigint")).alias("count"))
        .filter(F.col("count") > 0)
    )
    return (
        sums.join(chat.people, F.col("person_id") == F.col("id"))
        .select("id", "display_name", "color", "count")
        .orderBy(F.desc("count"), "display_name").limit(limit)
    )


def reactions_over_time(chat: Chat, filters=Filters()) -> DataFrame:
    n = F.coalesce("reaction_count", F.lit(0)).cast("bigint")
    return (
        scope(chat, filters).groupBy(bucket(F.col("ts"), "month").alias("bucket"))
        .agg(
            F.sum(n).alias("reaction_count"),
            F.count(F.lit(1)).alias("message_count"),
            F.sum(F.when(n > 0, 1).otherwise(0)).alias("reacted_message_count"),
        )
        .withColumn("reactions_per_message", F.col("reaction_count") / F.col("message_count"))
        .orderBy("bucket")
    )


def _scoped_events(chat: Chat, filters: Filters) -> DataFrame:
    rows = scope(chat, filters).select(F.col("id").alias("message_id"), "source_name")
    return chat.reaction_events.join(rows, "message_id")


def reaction_coverage(chat: Chat, filters=Filters()) -> DataFrame:
    """How many reactions are known by identity, and by person. Without stored events only the total is known."""
    if chat.reaction_events is None:
        out = scope(chat, filters).agg(
            F.coalesce(F.sum(F.col("reaction_count").cast("bigint")), F.lit(0)).alias("total_reactions"),
            F.lit(0).cast("bigint").alias("identified_reactions"),
            F.lit(0).cast("bigint").alias("resolved_reactions"),
        )
    else:
        out = _scoped_events(chat, filters).agg(
            F.count(F.lit(1)).alias("total_reactions"),
            F.count("reactor_raw_id").alias("identified_reactions"),
            F.count("reactor_person_id").alias("resolved_reactions"),
        )
    ratio = F.col("identified_reactions") / F.col("total_reactions")
    return out.withColumn("identity_coverage", F.when(F.col("total_reactions") > 0, ratio).otherwise(0.0))


def top_reactors(chat: Chat, filters=Filters(), limit: int = 20) -> DataFrame:
    counts = (
        _scoped_events(chat, filters).filter(F.col("reactor_person_id").isNotNull())
        .groupBy("reactor_person_id").agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        counts.join(chat.people, F.col("reactor_person_id") == F.col("id"))
        .select("id", "display_name", "color", "count")
        .orderBy(F.desc("count"), "display_name").limit(limit)
    )


def top_reacted_messages(chat: Chat, filters=Filters(), limit: int = 6, offset: int = 0) -> DataFrame:
    """A page of messages by reactions received. ``has_more`` tells whether another page follows."""
    order = [F.desc("reaction_count"), F.desc("ts"), F.desc("id")]
    known = chat.people.select(F.col("id").alias("person_id"))
    page = scope(chat, filters).filter(F.col("reaction_count") > 0).join(known, "person_id", "left_semi").orderBy(*order)
    page = (page.offset(offset) if offset else page).limit(limit + 1)
    people = chat.people.select(
        F.col("id").alias("person_id"), F.col("display_name").alias("person_name"), F.col("color").alias("person_color")
    )
    named = page.join(people, "person_id")
    whole = Window.partitionBy()  # the page only: limit + 1 rows
    return (
        named.withColumn("has_more", F.count(F.lit(1)).over(whole) > limit)
        .orderBy(*order).limit(limit)
        .select(
            "id", "ts", F.trim(F.coalesce("content", F.lit(""))).alias("content"), "attachment_preview",
            "person_name", "person_color",
            shown_channel(chat, F.col("channel_name"), F.col("source_name")).alias("channel_name"),
            "source_name", F.col("reaction_count").cast("bigint").alias("reaction_count"),
            "reaction_summary", "has_more",
        )
    )


def emoji_usage(chat: Chat, filters=Filters(), limit: int = 30) -> DataFrame:
    """Uses per emoji; the image shown is the smallest one known, with its source."""
    if chat.reaction_events is None:
        return emoji_usage_live(chat, filters, limit)
    image = F.when(F.col("image_url").isNotNull(), F.struct("image_url", "source_name"))
    return (
        _scoped_events(chat, filters).filter(F.col("emoji") != "unknown")
        .groupBy("emoji").agg(F.count(F.lit(1)).alias("count"), F.min(image).alias("image"))
        .orderBy(F.desc("count"), "emoji").limit(limit)
        .select(F.col("emoji").alias("name"), "count", "image.image_url", "image.source_name")
    )


def emoji_usage_live(chat: Chat, filters=Filters(), limit: int = 30) -> DataFrame:
    """Emoji counts straight from the details or summaries of messages, unclamped; ties by name."""
    rows = scope(chat, filters).filter(F.col("reaction_count") > 0)
    # a message with details is never read by its summary, even when they cannot be parsed
    bare = rows.withColumn(
        "reaction_summary", F.when(F.coalesce("reaction_details_json", F.lit("")) == "", F.col("reaction_summary"))
    )
    item = reaction_items(bare).select("source_name", F.explode("items").alias("x")).select(
        "source_name", _clean(F.col("x.name")).alias("name"),
        F.col("x.count").try_cast("double").cast("bigint").alias("n"), _clean(F.col("x.image_url")).alias("image_url"),
    ).filter(F.col("name").isNotNull() & (F.col("n") > 0))
    image = F.when(F.col("image_url").isNotNull(), F.struct("image_url", "source_name"))
    return (
        item.groupBy("name").agg(F.sum("n").alias("count"), F.min(image).alias("image"))
        .orderBy(F.desc("count"), "name").limit(limit)
        .select("name", "count", "image.image_url", "image.source_name")
    )
