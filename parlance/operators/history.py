"""Name history: chat renames, nicknames, and who made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import name_key, squeeze
from ..model import Chat, Filters
from ..session import written
from .asof import as_of
from .scope import channel_dim, in_dates, shown_channel

CLEARED = "(cleared)"


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _not_you(text: Column) -> Column:
    return F.when(~name_key(text).isin("", "you"), text)


def identity_names(chat: Chat) -> DataFrame:
    """(platform, raw_id, person_id, resolved, preferred): the name an identity is shown under,
    and the best one its person is known by.

    ``resolved`` is the person's own name, except where that is missing or "You": then
    the configured name, then any better name the person is known by.
    """
    known = chat.platform_identities.select(
        "platform", F.col("platform_user_id").alias("raw_id"), "person_id"
    ).join(chat.people.select(F.col("id").alias("person_id"), "display_name"), "person_id")
    configured = chat.config.identities_df(chat.spark).select("platform", "raw_id", "person", "pos")
    both = known.join(configured, ["platform", "raw_id"], "full")
    better = preferred_names(both)
    name = F.col("display_name")
    first = F.when(name.isNull() | (name_key(name) == "you"), F.coalesce("person", name)).otherwise(name)
    return both.withColumn("first", first).join(better, "person_id", "left").select(
        "platform", "raw_id", "person_id",
        F.when(name_key(F.col("first")) == "you", F.coalesce("preferred", "first")).otherwise(F.col("first")).alias("resolved"), "preferred",
    )


def preferred_names(identities: DataFrame) -> DataFrame:
    """(person_id, preferred): configured name, else own name, else an id, never "You"."""
    return (
        identities.filter(F.col("person_id").isNotNull()).groupBy("person_id")
        .agg(
            F.max_by("person", "pos").alias("c"),
            F.min(_not_you(F.col("display_name"))).alias("n"),
            F.min(_not_you(F.col("raw_id"))).alias("i"),
        )
        .select("person_id", F.coalesce("c", "n", "i").alias("preferred"))
    )


def actor_display_name(
    actor_name: Column, resolved: Column, nickname: Column, owner: str | None
) -> Column:
    """Nickname, else canonical name, else raw name; "You" replaced; the canonical name added in brackets."""
    owner_col = F.lit(owner).cast("string")
    resolved = F.when(name_key(resolved) == "you", owner_col).otherwise(_filled(resolved))
    shown = F.coalesce(_filled(nickname), resolved, _filled(actor_name))
    real = F.coalesce(F.when(name_key(resolved) != "you", resolved), _filled(owner_col))
    bracket = F.concat(F.lit("("), real, F.lit(")"))
    swapped = squeeze(F.replace(F.replace(shown, F.lit("(You)"), bracket), F.lit("(you)"), bracket))
    shown = (
        F.when(real.isNotNull() & (name_key(shown) == "you"), real)
        .when(real.isNotNull() & F.contains(F.lower(shown), F.lit("(you)")), swapped)
        .otherwise(shown)
    )
    suffix = F.concat(F.lit("("), resolved, F.lit(")"))
    plain = F.contains(F.lower(shown), F.lower(suffix)) | (name_key(shown) == name_key(resolved))
    return F.when(shown.isNull(), resolved).when(resolved.isNull() | plain, shown).otherwise(
        F.concat(shown, F.lit(" "), suffix)
    )


def nickname_timeline(chat: Chat) -> DataFrame:
    """Nickname changes with their chat; a cleared nickname is a change to null."""
    changes = chat.person_name_changes.select(
        "source_id", F.get_json_object("payload_json", "$.chatId").alias("chat_id"),
        F.col("person_id").alias("actor_id"), "ts", F.col("new_name"),
    ).filter(F.col("chat_id") != "").distinct()
    gone = name_key(F.col("new_name")).isin("", CLEARED)
    return changes.withColumn("nickname", F.when(~gone, F.col("new_name")))


def with_actor(chat: Chat, changes: DataFrame, identities: DataFrame) -> DataFrame:
    """Adds author_name to changes with platform, source_id, chat_id, actor_name, actor_raw_id and ts."""
    names = identities.select(
        "platform", F.col("raw_id").alias("actor_raw_id"), F.col("person_id").alias("actor_id"), "resolved"
    )
    known = changes.join(names, ["platform", "actor_raw_id"], "left")
    dated = as_of(
        known, nickname_timeline(chat), ["source_id", "chat_id", "actor_id"], "nickname", "actor_nickname", tie="new_name"
    )
    author = actor_display_name(
        F.col("actor_name"), F.col("resolved"), F.col("actor_nickname"), chat.config.primary_person
    )
    return dated.withColumn("author_name", author).drop("actor_id", "resolved", "actor_nickname")


def channel_changes(chat: Chat, filters=Filters()) -> DataFrame:
    """Distinct channel changes with a non-blank new name."""
    payload = F.col("payload_json")
    distinct = chat.channel_name_changes.select(
        "channel_id", "previous_name", "new_name", "ts",
        F.get_json_object(payload, "$.actor_name").alias("actor_name"),
        F.coalesce(
            F.get_json_object(payload, "$.actor_raw_id"),
            F.get_json_object(payload, "$.updateMessage.groupChange.updates[0].groupNameUpdate.updaterAci"),
        ).alias("actor_raw_id"),
    ).distinct().filter(F.trim("new_name") != "")
    dim = channel_dim(chat)
    if filters.platforms:
        dim = dim.filter(F.col("platform").isin(*filters.platforms))
    return in_dates(distinct, filters).join(dim, "channel_id").withColumnRenamed("platform_channel_id", "chat_id")


def chats_of_configured_people(chat: Chat, least: int = 2) -> DataFrame:
    """Channels where at least two configured people wrote."""
    people = chat.people.filter(F.col("display_name").isin(chat.config.person_names)).select(
        F.col("id").alias("person_id")
    )
    return (
        chat.messages.select("channel_id", "person_id").distinct()
        .join(people, "person_id", "left_semi")
        .groupBy("channel_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("channel_id")
    )


def renames(chat: Chat, filters=Filters()) -> DataFrame:
    """Real renames of chats without their author.

    Chats that never changed from one name to another are left out; Signal chats
    need two configured people.
    """
    changes = channel_changes(chat, filters)
    before, after = name_key(F.col("previous_name")), name_key(F.col("new_name"))
    kept = changes.filter((after != "") & (before != after))
    ever = F.max(before != "").over(W.partitionBy("channel_id"))
    rows = kept.withColumn("renamed", ever).filter("renamed").drop("renamed")
    admitted = chats_of_configured_people(chat).withColumn("ok", F.lit(True))
    rows = rows.join(admitted, "channel_id", "left").filter((F.col("platform") != "signal") | F.col("ok")).drop("ok")
    return rows.withColumn("current_name", shown_channel(chat, F.col("channel_name"), F.col("source_name")))


def rename_history(chat: Chat, filters=Filters()) -> DataFrame:
    """Real renames of chats, one row each, with their author."""
    return with_actor(chat, renames(chat, filters), identity_names(chat)).select(
        F.col("channel_id").alias("id"), "platform", "source_name", "source_id", "current_name",
        F.col("chat_id").alias("platform_channel_id"), "previous_name", "new_name", "author_name", "ts",
    )


def nickname_history(chat: Chat, filters=Filters()) -> DataFrame:
    """Nickname changes per chat and person, one row each, with their author."""
    payload = F.col("payload_json")
    distinct = chat.person_name_changes.select(
        "person_id", "source_id",
        F.get_json_object(payload, "$.chatId").alias("chat_id"),
        F.get_json_object(payload, "$.actor_name").alias("actor_name"),
        F.get_json_object(payload, "$.actor_raw_id").alias("actor_raw_id"),
        "previous_name", "new_name", "ts",
    ).distinct().filter(F.col("chat_id") != "")
    rows = in_dates(distinct, filters)
    if filters.people:
        rows = rows.filter(F.col("person_id").isin(*filters.people))
    sources = chat.sources.select(F.col("id").alias("source_id"), "platform")
    if filters.platforms:
        sources = sources.filter(F.col("platform").isin(*filters.platforms))
    people = chat.people.select(F.col("id").alias("person_id"), "display_name")
    identities = written(identity_names(chat))  # read twice
    rows = with_actor(chat, rows.join(sources, "source_id").join(people, "person_id"), identities)
    better = identities.filter(F.col("person_id").isNotNull()).select("person_id", "preferred").distinct()
    owner = F.lit(chat.config.primary_person).cast("string")
    shown = F.coalesce(
        "preferred", F.when(name_key(F.col("display_name")) == "you", owner), F.col("display_name")
    )
    return rows.join(better, "person_id", "left").select(
        "source_id", "platform", "chat_id", "person_id", shown.alias("display_name"),
        "previous_name", "new_name", F.coalesce("author_name", "display_name").alias("author_name"), "ts",
    )


def chat_participants(chat: Chat, filters=Filters()) -> DataFrame:
    """Nickname history of the chats that have a rename history."""
    chats = renames(chat, filters).select("source_id", "chat_id", "channel_id", "current_name", "source_name").distinct()
    return nickname_history(chat, filters).join(chats, ["source_id", "chat_id"])


def nickname_groups(chat: Chat, filters=Filters()) -> DataFrame:
    """Facebook nicknames by person name, repeated changes of a chat counted once."""
    rows = chat_participants(chat, filters).filter(F.col("platform") == "facebook")
    rows = rows.withColumn("person_key", F.lower(F.trim("display_name")))
    events = rows.groupBy("person_key", "channel_id", "current_name", "source_name", "ts", "new_name", "author_name").agg(
        F.min("previous_name").alias("previous_name"), F.min(F.struct("person_id", "display_name")).alias("p")
    )
    person = F.min("p").over(W.partitionBy("person_key"))
    return events.withColumn("p", person).select(
        F.col("p.person_id").alias("id"), F.col("p.display_name").alias("display_name"), "channel_id",
        "current_name", "source_name", "previous_name", "new_name", "author_name", "ts",
    )
