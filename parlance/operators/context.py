"""Messages around a message, and names as they were at the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MONTH_KEY, Chat
from .asof import as_of
from .numbering import numbered
from .scope import channel_dim, shown_channel

WINDOW_COLUMNS = [
    "id", "ts", "content", "attachment_preview", "attachment_count", "reaction_count", "reaction_summary",
    "reaction_details_json", "person_id", "is_system", "reply_to_id", "channel_id",
]


def nickname_changes(chat: Chat) -> DataFrame:
    """Nickname changes by person and chat. Unlike the author lookup, a cleared nickname stays visible."""
    return chat.person_name_changes.select(
        "id", "person_id", "source_id", F.get_json_object("payload_json", "$.chatId").alias("chat_id"), "new_name", "ts"
    )


def _resolved_name(nickname: Column, canonical: Column, content: Column) -> Column:
    """The nickname, unless the text itself starts with the canonical name."""
    own = F.startswith(F.lower(content), F.lower(F.concat(canonical, F.lit(" "))))
    return F.when(F.coalesce(own, F.lit(False)), canonical).otherwise(
        F.coalesce(F.nullif(nickname, F.lit("")), canonical)
    )


def names_at_time(chat: Chat, messages: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Author names as shown when each message was written, for all messages at once; keeps the columns ``more``."""
    rows = (chat.messages if messages is None else messages).select(*more, *WINDOW_COLUMNS)
    dim = channel_dim(chat).select(
        "channel_id", "source_id", F.col("platform_channel_id").alias("chat_id"), "platform", "source_name"
    )
    people = chat.people.select(
        F.col("id").alias("person_id"), F.col("display_name").alias("person_name_canonical"),
        F.col("color").alias("person_color"),
    )
    dated = as_of(
        rows.join(dim, "channel_id"), nickname_changes(chat), ["person_id", "source_id", "chat_id"],
        "new_name", "nickname_at_time", tie="id",
    ).join(people, "person_id", "left")
    name = _resolved_name(F.col("nickname_at_time"), F.col("person_name_canonical"), F.col("content"))
    return dated.withColumn("person_name", name).drop("source_id", "chat_id")


def channel_names_at_time(chat: Chat, messages: DataFrame | None = None) -> DataFrame:
    """(id, ts, channel_id, channel_name): chat names as they were when each message was written."""
    rows = (chat.messages if messages is None else messages).select("id", "ts", "channel_id")
    changes = chat.channel_name_changes.select(F.col("id").alias("change_id"), "channel_id", "new_name", "ts")
    dated = as_of(rows, changes, ["channel_id"], "new_name", "name_then", tie="change_id")
    dim = channel_dim(chat).select("channel_id", F.col("channel_name").alias("now"), "source_name")
    named = dated.join(dim, "channel_id")
    name = F.coalesce("name_then", F.nullif("now", F.lit("")), F.col("source_name"))
    return named.select("id", "ts", "channel_id", shown_channel(chat, name, F.col("source_name")).alias("channel_name"))


def message_places(messages: DataFrame) -> DataFrame:
    """(id, channel_id, ts, place): numbers in (channel, ts, id) order, so neighbours in a channel differ by one.

    The rows come range-partitioned and sorted by ``place``; stored messages bring their month.
    """
    month = [MONTH_KEY] if MONTH_KEY in messages.columns else []
    return numbered(messages.select("channel_id", "ts", "id", *month), ["channel_id", "ts", "id"], "place")


def message_windows(chat: Chat, targets: DataFrame, context: int = 10) -> DataFrame:
    """Every target with up to ``context`` neighbours on each side, names as they were then.

    ``targets`` has ``id``; null, repeated and unknown ids give no further rows.
    ``target_id`` and ``step`` (place relative to the target) lead each row. Targets
    are looked up by id, their neighbours by place: two equality joins on narrow
    tables, which a build stores in the right order (see ``Chat.places``). Work
    grows with targets times ``context``, however long a channel is.
    """
    places = chat.places if chat.places is not None else chat.once("places", lambda: message_places(chat.messages))
    ordered = chat.ordered if chat.ordered is not None else places
    month = [MONTH_KEY] if MONTH_KEY in ordered.columns and MONTH_KEY in chat.messages.columns else []
    aims = targets.select("id").na.drop().distinct().join(places, "id").select(F.col("id").alias("target_id"), "channel_id", "place")
    near = aims.withColumn("step", F.explode(F.sequence(F.lit(-context), F.lit(context)))).withColumn("place", F.col("place") + F.col("step"))
    hits = ordered.join(near, ["channel_id", "place"]).select("id", *month, "target_id", "step")
    return with_avatars(chat, names_at_time(chat, chat.messages.join(hits, ["id", *month]), ("target_id", "step")))


def _target(chat: Chat, message_id: str):
    """Place of one message, at most one row: in a build from the table sorted by id, whose
    Bloom filters leave few blocks to read."""
    table = chat.places if chat.places is not None else chat.messages
    found = table.filter(F.col("id") == message_id).select("id", "ts", "channel_id", *(["place"] if "place" in table.columns else [])).head(1)
    if not found:
        raise LookupError(f"Message not found: {message_id}")
    return found[0]


def _order_split(target) -> tuple[Column, Column]:
    ts = F.lit(target.ts).cast("timestamp_ntz")
    in_channel = F.col("channel_id") == F.lit(target.channel_id)
    before = (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < target.id))
    return in_channel, before


def window_rows(chat: Chat, message_id: str, context: int = 10, full: bool = False) -> DataFrame:
    """A message with up to ``context`` neighbours on each side in (ts, id) order.

    With stored places the neighbours are a range of numbers, and messages are read in
    their months only. Without, both sides are top-k selections on a filtered scan; the
    channel is never numbered or sorted as a whole.
    """
    target = _target(chat, message_id)
    in_channel, before = _order_split(target)
    rows = chat.messages.filter(in_channel)
    if full:
        return rows
    if chat.ordered is not None and "place" in target:
        near = chat.ordered.filter(in_channel & F.col("place").between(target.place - context, target.place + context))
        keys = [c for c in ("id", MONTH_KEY) if c in near.columns and c in rows.columns]
        return rows.join(near.select(*keys), keys, "left_semi")
    earlier = rows.filter(before).orderBy(F.desc("ts"), F.desc("id")).limit(context)
    later = rows.filter(~before).orderBy("ts", "id").limit(context + 1)
    return earlier.unionByName(later)


def with_avatars(chat: Chat, rows: DataFrame) -> DataFrame:
    avatars = chat.config.people_df(chat.spark).select(
        F.col("person").alias("person_name_canonical"), F.nullif("avatar", F.lit("")).alias("avatar_url")
    ).dropDuplicates(["person_name_canonical"])
    return rows.join(avatars, "person_name_canonical", "left")


def message_window(chat: Chat, message_id: str, context: int = 10, full: bool = False) -> DataFrame:
    """The neighbourhood of a message, with names as they were then."""
    return with_avatars(chat, names_at_time(chat, window_rows(chat, message_id, context, full))).orderBy("ts", "id")


def message_window_info(chat: Chat, message_id: str, context: int = 10, full: bool = False) -> DataFrame:
    """Channel name at the time, size of the channel, and whether the window covers it."""
    target = _target(chat, message_id)
    in_channel, before = _order_split(target)
    sizes = chat.messages.filter(in_channel).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("total_in_channel"), F.count(F.when(before, 1)).alias("index")
    )
    here = channel_names_at_time(chat, chat.messages.filter(in_channel & (F.col("id") == target.id)))
    got = F.least(F.col("index"), F.lit(context)) + 1 + F.least(
        F.col("total_in_channel") - F.col("index") - 1, F.lit(context)
    )
    dim = channel_dim(chat).select("channel_id", "platform", "source_name")
    return here.join(sizes, "channel_id").join(dim, "channel_id").select(
        "channel_name", "platform", "source_name", "total_in_channel",
        (F.lit(full) | (got >= F.col("total_in_channel"))).alias("is_full"),
    )


def message_snippet(chat: Chat, message_id: str, context: int = 5) -> DataFrame:
    """The neighbourhood of a message under canonical names only."""
    people = chat.people.select(
        F.col("id").alias("person_id"), F.col("display_name").alias("person_name"), F.col("color").alias("person_color")
    )
    return window_rows(chat, message_id, context).join(people, "person_id", "left").select(
        "id", "ts", "content", "attachment_preview", "attachment_count", "reaction_count", "reaction_summary",
        "reaction_details_json", "person_name", "person_color",
    ).orderBy("ts", "id")
