"""Signal backups as JSON lines: account, recipient, chat and chatItem records.

Lines are read as text, so a large backup is split over many tasks. Each line is
parsed once: the records are stored by kind as Parquet, and everything after reads
the kinds and columns it needs. Recipients and chats are small tables joined to the
items.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.names import casefold
from ..functions.times import from_micros
from ..session import pinned, written
from .facebook import ranked_summary
from .seeds import Export
from .signal import LEAST_CONFIGURED, group_name_change, is_system_text, title_changes

# --- fixed values -----------------------------------------------------------
PHOTO_CHANGED, EMOJI_CHANGED, POLL = "(photo changed)", "(emoji changed)", "(poll)"
REACTION_KEYS = ("reactions", "reactionList", "reactionData")
OWN_RECIPIENT = "1"
KINDS = ("account", "recipient", "chat", "chatItem")
# ----------------------------------------------------------------------------

CONTACT = (
    "profileGivenName string, profileFamilyName string, systemGivenName string, systemFamilyName string, "
    "systemNickname string, profileName string, name string, e164 string, aci string, pni string"
)
_REACTIONS = ", ".join(f"{k} string" for k in REACTION_KEYS)
_EMOJI = "struct<emoji:string,reaction:string>"
RECORD = (
    "account struct<givenName:string,username:string>, "
    f"recipient struct<id string, self string, contact struct<{CONTACT}>, "
    "group struct<snapshot:struct<title:struct<title:string>,members:array<struct<userId:string>>>>>, "
    "chat struct<id:string,recipientId:string>, "
    f"chatItem struct<chatId string, authorId string, dateSent string, {_REACTIONS}, stickerMessage string, viewOnceMessage string, "
    f"standardMessage struct<text struct<body:string>, attachments array<struct<pointer:struct<fileName:string,contentType:string>,fileName:string,contentType:string>>, {_REACTIONS}>, "
    "contactMessage struct<text:struct<body:string>>, "
    "updateMessage struct<profileChange:struct<previousName:string,newName:string>,groupChange:struct<updates:array<struct<"
    "groupNameUpdate:struct<newGroupName:string>,groupIconUpdate:string,groupPhotoUpdate:string,"
    f"groupEmojiUpdate:{_EMOJI},groupReactionUpdate:{_EMOJI},poll:string,pollUpdate:string>>>>>"
)


def _full(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *[_full(p) for p in parts]), F.lit(""))


@F.pandas_udf(StringType())
def canonical_sha1(items: pd.Series) -> pd.Series:
    """Hash of a JSON object with sorted keys and no blanks."""
    return items.map(
        lambda t: hashlib.sha1(
            json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8")
        ).hexdigest()
    )


def _recipients(records: DataFrame, given: str | None, username: str | None) -> DataFrame:
    """(recipient_id, raw_id, display_name, stable ids, is_group, title, members)"""
    r, c = F.col("recipient"), F.col("recipient.contact")
    own = F.col("recipient.self").isNotNull()
    own_name = " ".join(p.strip() for p in (given, username) if p and p.strip()) or None
    own_id = F.lit(username or None).cast("string")
    display = F.when(
        own, F.coalesce(F.lit(own_name).cast("string"), F.concat(F.lit("Signal "), r["id"]))
    ).otherwise(
        F.coalesce(
            _joined(c["profileGivenName"], c["profileFamilyName"]), _joined(c["systemGivenName"], c["systemFamilyName"]),
            *[F.nullif(c[k], F.lit("")) for k in ("systemNickname", "profileName", "name", "e164", "aci", "pni")], r["id"],
        )
    )
    stable = [F.nullif(c[k], F.lit("")) for k in ("aci", "pni", "e164")]
    raw = F.when(own, F.coalesce(own_id, F.concat(F.lit("signal-self:"), r["id"]))).otherwise(F.coalesce(*stable, r["id"]))
    return records.filter("kind = 'recipient'").select(
        r["id"].alias("recipient_id"), raw.alias("raw_id"), display.alias("display_name"),
        F.filter(F.array(*stable), lambda s: s.isNotNull()).alias("stable"),
        r["group"].isNotNull().alias("is_group"), r["group"]["snapshot"]["title"]["title"].alias("title"),
        F.transform(r["group"]["snapshot"]["members"], lambda m: m["userId"]).alias("members"),
    )


def _first_reactions(item: Column) -> Column:
    values = [item[k] for k in REACTION_KEYS] + [item["standardMessage"][k] for k in REACTION_KEYS]
    return F.coalesce(*[F.when(~v.isin("", "[]", "{}", "0", "null", "false"), v) for v in values])


def reaction_total(value: Column) -> Column:
    """Length of a list, of the list inside an object, the number itself, or one for another object."""
    nested = F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in REACTION_KEYS])
    whole = F.trim(value)
    return F.coalesce(
        F.when(whole.startswith("["), F.json_array_length(value))
        .when(whole.startswith("{"), F.coalesce(F.json_array_length(nested), F.lit(1)))
        .otherwise(value.try_cast("int")),
        F.lit(0),
    )


def _title_updates(items: DataFrame) -> DataFrame:
    """(chat, ts, pos, name, payload): new group titles and other changes listed with them."""

    def named(u: Column) -> Column:
        emoji = F.coalesce(u["groupEmojiUpdate"], u["groupReactionUpdate"])
        return (
            F.when(u["groupNameUpdate"].isNotNull(), _full(u["groupNameUpdate"]["newGroupName"]))
            .when(u["groupIconUpdate"].isNotNull() | u["groupPhotoUpdate"].isNotNull(), F.lit(PHOTO_CHANGED))
            .when(emoji.isNotNull(), F.coalesce(F.nullif(emoji["emoji"], F.lit("")), F.nullif(emoji["reaction"], F.lit("")), F.lit(EMOJI_CHANGED)))
            .when(u["poll"].isNotNull() | u["pollUpdate"].isNotNull(), F.lit(POLL))
        )

    listed = F.transform(F.col("item.updateMessage.groupChange.updates"), named)
    said = F.array(group_name_change(F.col("content"))["name"])
    names = F.filter(F.concat(F.coalesce(listed, F.array().cast("array<string>")), said), lambda n: n.isNotNull())
    return items.select("chat", "ts", "pos", "payload", F.explode(names).alias("name"))


def stored_records(lines: DataFrame) -> DataFrame:
    """One row a record, stored below a folder for each ``kind``; the only place where lines are parsed.

    ``pos`` is the order of the lines, ``payload`` the text of a chat item.
    """
    parsed = lines.select(F.from_json("value", RECORD).alias("r"), "value", F.monotonically_increasing_id().alias("pos"))
    kind = F.coalesce(*[F.when(F.col(f"r.{k}").isNotNull(), F.lit(k)) for k in KINDS])
    payload = F.when(F.col("r.chatItem").isNotNull(), F.get_json_object("value", "$.chatItem"))
    return written(parsed.select("r.*", "pos", payload.alias("payload"), kind.alias("kind")).filter(F.col("kind").isNotNull()), by="kind")


def read_signal_backup(lines: DataFrame, source: str, identities: set[str] | None = None) -> Export:
    """Group chats of a backup from its lines, as ``spark.read.text`` gives them.

    With ``identities``, only chats with at least two of them.
    """
    records = stored_records(lines)
    # one account record per backup; of several the first
    account = records.filter("kind = 'account'").orderBy("pos").select("account.*").head()
    recipients = pinned(_recipients(records, account and account.givenName, account and account.username))
    chats = records.filter("kind = 'chat'").select(F.col("chat.id").alias("chat"), F.col("chat.recipientId").alias("recipient_id"))
    groups = chats.join(recipients.filter("is_group").select("recipient_id", "title", "members"), "recipient_id").select(
        "chat", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Signal group "), "chat")).alias("title"), "members"
    )
    person = recipients.filter(~F.col("is_group")).select("recipient_id", "raw_id", "display_name")
    item = F.col("chatItem")
    content = F.coalesce(
        F.nullif(item["standardMessage"]["text"]["body"], F.lit("")), F.nullif(item["contactMessage"]["text"]["body"], F.lit("")), F.lit("")
    )
    items = records.filter("kind = 'chatItem'").select(
        item["chatId"].alias("chat"), item["authorId"].alias("author_id"), item.alias("item"), content.alias("content"),
        from_micros(item["dateSent"].cast("bigint") * 1000).alias("ts"), "pos", "payload",
    )
    # one row per stable id: the first recipient that carries it
    by_stable = (
        recipients.select("recipient_id", "raw_id", F.explode("stable").alias("stable"))
        .groupBy("stable").agg(F.min_by(F.struct("recipient_id", "raw_id"), F.length("recipient_id")).alias("m"))
        .select("stable", "m.recipient_id", F.col("m.raw_id").alias("mapped"))
    )
    members = groups.select("chat", F.explode("members").alias("stable")).filter(F.col("stable") != "").join(by_stable, "stable", "left")
    if identities is not None:
        wanted = sorted({i.casefold() for i in identities})
        wrote = items.select("chat", "author_id").distinct().join(
            person.select(F.col("recipient_id").alias("author_id"), "raw_id"), "author_id"
        )
        ids = (
            members.select("chat", F.explode(F.array("stable", "mapped")).alias("raw_id"))
            .unionByName(wrote.select("chat", "raw_id")).select("chat", casefold(F.col("raw_id")).alias("raw_id"))
            .filter(F.col("raw_id").isin(wanted)).distinct()
        )
        enough = ids.groupBy("chat").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_CONFIGURED)
        groups = groups.join(enough, "chat", "left_semi")
        members = members.join(enough, "chat", "left_semi")
    # a row a chat: stored, so that its size is known and the items of a busy chat need not meet in one task
    groups = written(groups)
    authors = person.select(F.col("recipient_id").alias("author_id"), "raw_id", "display_name")
    items = pinned(
        items.join(groups.select("chat", "title"), "chat").join(authors, "author_id", "left")
        .withColumn("person_raw_id", F.coalesce("raw_id", "author_id"))
        .withColumn("person_name", F.coalesce("display_name", "author_id"))
    )
    source_name, signal, none = F.lit(f"Signal: {source}"), F.lit("signal"), F.lit(None).cast("string")
    ord_ = F.struct(F.lit(2).alias("rank"), F.lit(source).alias("path"), "pos")

    titles = written(title_changes(_title_updates(items)))
    final = titles.groupBy("chat").agg(F.max_by("name", F.struct("ts", casefold(F.col("name")), "pos")).alias("last"))
    channels = written(groups.select("chat", "title").join(final, "chat", "left").select(
        source_name.alias("source_name"), F.col("chat").alias("raw_id"), F.coalesce("last", "title").alias("name")
    ))
    renamed = titles.select(
        source_name.alias("source_name"), signal.alias("platform"), F.lit("channel").alias("entity_kind"),
        F.col("chat").alias("entity_raw_id"), "previous_name", F.col("name").alias("new_name"), "ts",
        F.lit("channel-title-change").alias("kind"), F.col("payload").alias("payload_json"),
    )
    profile = F.col("item.updateMessage.profileChange")
    nicknames = items.filter(F.coalesce(profile["newName"], F.lit("")) != "").select(
        source_name.alias("source_name"), signal.alias("platform"), F.lit("person").alias("entity_kind"),
        F.col("person_raw_id").alias("entity_raw_id"), F.nullif(profile["previousName"], F.lit("")).alias("previous_name"),
        profile["newName"].alias("new_name"), "ts", F.lit("nickname-change").alias("kind"), F.col("payload").alias("payload_json"),
    )
    attached = F.col("item.standardMessage.attachments")
    single = F.col("item.stickerMessage").isNotNull() | F.col("item.viewOnceMessage").isNotNull()
    names = F.flatten(F.transform(attached, lambda a: F.array(
        _full(a["pointer"]["fileName"]), _full(a["fileName"]), _full(a["pointer"]["contentType"]), _full(a["contentType"]))))
    preview = F.coalesce(
        F.try_element_at(F.filter(names, lambda n: n.isNotNull()), F.lit(1)),
        F.when(F.col("item.stickerMessage").isNotNull(), F.lit("sticker")).when(F.col("item.viewOnceMessage").isNotNull(), F.lit("view-once message")),
    )
    given = _first_reactions(F.col("item"))
    emojis = F.transform(
        F.from_json(given, "array<struct<emoji:string,reaction:string,reactionEmoji:string>>"),
        lambda r: F.trim(F.coalesce(F.nullif(r["emoji"], F.lit("")), F.nullif(r["reaction"], F.lit("")), r["reactionEmoji"], F.lit(""))),
    )
    messages = items.drop("title").join(channels.select(F.col("raw_id").alias("chat"), F.col("name").alias("channel_name")), "chat").select(
        signal.alias("platform"), source_name.alias("source_name"), F.col("chat").alias("channel_raw_id"), "channel_name",
        canonical_sha1("payload").alias("id"), "person_raw_id", "person_name", "ts", "content", none.alias("reply_to_id"),
        F.when(attached.isNotNull(), F.size(attached)).when(single, 1).otherwise(0).cast("int").alias("attachment_count"),
        preview.alias("attachment_preview"), reaction_total(given).cast("int").alias("reaction_count"),
        F.when(F.trim(given).startswith("["), ranked_summary(emojis)).alias("reaction_summary"), none.alias("reaction_details_json"),
        F.lit(False).alias("is_edited"), is_system_text(F.col("content")).alias("is_system"), ord_.alias("ord"),
    )
    # members and authors; members nobody described stand for themselves
    zero = F.struct(F.lit(2).alias("rank"), F.lit(source).alias("path"), F.lit(-1).cast("bigint").alias("pos"))
    listed = members.join(person, "recipient_id", "left").select(
        F.coalesce("raw_id", "stable").alias("raw_id"), F.coalesce("display_name", "stable").alias("display_name"), zero.alias("ord")
    )
    # a member known under another primary id is listed under the member id as well
    plain = members.join(person.select("raw_id").withColumnRenamed("raw_id", "stable"), "stable", "left_anti").select(
        F.col("stable").alias("raw_id"), F.col("stable").alias("display_name"), zero.alias("ord")
    )
    everybody = listed.unionByName(plain).unionByName(
        items.select(F.col("person_raw_id").alias("raw_id"), F.col("person_name").alias("display_name"), ord_.alias("ord"))
    )
    if account:
        everybody = everybody.unionByName(
            person.filter(F.col("recipient_id") == OWN_RECIPIENT).select("raw_id", "display_name", zero.alias("ord"))
        )
    people = everybody.groupBy("raw_id").agg(F.min_by("display_name", "ord").alias("display_name"), F.min("ord").alias("ord")).select(
        signal.alias("platform"), "raw_id", "display_name", "ord"
    )
    sources = lines.limit(1).select(signal.alias("platform"), source_name.alias("name"))
    return Export(messages, sources, channels, people, renamed.unionByName(nicknames))
