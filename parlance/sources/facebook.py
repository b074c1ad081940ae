"""Facebook HTML archives.

Parsing is per file; everything that looks across messages - nicknames becoming
aliases, emoji messages counting as reactions, ordering within a minute, name
chains - is done on columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import fold
from ..functions.text import let, may_say, squeeze
from ..functions.times import boundary_number, iso_text, micros, from_micros
from ..session import written
from .discord import first_group
from .html import Node, arrow_schema, in_batches, outlined
from .seeds import Export

# --- fixed values, must equal the reference's for equal results -------------
CONTAINER = "div.pam._3-95._2pi0._2lej.uiBoxWhite.noborder"
TIME_FORMAT = "%d %b %Y, %H:%M"
MEMBER = {
    "added": r"(?iu)^(.+?) added (.+?) to the (?:group|chat)\.?$",
    "removed": r"(?iu)^(.+?) removed (.+?) from the (?:group|chat)\.?$",
    "left": r"(?iu)^(.+?) left the (?:group|chat|conversation)\.?$",
}
GROUP_NAME = (
    r"(?iu)^(.+?) named the group (.+?)\.?$",
    r"(?iu)^(.+?) renamed the group(?: to)? (.+?)\.?$",
    r"(?iu)^(.+?) changed the group name(?: to)? (.+?)\.?$",
    r"(?iu)^(.+?) changed the chat name(?: to)? (.+?)\.?$",
    r"(?iu)^(.+?) set the chat name(?: to)? (.+?)\.?$",
    r"(?iu)^(.+?) changed the group name from .+? to (.+?)\.?$",
    r"(?iu)^(.+?) changed the chat name from .+? to (.+?)\.?$",
    r"(?iu)^(.+?) updated the group name(?: to)? (.+?)\.?$",
)
NICK_SET_FOR = r"(?iu)^(.+?) (?:set|changed) the nickname for (.+?) to (.+?)\.?$"
NICK_SET_YOUR = r"(?iu)^(.+?) (?:set|changed) your nickname to (.+?)\.?$"
NICK_SET_OWN = r"(?iu)^(.+?) (?:set|changed) (?:his|her|their) own nickname to (.+?)\.?$"
NICK_CLEAR_FOR = r"(?iu)^(.+?) cleared the nickname for (.+?)\.?$"
NICK_CLEAR_YOUR = r"(?iu)^(.+?) cleared your nickname\.?$"
NICK_CLEAR_OWN = r"(?iu)^(.+?) cleared (?:his|her|their) own nickname\.?$"
ATTACHMENT_ONLY = (
    r"(?iu)^.+ sent an attachment\.?(?:\s+https?://\S+)?$",
    r"(?iu)^click for (video|audio):?$",
)
OTHER_SYSTEM = (
    r"(?iu)^.+ changed the (group|chat) photo\.?$",
    r"(?iu)^.+ updated the (group|cover) photo\.?$",
    r"(?iu)^.+ changed the group's? (icon|cover|avatar)\.?$",
    r"(?iu)^.+ created a poll[.:]",
    r"(?iu)^.+ (voted in|answered) (a )?poll",
    r"(?iu)^.+ voted for .+ in the poll[.:]?(?: .*)?$",
    r"(?iu)^.+ changed (your|their) vote to .+ in the poll[.:]?(?: .*)?$",
    r"(?iu)^.+ removed (your|their) vote for .+ in the poll[.:]?(?: .*)?$",
    r"(?iu)^.+ set the (group )?theme to .+\.?$",
    r"(?iu)^.+ changed the (group )?theme\.?$",
    r"(?iu)^.+ set the emoji to .+$",
    r"(?iu)^.+ changed the (chat|group) colou?rs?\.?$",
    r"(?iu)^.+ turned off (link previews|notifications)\.?$",
    r"(?iu)^.+ turned on (link previews|notifications)\.?$",
    r"(?iu)^.+ pinned a message\.?$",
    r"(?iu)^.+ (started|ended) a (live )?video(?: call)?\.?$",
    r"(?iu)^.+ (started|answered|declined|missed) (an? )?(audio|video) call\.?$",
    r"(?iu)^.+ created (the|this) group\.?$",
    r"(?iu)^.+ scored \d+ points? playing \w+\.?$",
    r"(?iu)^.+ set the new high score of \d+ points? playing \w+\.?$",
    r"(?iu)^Plan created: .+$",
    r"(?iu)^.+ created a plan\.?$",
    r"(?iu)^.+ named the plan .+\.?$",
    r"(?iu)^.+ responded .+\.?$",
)
ANNOUNCEMENTS = (
    r"(?iu)^.+ sent a link\.\s*(https?://\S+)\s*$",
    r"(?iu)^.+ sent an attachment\.\s*download file:\s*(messages/\S+)\s*$",
    r"(?iu)^(https?://\S+)\s+\1$",
)
# words without which none of the patterns above can be found
MEMBER_WORDS = {"added": " added ", "removed": " removed ", "left": " left the "}
GROUP_WORDS = (" named the group", " renamed the group", " the group name", " the chat name")
NICK_WORDS = ("nickname",)
SENT_WORDS = (" sent a link.", " sent an attachment")
OTHER_WORDS = (
    " changed the ", " updated the ", "poll", " set the ", " turned o", " pinned a message", " video",
    "o call", " created ", " scored ", "plan created: ", " named the plan ", " responded ",
)
REMOVED_MEDIA = "one or more media attachments were removed"
CLEARED = "(cleared)"
_REACTIONS = re.compile(r"(\d+)\s+reactions?")
EMOJI_MODIFIERS = "[️︎‍]"
EMOJI_LENGTH = 6
# ----------------------------------------------------------------------------

RAW_SCHEMA = (
    "path string, pos bigint, author string, body string, box_text string, ts timestamp_ntz, "
    "attachments array<struct<preview:string,label:string>>, reaction_classes int, reactions_in_text int, reaction_items array<string>"
)


def repair(text: str) -> str:
    """Undoes UTF-8 that was stored as Latin-1."""
    if text.isascii():
        return text
    try:
        return text.encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


def _text(parts: Iterable[str]) -> str:
    return repair(" ".join(" ".join(parts).split()))


@lru_cache(maxsize=4096)
def _minute(text: str) -> datetime | None:
    try:
        return datetime.strptime(text, TIME_FORMAT)
    except ValueError:
        return None


def _preview(node: Node) -> str | None:
    for name in ("src", "data-src", "href"):
        if (node.get(name) or "").strip():
            return node.attrs[name].strip()
    return None


def _attachments(body: Node) -> list[dict]:
    out = []
    for node in body.walk():
        if node.tag not in ("video", "audio", "img", "a"):
            continue
        if node.tag in ("img", "a") and any(p.tag in ("video", "audio") for p in node.ancestors()):
            continue
        preview = _preview(node)
        if preview:
            label = preview.rstrip("/").rsplit("/", 1)[-1] or preview
        else:
            label = node.tag if node.tag in ("video", "audio") else node.get("alt") or "attachment"
        out.append({"preview": preview, "label": label})
    return out


def _outline(box: Node) -> tuple:
    """Where a box has its texts: author, body, all of it with and without lists of reactions, each child from the
    last, items of those lists; and what its tags tell."""
    children = box.elements()
    if len(children) < 2:
        return ()
    whole, lines = list(box.strings()), [list(c.strings()) for c in children]
    tagged = sum(any("reaction" in c.lower() for c in n.kinds) for n in box.walk() if n.kinds)
    lists = box.all("ul._tqp")
    items = [list(li.strings()) for ul in lists for li in ul.elements() if li.tag == "li"]
    for ul in children[1].all("ul._tqp"):
        ul.remove()
    # without lists the two are one
    left = list(box.strings()) if lists else None
    return lines[0], list(children[1].strings()), whole, left, lines[::-1], items, tagged, _attachments(children[1])


def parse_chat_file(path: str, html: str) -> Iterator[tuple]:
    for pos, (outline, pick) in enumerate(outlined(html, CONTAINER, _outline)[1]):
        if not outline:
            continue
        author, body, whole, left, lines, items, tagged, attachments = outline
        ts = next((ts for line in lines if (ts := _minute(_text(pick(line)))) is not None), None)
        if ts is None:
            continue
        shown = _text(pick(whole))
        said = _REACTIONS.search(shown.lower()) if "reaction" in shown.lower() else None
        yield (
            path, pos, _text(pick(author)), _text(pick(body)), shown if left is None else _text(pick(left)), ts, attachments, tagged, int(said.group(1)) if said else None,
            [_text(pick(item)) for item in items],
        )


def _parsed(files: DataFrame) -> DataFrame:
    """Rows of RAW_SCHEMA from files of (path, content)."""
    schema = arrow_schema(RAW_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (file for batch in batches for file in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()))
        yield from in_batches((row for path, content in found for row in parse_chat_file(path, content.decode("utf-8", errors="replace"))), schema)

    return files.select("path", "content").mapInArrow(parse, RAW_SCHEMA)


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def _trim_end(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), "[.!?]+$", ""))


# -- message body ------------------------------------------------------------
def _plain_body(body: Column) -> Column:
    """The link or file itself where the text only announces it."""

    def unwrap(text: Column, pattern: str) -> Column:
        return let(text, lambda t: F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t))

    def unwrapped(text: Column) -> Column:
        for pattern in ANNOUNCEMENTS[:2]:
            text = unwrap(text, pattern)
        return text

    # the last one begins with the link, which is seen at once
    return unwrap(let(body, lambda t: F.when(may_say(t, *SENT_WORDS), unwrapped(t)).otherwise(t)), ANNOUNCEMENTS[2])


def cleaned_body(body: Column, attachments: Column) -> Column:
    """struct(content, attachment_count, attachment_preview): placeholders and repeated links taken out."""
    none = F.lit(None).cast("string")

    def result(content: Column, count: Column, preview: Column) -> Column:
        return F.struct(
            content.alias("content"), count.cast("int").alias("attachment_count"), preview.alias("attachment_preview")
        )

    previews = F.filter(F.transform(attachments, lambda a: a["preview"]), lambda p: p.isNotNull())
    preview = F.try_element_at(previews, F.lit(1))
    labels = F.transform(attachments, lambda a: a["label"])

    def with_files(rest: Column) -> Column:
        key = fold(rest)
        is_label = F.exists(labels, lambda x: fold(x) == key) | (key == fold(F.array_join(labels, " ")))
        only = (rest == "") | _any(squeeze(rest), ATTACHMENT_ONLY) | is_label | F.coalesce(key == fold(preview), F.lit(False))
        return result(F.when(only, F.lit("")).otherwise(rest), F.size(attachments), preview)

    def without_files(text: Column) -> Column:
        url = F.nullif(F.regexp_extract(text, r"https?://[^\s]+", 0), F.lit(""))
        local = F.nullif(F.regexp_extract(text, r"messages/[^\s]+", 0), F.lit(""))
        target = F.coalesce(url, local)
        # what only asks for audio or video begins with a fixed word
        placeholder = (
            (may_say(squeeze(text), " sent an attachment", "click for ") & _any(squeeze(text), ATTACHMENT_ONLY))
            | text.rlike(r"(?iu)sent (an |a )?(attachment|link)")
            | F.contains(F.lower(text), F.lit(REMOVED_MEDIA))
            | text.rlike(r"(?iu)^https?://")
        )
        bare = result(F.lit(""), F.when(target.isNotNull(), 1).otherwise(0), target)
        return F.when(placeholder, bare).otherwise(result(text, F.lit(0), none))

    def cleaned(text: Column) -> Column:
        rest = F.when(
            F.contains(F.lower(text), F.lit(REMOVED_MEDIA)),
            F.trim(F.regexp_replace(text, rf"(?iu)\b{REMOVED_MEDIA}\b[.]*", "")),
        ).otherwise(text)
        return F.when(F.size(attachments) > 0, let(rest, with_files)).otherwise(without_files(text))

    return let(_plain_body(body), cleaned)


def reaction_emoji(text: Column) -> Column:
    """Leading symbols of a reaction entry, up to the first letter, digit or blank."""
    return F.regexp_extract(squeeze(text), r"(?U)^[^\p{L}\p{N}\s]+", 0)


def ranked_summary(emojis: Column) -> Column:
    """name×n by count, ties in the order first seen; null when nothing is left."""
    found = F.filter(emojis, lambda e: e != "")
    distinct = F.array_distinct(found)
    counted = F.transform(
        distinct,
        lambda e, i: F.struct((-F.size(F.filter(found, lambda x: x == e))).alias("n"), i.alias("i"), e.alias("e")),
    )
    parts = F.transform(F.array_sort(counted), lambda x: F.concat(x["e"], F.lit("×"), (-x["n"]).cast("string")))
    return F.when(F.size(distinct) > 0, F.array_join(parts, " "))


def is_emoji_message(text: Column) -> Column:
    """Short text of symbols only: at most six visible characters, none ASCII, no letters or digits."""
    visible = F.regexp_replace(text, rf"(?U)\s|{EMOJI_MODIFIERS}", "")
    # most texts show a letter at once
    return ~text.rlike("[A-Za-z0-9]") & visible.rlike(r"^[^\x00-\x7F\p{L}\p{N}]{1," + str(EMOJI_LENGTH) + "}$")


# -- events in the text ------------------------------------------------------
def group_rename(text: Column) -> tuple[Column, Column]:
    """(new name, actor) of a group rename."""
    said = may_say(text, *GROUP_WORDS)
    return F.when(said, _trim_end(first_group(text, GROUP_NAME, 2))), F.when(said, F.trim(first_group(text, GROUP_NAME, 1)))


def split_names(names: Column) -> Column:
    """The people in "A, B and C"."""
    listed = F.split(F.regexp_replace(names, r"(?iu)\s+and\s+", ", "), ",")
    named = F.filter(F.transform(listed, lambda n: F.trim(n)), lambda n: n != "")
    return F.transform(named, lambda n: F.regexp_replace(n, r"\.+$", ""))


def member_event(text: Column) -> Column:
    """struct(kind, actor, targets) or null."""

    def event(kind: str, targets: Column) -> Column:
        actor = F.trim(F.regexp_extract(text, MEMBER[kind], 1))
        return F.struct(F.lit(kind).alias("kind"), actor.alias("actor"), targets.alias("targets"))

    out = None
    for kind in ("added", "removed"):
        targets = split_names(F.regexp_extract(text, MEMBER[kind], 2))
        hit = may_say(text, MEMBER_WORDS[kind]) & text.rlike(MEMBER[kind]) & (F.size(targets) > 0)
        out = (F if out is None else out).when(hit, event(kind, targets))
    left = F.array(F.trim(F.regexp_extract(text, MEMBER["left"], 1)))
    return out.when(may_say(text, MEMBER_WORDS["left"]) & text.rlike(MEMBER["left"]), event("left", left))


def nickname_event(text: Column) -> Column:
    """struct(actor, target, nickname, cleared) or null."""
    your = F.contains(F.lower(text), F.lit("your nickname"))

    def event(pattern: str, target: Column, nickname: Column, cleared: bool) -> Column:
        actor = F.trim(F.regexp_extract(text, pattern, 1))
        return F.struct(
            actor.alias("actor"), F.coalesce(target, F.when(your, F.lit("You")).otherwise(actor)).alias("target"),
            nickname.alias("nickname"), F.lit(cleared).alias("cleared"),
        )

    none = F.lit(None).cast("string")
    gone = F.lit(CLEARED)

    def part(pattern: str, group: int) -> Column:
        return F.trim(F.regexp_extract(text, pattern, group))

    found = (
        F.when(text.rlike(NICK_SET_FOR), event(NICK_SET_FOR, part(NICK_SET_FOR, 2), _trim_end(part(NICK_SET_FOR, 3)), False))
        .when(text.rlike(NICK_SET_YOUR), event(NICK_SET_YOUR, none, _trim_end(part(NICK_SET_YOUR, 2)), False))
        .when(text.rlike(NICK_SET_OWN), event(NICK_SET_OWN, none, _trim_end(part(NICK_SET_OWN, 2)), False))
        .when(text.rlike(NICK_CLEAR_FOR), event(NICK_CLEAR_FOR, part(NICK_CLEAR_FOR, 2), gone, True))
        .when(text.rlike(NICK_CLEAR_YOUR), event(NICK_CLEAR_YOUR, none, gone, True))
        .when(text.rlike(NICK_CLEAR_OWN), event(NICK_CLEAR_OWN, none, gone, True))
    )
    return F.when(may_say(text, *NICK_WORDS), let(found, lambda f: F.when(f["nickname"] != "", f)))


def is_system_text(text: Column) -> Column:
    """Whether single-spaced text is a notice of the platform."""
    said = (
        (may_say(text, *GROUP_WORDS) & _any(text, GROUP_NAME)) | member_event(text).isNotNull() | nickname_event(text).isNotNull()
        | (may_say(text, *OTHER_WORDS) & _any(text, OTHER_SYSTEM))
    )
    return (text != "") & said


# -- aliases -----------------------------------------------------------------
def _key(name: Column) -> Column:
    return fold(name)


def name_bindings(rows: DataFrame) -> DataFrame:
    """(chat, key, raw_id, since): what each name in a chat stands for.

    The first thing a name occurs as decides: an author or target stands for
    itself, a nickname for whoever it was given to. Nicknames of nicknames are
    followed by pointer doubling on this small table of names.
    """

    def named(step: int, i: Column, name: Column, parent: Column) -> Column:
        return F.struct(F.struct("path", "pos", F.lit(step).alias("step"), i.cast("int").alias("i")).alias("since"),
                        _key(name).alias("key"), name.alias("raw_id"), parent.alias("parent"))

    none = F.lit(None).cast("string")
    zero = F.lit(0)
    nick = F.col("nick")
    members = F.transform("member.targets", lambda t, i: named(2, i, t, none))
    empty = F.array().cast(
        "array<struct<since:struct<path:string,pos:bigint,step:int,i:int>,key:string,raw_id:string,parent:string>>"
    )
    found = F.concat(
        F.array(named(0, zero, F.col("author"), none)),
        F.when(F.col("member").isNotNull(), members).otherwise(empty),
        F.when(nick.isNotNull(), F.array(named(3, zero, nick["target"], none))).otherwise(empty),
        F.when(nick.isNotNull() & ~nick["cleared"], F.array(named(5, zero, nick["nickname"], _key(nick["target"])))).otherwise(empty),
    )
    first = (
        rows.select("chat", F.explode(found).alias("b")).select("chat", "b.*")
        .groupBy("chat", "key")
        .agg(F.min_by(F.struct("raw_id", "parent"), "since").alias("b"), F.min("since").alias("since"))
        .select("chat", "key", "b.raw_id", "b.parent", "since")
    )
    names = written(first)  # its size is known later on
    while not names.filter(F.col("parent").isNotNull()).isEmpty():
        up = names.select("chat", F.col("key").alias("parent"), F.col("raw_id").alias("up_raw"), F.col("parent").alias("up_parent"))
        names = written(
            names.join(up, ["chat", "parent"], "left").select(
                "chat", "key", F.coalesce("up_raw", "raw_id").alias("raw_id"), F.col("up_parent").alias("parent"), "since"
            )
        )
    return names.drop("parent")


def _bound(rows: DataFrame, bindings: DataFrame, name: str, out: str, step: int | None = None) -> DataFrame:
    """Adds the raw id a name column stands for; with ``step`` only if it was bound by then."""
    b = bindings.select("chat", F.col("key").alias("k_"), F.col("raw_id").alias(out), F.col("since").alias("since_"))
    rows = rows.withColumn("k_", _key(F.col(name)))
    joined = rows.join(b, ["chat", "k_"], "left")
    if step is not None:
        now = F.struct("path", "pos", F.lit(step).alias("step"), F.lit(0).alias("i"))
        joined = joined.withColumn(out, F.when(F.col("since_") < now, F.col(out)))
    return joined.drop("k_", "since_")


# -- folding and ordering ----------------------------------------------------
def fold_emoji_messages(rows: DataFrame) -> DataFrame:
    """Counts emoji-only messages as reactions to the message before them, and spreads a minute.

    Of rows with equal author, minute and text the first one read counts. Time stamps have
    whole minutes, files list newest first. Inside a minute rows
    are numbered backwards through the file and get that number as microseconds.
    An emoji message belongs to the last ordinary message before it: found inside
    its minute, else carried over from the nearest earlier minute of the chat, so
    the only window across a chat runs over one row per minute. A chat's very first
    message belongs to none.

    All of this looks at places and emojis only; texts travel once, by ``row``.
    """
    text = squeeze(F.col("content"))
    marks = (
        rows.select(
            "chat", F.unhex("id").alias("id"), boundary_number(F.col("ts"), 60).alias("minute"), "path", "pos", "row",
            F.when(is_emoji_message(text), text).alias("emoji"),
        )
        .groupBy("chat", "id").agg(F.min(F.struct("path", "pos", "row", "minute", "emoji")).alias("m"))
        .select("chat", "m.*").repartition("chat", "minute")
    )
    ordinary = F.col("emoji").isNull()
    minutes = marks.groupBy("chat", "minute").agg(
        F.min(F.when(ordinary, F.struct("path", "pos", "row"))).alias("last"), F.max(F.struct("path", "pos", "row")).alias("first")
    )
    line = W.partitionBy("chat").orderBy("minute")
    minutes = minutes.withColumn("opens", F.lag("minute").over(line).isNull())
    minutes = minutes.withColumn("closing", F.coalesce("last.row", F.when(F.col("opens"), F.col("first.row"))))
    carried = minutes.select(
        "chat", "minute", "opens", F.last("closing", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("far")
    )
    inside = W.partitionBy("chat", "minute").orderBy(F.desc("path"), F.desc("pos"))
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    near = F.last(F.when(ordinary, F.col("row")), ignorenulls=True).over(before)
    placed = marks.select(
        "chat", "minute", "row", "emoji", F.row_number().over(inside).alias("rn"), F.coalesce(near, F.first("row").over(before)).alias("opening"),
        near.alias("near"),
    )
    # the first of a chat's first minute is an anchor whatever it says
    anchor = F.coalesce("near", F.when(F.col("opens"), F.col("opening")).otherwise(F.col("far")))
    placed = placed.join(carried, ["chat", "minute"]).select("minute", "row", "emoji", "rn", F.when(~ordinary, anchor).alias("anchor"))
    # per anchor: how often each emoji came, and when it came last
    given = (
        placed.filter(F.col("anchor").isNotNull())
        .groupBy("anchor", "emoji")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("minute", "rn")).alias("at"))
        .groupBy("anchor")
        .agg(F.sum("n").alias("more"), F.collect_list(F.struct("emoji", "n", "at")).alias("given"))
        .withColumnRenamed("anchor", "row")
    )
    found = placed.select("row", "rn", F.col("anchor").isNotNull().alias("folded"))
    spread = from_micros(micros(F.col("ts")) + F.col("rn") - 1)
    return rows.join(found, "row").join(given, "row", "left").select(
        *[c for c in rows.columns if c not in ("ts", "reaction_count", "reaction_summary", "is_system")],
        spread.alias("ts"),
        (F.col("reaction_count") + F.coalesce("more", F.lit(0))).cast("int").alias("reaction_count"),
        F.when(F.col("given").isNotNull(), merged_summary(F.col("reaction_summary"), F.col("given")))
        .otherwise(F.col("reaction_summary")).alias("reaction_summary"),
        (F.col("is_system") | F.col("folded")).alias("is_system"),
    )


def merged_summary(summary: Column, given: Column) -> Column:
    """A summary with more emojis counted in.

    Adding one at a time and re-ranking after each keeps whoever reached a count
    first in front, so ties are ordered by the last time an emoji came, those that
    only stand in the summary before all others, in their old order.
    """
    tokens = F.filter(F.split(F.coalesce(summary, F.lit("")), " "), lambda t: t.rlike(r"^[^×]*×[+-]?\d+$"))
    old = F.transform(
        tokens,
        lambda t, i: F.struct(
            F.split_part(t, F.lit("×"), F.lit(1)).alias("emoji"),
            F.split_part(t, F.lit("×"), F.lit(2)).cast("bigint").alias("n"),
            i.alias("i"),
        ),
    )
    names = F.array_distinct(F.concat(F.transform(old, lambda x: x["emoji"]), F.transform(given, lambda x: x["emoji"])))

    def total(items: Column, name: Column) -> Column:
        return F.aggregate(
            F.filter(items, lambda x: x["emoji"] == name), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]
        )

    def came(name: Column) -> Column:
        hit = F.filter(given, lambda x: x["emoji"] == name)
        return F.when(F.size(hit) > 0, hit[0]["at"])

    ranked = F.array_sort(
        F.transform(
            names,
            lambda e, i: F.struct(
                (-(total(old, e) + total(given, e))).alias("n"),
                F.coalesce(came(e)["minute"], F.lit(-(2**62))).alias("minute"),
                F.coalesce(came(e)["rn"], F.lit(0)).alias("rn"), i.alias("i"), e.alias("e"),
            ),
        )
    )
    return F.array_join(F.transform(ranked, lambda x: F.concat(x["e"], F.lit("×"), (-x["n"]).cast("string"))), " ")


# -- the reader --------------------------------------------------------------
def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _rename_changes(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """Group renames; a repeat of the current name is dropped, the name before is filled in."""
    named = rows.filter(F.col("rename").isNotNull())
    named = _bound(named, bindings, "rename_actor", "actor_raw_id", step=1)
    order = W.partitionBy("chat").orderBy("ts", "path", "pos", F.lower("rename"))
    last = F.lag("rename").over(order)
    chained = named.withColumn("previous_name", last)
    return chained.filter(F.col("previous_name").isNull() | (F.col("previous_name") != F.col("rename"))).select(
        "source_name", F.lit("facebook").alias("platform"), F.lit("channel").alias("entity_kind"),
        F.col("chat").alias("entity_raw_id"), "previous_name", F.col("rename").alias("new_name"), "ts",
        F.lit("channel-title-change").alias("kind"),
        _json(actor_name=F.nullif("rename_actor", F.lit("")), actor_raw_id=F.col("actor_raw_id")).alias("payload_json"),
    )


def _nickname_changes(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """Nickname changes per person; clearing nothing and repeating the current one are dropped."""
    named = rows.filter(F.col("nick").isNotNull()).select(
        "chat", "source_name", "path", "pos", "ts", "nick.actor", "nick.target", "nick.nickname", "nick.cleared"
    )
    named = _bound(_bound(named, bindings, "target", "target_raw_id"), bindings, "actor", "actor_raw_id", step=4)
    order = W.partitionBy("chat", "target_raw_id").orderBy("ts", "path", "pos", F.lower("nickname"))
    state = F.when(~F.col("cleared"), F.col("nickname"))
    chained = named.withColumn("previous_name", F.lag(state).over(order))
    kept = chained.filter(
        F.when(F.col("cleared"), F.col("previous_name").isNotNull())
        .otherwise(F.col("previous_name").isNull() | (F.col("previous_name") != F.col("nickname")))
    )
    return kept.select(
        "source_name", F.lit("facebook").alias("platform"), F.lit("person").alias("entity_kind"),
        F.col("target_raw_id").alias("entity_raw_id"), "previous_name", F.col("nickname").alias("new_name"), "ts",
        F.lit("nickname-change").alias("kind"),
        _json(chatId=F.col("chat"), actor_name=F.col("actor"), actor_raw_id=F.col("actor_raw_id")).alias("payload_json"),
    )


def _member_events(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    named = rows.filter(F.col("member").isNotNull()).select(
        "chat", "source_name", "path", "pos", "ts", "raw_id", F.col("member.kind").alias("kind"),
        F.col("member.actor").alias("actor"), "member.targets",
    )
    named = _bound(named, bindings, "actor", "bound_actor", step=2).withColumn(
        "actor_raw_id",
        F.coalesce("bound_actor", F.when(F.col("kind") == "left", F.col("raw_id"))),
    )
    single = named.withColumn("target", F.explode("targets"))
    single = _bound(single, bindings, "target", "target_raw_id")
    return single.select(
        "source_name", F.lit("facebook").alias("platform"), F.col("chat").alias("channel_raw_id"), "kind",
        "actor_raw_id", "target_raw_id", "ts",
        _json(
            actor_name=F.col("actor"), target_name=F.col("target"), chatId=F.col("chat"), actor_raw_id=F.col("actor_raw_id")
        ).alias("payload_json"),
    )


def parse_rows(files: DataFrame) -> DataFrame:
    """One row per message container, with what its text says about names and members."""
    raw = _parsed(files)
    chat = F.element_at(F.split("path", "/"), -2)
    body = cleaned_body(F.col("body"), F.col("attachments"))
    rows = raw.withColumn("chat", chat).withColumn("b", body).select("*", "b.*").drop("b")
    rows = rows.withColumn("text", squeeze(F.col("content")))
    rows = rows.withColumn("said", F.when(F.col("content") != "", F.col("text")).otherwise(squeeze(F.col("box_text"))))
    said = F.col("said")
    rename, rename_actor = group_rename(said)
    tags = F.nullif("reaction_classes", F.lit(0))
    return rows.select(
        "chat", F.concat(F.lit("Facebook: "), "chat").alias("source_name"), "path", "pos", "author", "content", "ts",
        "attachment_count", "attachment_preview",
        F.coalesce(tags, "reactions_in_text", F.size("reaction_items")).cast("int").alias("reaction_count"),
        ranked_summary(F.transform("reaction_items", lambda t: reaction_emoji(t))).alias("reaction_summary"),
        is_system_text(F.col("text")).alias("is_system"),
        rename.alias("rename"), rename_actor.alias("rename_actor"),
        member_event(said).alias("member"), nickname_event(said).alias("nick"),
        F.sha1(F.concat_ws("\x1f", F.col("author"), iso_text(F.col("ts")), F.col("content"))).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_facebook(files: DataFrame) -> Export:
    """All chats of an archive from rows of (path, content); the parent folder names the chat."""
    # parsed once, read by several consumers below
    rows = written(parse_rows(files))
    bindings = name_bindings(rows)
    ord_ = F.struct(F.lit(1).alias("rank"), "path", "pos")
    seen = F.array(F.struct(F.lit(0).alias("step"), F.col("author").alias("name")))
    people = _people(rows, bindings, seen)
    names = people.select("chat", "raw_id", F.col("display_name").alias("person_name"))
    known = bindings.join(names, ["chat", "raw_id"]).select("chat", F.col("key").alias("k_"), F.col("raw_id").alias("person_raw_id"), "person_name")
    authors = rows.select("row", "chat", _key(F.col("author")).alias("k_")).join(known, ["chat", "k_"]).drop("chat", "k_")
    messages = fold_emoji_messages(rows).join(authors, "row").select(
        F.lit("facebook").alias("platform"), "source_name", F.col("chat").alias("channel_raw_id"),
        F.col("chat").alias("channel_name"), "id", "person_raw_id", "person_name", "ts", "content",
        F.lit(None).cast("string").alias("reply_to_id"), "attachment_count", "attachment_preview", "reaction_count",
        "reaction_summary", F.lit(None).cast("string").alias("reaction_details_json"), F.lit(False).alias("is_edited"),
        "is_system", ord_.alias("ord"),
    )
    # chats whose messages cannot be read still are sources and channels
    chats = files.select(F.element_at(F.split("path", "/"), -2).alias("chat")).distinct()
    sources = chats.select(F.lit("facebook").alias("platform"), F.concat(F.lit("Facebook: "), "chat").alias("name"))
    channels = chats.select(
        F.concat(F.lit("Facebook: "), "chat").alias("source_name"), F.col("chat").alias("raw_id"), F.col("chat").alias("name")
    )
    rows = _bound(rows, bindings, "author", "raw_id")
    return Export(
        messages=messages,
        sources=sources,
        channels=channels,
        people=people.select(F.lit("facebook").alias("platform"), "raw_id", "display_name", "ord"),
        name_changes=_rename_changes(rows, bindings).unionByName(_nickname_changes(rows, bindings)),
        member_events=_member_events(rows, bindings),
    )


def _people(rows: DataFrame, bindings: DataFrame, seen: Column) -> DataFrame:
    """(chat, raw_id, display_name, ord): everybody who wrote, was added or removed, or got a nickname."""
    empty = F.array().cast("array<struct<step:int,name:string>>")
    targets = F.transform("member.targets", lambda t: F.struct(F.lit(2).alias("step"), t.alias("name")))
    nick = F.array(F.struct(F.lit(3).alias("step"), F.col("nick.target").alias("name")))
    named = rows.select(
        "chat", "path", "pos",
        F.explode(
            F.concat(
                seen, F.when(F.col("member").isNotNull(), targets).otherwise(empty),
                F.when(F.col("nick").isNotNull(), nick).otherwise(empty),
            )
        ).alias("s"),
    ).select("chat", "path", "pos", "s.step", "s.name")
    bound = _bound(named, bindings, "name", "raw_id")
    first = F.struct("path", "pos", "step")
    return bound.groupBy("chat", "raw_id").agg(
        F.min_by("name", first).alias("display_name"), F.min(F.struct(F.lit(1).alias("rank"), "path", "pos")).alias("ord")
    )
