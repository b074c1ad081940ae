"""Signal chats exported as HTML: a parse per chat, then columns."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.names import casefold, unquote
from ..functions.text import let, may_say, squeeze
from ..operators.resolve import resolve_people
from ..session import written
from .html import Node, arrow_schema, by_class, in_batches, outlined
from .seeds import Export, first_people

# --- fixed values, must equal the reference's for equal results -------------
SYSTEM = (
    r"(?iu)^.+ (named|changed|updated) the group (name|title|description|avatar|photo|icon)(?: to .+)?[.!?]?$",
    r"(?iu)^(you|.+?) (added|removed|invited) .+ (to|from) the (group|chat)[.!?]?$",
    r"(?iu)^.+ (left|joined) the (group|chat)[.!?]?$",
    r"(?iu)^(you )?(were|was) (removed|added) (from|to) the (group|chat)[.!?]?$",
    r"(?iu)^(you )?changed the (group|chat) (name|description|avatar|photo|icon)(?: to .+)?[.!?]?$",
    r"(?iu)^(you )?updated the (group|cover) (photo|avatar|icon)[.!?]?$",
    r"(?iu)^missed (voice|video) call[.!?]?$",
    r"(?iu)^(voice|video) call[.!?]?$",
    r"(?iu)^(you )?accepted a request to join[.!?]?$",
    r"(?iu)^(you )?(sent|requested) a group invite[.!?]?$",
)
GROUP_NAME = (
    r"(?isu)^(.+?) named the group (.+?)(?:[.!?])?$",
    r"(?isu)^(.+?) changed the group name to (.+?)(?:[.!?])?$",
    r"(?isu)^(.+?) changed the group title to (.+?)(?:[.!?])?$",
    r"(?isu)^(.+?) updated the group name to (.+?)(?:[.!?])?$",
    r"(?isu)^(.+?) updated the group title to (.+?)(?:[.!?])?$",
    r"(?isu)^(.+?) renamed the group to (.+?)(?:[.!?])?$",
)
OTHER_SENTENCES = (
    "you changed the group description",
    "you changed the group avatar",
    "changed the group description",
    "changed the group avatar",
    "updated the group photo",
    "changed the group photo",
    "added .* to the group",
    "removed .* from the group",
)
# words without which no name is given to a group, and none of the first three notices of SYSTEM is found
NAMED_WORDS = ("named the group ", " group name to ", " group title to ")
NOTICE_WORDS = (" the group", " the chat")
TIME_FORMATS = ("%b %d, %Y %H:%M:%S", "%b %d, %Y %H:%M")
DIR_ID = r"\(_id(\d+)\)\s*$"
LEAST_CONFIGURED = 2
FOOTERS, QUOTE = frozenset({"footer", "footer-status"}), "msg-quote"
# ----------------------------------------------------------------------------

RAW_SCHEMA = (
    "path string, pos bigint, chat string, title string, kind string, ts timestamp_ntz, person_raw_id string, "
    "person_name string, content string, id string, reply_to_id string, attachment_count int, attachment_preview string, "
    "reaction_count int, reaction_summary string, reaction_details_json string"
)


def person_raw_id(name: str) -> str:
    key = " ".join(name.split()).casefold()
    return "self" if key == "you" else f"name:{key}"


def raw_id_of(name: Column) -> Column:
    key = squeeze(casefold(name))
    return F.when(key == "you", F.lit("self")).otherwise(F.concat(F.lit("name:"), key))


@lru_cache(maxsize=4096)
def _time(text: str) -> datetime | None:
    for form in TIME_FORMATS:
        try:
            return datetime.strptime(" ".join(text.split()), form)
        except ValueError:
            continue
    return None


def _members(page: Node, found: dict[str, list[Node]]) -> set[str]:
    """Names of a chat: those in its header, and everybody who wrote."""
    names = {n.text() for n in page.all("div.membername", among=found.get("membername", ()))}
    details = page.one(".thread-subtitle", ".groupdetails", ".columnview", among=found.get("columnview", ()))
    cells = [] if details is None else [
        n for n in details.all("span") if {"column-right-align", "column-left-align"} & set(n.classes())
    ]
    for label, value in zip(cells[::2], cells[1::2]):
        if label.text().casefold().rstrip(":") == "members":
            listed = re.sub(r"\s*\(admin\)\s*", "", value.text(), flags=re.IGNORECASE)
            found = [" ".join(p.split()) for p in listed.split(",") if p.strip()]
            if found:
                names.update(found)
                break
    return names - {""}


def _joined(parts: Iterable[str], joiner: str = " ") -> str:
    return joiner.join([p for part in parts if (p := part.strip())])


def _strings(node: Node | None) -> list[str]:
    return [] if node is None else list(node.strings())


class _Outline:
    """What the tags of a message box tell, and where its texts are."""

    def __init__(self, box: Node):
        nodes = list(box.walk())
        found = by_class(nodes)
        dates, members = found.get("msg-data", ()), found.get("membername", ())
        self.kinds = set(box.classes())
        stamp = box.one("div.footer", "span.msg-data", among=dates) or box.one("div.footer-status", "span.msg-data", among=dates)
        self.stamp = None if stamp is None else _strings(stamp)
        self.names = [_strings(n) for n in box.all("div.membername", among=members)]
        status = box.one("div.status-text", "pre")
        self.status = [_strings(n) for n in ([status] if status is not None else box.all("pre")) if n is status or not any(FOOTERS & p.kinds for p in n.ancestors())]
        quote = next((a for a in found.get("quote-link", ()) if (a.get("href") or "").startswith("#")), None)
        self.reply = (quote.attrs["href"].lstrip("#").strip() or None) if quote is not None else None
        targets = (n.get("href") if n.tag == "a" else n.get("src") if n.tag in ("img", "source") else None for n in nodes)
        self.files = list(dict.fromkeys(t for t in targets if t and t.startswith("media/")))
        # texts of a message without the quoted one
        self.body = [_strings(n) for n in nodes if n.tag == "pre" and not any(QUOTE in p.kinds for p in n.ancestors())]
        self.reactions = [
            (_strings(r.one("span.msg-emoji")), _strings(r.one("span.reaction-count")), _strings(r.one(".msg-reaction-info")))
            for r in box.all("div.msg-reactions", "div.msg-reaction", among=found.get("msg-reaction", ()))
        ]


@lru_cache(maxsize=4096)
def _reactions(items: tuple[tuple[str, str, str], ...]) -> tuple[int, str | None, str | None]:
    counts: Counter[str] = Counter()
    who: dict[str, list[dict]] = {}
    for emoji, shown, info in items:
        if not emoji:
            continue
        counts[emoji] += max(int(shown), 1) if shown.isdigit() else 1
        said = re.search(r"(?:^|\n)\s*From:\s*(.+?)(?:\n|$)", info, re.IGNORECASE)
        if said:
            name = said.group(1).strip()
            who.setdefault(emoji, []).append({"platform": "signal", "raw_id": person_raw_id(name), "display_name": name})
    if not counts:
        return 0, None, None
    ranked = counts.most_common()
    details = [{"name": e, "count": n, "reactors": who.get(e, [])} for e, n in ranked]
    return sum(counts.values()), " ".join(f"{e}×{n}" for e, n in ranked), json.dumps(details, ensure_ascii=False)


def parse_chat(path: str, html: str) -> Iterator[tuple]:
    """Rows of kind member, status and message of one chat file."""
    folder = path.split("/")[-2]
    numbered = re.search(DIR_ID, folder)
    chat = numbered.group(1) if numbered else folder
    page, boxes = outlined(html, "div.msg", _Outline, inside=frozenset({"columnview"}), outside=FOOTERS | {QUOTE, "membername", "columnview"})
    head = page.one("title")
    title = (head.text("") if head is not None else "") or re.sub(r"\s*" + DIR_ID, "", folder).strip() or folder
    nothing = (None, None, None, None, 0, None, 0, None, None)
    yield (path, -1, chat, title, "chat", None, None, None, *nothing[1:])
    wrote = {_joined(pick(name)) for box, pick in boxes for name in box.names} - {""}
    for name in sorted(_members(page, page.by_class()) | wrote):
        yield (path, -1, chat, title, "member", None, person_raw_id(name), name, *nothing[1:])
    for pos, (box, pick) in enumerate(boxes, start=1):
        if "msg-date-change" in box.kinds:
            continue
        ts = _time(_joined(pick(box.stamp))) if box.stamp is not None else None
        if ts is None:
            continue
        if "msg-status" in box.kinds:
            said = next((text for part in box.status if (text := _joined(pick(part)))), "")
            yield (path, pos, chat, title, "status", ts, None, None, said, *nothing[2:])
            continue
        name = "You" if "msg-outgoing" in box.kinds else _joined(pick(box.names[0])) if box.names else "Unknown"
        files = [f"{folder}/{target}" for target in box.files]
        raw_id = person_raw_id(name)
        content = "\n\n".join(text for part in box.body if (text := _joined(pick(part), "\n")))
        parts = [chat, ts.isoformat(), raw_id, content, str(pos), files[0] if files else ""]
        yield (
            path, pos, chat, title, "message", ts, raw_id, "You" if raw_id == "self" else name, content,
            hashlib.sha1("|".join(parts).encode("utf-8")).hexdigest(), box.reply, len(files), files[0] if files else None,
            *_reactions(tuple((_joined(pick(tag), ""), _joined(pick(number), ""), _joined(pick(info), "\n")) for tag, number, info in box.reactions)),
        )


def _parsed(files: DataFrame) -> DataFrame:
    """Rows of RAW_SCHEMA from files of (path, content)."""
    schema = arrow_schema(RAW_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (file for batch in batches for file in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()))
        yield from in_batches((row for path, content in found for row in parse_chat(path, content.decode("utf-8", errors="ignore"))), schema)

    return files.select("path", "content").mapInArrow(parse, RAW_SCHEMA)


def group_name_change(content: Column) -> Column:
    """struct(actor, name) when the text says a group was named; other notices in it are skipped first."""
    other = "|".join(OTHER_SENTENCES)

    def named(candidate: Column, pattern: str) -> Column:
        raw = F.trim(F.regexp_replace(F.trim(F.regexp_extract(candidate, pattern, 2)), "[.!?]+$", ""))
        actor = F.nullif(F.trim(F.regexp_extract(candidate, pattern, 1)), F.lit(""))
        change = let(unquote(raw), lambda name: F.when(name != "", F.struct(actor.alias("actor"), name.alias("name"))))
        return F.when(candidate.rlike(pattern), change)

    def first(candidate: Column) -> Column:
        return F.coalesce(*[named(candidate, p) for p in GROUP_NAME])

    def either(text: Column) -> Column:
        sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: (s != "") & ~F.lower(s).rlike(other))
        return F.coalesce(let(F.nullif(F.trim(F.array_join(sentences, " ")), F.lit("")), first), first(text))

    return let(squeeze(F.coalesce(content, F.lit(""))), lambda text: F.when(may_say(text, *NAMED_WORDS), either(text)))


def is_system_text(content: Column) -> Column:
    def said(text: Column) -> Column:
        notice = text.rlike(SYSTEM[0])
        for pattern in SYSTEM[1:3]:
            notice = notice | text.rlike(pattern)
        # the others begin with fixed words
        notice = may_say(text, *NOTICE_WORDS) & notice
        for pattern in SYSTEM[3:]:
            notice = notice | text.rlike(pattern)
        # a group name change always contains one of these phrases
        named = F.lower(text).rlike(r"(named the group|group (name|title) to) ") & group_name_change(text).isNotNull()
        return (text != "") & (notice | named)

    return let(squeeze(F.coalesce(content, F.lit(""))), said)


def admitted_chats(members: DataFrame, config: Config) -> DataFrame:
    """Chats in which at least two configured people take part."""
    people = members.select(
        "chat", F.lit("signal").alias("platform"), F.col("person_raw_id").alias("raw_id"),
        F.col("person_name").alias("display_name"),
    )
    names = people.select("platform", "raw_id", "display_name").distinct()
    known = resolve_people(names, config).filter(F.col("color_hint") != "")
    return (
        people.join(known, ["platform", "raw_id", "display_name"])
        .select("chat", "canonical_name").distinct()
        .groupBy("chat").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_CONFIGURED).select("chat")
    )


def title_changes(events: DataFrame) -> DataFrame:
    """Renames of (chat, ts, name, ...) in order; repeats are dropped, the name before is filled in."""
    order = W.partitionBy("chat").orderBy("ts", casefold(F.col("name")), "pos")
    chained = events.withColumn("previous_name", F.lag("name").over(order))
    return chained.filter(F.col("previous_name").isNull() | (F.col("previous_name") != F.col("name")))


def read_signal(files: DataFrame, config: Config | None = None, source: str = "signal_decrypted") -> Export:
    """Chats from rows of (path, content). With a configuration, only chats of at least two configured people."""
    # parsed once, read by several consumers below
    raw = written(_parsed(files))
    if config is not None:
        raw = raw.join(admitted_chats(raw.filter(F.col("kind") == "member"), config), "chat", "left_semi")
    source_name = F.lit(f"Signal: {source}")
    ord_ = F.struct(F.lit(2).alias("rank"), "path", "pos")
    messages = raw.filter(F.col("kind") == "message").select(
        F.lit("signal").alias("platform"), source_name.alias("source_name"), F.col("chat").alias("channel_raw_id"),
        F.col("title").alias("channel_name"), "id", "person_raw_id", "person_name", "ts", "content", "reply_to_id",
        "attachment_count", "attachment_preview", "reaction_count", "reaction_summary", "reaction_details_json",
        F.lit(False).alias("is_edited"), is_system_text(F.col("content")).alias("is_system"), ord_.alias("ord"),
    )
    events = (
        raw.filter(F.col("kind") == "status").withColumn("g", group_name_change(F.col("content")))
        .filter(F.col("g").isNotNull())
        .select("chat", "path", "pos", "ts", "content", F.col("g.actor").alias("actor"), F.col("g.name").alias("name"))
    )
    empty = F.lit("")
    payload = F.to_json(
        F.struct(
            F.coalesce("actor", empty).alias("actor_name"),
            F.coalesce(raw_id_of(F.col("actor")), empty).alias("actor_raw_id"),
            F.col("content").alias("text"),
        )
    )
    changes = title_changes(events).select(
        source_name.alias("source_name"), F.lit("signal").alias("platform"), F.lit("channel").alias("entity_kind"),
        F.col("chat").alias("entity_raw_id"), "previous_name", F.col("name").alias("new_name"), "ts",
        F.lit("channel-title-change").alias("kind"), payload.alias("payload_json"),
    )
    actors = events.filter(F.col("actor").isNotNull()).select(
        F.lit("signal").alias("platform"), raw_id_of(F.col("actor")).alias("person_raw_id"),
        F.when(raw_id_of(F.col("actor")) == "self", F.lit("You")).otherwise(F.col("actor")).alias("person_name"),
        ord_.alias("ord"),
    )
    people = first_people(messages.select("platform", "person_raw_id", "person_name", "ord").unionByName(actors))
    channels = raw.filter(F.col("kind") == "chat").select(
        source_name.alias("source_name"), F.col("chat").alias("raw_id"), F.col("title").alias("name")
    )
    sources = files.limit(1).select(F.lit("signal").alias("platform"), source_name.alias("name"))
    return Export(messages, sources, channels, people, changes)


__all__ = ["admitted_chats", "group_name_change", "is_system_text", "parse_chat", "read_signal", "title_changes"]
