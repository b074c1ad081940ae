"""Links, mentions, and how a message shows its links and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import Chat, Filters
from .facts import with_domains, with_mentions
from .scope import scope
from .words import as_examples

# --- fixed values -----------------------------------------------------------
SHOWN_URL = r"""(?i)\bhttps?://[^\s<>"']+"""
URL_TAIL = r"[)\].,!?;:]+$"
SHOWN_LIMIT = 2
SHORTEST_URL = 8
IMAGE_PATH = r"\.(png|jpe?g|gif|webp|bmp|svg)(\?|#|$)"
VIDEO_PATH = r"\.(mp4|mov|webm|m4v)(\?|#|$)"
AUDIO_PATH = r"\.(mp3|wav|ogg|m4a|aac|flac)(\?|#|$)"
# ----------------------------------------------------------------------------


def linked_domains(chat: Chat, filters=Filters(), limit: int | None = 200) -> DataFrame:
    counts = (
        with_domains(chat, scope(chat, filters)).filter(F.col("domain") != "")
        .groupBy("domain").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "domain")
    )
    return counts if limit is None else counts.limit(limit)


def domain_examples(chat: Chat, domain: str, filters=Filters(), limit: int = 6, offset: int = 0) -> DataFrame:
    wanted = domain.strip().casefold()
    if not wanted or len(wanted) > 255:
        raise ValueError("Invalid domain")
    rows = scope(chat, filters)
    if chat.links is not None:
        hits = chat.links.filter(F.col("domain") == wanted).select(F.col("message_id").alias("id"))
        rows = rows.join(hits, "id", "left_semi")
    else:
        rows = rows.filter(F.exists(tx.hosts(F.col("content")), lambda h: tx.canonical_domain(h) == wanted))
    return as_examples(chat, rows, newest=True, limit=limit, offset=offset)


def links_by_author(chat: Chat, filters=Filters(), limit: int = 15) -> DataFrame:
    counts = (
        with_domains(chat, scope(chat, filters)).filter(F.col("domain") != "")
        .groupBy("person_id").agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        counts.join(chat.people, F.col("person_id") == F.col("id"))
        .select("id", "display_name", "color", "count")
        .orderBy(F.desc("count"), "display_name").limit(limit)
    )


def most_mentioned(chat: Chat, filters=Filters(), limit: int = 200) -> DataFrame:
    return (
        with_mentions(chat, scope(chat, filters)).filter(F.col("mention") != "")
        .groupBy("mention").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "mention").limit(limit)
        .select(F.concat(F.lit("@"), "mention").alias("mention"), "count")
    )


def url_key(url: Column) -> Column:
    """Equal for links to the same video, otherwise the URL itself."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    short = F.split_part(F.substring(F.try_parse_url(url, F.lit("PATH")), F.lit(2), F.length(url)), F.lit("/"), F.lit(1))
    long = F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))
    video = F.when(host == "youtu.be", short).when(host.isin("youtube.com", "m.youtube.com"), long)
    return F.coalesce(F.concat(F.lit("youtube:"), F.nullif(video, F.lit(""))), url)


def shown_links(content: Column) -> Column:
    """The first two different links of a message, as shown under it."""
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(SHOWN_URL), F.lit(0))
    clean = F.filter(F.transform(found, lambda u: F.regexp_replace(u, URL_TAIL, "")), lambda u: F.length(u) >= SHORTEST_URL)
    keyed = F.transform(clean, lambda u: F.struct(url_key(u).alias("key"), u.alias("url")))
    keys = F.transform(keyed, lambda x: x["key"])
    # keep an item when its key has not been seen before it
    first = F.filter(keyed, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.slice(F.transform(first, lambda x: x["url"]), 1, SHOWN_LIMIT)


def is_url_only(content: Column) -> Column:
    text = F.coalesce(content, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(text, SHOWN_URL, ""), r"(?U)[\s​]+", "")
    return text.rlike(SHOWN_URL) & (rest == "")


def without_links(content: Column, links: Column) -> Column:
    """Message text with the shown links taken out."""
    text = F.coalesce(content, F.lit(""))
    bare = F.aggregate(links, text, lambda acc, u: F.replace(acc, u, F.lit("")))
    tidy = F.trim(F.regexp_replace(bare, r"(?U)\s{2,}", " "))
    return F.when(F.size(links) == 0, text).otherwise(tidy)


def message_links_view(messages: DataFrame) -> DataFrame:
    shown = messages.select("id", "content", shown_links(F.col("content")).alias("links"))
    return shown.select(
        "id", "links",
        is_url_only(F.col("content")).alias("url_only"),
        without_links(F.col("content"), F.col("links")).alias("text"),
    )


def attachment_kind(preview: Column) -> Column:
    low = F.lower(preview)
    return (
        F.when(preview.isNull() | (preview == ""), F.lit(None).cast("string"))
        .when(F.contains(preview, F.lit("/api/media-removed")), "image")
        .when(low.rlike(IMAGE_PATH), "image")
        .when(low.rlike(VIDEO_PATH), "video")
        .when(low.rlike(AUDIO_PATH), "audio")
        .when(low.rlike("^https?://"), "link")
        .otherwise("label")
    )
