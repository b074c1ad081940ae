"""Media files of exports: catalogue, attachment resolution, and blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

# --- fixed values -----------------------------------------------------------
LOCAL_HOST = r"^https?://(localhost:|127\.0\.0\.1:)"
WEB = r"(?i)^https?://"
REMOVED_URL = "/api/media-removed"
INBOX_FOLDERS = ("messages/inbox/", "messages/archived_threads/")
# ----------------------------------------------------------------------------


def media_catalog(files: DataFrame) -> DataFrame:
    """(platform, source, path, name, sha256) from rows of (path, content).

    ``path`` is relative to the source folder: a chat folder for Facebook and
    Signal, the export folder for Discord.
    """
    split = r"^.*?/(facebook|signal_decrypted|discord|discord-media)/(.*)$"
    area = F.regexp_extract("path", split, 1)
    rest = F.regexp_extract("path", split, 2)
    per_chat = area.isin("facebook", "signal_decrypted")
    return files.select(
        F.when(area == "signal_decrypted", F.lit("signal")).when(area == "discord-media", F.lit("discord"))
        .otherwise(area).alias("platform"),
        F.when(per_chat, F.split_part(rest, F.lit("/"), F.lit(1))).otherwise(area).alias("source"),
        F.when(per_chat, F.regexp_replace(rest, "^[^/]*/", "")).otherwise(rest).alias("path"),
        F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"),
        F.sha2("content", 256).alias("sha256"),
    ).filter(F.col("platform") != "")


def blocked(catalog: DataFrame, config: Config) -> DataFrame:
    """Adds whether a file is blocked, by content or by name."""
    by_hash = F.col("sha256").isin(sorted(config.blocked_sha256)) if config.blocked_sha256 else F.lit(False)
    by_name = F.col("name").isin(sorted(config.blocked_filenames)) if config.blocked_filenames else F.lit(False)
    return catalog.withColumn("blocked", by_hash | by_name)


def local_path(preview: Column) -> Column:
    """A preview as a path: local servers' addresses lose their host, escapes are undone."""
    path = F.when(preview.rlike(LOCAL_HOST), F.coalesce(F.try_parse_url(preview, F.lit("PATH")), F.lit(""))).otherwise(preview)
    path = F.trim(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    return F.regexp_replace(path, "^/", "")


def _safe(path: Column) -> Column:
    """Without empty, "." and ".." parts; null when nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.nullif(F.array_join(parts, "/"), F.lit(""))


def facebook_path(preview: Column, folder: Column) -> Column:
    path = local_path(preview)
    inbox = F.lit(False)
    for prefix in INBOX_FOLDERS:
        inbox = inbox | F.startswith(path, F.lit(prefix))
    bare = F.when(inbox, F.regexp_replace(path, "^messages/(inbox|archived_threads)/", "")).otherwise(path)
    own = F.concat(folder, F.lit("/"))
    cut = F.substring(bare, F.length(own) + 1, F.length(bare))
    return F.when(F.startswith(bare, own), cut).otherwise(path)


def media_url(platform: Column, source: Column, path: Column) -> Column:
    return F.concat(
        F.lit("/api/media?platform="), F.url_encode(platform), F.lit("&source="), F.url_encode(source),
        F.lit("&path="), F.url_encode(path),
    )


def resolve_attachments(messages: DataFrame, catalog: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds attachment_url to messages with source_name and attachment_preview.

    Web addresses pass through. Otherwise the path as given is looked up, then a
    fallback by base name: any file of the Signal chat, or the media folders of
    Discord. Blocked files get the address of a placeholder. ``catalog`` comes
    from ``media_catalog``.
    """
    known = blocked(catalog, config or Config())
    preview = F.trim(F.coalesce("attachment_preview", F.lit("")))
    web = preview.rlike(WEB) & ~preview.rlike(LOCAL_HOST)
    folder = F.trim(F.regexp_replace("source_name", "^(Facebook|Signal|Discord): ", ""))
    area = F.lower(F.split_part(F.col("source_name"), F.lit(":"), F.lit(1)))
    path = F.when(area == "facebook", facebook_path(preview, folder)).otherwise(local_path(preview))
    # an absolute path into an export folder is read relative to it
    path = F.when((area == "discord") & path.rlike("(^|/)discord(-media)?/"), F.regexp_replace(path, "^.*?(^|/)discord(-media)?/", "")).otherwise(path)
    rows = messages.withColumn("m_", F.monotonically_increasing_id()).withColumn("area_", area).withColumn(
        "path_", F.when((preview != "") & ~web, _safe(path))
    )
    # Signal exports are one source of many chat folders, so their first folder is part of the path
    rows = rows.withColumn(
        "folder_",
        F.when((area == "signal") & (folder == "signal_decrypted"), F.split_part(F.col("path_"), F.lit("/"), F.lit(1)))
        .when(area == "discord", F.lit("discord")).otherwise(folder),
    ).withColumn(
        "inner_",
        F.when((area == "signal") & (folder == "signal_decrypted"), F.regexp_replace("path_", "^[^/]*/", "")).otherwise(F.col("path_")),
    ).withColumn("name_", F.lower(F.element_at(F.split("path_", "/"), -1)))
    direct = known.groupBy("platform", "source", "path").agg(F.max("blocked").alias("direct_blocked"))
    rows = rows.join(
        direct.select(
            F.col("platform").alias("area_"), F.col("source").alias("folder_"), F.col("path").alias("inner_"), "direct_blocked"
        ),
        ["area_", "folder_", "inner_"], "left",
    )
    # by base name: the first path of its kind
    discord_place = F.when(F.col("path").rlike("^assets/[^/]+$"), 0).when(F.col("path").rlike("^media/[^/]+$"), 1).when(
        (F.col("source") == "discord-media") & ~F.contains("path", F.lit("/")), 2
    )
    fallback = (
        known.withColumn("place", F.when(F.col("platform") == "discord", discord_place).when(
            (F.col("platform") == "signal") & F.col("path").startswith("media/"), 0))
        .filter(F.col("place").isNotNull())
        .withColumn("source", F.when(F.col("platform") == "discord", F.lit("discord")).otherwise(F.col("source")))
        .groupBy("platform", "source", "name")
        .agg(F.min_by(F.struct("path", "blocked"), F.struct("place", "path")).alias("found"))
    )
    rows = rows.join(
        fallback.select(
            F.col("platform").alias("area_"), F.col("source").alias("folder_"), F.col("name").alias("name_"), "found"
        ),
        ["area_", "folder_", "name_"], "left",
    )
    hit_path = F.when(F.col("direct_blocked").isNotNull(), F.col("inner_")).otherwise(F.col("found.path"))
    hit_blocked = F.coalesce("direct_blocked", F.col("found.blocked"))
    shown_source = F.when(F.col("area_") == "signal", F.col("folder_")).otherwise(folder)
    url = F.when(web, preview).when(hit_blocked, F.lit(REMOVED_URL)).when(
        hit_path.isNotNull(), media_url(F.col("area_"), shown_source, hit_path)
    )
    return rows.select(*messages.columns, url.alias("attachment_url"))
