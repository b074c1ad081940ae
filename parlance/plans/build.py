"""From exports to tables: identities, conversations, facts, statistics, and an atomic switch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as tx
from ..functions.names import stable_color
from ..model import MONTH_KEY, Chat
from ..operators import facts
from ..operators.context import message_places
from ..operators.numbering import numbered, numbered_in_time
from ..operators.people import person_stats
from ..operators.reactions import reaction_events
from ..operators.resolve import resolve_people, resolve_themes
from ..operators.sessions import assign_conversations, conversation_table
from ..session import pinned, use_utc
from ..sources.discord import read_discord
from ..sources.facebook import read_facebook
from ..sources.files import discover_exports, read_files
from ..sources.seeds import Export, merge
from ..sources.signal import read_signal

POINTER = "CURRENT"
STAGED = "_staged"
#: derived tables and the column their files are clustered by, with Bloom filters, so that scans for one key skip files
FACT_KEYS = {
    "message_tokens": "token",
    "message_links": "domain",
    "message_mentions": "mention",
    "message_search_trigrams": "gram",
    "message_reaction_events": "emoji",
}
#: file names that may be broadcast, some 100 bytes each
LISTED_FILES = 100_000
#: an id with more copies than this is looked up without a shuffle; the list is shorter than the messages by this factor
OFTEN = 100_000
PLAIN_TABLES = (
    "people", "platform_identities", "sources", "themes", "channels", "person_name_changes", "channel_name_changes",
    "conversations", "member_events", "person_stats", "build_metadata",
)


class BuildError(RuntimeError):
    """A build whose tables do not agree with what was read."""


# -- dimensions --------------------------------------------------------------
def people_tables(people: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(people, platform_identities): identities of the same name and colour hint are one person.

    People are numbered in the order of their first identity by (platform, raw_id).
    """
    known = pinned(resolve_people(people, config))
    persons = known.groupBy("canonical_name", "color_hint").agg(F.min(F.struct("platform", "raw_id")).alias("first"))
    persons = pinned(numbered(persons.select("canonical_name", "color_hint", "first.*"), ["platform", "raw_id"]))
    table = persons.select(
        "id", F.col("canonical_name").alias("display_name"),
        F.coalesce(F.nullif("color_hint", F.lit("")), stable_color(F.col("canonical_name"))).alias("color"),
    )
    identities = known.join(
        persons.select("canonical_name", "color_hint", F.col("id").alias("person_id")), ["canonical_name", "color_hint"]
    ).select(
        "platform", F.col("raw_id").alias("platform_user_id"), F.col("display_name").alias("platform_username"), "person_id"
    )
    return table, identities


def channel_tables(sources: DataFrame, channels: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, channels, themes); themes are numbered in the order channels use them."""
    source_table = pinned(numbered(sources, ["name"]).select("id", "platform", "name"))
    rows = numbered(channels, ["source_name", "raw_id"]).withColumnRenamed("name", "channel_name")
    rows = pinned(resolve_themes(rows, config))
    used = rows.groupBy(F.col("theme").alias("name")).agg(F.min("id").alias("first"))
    themes = pinned(numbered(used, ["first"]).select("id", "name"))
    channel_table = (
        rows.join(source_table.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_name")
        .join(themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme")), "theme")
        .select("id", "source_id", F.col("raw_id").alias("platform_channel_id"), F.col("channel_name").alias("name"), "theme_id")
    )
    return source_table, channel_table, themes


# -- messages ----------------------------------------------------------------
def dedupe_messages(messages: DataFrame, order: str = "ord") -> DataFrame:
    """Of messages with the same id the earliest; equal times keep reading order.

    Which one that is comes from narrow columns alone; only ids that occur more than once
    need the look-up, and no row is packed whole. Ids with very many copies are settled where
    their rows are read, so that the copies of one id need not meet in one task.
    """
    keys = messages.groupBy("id").agg(F.count(F.lit(1)).alias("n_"), F.min(F.struct("ts", F.col(order).alias("o_"))).alias("first_"))
    kept = F.col("ts_").isNull() | ((F.col("ts") == F.col("ts_")) & (F.col(order) == F.col("o_")))

    def looked_up(rows: DataFrame, again: DataFrame, hint=lambda df: df) -> DataFrame:
        first = again.select("id", F.col("first_.ts").alias("ts_"), F.col("first_.o_").alias("o_"))
        return rows.join(hint(first), "id", "left").filter(kept).select(*messages.columns)

    rest = looked_up(messages, keys.filter(F.col("n_") > OFTEN), F.broadcast)
    return looked_up(rest, keys.filter((F.col("n_") > 1) & (F.col("n_") <= OFTEN)))


Stage = Callable[[DataFrame, str], DataFrame]


def message_table(
    messages: DataFrame, channels: DataFrame, sources: DataFrame, identities: DataFrame, stage: Stage = lambda df, _: df
) -> DataFrame:
    """Deduplicated messages with all ids; keeps the identity columns for conversations.

    ``stage`` writes the rows before conversations are looked for, since these read them twice.
    """
    dim = channels.select(F.col("id").alias("channel_id"), "source_id", F.col("platform_channel_id").alias("channel_raw_id")).join(
        sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id"
    ).drop("source_id")
    who = identities.select("platform", F.col("platform_user_id").alias("person_raw_id"), "person_id")
    rows = (
        dedupe_messages(messages)
        .join(dim, ["source_name", "channel_raw_id"])
        .join(who, ["platform", "person_raw_id"])
        .withColumn("word_count", tx.word_count(F.col("content")))
        .withColumn("char_count", tx.char_count(F.col("content")))
    )
    return assign_conversations(stage(rows, "rows")).select(
        "id", "channel_id", "person_id", "ts", "content", "reply_to_id", "word_count", "char_count", "attachment_count",
        "attachment_preview", "reaction_count", "reaction_summary", "reaction_details_json", "is_edited", "is_system",
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("float").alias("sentiment"), "conversation_id",
        "platform", "person_raw_id",
    )


# -- change logs -------------------------------------------------------------
def name_change_tables(
    changes: DataFrame, sources: DataFrame, channels: DataFrame, identities: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(person_name_changes, channel_name_changes) numbered together in time order."""
    rows = pinned(
        numbered_in_time(changes, ["platform", "source_name", "entity_kind", "entity_raw_id", "kind", "previous_name", "new_name", "payload_json"])
        .join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_name")
    )
    tail = ["source_id", "kind", "previous_name", "new_name", "ts", "payload_json"]
    persons = rows.filter(F.col("entity_kind") == "person").join(
        identities.select("platform", F.col("platform_user_id").alias("entity_raw_id"), "person_id"), ["platform", "entity_raw_id"]
    )
    chats = rows.filter(F.col("entity_kind") == "channel").join(
        channels.select("source_id", F.col("platform_channel_id").alias("entity_raw_id"), F.col("id").alias("channel_id")),
        ["source_id", "entity_raw_id"],
    )
    return persons.select("id", "person_id", *tail), chats.select("id", "channel_id", *tail)


def member_event_table(
    events: DataFrame, sources: DataFrame, channels: DataFrame, identities: DataFrame
) -> DataFrame:
    """Events of known channels and targets; the actor may be unknown. Numbers keep their gaps."""
    rows = numbered_in_time(events, ["kind", "source_name", "channel_raw_id", "target_raw_id", "actor_raw_id", "payload_json"])
    dim = channels.select("source_id", F.col("platform_channel_id").alias("channel_raw_id"), F.col("id").alias("channel_id"))
    target = identities.select("platform", F.col("platform_user_id").alias("target_raw_id"), F.col("person_id").alias("target_person_id"))
    actor = identities.select("platform", F.col("platform_user_id").alias("actor_raw_id"), F.col("person_id").alias("actor_person_id"))
    return (
        rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_name")
        .join(dim, ["source_id", "channel_raw_id"])
        .join(target, ["platform", "target_raw_id"])
        .join(actor, ["platform", "actor_raw_id"], "left")
        .select("id", "channel_id", "source_id", "kind", "actor_person_id", "target_person_id", "ts", "payload_json")
    )


# -- reading, writing, switching ---------------------------------------------
def read_exports(spark: SparkSession, data_root: str, config: Config, filter_signal: bool) -> Export:
    root = data_root.rstrip("/")
    wanted = discover_exports(spark, root).select("path")
    if wanted.limit(LISTED_FILES + 1).count() <= LISTED_FILES:
        wanted = F.broadcast(wanted)  # else the bytes of all files would travel to meet a list of names

    def files(folder: str, pattern: str) -> DataFrame:
        return read_files(spark, f"{root}/{folder}", pattern).join(wanted, "path", "left_semi")

    return merge([
        read_discord(files("discord", "*.html")),
        read_facebook(files("facebook", "message_*.html")),
        read_signal(files("signal_decrypted", "*.html"), config if filter_signal else None),
    ])


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write(df: DataFrame, folder: str, key: str | None = None, seen: Observation | None = None) -> None:
    """Writes a table; ``seen`` takes the number of its rows in passing."""
    writer_options = {}
    if key:
        # by hash, since ranges would derive the rows a first time to sample them; adaptive execution splits
        # the partition of a key with many rows by the bytes it finds, so a hot key takes as many files as it needs
        # (and so do keys that hash into its partition; at most one file for each task that wrote the rows)
        df = df.hint("rebalance", key).sortWithinPartitions(key, "message_id")
        writer_options[f"parquet.bloom.filter.enabled#{key}"] = "true"
    if seen:
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    df.write.mode("overwrite").options(**writer_options).parquet(folder)


def _staging(spark: SparkSession, folder: str) -> Stage:
    """Writes rows below ``folder`` as Parquet and reads them back: parsed once, then read by column."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{STAGED}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{STAGED}/{name}")

    return stage


def write_places(messages: DataFrame, folder: str) -> None:
    """Message numbers in channel order, once as they are and once sorted by id with Bloom filters on it."""
    message_places(messages).sortWithinPartitions("place").write.mode("overwrite").parquet(f"{folder}/message_order")
    ordered = messages.sparkSession.read.parquet(f"{folder}/message_order")
    by_id = ordered.repartition("id").sortWithinPartitions("id").write.mode("overwrite")
    by_id.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{folder}/message_places")


def write_tables(export: Export, folder: str, config: Config) -> dict[str, int]:
    """All tables of a dataset below one folder. Returns what ``validate`` looks at, counted
    while the rows were written, right before the files, where every row passes once."""
    spark = export.messages.sparkSession
    people, identities = people_tables(export.people, config)
    sources, channels, themes = channel_tables(export.sources, export.channels, config)
    for name, table in {
        "people": people, "platform_identities": identities, "sources": sources, "channels": channels, "themes": themes,
    }.items():
        _write(table, f"{folder}/{name}")
    read = {n: spark.read.parquet(f"{folder}/{n}") for n in ("people", "platform_identities", "sources", "channels", "themes")}
    dims = (read["channels"], read["sources"], read["platform_identities"])

    whole = message_table(export.messages, *dims, stage=_staging(spark, folder))
    month = F.year("ts") * 100 + F.month("ts")
    # neighbours in a channel lie in one file, and a month in few
    laid_out = whole.withColumn(MONTH_KEY, month).repartitionByRange(MONTH_KEY, "channel_id", "ts", "id")
    seen = {name: Observation() for name in ("messages", "message_search_trigrams", "message_reaction_events")}
    counted = laid_out.sortWithinPartitions(MONTH_KEY, "channel_id", "ts", "id").observe(
        seen["messages"], F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("reaction_count").cast("bigint")), F.lit(0)).alias("reactions"),
        F.coalesce(F.max(F.length("content")), F.lit(0)).alias("longest"),
    )
    counted.write.mode("overwrite").partitionBy(MONTH_KEY).parquet(f"{folder}/messages")
    stored = spark.read.parquet(f"{folder}/messages")
    write_places(stored, folder)
    _write(stored.groupBy(MONTH_KEY).agg(F.count(F.lit(1)).alias("n")), f"{folder}/message_months")
    _write(conversation_table(stored, ("platform", "person_raw_id")), f"{folder}/conversations")
    persons, chats = name_change_tables(export.name_changes, read["sources"], read["channels"], read["platform_identities"])
    _write(persons, f"{folder}/person_name_changes")
    _write(chats, f"{folder}/channel_name_changes")
    if export.member_events is not None:
        _write(
            member_event_table(export.member_events, read["sources"], read["channels"], read["platform_identities"]),
            f"{folder}/member_events",
        )
    for name, table in {
        "message_tokens": facts.message_tokens(stored),
        "message_links": facts.message_links(stored),
        "message_mentions": facts.message_mentions(stored),
        "message_search_trigrams": facts.message_trigrams(stored),
        "message_reaction_events": reaction_events(stored, read["platform_identities"]),
    }.items():
        _write(table, f"{folder}/{name}", FACT_KEYS[name], seen.get(name))
    _write(facts.fact_metadata(spark), f"{folder}/build_metadata")
    chat = Chat(
        messages=stored.drop("platform", "person_raw_id"), channels=read["channels"], sources=read["sources"], people=read["people"], themes=read["themes"],
        config=config, tokens=spark.read.parquet(f"{folder}/message_tokens"),
    )
    _write(person_stats(chat), f"{folder}/person_stats")
    found = seen["messages"].get
    return {
        "messages": found["n"], "reactions": found["reactions"], "longest": found["longest"],
        "trigrams": seen["message_search_trigrams"].get["n"], "reaction_events": seen["message_reaction_events"].get["n"],
    }


def validate(spark: SparkSession, folder: str, seen: dict[str, int], expected_messages: int) -> None:
    """Raises when what was written does not agree with itself or with what was read."""
    if seen["messages"] != expected_messages:
        raise BuildError(f"expected {expected_messages} messages, found {seen['messages']}")
    if seen["longest"] >= 3 and not seen["trigrams"]:
        raise BuildError("search facts are empty")
    if seen["reaction_events"] != seen["reactions"]:
        raise BuildError(f"expected {seen['reactions']} reaction events, found {seen['reaction_events']}")
    version = spark.read.parquet(f"{folder}/build_metadata").filter(F.col("key") == "fact_schema_version").head(1)
    if not version or version[0].value != tx.FACT_VERSIONS["fact_schema_version"]:
        raise BuildError("fact version is missing")


def build(
    spark: SparkSession,
    data_root: str,
    out: str,
    config: Config = Config(),
    filter_signal: bool | None = None,
    overwrite: bool = True,
) -> str:
    """Builds all tables from the exports below a folder and makes them current in one step (see ``build_from``)."""
    use_utc(spark)
    return build_from(
        spark, lambda: read_exports(spark, data_root, config, bool(config.people) if filter_signal is None else filter_signal), out, config, overwrite
    )


def build_from(
    spark: SparkSession, read: Callable[[], Export], out: str, config: Config = Config(), overwrite: bool = True
) -> str:
    """Builds all tables from what ``read`` gives and makes them current in one step.

    Tables go to a folder of their own and are checked; only then the pointer file
    is replaced. A failed build leaves the current one as it was and removes its
    own files. Returns the folder of the new tables.
    """
    use_utc(spark)
    out = out.rstrip("/")
    fs, pointer = _fs(spark, f"{out}/{POINTER}")
    if fs.exists(pointer) and not overwrite:
        raise FileExistsError(f"{out} already holds a build")
    name = f"build_id={uuid.uuid4().hex}"
    folder = f"{out}/{name}"
    try:
        export = read()
        # each consumer below would otherwise parse the exports again
        stage = _staging(spark, folder)
        export.messages = stage(export.messages, "messages")
        export.people = stage(export.people, "people")
        export.name_changes = stage(export.name_changes, "name_changes")
        seen = write_tables(export, folder, config)
        validate(spark, folder, seen, export.messages.select("id").distinct().count())
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STAGED}"), True)
    except Exception:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        raise
    _point_to(spark, out, name)
    return folder


def _point_to(spark: SparkSession, out: str, name: str) -> None:
    jvm = spark._jvm
    fs, temp = _fs(spark, f"{out}/.{POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(temp, True)
    stream.write(bytearray(name, "utf-8"))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{out}/{POINTER}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(temp), fs.makeQualified(target), options)


def current_folder(spark: SparkSession, out: str) -> str:
    name = spark.read.text(f"{out.rstrip('/')}/{POINTER}").head().value
    return f"{out.rstrip('/')}/{name}"


def stored_versions(spark: SparkSession, out: str) -> DataFrame:
    """Which version the facts of the current build have, if it is the one this library reads."""
    metadata = spark.read.parquet(f"{current_folder(spark, out)}/build_metadata")
    return metadata.join(facts.fact_metadata(spark), ["key", "value"]).filter(F.col("key") == "fact_schema_version")


def open_build(spark: SparkSession, out: str, config: Config = Config()) -> Chat:
    """The current tables. Stored facts are used only when all of them are there in the right version."""
    use_utc(spark)
    folder = current_folder(spark, out)

    def table(name: str) -> DataFrame | None:
        fs, where = _fs(spark, f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}") if fs.exists(where) else None

    chat = Chat(
        messages=table("messages").drop("platform", "person_raw_id"),
        channels=table("channels"), sources=table("sources"), people=table("people"), themes=table("themes"), config=config,
        tokens=table("message_tokens"), links=table("message_links"), mentions=table("message_mentions"),
        trigrams=table("message_search_trigrams"), reaction_events=table("message_reaction_events"),
        person_stats=table("person_stats"), conversations=table("conversations"),
        platform_identities=table("platform_identities"), person_name_changes=table("person_name_changes"),
        channel_name_changes=table("channel_name_changes"), member_events=table("member_events"),
        places=table("message_places"), ordered=table("message_order"), months=table("message_months"),
    )
    if not facts.facts_valid(chat, table("build_metadata")):
        chat.tokens = chat.links = chat.mentions = chat.trigrams = chat.reaction_events = None
    return chat
