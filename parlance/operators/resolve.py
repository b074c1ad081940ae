"""Which configured person or theme a raw identity or channel stands for.

Each rule tier is a left join against a table built from the configuration (its
size is that of the configuration files, which Catalyst sees as local data), and
the first tier that answers wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.names import fold, name_tokens
from ..session import local_frame


def _fold(text: str) -> str:
    """The driver-side twin of ``functions.names.fold``, for configuration values."""
    return " ".join(text.upper().lower().split())


def _words(text: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", _fold(text))))


def _latest(pairs: Iterable[tuple]) -> dict:
    """Of equal keys the last one configured."""
    return dict(pairs)


def _unique(pairs: Iterable[tuple]) -> dict:
    """Keys that lead to exactly one value."""
    found: dict = {}
    for key, value in pairs:
        found.setdefault(key, set()).add(value)
    return {key: next(iter(values)) for key, values in found.items() if len(values) == 1}


def _table(spark: SparkSession, found: dict, keys: list[str], hit: str) -> DataFrame:
    rows = [((*key, value) if isinstance(key, tuple) else (key, value)) for key, value in found.items()]
    return local_frame(spark, rows, ", ".join(f"{k} string" for k in keys) + f", hit {hit}")


def _look_up(df: DataFrame, table: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Left join; ``on`` maps columns of ``df`` to key columns of ``table``."""
    right = table.select(*[F.col(k).alias(f"{name}_{k}") for k in on.values()], F.col("hit").alias(name))
    condition = None
    for left, key in on.items():
        part = df[left] == right[f"{name}_{key}"]
        condition = part if condition is None else condition & part
    return df.join(right, condition, "left").drop(*[f"{name}_{k}" for k in on.values()])


def _only_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose rows all hold the same value."""
    found = df.groupBy(*keys).agg(F.min(value).alias("hit"), F.max(value).alias("other_"))
    return found.filter(F.col("hit") == F.col("other_")).drop("other_")


def _fuzzy(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, hit): names whose word set contains, or is contained in, that of one person only.

    Names and candidates meet on a shared word, so only pairs with something in
    common are ever formed.
    """
    left = names.select("key", F.size("words").alias("mine"), F.explode("words").alias("word"))
    right = candidates.select("pos", "who", F.size("words").alias("theirs"), F.explode("words").alias("word"))
    pairs = left.join(right, "word").groupBy("key", "pos").agg(
        F.min("who").alias("who"), F.min("mine").alias("mine"), F.min("theirs").alias("theirs"),
        F.count(F.lit(1)).alias("shared"),
    )
    inside = pairs.filter((F.col("shared") == F.col("mine")) | (F.col("shared") == F.col("theirs")))
    return _only_one(inside, ["key"], "who")


def resolve_people(people: DataFrame, config: Config) -> DataFrame:
    """Adds canonical_name and color_hint to rows of (platform, raw_id, display_name).

    color_hint is empty for people the configuration does not know.
    """
    spark = people.sparkSession
    if not config.people:
        return people.withColumn("canonical_name", F.col("display_name")).withColumn("color_hint", F.lit(""))
    who = "struct<name:string,hint:string>"
    identities = [(i.platform, i.raw_id, (p.name, p.hint)) for p in config.people for i in p.identities]
    exact = _table(spark, _latest(((pl, raw), w) for pl, raw, w in identities), ["platform", "raw_id"], who)
    same_platform = _table(spark, _latest(((pl, _fold(raw)), w) for pl, raw, w in identities), ["platform", "norm"], who)
    any_platform = _table(spark, _unique((_fold(raw), w) for _, raw, w in identities), ["norm"], who)
    by_name = _table(spark, _unique((_fold(p.name), (p.name, p.hint)) for p in config.people), ["norm"], who)
    candidate = f"pos int, who {who}, words array<string>"
    ident_words = local_frame(spark, [(n, w, _words(raw)) for n, (_, raw, w) in enumerate(identities)], candidate)
    name_words = local_frame(
        spark,
        [(n, (p.name, p.hint), _words(p.name)) for n, p in enumerate(config.people)], candidate
    )

    norm_raw = fold(F.col("raw_id"))
    df = (
        people.withColumn("n_raw", norm_raw)
        .withColumn("n_name", fold(F.col("display_name")))
        .withColumn(
            "n_alias",
            F.when(
                (F.col("platform") == "signal") & F.startswith(F.col("n_raw"), F.lit("name:")),
                F.trim(F.substring(F.col("n_raw"), F.lit(6), F.length("n_raw"))),
            ),
        )
    )

    def words_of(column: str) -> DataFrame:
        keys = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("key")).distinct()
        return keys.withColumn("words", name_tokens(F.col("key"))).filter(F.size("words") > 0)

    tiers = [
        (exact, {"platform": "platform", "raw_id": "raw_id"}),
        (same_platform, {"platform": "platform", "n_raw": "norm"}),
        (same_platform, {"platform": "platform", "n_alias": "norm"}),
        (any_platform, {"n_alias": "norm"}),
        (_fuzzy(words_of("n_alias"), ident_words), {"n_alias": "key"}),
        (same_platform, {"platform": "platform", "n_name": "norm"}),
        (any_platform, {"n_name": "norm"}),
        (by_name, {"n_name": "norm"}),
        (_fuzzy(words_of("n_name"), ident_words), {"n_name": "key"}),
        (_fuzzy(words_of("n_name"), name_words), {"n_name": "key"}),
    ]
    columns = people.columns
    for i, (table, on) in enumerate(tiers):
        df = _look_up(df, table, on, f"tier_{i}")
    hit = F.coalesce(*[F.col(f"tier_{i}") for i in range(len(tiers))])
    return df.select(
        *columns,
        F.coalesce(hit["name"], F.col("display_name")).alias("canonical_name"),
        F.coalesce(hit["hint"], F.lit("")).alias("color_hint"),
    )


def source_platform(source: Column) -> Column:
    """The part of a source name before its colon, folded; empty without a colon."""
    head = fold(F.split_part(source, F.lit(":"), F.lit(1)))
    return F.when(F.contains(source, F.lit(":")), head).otherwise(F.lit(""))


def resolve_themes(channels: DataFrame, config: Config) -> DataFrame:
    """Adds ``theme`` to rows with source_name and channel_name; unmatched channels are their own theme."""
    spark = channels.sparkSession
    rules = [(src, ch, t.name) for t in config.themes for src, ch in t.channels]
    if not rules:
        return channels.withColumn("theme", F.col("channel_name"))

    def platform(source: str) -> str:
        return _fold(source.split(":", 1)[0]) if ":" in source else ""

    by_pair = _latest(((_fold(src), _fold(ch)), t) for src, ch, t in rules)
    folded = _table(spark, by_pair, ["n_source", "n_channel"], "string")
    pairs = local_frame(
        spark,
        [(platform(src), src, ch, t) for (src, ch), t in by_pair.items()],
        "p string, n_source string, n_channel string, t_ string",
    )
    df = (
        channels.withColumn("ns_", fold(F.col("source_name")))
        .withColumn("nc_", fold(F.col("channel_name")))
        .withColumn("p_", source_platform(F.col("source_name")))
    )
    # exports that append suffixes: the configured names must be prefixes, and agree on one theme
    prefixed = (
        df.filter(F.col("p_").isin("facebook", "signal"))
        .select("ns_", "nc_", "p_").distinct()
        .join(pairs, F.col("p_") == F.col("p"))
        .filter(
            F.startswith(F.col("ns_"), F.col("n_source")) & F.startswith(F.col("nc_"), F.col("n_channel"))
        )
    )
    tiers = [
        (
            _table(spark, _latest(((src, ch), t) for src, ch, t in rules), ["source", "channel"], "string"),
            {"source_name": "source", "channel_name": "channel"},
        ),
        (folded, {"ns_": "n_source", "nc_": "n_channel"}),
        (
            _table(spark, _unique(((platform(src), _fold(ch)), t) for src, ch, t in rules), ["p", "n_channel"], "string"),
            {"p_": "p", "nc_": "n_channel"},
        ),
        (_table(spark, _unique((_fold(ch), t) for _, ch, t in rules), ["n_channel"], "string"), {"nc_": "n_channel"}),
        (
            _only_one(prefixed.select(F.col("ns_").alias("a"), F.col("nc_").alias("b"), "t_"), ["a", "b"], "t_"),
            {"ns_": "a", "nc_": "b"},
        ),
    ]
    columns = channels.columns
    for i, (table, on) in enumerate(tiers):
        df = _look_up(df, table, on, f"tier_{i}")
    return df.select(
        *columns, F.coalesce(*[F.col(f"tier_{i}") for i in range(len(tiers))], F.col("channel_name")).alias("theme")
    )
