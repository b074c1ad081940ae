"""Tables derived from message content, and the choice between stored and live derivation.

Every explosion here is narrow: no shuffle until a query aggregates the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import MONTH_KEY, Chat


def message_tokens(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("id").alias("message_id"), F.posexplode(tx.tokens(F.col("content"))).alias("token_index", "token")
    )


def message_links(messages: DataFrame) -> DataFrame:
    found = messages.select(
        F.col("id").alias("message_id"), F.posexplode(tx.urls(F.col("content"))).alias("link_index", "raw_url")
    )
    host = tx.url_host(F.col("raw_url"))
    return found.withColumn("raw_host", host).filter(F.col("raw_host") != "").withColumn(
        "domain", tx.canonical_domain(F.col("raw_host"))
    )


def message_mentions(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("id").alias("message_id"), F.posexplode(tx.mentions(F.col("content"))).alias("mention_index", "mention")
    )


def message_trigrams(messages: DataFrame) -> DataFrame:
    """(message_id, gram), and the month where messages are stored by it: a search then reads the months of its hits only."""
    long_enough = messages.filter(F.length("content") >= 3)
    month = [MONTH_KEY] if MONTH_KEY in messages.columns else []
    return long_enough.select(F.col("id").alias("message_id"), F.explode(tx.trigrams(F.col("content"))).alias("gram"), *month)


def fact_metadata(spark) -> DataFrame:
    return spark.createDataFrame(sorted(tx.FACT_VERSIONS.items()), "key string, value string")


def facts_valid(chat: Chat, metadata: DataFrame | None) -> bool:
    """Stored facts count only when every table is there and the version is the current one."""
    tables = (chat.tokens, chat.links, chat.mentions, chat.trigrams, chat.reaction_events, metadata)
    if any(t is None for t in tables):
        return False
    version = metadata.filter(F.col("key") == "fact_schema_version").select("value").head(1)
    return bool(version) and version[0][0] == tx.FACT_VERSIONS["fact_schema_version"]


def with_tokens(chat: Chat, rows: DataFrame, word: str | None = None) -> DataFrame:
    """Scoped messages times their tokens, column ``token``; with ``word`` only that token.

    For one word the stored table answers: it is clustered by token, and what is
    left of it joins cheaply. For all words the text is cut up again, since the
    token table is as large as the text and joining it would shuffle both.
    """
    if word is not None and chat.tokens is not None:
        hits = chat.tokens.filter(F.col("token") == word).select(F.col("message_id").alias("id"), "token")
        return rows.join(hits, "id")
    found = rows.withColumn("token", F.explode(tx.tokens(F.col("content"))))
    return found if word is None else found.filter(F.col("token") == word)


def with_domains(chat: Chat, rows: DataFrame) -> DataFrame:
    """Scoped messages times the domains they link to."""
    if chat.links is not None:
        return rows.join(chat.links.select(F.col("message_id").alias("id"), "domain"), "id")
    host = F.explode(tx.hosts(F.col("content")))
    return rows.withColumn("host_", host).withColumn("domain", tx.canonical_domain(F.col("host_"))).drop("host_")


def with_mentions(chat: Chat, rows: DataFrame) -> DataFrame:
    if chat.mentions is not None:
        return rows.join(chat.mentions.select(F.col("message_id").alias("id"), "mention"), "id")
    return rows.withColumn("mention", F.explode(tx.mentions(F.col("content"))))
