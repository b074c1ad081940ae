"""Finding the archive folders of the groups one is in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .facebook import repair
from .html import parse_html

HEADER_SCHEMA = "path string, title string, participants array<string>"
PREFIX = "Participants:"


def read_header(html: str) -> tuple[str | None, list[str]]:
    """Title and participants a chat file names in its head."""
    page = parse_html(html)
    head = page.one("title")
    title = repair(" ".join(head.text().split())) if head is not None else None
    line = next((s.strip() for s in page.strings() if s.strip().startswith(PREFIX)), "")
    line = repair(" ".join(line.split()))[len(PREFIX) :].replace(", and ", ", ").replace(" and ", ", ")
    return title, [name for name in (repair(" ".join(p.split())) for p in line.split(",")) if name]


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(p, *read_header(bytes(c).decode("utf-8", errors="replace"))) for p, c in zip(batch["path"], batch["content"])]
        yield pd.DataFrame(rows, columns=["path", "title", "participants"])


def scan_archives(files: DataFrame, config: Config, least: int = 3) -> DataFrame:
    """(chat_dir, title, participants, matched, readable, is_match) per archive folder.

    The first file of a folder that names participants speaks for it; folders
    without one are reported as unreadable.
    """
    spark = files.sparkSession
    chat = F.element_at(F.split("path", "/"), -2)
    heads = files.select("path", "content").mapInPandas(_headers, HEADER_SCHEMA).withColumn("chat_dir", chat)
    named = F.when(F.size("participants") > 0, F.col("path"))
    first = heads.groupBy("chat_dir").agg(
        F.min_by(F.struct("title", "participants"), named).alias("h"), F.count(named).alias("n")
    )
    rows = first.select(
        "chat_dir", F.coalesce(F.nullif("h.title", F.lit("")), "chat_dir").alias("title"),
        F.coalesce("h.participants", F.array().cast("array<string>")).alias("participants"), (F.col("n") > 0).alias("readable"),
    )
    people = config.identities_df(spark).filter(F.col("platform") == "facebook").select(F.col("raw_id").alias("name"))
    matched = (
        rows.select("chat_dir", F.posexplode("participants").alias("i", "name"))
        .join(people.distinct(), "name")
        .groupBy("chat_dir").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("m"))
    )
    out = rows.join(matched, "chat_dir", "left").withColumn(
        "matched", F.coalesce(F.transform("m", lambda x: x["name"]), F.array().cast("array<string>"))
    )
    return out.select(
        "chat_dir", "title", "participants", "matched", "readable",
        (F.col("readable") & (F.size("matched") >= least)).alias("is_match"),
    )
