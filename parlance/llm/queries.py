"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, chain_dedup, collocations, decontaminate, embedding_dedup, html_extract, language_id, license_scan, line_dedup, mixing, simhash,
    suffix_dedup, url_filter,
)
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("sentence_ids").cast("bigint").alias("n_sentences"),
        F.array_join("left_over", ",").alias("left_over"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = url_filter.demo_captures(pages, table(spark, sf_dir, "events"))
    judged = url_filter.evaluate(captures, url_filter.demo_entries(pages))
    return judged.select("page_id", "url", F.array_join("lists", ",").alias("lists"), "n_entries", "blocked")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["stop"] - r["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id"))
    dictionaries = language_id.fit(docs.filter(~F.coalesce(held, F.lit(False))))
    return language_id.identify(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), dictionaries).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = html_extract.extract(pages, html_extract.fit(pages))
    return done.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("centroid")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.apply_keep().cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op3_url_filter": op3_url_filter,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_html_extract": op6_html_extract,
    "op7_decontaminate": op7_decontaminate,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_chain_dedup": op9_chain_dedup,
    "op10_mixing": op10_mixing,
    "op11_phrase_collocation": op11_phrase_collocation,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_line_dedup": op13_line_dedup,
}
ORACLE: dict[str, str] = {
    "op3_url_filter": url_filter.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_phrase_collocation": collocations.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
