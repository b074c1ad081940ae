"""Finding exports and reading them as rows of (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_files(spark: SparkSession, root: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """All files under a folder, in any depth; nothing when the folder is missing.

    Only the listing is read when the content is not asked for.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], FILE_SCHEMA if content else "path string")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    return files.select("path", "content") if content else files.select("path")


def discover_exports(spark: SparkSession, data_root: str) -> DataFrame:
    """(platform, chat_dir, file, path) of every export file below a folder, without reading any of them."""
    root = data_root.rstrip("/")
    folders = (("discord", "discord", "*.html"), ("facebook", "facebook", "message_*.html"), ("signal", "signal_decrypted", "*.html"))
    found = [read_files(spark, f"{root}/{f}", pattern, content=False).withColumn("platform", F.lit(p)) for p, f, pattern in folders]
    return export_files(found[0].unionByName(found[1]).unionByName(found[2])).orderBy("platform", "path")


def export_files(found: DataFrame) -> DataFrame:
    """Those of the listed files (platform, path) that are exports, as (platform, chat_dir, file, path).

    Discord: every HTML file. Facebook: the message files of each chat folder.
    Signal: the first HTML file of each chat folder, or of a single flat chat.
    """
    parts = F.split("path", "/")
    found = found.withColumn("file", F.element_at(parts, -1)).withColumn("chat_dir", F.element_at(parts, -2))
    depth = F.col("path").rlike
    wanted = (
        (F.col("platform") == "discord")
        | ((F.col("platform") == "facebook") & depth(r"/facebook/[^/]+/message_[^/]*\.html$"))
        | ((F.col("platform") == "signal") & depth(r"/signal_decrypted/[^/]+/[^/]+\.html$"))
    )
    found = found.filter(wanted)
    # several HTML files in one Signal chat folder: the first by name counts
    first = found.filter(F.col("platform") == "signal").groupBy("chat_dir").agg(F.min("path").alias("path"))
    return found.filter(F.col("platform") != "signal").unionByName(
        found.join(first, ["chat_dir", "path"], "left_semi").filter(F.col("platform") == "signal")
    ).select("platform", "chat_dir", "file", "path")
