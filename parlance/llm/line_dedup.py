"""Lines that an earlier document has, by range-partitioned hashes.

Every line's key is hashed to 128 bits. Hashes are range-partitioned and sorted by (hash,
document, place), and each partition is read as a stream: the first document of a hash keeps
its lines, all later ones lose theirs. Ranges go by document and place as well, so a line that
makes up a third of the corpus is spread over many partitions; those hand over at their
borders: each reports the first document it saw of its first and of its last hash, and the
few rows that only an earlier partition can decide are settled by that list, which has two
rows a partition.

The result is one compressed bitmap a document, never text: bit i tells whether line i stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .shared import fresh, staged

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROPPED, OPEN, BORDER = 0, 1, 2
KEY = ["h1", "h2"]
ROW = "h1 bigint, h2 bigint, doc bigint, tag bigint, place int, kind int"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, tag, place): every line whose key has at least ``min_chars`` code points."""
    bare = F.btrim("line", F.lit(SPACE))
    key = F.translate(bare, UPPER, LOWER)
    return (
        docs.select("doc", "tag", F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
        .filter(F.char_length(bare) >= min_chars)
        .select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"), "doc", "tag", "place")
    )


def later_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks one sorted partition: lines of later documents, lines of its first hash that an
    earlier partition may have to take away, and what it saw at its borders."""
    head = last = None  # (h1, h2, smallest document) of the first and of the current hash
    for batch in batches:
        if not len(batch):
            continue
        h1, h2, doc = (batch[c].to_numpy(np.int64) for c in ("h1", "h2", "doc"))
        new = np.ones(len(batch), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        if last is not None and last[:2] == (h1[0], h2[0]):
            first[: np.argmax(new[1:]) + 1 if new[1:].any() else len(new)] = last[2]
        last = (h1[-1], h2[-1], first[-1])
        head = head or (h1[0], h2[0], first[0])
        kind = np.where(doc != first, DROPPED, np.where((h1 == head[0]) & (h2 == head[1]), OPEN, BORDER))
        said = kind != BORDER
        if said.any():
            yield batch[said].assign(kind=kind[said].astype(np.int32))
    if head is not None:
        yield pd.DataFrame([(*head, 0, 0, BORDER), (*last, 0, 0, BORDER)], columns=["h1", "h2", "doc", "tag", "place", "kind"])


@F.pandas_udf(StructType().add("n_dropped", LongType()).add("keep", BinaryType()))
def bitmap(places: pd.Series) -> pd.DataFrame:
    rows = []
    for found in places:
        found = np.unique(found)
        bits = np.ones(int(found[-1]) // 8 * 8 + 8, bool)
        bits[found] = False
        rows.append((len(found), zlib.compress(np.packbits(bits).tobytes())))
    return pd.DataFrame(rows, columns=["n_dropped", "keep"])


@F.pandas_udf(StringType())
def kept_lines(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    """The lines of a text that its bitmap keeps; lines beyond the bitmap stay."""
    out = []
    for text, keep in zip(texts, keeps):
        if keep is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).astype(bool).tolist()
            lines = text.split("\n")
            text = "\n".join([line for line, bit in zip(lines, bits) if bit] + lines[len(bits) :])
        out.append(text)
    return pd.Series(out, dtype=object)


def line_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, tag, n_dropped, keep) for each row of ``docs`` (doc, tag, text) that loses lines.

    ``keep`` is a deflated bit string, first line in the highest bit; it ends at the last line
    that goes, and is filled up with ones.
    """
    lines = staged(hashed_lines(docs, min_chars))
    order = [*KEY, "doc", "tag", "place"]
    walked = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(later_lines, ROW)
    found = staged(walked)
    borders = found.filter(F.col("kind") == BORDER).groupBy(*KEY).agg(F.min("doc").alias("first"))
    settled = found.filter(F.col("kind") == OPEN).join(borders, KEY).filter(F.col("doc") > F.col("first"))
    places = found.filter(F.col("kind") == DROPPED).unionByName(settled.drop("first"))
    return places.groupBy("doc", "tag").agg(F.collect_set("place").alias("places")).withColumn("map", bitmap("places")).select(
        "doc", "tag", "map.n_dropped", "map.keep"
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_lines``, ``n_dropped`` and ``keep`` (null: all lines stay).

    A line's key is the line without white space at its ends, A-Z in lower case; keys shorter
    than ``min_chars`` are never compared. A key's smallest ``doc_id`` keeps all its lines with
    that key, repeated ones too; nulls come last and count as one document. Rows that share an
    id are one document, whatever their texts; equal rows lose the same lines. A null or empty
    text has one empty line; a long text is one row of hashes a line; an empty table gives no
    rows. Columns with one of the new names are replaced.
    """
    kept = docs.drop("n_lines", "n_dropped", "keep")
    name = fresh(kept)
    doc, tag = f"{name}doc", f"{name}tag"
    keyed = kept.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)), tag: F.xxhash64("text")})
    plain = keyed.select(F.col(doc).alias("doc"), F.col(tag).alias("tag"), "text")
    maps = line_bitmaps(plain, min_chars).select(F.col("doc").alias(doc), F.col("tag").alias(tag), "n_dropped", "keep")
    return keyed.withColumn("n_lines", F.size(lines_of(F.col("text"))).cast("bigint")).join(maps, [doc, tag], "left").select(
        *kept.columns, "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep"
    )


def apply_keep(text: str = "text", keep: str = "keep") -> Column:
    """The text without the lines its bitmap drops. Texts that lose nothing don't leave the JVM."""
    cut = kept_lines(F.when(F.col(keep).isNotNull(), F.col(text)), F.col(keep))
    return F.when(F.col(keep).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(cut)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
d AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
