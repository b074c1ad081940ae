"""Language identification by compression.

One zstandard dictionary of raw text per language; a text belongs to the language whose
dictionary compresses it best. Texts are compressed in pieces, so that a long text cannot
become its own dictionary and every part of it counts. A text is rejected when the best
language saves hardly more than the next one, or when it has no letters.

The dictionaries are fitted on a bounded sample: for each language and each of ``slots``
hash slots the labelled document with the smallest hash, cut to ``sample_chars``. Everything
else covers all documents and their whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

UNKNOWN = "und"
PIECE = 4_096


_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case letters, runs of anything else as one space."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, slots: int = 64, sample_chars: int = 1_000, most_languages: int = 200) -> dict[str, bytes]:
    """Dictionaries by language, learnt from ``text`` and non-null ``lang``.

    The sample has at most ``slots`` documents a language of at most ``sample_chars``
    characters, so the driver holds at most slots * sample_chars * most_languages of them.
    Languages beyond ``most_languages`` (by rows, then by name) are an error, not a cut.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).alias("h")
    )
    chosen = labelled.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h"))
    if (languages := chosen.select("lang").distinct().count()) > most_languages:
        raise ValueError(f"{languages} languages are labelled, at most {most_languages} can be learnt")
    sample = labelled.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(
        F.min(F.substring("text", 1, sample_chars)).alias("text")
    )
    texts: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    return {lang: b"\n".join(map(plain, parts)) for lang, parts in sorted(texts.items())}


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        # a lazy search over matches of four bytes and more: the quick levels miss the short ones that tell languages apart
        how = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=2, min_match=4, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self.coders = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """The language, a score from 0 to 1, and the share saved over the second best."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        # bits saved a byte of text, as odds: even for the same size, near 1 for half the size
        return self.names[best], 1.0 / (1.0 + 2.0 ** (-20.0 * margin)), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], reject_below: float = 0.004) -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred``, ``score``, ``margin`` and ``rejected``.

    Only ``text`` is read. Null texts, texts without a letter and everything when nothing
    was learnt are ``und`` with score 0 and rejected; ties go to the first language by name
    and are rejected; equal texts get equal results. Columns of ``docs`` with one of the new
    names are replaced.
    """

    @F.pandas_udf("lang_pred string, score double, margin double")
    def classified(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = Classifier(dictionaries)
        for batch in texts:
            yield pd.DataFrame([classify(t) for t in batch], columns=["lang_pred", "score", "margin"])

    kept = docs.drop("lang_pred", "score", "margin", "rejected")
    name = fresh(kept)
    return (
        kept.withColumn(name, classified("text"))
        .select(*kept.columns, f"{name}.*")
        .withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < reject_below))
    )
