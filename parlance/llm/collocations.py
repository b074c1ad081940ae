"""Phrase collocations by direct-address tiling.

Words of a language are numbered by falling frequency. Pairs of neighbouring numbers are
cells of a square that is cut into tiles: blocks of numbers are 1, 2, 4 ... wide up to 2^14,
then always 2^14, so that blocks hold about equal shares of a text. A chunk of documents is
counted tile by tile: a tile with few cells by adding up in a dense array that the cell
addresses directly (bincount), a thinly filled one as a sorted list of coordinates and counts
(COO). Chunk counts, not words, are shuffled; a tile whose lists are long together is cut into
ranges of cells first, so that no task sees more than its share, whatever the tile.

Pairs that are frequent enough are ranked by frequency again and take the words' place: a
text becomes a sequence of pair numbers, and two neighbouring pairs, which share a word, are a
phrase of three. The same once more gives phrases of four. Every part of a frequent phrase is
frequent, so a phrase's words, the counts of its first words and those of its last words come
with the two pairs it is made of.

A chunk learns the numbers it needs, and no others, through joins by word or by tile; neither
words nor pairs are ever broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import staged

CHUNK = 1 << 20  # words of one language counted together
SIDE = 14  # log2 of the widest block
DENSE = 1 << 16  # cells counted densely whatever their number of pairs; larger tiles if half full
BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
LEVEL = "lang string, chunk bigint, codes binary, tile bigint, cells binary, counts binary, entries bigint"


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from -1 up, in as many bytes as the largest needs, compressed."""
    up = numbers + 1
    top = int(up.max()) if len(up) else 0
    kind = next(c for c, bits in zip("BHIQ", (8, 16, 32, 64)) if top < 1 << bits)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(up.astype(kind).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(blob[1:])
    return np.frombuffer(data, chr(blob[0])).astype(np.int64) - 1


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=0))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob))


def block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each number, its place in there, and log2 of the block's width."""
    up = ids + 1
    bits = np.minimum(np.frexp(up.astype(np.float64))[1].astype(np.int64) - 1, SIDE)
    wide = bits == SIDE
    return np.where(wide, SIDE - 1 + (up >> SIDE), bits), up & ((np.int64(1) << bits) - 1), bits


def block_start(blocks: np.ndarray) -> np.ndarray:
    return np.where(blocks < SIDE, (np.int64(1) << np.minimum(blocks, SIDE)) - 1, ((blocks - SIDE + 1) << SIDE) - 1)


def tile_bits(tile: int) -> int:
    """log2 of a tile's number of cells."""
    return min(tile >> 31, SIDE) + min(tile & ((1 << 31) - 1), SIDE)


def cells_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a sequence where a pair begins, and the pair's tile and cell."""
    at = np.nonzero((codes[:-1] >= 0) & (codes[1:] >= 0))[0]
    up, left, _ = block(codes[at])
    across, right, bits = block(codes[at + 1])
    return at, (up << 31) | across, (left << bits) | right


def pairs_of(tile: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, across = np.int64(tile >> 31), np.int64(tile & ((1 << 31) - 1))
    bits = int(min(across, SIDE))
    return block_start(up) + (cells >> bits), block_start(across) + (cells & ((1 << bits) - 1))


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a sorted list and where each begins."""
    first = np.nonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))[0]
    return sorted_[first], first


def counted(tile: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a tile and how often each occurs: a dense array where the tile is small or well filled, else COO."""
    size = 1 << tile_bits(tile)
    if size <= max(DENSE, 2 * len(cells)):
        dense = np.bincount(cells, minlength=size)
        found = np.nonzero(dense)[0]
        return found, dense[found]
    found, first = runs(np.sort(cells))
    return found, np.diff(first, append=len(cells))


def tiled(lang, chunk, codes: np.ndarray) -> Iterator[tuple]:
    """One row a tile with the counts of one chunk."""
    _, tiles, cells = cells_of(codes)
    order = np.argsort(tiles, kind="stable")
    tiles, cells = tiles[order], cells[order]
    if len(tiles):
        each, starts = runs(tiles)
        for tile, part in zip(each.tolist(), np.split(cells, starts[1:])):
            found, n = counted(tile, part)
            yield lang, chunk, None, tile, pack_sorted(found), pack(n), len(found)


def rows(found: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])


def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, chunk, words, counts, codes): documents of a language as numbers into the chunk's own list of words."""
    schema = "lang string, chunk bigint, words array<string>, counts array<bigint>, codes binary"
    held: dict[str, list[pa.Array]] = {}  # words as Arrow keeps them: bytes end to end, not an object each
    sizes: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def flush(lang: str) -> pd.DataFrame:
        nonlocal number
        number += 1
        del sizes[lang]
        coded = pa.concat_arrays(held.pop(lang)).dictionary_encode()
        words, codes = coded.dictionary.cast(pa.string()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
        n, dot = np.bincount(codes, minlength=len(words)), words.index(".")  # every text ends with a break
        n[dot], codes[codes == dot] = 0, -1
        return rows([(lang, number, words, n, pack(codes))], schema)

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words = text.encode().lower().translate(BREAKS).replace(b".", b" . ").split()
            if words:
                words.append(b".")
                held.setdefault(lang, []).append(pa.array(words, pa.binary()))
                sizes[lang] = sizes.get(lang, 0) + len(words)
                if sizes[lang] >= CHUNK:
                    yield flush(lang)
        if sum(sizes.values()) >= 2 * CHUNK:  # many languages, each below its share
            for lang in list(held):
                yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def renumbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of chunks become their numbers in the language (-1: too rare), and pairs are counted."""
    for batch in batches:
        for lang, chunk, codes, size, at, ids in zip(*(batch[c] for c in ("lang", "chunk", "codes", "size", "at", "id"))):
            number = np.full(size + 1, -1, np.int64)  # the last place is that of breaks
            number[at] = ids
            new = number[unpack(codes)]
            yield rows([(lang, chunk, pack(new), None, None, None, 0), *tiled(lang, chunk, new)], LEVEL)


def raised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequences of phrases become sequences of phrases one word longer, whose pairs are counted."""
    for batch in batches:
        for lang, chunk, codes, maps in zip(batch["lang"], batch["chunk"], batch["codes"], batch["maps"]):
            codes = unpack(codes)
            at, tiles, cells = cells_of(codes)
            known, place = np.unique([m["tile"] for m in maps], return_inverse=True)
            keys = np.concatenate([(np.int64(p) << (2 * SIDE)) | unpack_sorted(m["cells"]) for p, m in zip(place, maps)])
            ids = np.concatenate([unpack(m["ids"]) for m in maps])
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            tile = np.minimum(np.searchsorted(known, tiles), len(known) - 1)
            mine = (tile << (2 * SIDE)) | cells
            slot = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            new = np.full(len(codes), -1, np.int64)
            new[at] = np.where((known[tile] == tiles) & (keys[slot] == mine), ids[slot], -1)
            yield rows([(lang, chunk, pack(new), None, None, None, 0), *tiled(lang, chunk, new)], LEVEL)


def split(counts: bool):
    """Cuts the lists of a tile into 2^``cut`` ranges of cells, where ``cut`` is above 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["cut"] == 0
            columns = ["lang", "tile", "chunk", "cells"] + ["counts"] * counts
            if whole.any():
                yield batch.loc[whole, columns].assign(part=0)
            for r in batch[~whole].itertuples():
                cells, n = unpack_sorted(r.cells), unpack(r.counts) if counts else None
                parts = cells >> max(tile_bits(r.tile) - r.cut, 0)
                found, starts = runs(parts)
                for p, first, last in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(parts)]):
                    extra = {"counts": [pack(n[first:last])]} if counts else {}
                    yield pd.DataFrame({"lang": [r.lang], "tile": [r.tile], "chunk": [r.chunk], "cells": [pack_sorted(cells[first:last])], **extra, "part": [p]})

    return run


def merged(least: int, buffer: int):
    """Adds up the lists of each (lang, tile, part) of a sorted partition; gives the pairs that occur ``least`` times."""
    schema = "lang string, tile bigint, part bigint, cell bigint, left bigint, right bigint, f bigint"

    def close(cells: list, counts: list) -> tuple[list, list]:
        every, n = np.concatenate(cells), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        found, first = runs(every[order])
        return [found], [np.add.reduceat(n[order], first)]

    def frequent(key, cells, counts) -> pd.DataFrame | None:
        (found,), (n,) = close(cells, counts)
        found, n = found[n >= least], n[n >= least]
        left, right = pairs_of(key[1], found)
        return pd.DataFrame({"lang": key[0], "tile": key[1], "part": key[2], "cell": found, "left": left, "right": right, "f": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cells, counts, held = None, [], [], 0
        for batch in batches:
            for lang, tile, part, c, n in zip(batch["lang"], batch["tile"], batch["part"], batch["cells"], batch["counts"]):
                if (lang, tile, part) != key:
                    if key is not None:
                        yield frequent(key, cells, counts)
                    key, cells, counts, held = (lang, tile, part), [], [], 0
                cells.append(unpack_sorted(c))
                counts.append(unpack(n))
                held += len(cells[-1])
                if held > buffer:
                    cells, counts = close(cells, counts)
                    held = buffer // 2 if len(cells[0]) > buffer // 2 else len(cells[0])
        if key is not None:
            yield frequent(key, cells, counts)

    return run, schema


def packed_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("cell")
    return pd.DataFrame({
        "lang": group["lang"].iloc[:1], "tile": group["tile"].iloc[:1], "part": group["part"].iloc[:1],
        "known": [pack_sorted(group["cell"].to_numpy())], "ids": [pack(group["id"].to_numpy())],
    })


def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The numbered pairs that a chunk has in a tile."""
    for batch in batches:
        found = []
        for lang, chunk, tile, cells, known, ids in zip(*(batch[c] for c in ("lang", "chunk", "tile", "cells", "known", "ids"))):
            cells, _, at = np.intersect1d(unpack_sorted(cells), unpack_sorted(known), assume_unique=True, return_indices=True)
            if len(cells):
                found.append((lang, chunk, tile, pack_sorted(cells), pack(unpack(ids)[at])))
        yield rows(found, "lang string, chunk bigint, tile bigint, cells binary, ids binary")


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``id``: 0, 1 ... inside each language, most frequent first."""
    all_ = numbered(df.withColumn("neg", -F.col("f")), ["lang", "neg", *keys], "nth")
    first = all_.groupBy("lang").agg(F.min("nth").alias("first"))
    return staged(all_.join(first, "lang").withColumn("id", F.col("nth") - F.col("first")).drop("neg", "nth", "first"))


def frequent_pairs(level: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of a level with their counts and tiles, and how finely each tile is cut."""
    lists = level.filter("tile is not null")
    cut = lists.groupBy("lang", "tile").agg(F.sum("entries").alias("n")).select(
        "lang", "tile", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / most))).cast("int").alias("cut")
    )
    cut = staged(cut)
    run, schema = merged(least, most)
    dealt = lists.join(cut, ["lang", "tile"]).mapInPandas(
        split(True), "lang string, tile bigint, chunk bigint, cells binary, counts binary, part bigint"
    )
    keys = ["lang", "tile", "part"]
    found = dealt.drop("chunk").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
    return ranked(found, ["left", "right"]), cut


def next_level(level: DataFrame, pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Sequences of numbered pairs, and the counts of their pairs."""
    keys = ["lang", "tile", "part"]
    known = pairs.groupBy(*keys).applyInPandas(packed_group, "lang string, tile bigint, part bigint, known binary, ids binary")
    lists = level.filter("tile is not null").join(cut, ["lang", "tile"]).mapInPandas(
        split(False), "lang string, tile bigint, chunk bigint, cells binary, part bigint"
    )
    maps = lists.join(known, keys).mapInPandas(wanted, "lang string, chunk bigint, tile bigint, cells binary, ids binary").groupBy("chunk").agg(
        F.collect_list(F.struct("tile", "cells", "ids")).alias("maps")
    )
    return staged(level.filter("tile is null").select("lang", "chunk", "codes").join(maps, "chunk").mapInPandas(raised, LEVEL))


def longer(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases one word longer than ``parts``, with the counts of what they begin and end with."""
    left = parts.select("lang", F.col("id").alias("left"), F.col("phrase").alias("head"), F.array_append("starts", F.col("f")).alias("starts"))
    right = parts.select("lang", F.col("id").alias("right"), "last", F.array_append("ends", F.col("f")).alias("ends"))
    return staged(
        pairs.select("lang", "id", "left", "right", "f").join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .select("lang", "id", "left", "right", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "starts", "ends")
    )


def scored(phrases: DataFrame, above: DataFrame | None) -> DataFrame:
    """Candidates with their weakest cut, without those that a longer one stands for."""
    big = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")
    cuts = F.transform(
        F.arrays_zip(F.sequence(F.lit(1), F.size("starts")).alias("k"), F.col("starts").alias("l"), F.reverse("ends").alias("r")),
        lambda c: F.struct(
            F.floor(F.lit(2_000_000).cast("decimal(7,0)") * big("f") / (big(c["l"]) + big(c["r"]))).cast("bigint").alias("score"), c["k"].alias("k"),
            c["l"].alias("l"), c["r"].alias("r"),
        ),
    )
    if above is not None:
        best = above.select("lang", F.col("left").alias("id"), "f").unionByName(above.select("lang", F.col("right").alias("id"), "f"))
        best = best.groupBy("lang", "id").agg(F.max("f").alias("longer"))
        phrases = phrases.join(best, ["lang", "id"], "left").filter(
            F.coalesce(F.lit(100).cast("decimal(3,0)") * big("longer") < F.lit(80).cast("decimal(3,0)") * big("f"), F.lit(True))
        )
    return phrases.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, most: int = 1 << 22) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    ``docs`` has ``text`` and ``lang``; other columns are ignored. Null texts are empty, a null
    language is ``und``; equal rows count each. Ties go to the more frequent, then the smaller
    phrase. A language without a phrase that occurs ``least`` times has no row, an empty table
    gives none. A long text is a chunk of its own. ``most`` is the number of list entries one
    group of a tile aims at.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    chunks = staged(texts.mapInPandas(encoded, "lang string, chunk bigint, words array<string>, counts array<bigint>, codes binary"))
    words = chunks.select("lang", "chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(
        "lang", "chunk", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("f")
    ).filter("f > 0")
    frequent = words.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    known = ranked(frequent, ["word"])
    total = chunks.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    ids = words.join(known.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(
        F.collect_list(F.struct("at", "id")).alias("ids")
    ).select("chunk", "ids.at", "ids.id")
    level = staged(
        chunks.select("lang", "chunk", "codes", F.size("words").alias("size")).join(ids, "chunk").mapInPandas(renumbered, LEVEL)
    )
    empty = F.array().cast("array<bigint>")
    parts = [known.select("lang", "id", F.lit(None).alias("left"), F.lit(None).alias("right"), "f", F.col("word").alias("phrase"), F.col("word").alias("last"), empty.alias("starts"), empty.alias("ends"))]
    for words_ in (2, 3, 4):
        pairs, cut = frequent_pairs(level, least, most)
        if words_ < 4:
            level = next_level(level, pairs, cut)
        parts.append(longer(parts[-1], pairs))
    found = scored(parts[1], parts[2]).unionByName(scored(parts[2], parts[3])).unionByName(scored(parts[3], None))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS t(m), LATERAL (SELECT unnest(range(1, len(words) - m + 2)) AS i)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM f AS c, (VALUES (1), (2), (3)) AS t(k), f AS x, f AS y
  WHERE c.m > k AND x.lang = c.lang AND x.phrase = array_to_string(c.p[1 : k], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(c.p[k + 1 : c.m], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1),
inner_ AS (
  SELECT b.lang, array_to_string(b.p[i : i + s - 1], ' ') AS phrase, max(b.f) AS longer
  FROM f AS b, (VALUES (2), (3)) AS t(s), (VALUES (1), (2), (3)) AS u(i)
  WHERE s < b.m AND i + s - 1 <= b.m GROUP BY ALL),
left_ AS (
  SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_) JOIN n USING (lang)
WHERE rank <= 2000
"""
