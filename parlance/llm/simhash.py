"""SimHash near-duplicates, joined through Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into three segments of at most 23. Of fingerprints that differ
in at most 4 bits, the two segments with the fewest errors have at most 2 errors together, so
a word half way between them is one bit from either. Keys of a pair of segments are therefore
the codeword indices (24 bits) of the pair as it is and with any one of its bits turned over;
decoding collapses these 47 words into some ten keys. Fingerprints that share a key meet and
are verified by their bits.

Only distinct fingerprints take part, so copies cost nothing. Where many fingerprints share a
key, connectivity is found by visiting: each visited fingerprint is compared with those not
yet reached, so a dense bucket is used up in a few steps, and links are reported as a star.

Near copies of whole documents (``near_groups``) are found with wider fingerprints, whose bits
only propose pairs: a pair is linked if the sets of its five-word shingles, compared whole,
have a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .components import components
from .shared import fresh, staged

SEED = 42
AT_ONCE = 1 << 16
MIXERS = (np.random.default_rng(23).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2)) | np.uint64(1)
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SKETCH = 512  # cells


def fingerprint(text: str | None, shingle: int = 4, planes: int = 1) -> list[int]:
    """``planes`` signed 64-bit numbers, all 0 for texts without words.

    The first votes with the shingles' own hashes, further ones with hashes mixed from them.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return [0] * planes
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    flat, digest = b" ".join(words), xxhash.xxh64_digest
    votes = np.zeros((planes, 64), np.int64)
    for at in range(0, len(last), AT_ONCE):
        part = b"".join([digest(flat[s:e], SEED) for s, e in zip(starts[at : at + AT_ONCE], last[at : at + AT_ONCE])])
        hashes = np.frombuffer(part, np.uint8).reshape(-1, 8)
        for plane in range(planes):
            if plane:
                mixed = hashes.view(">u8").ravel().astype(np.uint64) * MIXERS[plane % len(MIXERS)]
                mixed ^= mixed >> np.uint64(32)
                own = (mixed * MIXERS[(plane + 1) % len(MIXERS)]).astype(">u8").view(np.uint8).reshape(-1, 8)
            else:
                own = hashes
            votes[plane] += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(last), axis=1).view(">i8").ravel().tolist()


def fingerprints(docs: DataFrame, shingle: int = 4, planes: int = 1, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``fps`` (array of ``planes`` numbers) and ``node``, one number for all of them."""

    @F.pandas_udf("array<bigint>")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle, planes) for t in batch], dtype=object)

    node = F.col("fps")[0] if planes == 1 else F.xxhash64("fps")
    return docs.withColumn("fps", prints(text)).withColumn("node", node)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and their keys: (pair of segments, two codeword indices) as one number."""
    bits = fps.view(np.uint64)
    near = [golay.nearby(((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32)) for at, n in SEGMENTS]
    rows, out = [], []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        one = (near[i].astype(np.int64) << 12) | near[j][0]  # turned over in the first, or nowhere
        two = (near[i][0].astype(np.int64) << 12) | near[j][1:]
        both = np.sort(np.concatenate([one, two]), axis=0)
        new = np.ones(both.shape, bool)
        new[1:] = both[1:] != both[:-1]
        at = np.nonzero(new.T)
        rows.append(at[0])
        out.append(both.T[at] | (tag << 24))
    return np.concatenate(rows), np.concatenate(out)


def reach(fps: np.ndarray, distance: int, direct: bool = False) -> np.ndarray:
    """For each row of fingerprints the number of the first one it is linked with, through
    others; with ``direct`` of the one it was reached from, which is within the distance."""
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        queue = [start]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1) <= distance
            found, left = left[hit], left[~hit]
            root[found] = at if direct else start
            queue.extend(found.tolist())
    return root


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Which of ``SKETCH`` cells the hashes fall into, one bit a cell, as signed 64-bit numbers."""
    cells = np.zeros(SKETCH, bool)
    cells[(hashes.view(np.uint64) * MIXERS[2]) >> np.uint64(64 - SKETCH.bit_length() + 1)] = True
    return np.packbits(cells).view(np.int64)


def at_most(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No less than what sets of these sizes and sketches have in common: each cell that only
    one of them has holds something that the other has not."""
    a, b = a.view(np.uint64), b.view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
    only_a, only_b = np.bitwise_count(a & ~b).sum(axis=1), np.bitwise_count(b & ~a).sum(axis=1)
    return np.minimum(n_a - only_a.astype(np.int64), n_b - only_b.astype(np.int64))


def fingerprint_links(fps: DataFrame, distance: int = 4, planes: int = 1, direct: bool = False, apart: float | None = None) -> DataFrame:
    """Links (a, b) of nodes that share a key and differ in at most ``distance`` bits of all planes.

    ``fps``: distinct ``node`` and ``fps``. With one plane and up to 4 bits no link is missed;
    with several, a pair is found if any plane's keys meet. The links are a star in each
    bucket, so there are never more of them than bucket members. With ``direct`` they are
    trees whose two ends are themselves within the distance, and every bucket starts its tree
    at another member, so that a node of several buckets meets several others.

    With ``apart``, ``fps`` also has ``component``, ``n`` and, if known, ``sketch``, and of the links
    of each bucket only those are given whose ends are of different components and whose sets of
    ``n`` can have a Jaccard similarity of ``apart`` (see ``at_most``): a bucket of one component gives none.
    """
    if planes == 1 and distance > 4:
        raise ValueError("three segments find at most 4 different bits")
    names = [f"f{i}" for i in range(planes)]
    sketched = [f"s{i}" for i in range(SKETCH // 64)] if apart is not None and "sketch" in fps.columns else []
    known = [] if apart is None else ["component", "n", *sketched]
    carried = [*([] if planes == 1 else ["node"]), *names, *known]  # one plane is its own node

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = {c: batch[c].to_numpy(np.int64)[at : at + AT_ONCE] for c in carried}
                for plane, name in enumerate(names):
                    rows, key = keys(part[name])
                    yield pd.DataFrame({"key": key | (plane << 32), **{c: v[rows] for c, v in part.items()}})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(batches)
        if not whole:
            return
        key = np.concatenate([b["key"].to_numpy(np.int64) for b in whole])
        node = np.concatenate([b[carried[0]].to_numpy(np.int64) for b in whole])
        mixed = (node.view(np.uint64) ^ key.view(np.uint64) * MIXERS[0]) * MIXERS[1] if direct else node
        order = np.lexsort((mixed ^ (mixed >> np.uint64(29)) if direct else node, key))
        key, node = key[order], node[order]
        fp = np.stack([np.concatenate([b[c].to_numpy(np.int64) for b in whole])[order] for c in names], axis=1).view(np.uint64)
        part, n_grams, *bits = ([np.concatenate([b[c].to_numpy(np.int64) for b in whole])[order] for c in known]) if known else (None, None)
        cut = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]))
        size = np.diff(cut)
        twos = cut[:-1][size == 2]
        hit = np.bitwise_count(fp[twos] ^ fp[twos + 1]).sum(axis=1) <= distance
        a, b = [twos[hit] + 1], [twos[hit]]
        many = size > 2
        if known:
            many &= np.minimum.reduceat(part, cut[:-1]) != np.maximum.reduceat(part, cut[:-1])
        for start, n in zip(cut[:-1][many].tolist(), size[many].tolist()):
            root = reach(fp[start : start + n], distance, direct)
            linked = np.nonzero(root != np.arange(n))[0]
            a.append(start + linked)
            b.append(start + root[linked])
        a, b = np.concatenate(a), np.concatenate(b)
        if known:
            able, share = part[a] != part[b], Fraction(str(apart))
            a, b = a[able], b[able]
            one, two = n_grams[a], n_grams[b]
            both = at_most(one, two, *(np.stack([c[i] for c in bits], axis=1) for i in (a, b))) if bits else np.minimum(one, two)
            able = both * share.denominator >= (one + two - both) * share.numerator
            a, b = a[able], b[able]
        found = pd.DataFrame({"a": node[a], "b": node[b]}).drop_duplicates()
        if len(found):
            yield found

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = fps.select("node", *known[:2], *[F.col("sketch")[i].alias(c) for i, c in enumerate(sketched)], *[F.col("fps")[i].alias(c) for i, c in enumerate(names)]).select(*carried)
    keyed = wide.mapInPandas(emit, ", ".join(f"{c} bigint" for c in ("key", *carried)))
    return keyed.repartition(parts, "key").mapInPandas(verify, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, planes: int = 1) -> DataFrame:
    """``doc_id``, ``fp`` (the first plane), ``node``, ``component_id`` and ``digest`` (of the text) for every row of ``docs``.

    Texts without words share fingerprint 0 and are linked like any other. Rows with equal
    ids are kept apart by nothing: each gets its own fingerprint's component. A null id
    takes part, and a component of null ids only has a null id. An empty table gives no rows.
    """
    printed = staged(fingerprints(docs.select("doc_id", "text"), shingle, planes).select("doc_id", F.xxhash64("text").alias("digest"), "node", "fps"))
    distinct = staged(printed.groupBy("node", "fps").agg(F.min("doc_id").alias("first_id")))
    found = components(fingerprint_links(distinct, distance, planes))
    named = distinct.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_node = named.join(label, "component").select("node", "component_id")
    return printed.join(by_node, "node").select("doc_id", F.col("fps")[0].alias("fp"), "node", "component_id", "digest")


#: For whole documents: three fingerprints of word pairs. Texts that share four fifths of their
#: five-word shingles differ in 5 to 18 % of these 192 bits, unrelated ones in about half of them.
NEAR = {"shingle": 2, "distance": 40, "planes": 3}


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    cut = text.encode("utf-8", "replace").lower().split() if text else []
    if not cut:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = (digest(b" ".join(cut[i : i + words]), SEED) for i in range(max(1, len(cut) - words + 1)))
    return np.unique(np.fromiter(hashes, np.uint64)).view(np.int64)


def similar(pairs: DataFrame, sets: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (``node``, ``grams``) have a Jaccard similarity of ``at_least``; two empty sets are alike."""
    share = Fraction(str(at_least))
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    counted = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).alias("all"))
    return counted.filter(F.col("both") * share.denominator >= (F.col("all") - F.col("both")) * share.numerator).select("a", "b")


def near_groups(docs: DataFrame, at_least: float = 0.8, words: int = 5, shingle: int = NEAR["shingle"], distance: int = NEAR["distance"], planes: int = NEAR["planes"]) -> DataFrame:
    """``doc_id``, ``node`` (hash of the text) and ``component_id`` for every row of ``docs``.

    Different texts are linked if their sets of ``words``-word shingles have a Jaccard
    similarity of at least ``at_least``; fingerprints only say which pairs are compared. First
    every text is held against its smallest neighbour. Then the buckets are gone through once
    more by the texts that have a neighbour, and give only the pairs that could still connect
    two components and whose sketches leave room for so much in common, so a large group costs
    one comparison a member and no join of all its pairs, alike or not. Null ids, repeated ids,
    texts without words and empty tables are treated as in ``simhash_groups``.
    """

    @F.pandas_udf("array<bigint>")
    def grams(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(t, words) for t in batch], dtype=object)

    @F.pandas_udf("array<bigint>")
    def sketches(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sets:
            yield pd.Series([sketch(np.asarray(g, np.int64)) for g in batch], dtype=object)

    texts = docs.select("doc_id", "text").withColumn("node", F.xxhash64("text"))
    printed = staged(fingerprints(texts, shingle, planes).select("doc_id", F.xxhash64("text").alias("node"), "fps"))
    distinct = staged(printed.groupBy("node").agg(F.first("fps").alias("fps"), F.min("doc_id").alias("first_id")))
    near = staged(fingerprint_links(distinct, distance, planes, direct=True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    asked = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    one_row = asked.join(distinct, "node").select("node", "first_id")  # one row of each text that is asked for
    rows = texts.alias("t").join(one_row.alias("o"), (F.col("t.node") == F.col("o.node")) & F.col("t.doc_id").eqNullSafe(F.col("o.first_id")))
    sets = staged(rows.select("t.node", grams("t.text").alias("grams")).dropDuplicates(["node"]))
    first = near.groupBy("a").agg(F.min("b").alias("b"))
    sure = staged(similar(first, sets, at_least))
    size = sets.select("node", F.size("grams").cast("bigint").alias("n"), sketches("grams").alias("sketch"))
    marked = staged(
        distinct.join(size, "node").join(components(sure), "node", "left")
        .select("node", "fps", "n", "sketch", F.coalesce("component", "node").alias("component"))
    )
    crossing = fingerprint_links(marked, distance, planes, direct=True, apart=at_least)
    crossing = crossing.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = components(sure.unionByName(similar(crossing, sets, at_least)))
    named = distinct.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return printed.select("doc_id", "node").join(named.join(label, "component").select("node", "component_id"), "node")


def drop_near_duplicates(docs: DataFrame, at_least: float = 0.8, words: int = 5) -> DataFrame:
    """One document of each group of ``near_groups``, the one with the smallest id, with all columns of ``docs``.

    Texts without words form one group. Rows that share the smallest id of a group all stay,
    and so do rows whose id is null. Of rows with one id and different texts, only the copies go.
    """
    name = fresh(docs)
    groups = near_groups(docs, at_least, words)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name), F.col("node").alias(f"{name}digest")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone[name]) & (F.xxhash64(docs["text"]) == gone[f"{name}digest"]), "left_anti")
