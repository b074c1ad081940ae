"""Removal of repeated byte strings by prefix-free parsing and the order of suffixes.

Parsing. A rolling hash of every ``gram`` bytes is computed; of each string of ``length``
bytes the gram with the smallest hash is its trigger. Consecutive strings with the same
trigger make a phrase (the bytes they cover), so every string lies whole in exactly one
phrase, at a place that depends on its own bytes only: equal strings have equal triggers,
wherever they stand. Phrases overlap by length - 1 bytes, and a repeated passage is parsed
into the same phrases each time, whatever surrounds it.

Dictionary and parse. The dictionary has each distinct phrase with its first place in the
corpus; the parse is the list of its places. All places of a phrase but the first are
repeated in full, and are settled without looking at the text again.

Suffix order. What is left are distinct phrases with the same trigger. Their suffixes of
``length`` bytes are sorted, and runs of equal ones found: suffixes are dealt out by the
bytes that any strings with this place of the trigger have in common (all but the outer
few), so that only phrases that share them meet, and ordered by the bytes around. In a run
the suffix that comes first in the corpus stays, and the parse order of the dictionary's
phrases decides which that is. Only the order to depth ``length`` is made, since nothing
beyond it matters.

Hashes are 64 bits of polynomials over random byte values; grams and phrases are compared by
two of them, suffixes by one of the common bytes and by the bytes around themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, staged

U = np.uint64
AT_ONCE = 1 << 21  # bytes hashed at a time
STEP = 9  # suffixes dealt out together; the bytes around the common ones fit one 64-bit word each side
LOW = U((1 << 28) - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of an odd base modulo 2^64, and powers of its inverse."""
    values = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64) | U(1)
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


class Hashes:
    """Hash of any substring of ``data`` from running sums."""

    def __init__(self, data: np.ndarray):
        values, up, self.down = _powers(1 << (max(len(data), AT_ONCE) + 1).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        return _mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def parse(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Phrases of texts that lie end to end in ``data``.

    Returns gram hash, phrase hash, text number, first and last string, trigger - places are
    those in ``data``.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    hashes = Hashes(data)
    grams = hashes.all(gram)
    window = length - gram + 1
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    wide = 1
    while wide * 2 <= window:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if window > wide:
        least = np.minimum(least[: len(least) - (window - wide)], least[window - wide :])
    trigger = (least & LOW).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(trigger)]
    at = np.nonzero(np.arange(len(trigger)) + length <= ends[text])[0]
    if not len(at):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    trigger, text = trigger[at], text[at]
    new = np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])))
    head = np.nonzero(new)[0]
    first, last = at[head], at[np.concatenate((head[1:] - 1, [len(at) - 1]))]
    trigger = trigger[head]
    return grams[trigger], hashes.of(first, last + length), text[head], first, last, trigger


def _buffers(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
    """Texts end to end, about AT_ONCE bytes of them; a longer one comes in overlapping parts.

    Yields the bytes, the end of each part, the row of each part, and its place in its text.
    """
    parts, rows, offsets, size = [], [], [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            text = row.text or b""
            for at in range(0, max(1, len(text) - length + 1), AT_ONCE):
                part = text[at : at + AT_ONCE + length - 1]
                if size and size + len(part) > AT_ONCE:
                    yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), rows, offsets
                    parts, rows, offsets, size = [], [], [], 0
                parts.append(part)
                rows.append(row)
                offsets.append(at)
                size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), rows, offsets


def _runs(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> pd.DataFrame:
    """Ranges of strings, put together where they touch inside a document."""
    order = np.lexsort((first, tag, doc))
    doc, tag, first, last = doc[order], tag[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] > last[:-1] + 1)
    head = np.nonzero(new)[0]
    stop = np.maximum.reduceat(last, head) if len(head) else last
    return pd.DataFrame({"doc": doc[head], "tag": tag[head], "first": first[head], "last": stop, "trigger": np.full(len(head), -1)})


def _changes(column: np.ndarray) -> np.ndarray:
    """Where a sorted column has a value that the row before has not."""
    new = np.ones(len(column), bool)
    new[1:] = column[1:] != column[:-1]
    return new


def _repeats(keys: list[np.ndarray], doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by (keys, doc, tag, at) without repeated places, and which begin a new key; of each key alone, the first key too."""
    order = np.lexsort((at, tag, doc, *keys[::-1]))
    cols = [c[order] for c in (*keys, doc, tag, at)]
    differs = [_changes(c) for c in cols]
    keep = np.logical_or.reduce(differs)
    order, differs = order[keep], [d[keep] for d in differs]
    new = np.logical_or.reduce(differs[: len(keys)])
    # dropping a repeated place never drops the first of a key
    return order, new, differs[0]


FOUND = "doc bigint, tag bigint, first bigint, last bigint, trigger bigint"


def repeated_spans(docs: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """(doc, tag, spans): ranges (first, last) of string starts that occur earlier as well.

    ``docs`` has ``doc`` (order of documents), ``tag`` (tells rows with equal ``doc`` apart,
    0 to 65535) and ``text`` (binary). Rows equal in all of them count once.
    """
    common = length - STEP + 1
    if not 0 < gram <= common or length - gram >= 128:
        raise ValueError("choose gram between length - 127 and length - 8")

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data, ends, rows, offsets in _buffers(batches, length):
            g, p, text, first, last, trigger = parse(data, ends, length, gram)
            if not len(g):
                continue
            starts = np.concatenate(([0], ends[:-1])) - np.array(offsets)
            doc, tag = np.array([r.doc for r in rows], np.int64)[text], np.array([r.tag for r in rows], np.int64)[text]
            base = starts[text]
            # of equal phrases in this buffer only the first need travel, the others are repeats already
            order, new, _ = _repeats([g, p], doc, tag, first - base)
            here, rest = order[new], order[~new]
            yield pd.DataFrame({
                "gram": g[here].view(np.int64), "phrase": p[here].view(np.int64), "doc": doc[here],
                "place": ((first - base)[here] << 30) | (tag[here] << 14) | ((last - first)[here] << 7) | (trigger - first)[here],
            })
            if len(rest):
                runs = _runs(doc[rest], tag[rest], (first - base)[rest], (last - base)[rest])
                at = runs["first"].to_numpy()
                yield pd.DataFrame({  # settled: dealt out evenly and passed on
                    "gram": _mix((runs["doc"].to_numpy() + at).view(np.uint64)).view(np.int64),
                    "phrase": runs["last"], "doc": runs["doc"], "place": -1 - ((at << 16) | runs["tag"].to_numpy()),
                })

    def dictionary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(batches)
        if not whole:
            return
        g, p, doc, place = (np.concatenate([b[c].to_numpy(np.int64) for b in whole]) for c in ("gram", "phrase", "doc", "place"))
        del whole
        done = place < 0
        if done.any():
            packed = -1 - place[done]
            yield pd.DataFrame({"doc": doc[done], "tag": packed & 0xFFFF, "first": packed >> 16, "last": p[done], "trigger": -1})
            g, p, doc, place = g[~done], p[~done], doc[~done], place[~done]
        tag, first = (place >> 14) & 0xFFFF, place >> 30
        last, trigger = first + ((place >> 7) & 127), first + (place & 127)
        order, new, new_gram = _repeats([g, p], doc, tag, first)
        rest = order[~new]
        if len(rest):
            yield _runs(doc[rest], tag[rest], first[rest], last[rest])
        if len(order):
            number = np.cumsum(new_gram) - 1
            several = np.bincount(number, weights=new)[number] > 1
            one = order[new & several]
            if len(one):
                yield pd.DataFrame({"doc": doc[one], "tag": tag[one], "first": first[one], "last": last[one], "trigger": trigger[one]})

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for data, ends, rows, offsets in _buffers(batches, length):
            begin = np.concatenate(([0], ends[:-1]))
            doc, tag, first, last, trigger, base = [], [], [], [], [], []
            for row, start, end, offset in zip(rows, begin.tolist(), ends.tolist(), offsets):
                found = np.array([(c["first"], c["last"], c["trigger"]) for c in row.phrases], np.int64).reshape(-1, 3) + (start - offset)
                f, t = np.maximum(found[:, 0], start), np.minimum(found[:, 1], end - length)
                inside = f <= t
                if offset:  # strings of an earlier part
                    inside &= t >= start
                first.append(f[inside])
                last.append(t[inside])
                trigger.append(found[inside, 2])
                for to, value in ((doc, row.doc), (tag, row.tag), (base, start - offset)):
                    to.append(np.full(int(inside.sum()), value, np.int64))
            doc, tag, first, last, trigger, base = map(np.concatenate, (doc, tag, first, last, trigger, base))
            if not len(doc):
                continue
            low, high = trigger - last, trigger - first  # distances from a string's start to the trigger
            n = high // STEP - low // STEP + 1
            of = np.repeat(np.arange(len(doc)), n)
            piece = (low // STEP)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            mark = trigger[of] - piece * STEP  # where the common bytes begin
            padded = np.concatenate((np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)))
            word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
            key = Hashes(data).of(mark, mark + common) ^ _mix(piece.astype(np.uint64) + U(1))
            least = np.maximum(low[of] - piece * STEP, 0)
            most = np.minimum(high[of] - piece * STEP, STEP - 1)
            yield pd.DataFrame({
                "key": key.view(np.int64), "doc": doc[of], "place": ((mark - base[of]) << 24) | (tag[of] << 8) | (least << 4) | most,
                "before": word[mark].view(np.int64), "after": word[mark + common + 8].view(np.int64),
            })

    def order_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(batches)
        if not whole:
            return
        key, doc, place, before, after = (np.concatenate([b[c].to_numpy(np.int64) for b in whole]) for c in ("key", "doc", "place", "before", "after"))
        del whole
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        met = count[number] > 1
        key, doc, place, before, after = key[met], doc[met], place[met], before[met].view(np.uint64), after[met].view(np.uint64)
        mark, tag, least, most = place >> 24, (place >> 8) & 0xFFFF, (place >> 4) & 15, place & 15
        docs_, tags, starts = [], [], []
        for k in range(STEP):
            has = np.nonzero((least <= k) & (k <= most))[0]
            if not len(has):
                continue
            around = (before[has] >> U(64 - 8 * k) if k else U(0)) | (after[has] << U(8 * k) if k < 8 else U(0))
            order, new, _ = _repeats([key[has], around], doc[has], tag[has], mark[has] - k)
            rest = has[order[~new]]
            docs_.append(doc[rest])
            tags.append(tag[rest])
            starts.append(mark[rest] - k)
        if docs_ and sum(map(len, docs_)):
            starts = np.concatenate(starts)
            yield _runs(np.concatenate(docs_), np.concatenate(tags), starts, starts)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = docs.mapInPandas(phrases, "gram bigint, phrase bigint, doc bigint, place bigint")
    found = staged(parsed.repartition(parts, "gram").mapInPandas(dictionary, FOUND))
    open_ = found.filter("trigger >= 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last", "trigger")).alias("phrases"))
    sorted_ = (
        docs.join(open_, ["doc", "tag"])
        .mapInPandas(suffixes, "key bigint, doc bigint, place bigint, before bigint, after bigint")
        .repartition(parts, "key")
        .mapInPandas(order_suffixes, FOUND)
    )
    return found.filter("trigger < 0").unionByName(sorted_).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("first", "last")).alias("spans")
    )


def cover(spans, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, stop) covered by strings that begin in the given ranges."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        stop = min(last + length, size)
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_bytes``, ``removed`` (array of start, stop) and ``kept`` (binary).

    Documents are ordered by ``doc_id`` (nulls last), then by a digest of their text; null
    texts are empty, texts shorter than ``length`` stay whole, rows equal in id and text count
    as one document, an empty table gives no rows. Columns with one of the new names are
    replaced.
    """
    kept = docs.drop("n_bytes", "removed", "kept")
    name = fresh(kept)
    doc, tag, raw = f"{name}doc", f"{name}tag", f"{name}raw"
    keyed = kept.withColumns({
        doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)),
        raw: F.coalesce(F.col("text").cast("binary"), F.lit(b"")),
    }).withColumn(tag, F.xxhash64(raw).bitwiseAND(F.lit(0xFFFF)))
    plain = keyed.select(F.col(doc).alias("doc"), F.col(tag).alias("tag"), F.col(raw).alias("text"))
    spans = repeated_spans(plain, length, gram).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(f"{name}spans"))

    @F.pandas_udf("removed array<struct<start:bigint,stop:bigint>>, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            removed, left = [], []
            for text, ranges in zip(texts, found):
                gone = cover([(r["first"], r["last"]) for r in ranges], length, len(text)) if ranges is not None else []
                at, pieces = 0, []
                for start, stop in gone:
                    pieces.append(text[at:start])
                    at = stop
                pieces.append(text[at:])
                removed.append([{"start": a, "stop": b} for a, b in gone])
                left.append(b"".join(pieces) if gone else text)
            yield pd.DataFrame({"removed": removed, "kept": left})

    return (
        keyed.join(spans, [doc, tag], "left")
        .withColumn(f"{name}cut", cut(F.col(raw), F.col(f"{name}spans")))
        .select(*kept.columns, F.octet_length(raw).cast("bigint").alias("n_bytes"), f"{name}cut.removed", f"{name}cut.kept")
    )
