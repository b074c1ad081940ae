"""Lexical diversity per person (MTLD) for token streams of any length.

The measure walks a person's words in order and starts over whenever the ratio
of different words to words falls to the threshold, so it is sequential. To keep
one talkative person from becoming one task, the stream is cut by a range
partitioning over (person, ts, id), whose boundaries come from a sample and may
fall anywhere inside a person. Each piece is walked on its own as if it began
fresh. What a piece hands on is only its open stretch: the set of words since the
last restart, and their number. A piece without a restart adds its words to what
it was handed; long runs of such pieces are composed pairwise, spans doubling, so the
last of n has all words before it after log2 n steps. Pieces whose input turns
out to differ from what they assumed are walked again, until nothing changes.
Walks fall into step after a few restarts, so one extra round is the usual case,
as it is for somebody who never restarts at all. After k rounds the first k
pieces are exact, so the loop always ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import pinned, shares

# --- fixed value ------------------------------------------------------------
THRESHOLD = 0.72
# ----------------------------------------------------------------------------

#: so many pieces without a restart may hand on one by one
SHORT = 4
PIECE_SCHEMA = (
    "person_id bigint, backward boolean, piece int, n bigint, closed bigint, open_types bigint, open_words array<string>, "
    "open_count bigint, own_words array<string>"
)
PIECE = ["person_id", "backward", "piece"]


def _walk(batches: Iterator[pd.DataFrame], backward: bool, whole: bool) -> Iterator[pd.DataFrame]:
    """Rows arrive ordered by person and position; state is carried across batches.

    A row with ``entry`` set holds the open stretch a piece starts with. ``own_words`` are
    the words of a piece that was given some and never restarts, without those it was given.
    With ``whole`` the rows are all of a range: only its first and last person can go on in
    another one, so nobody else's open words are handed out.
    """
    columns = [*PIECE, "n", "closed", "open_types", "open_words", "open_count", "own_words"]
    first = True
    current = None
    n = closed = count = 0
    words: set[str] = set()
    own: set[str] | None = None  # kept while a piece goes on with what it was given
    out: list[tuple] = []

    def finish(end: bool = False):
        nonlocal first
        if current is not None:
            edge = not whole or first or end
            first = False
            out.append((
                *(current[0], backward, current[1], n, closed, len(words), sorted(words) if edge else [], count),
                None if own is None else sorted(own),
            ))

    for pdf in batches:
        for person, piece, entry, said in zip(pdf["person_id"], pdf["piece"], pdf["entry"], pdf["tokens"]):
            tokens = said.split()
            if current != (person, piece):
                finish()
                current, n, closed, count, words, own = (person, piece), 0, 0, 0, set(), None
            if entry > 0:
                words, count, own = set(tokens), int(entry), set()
                continue
            n += len(tokens)
            for word in reversed(tokens) if backward else tokens:
                words.add(word)
                count += 1
                if len(words) / count <= THRESHOLD:
                    closed += 1
                    words, count = set(), 0
            if closed:
                own = None
            elif own is not None:
                own.update(tokens)
        if len(out) > 1000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    finish(True)
    yield pd.DataFrame(out, columns=columns)


def _order(backward: bool) -> list:
    return [F.desc("ts"), F.desc("id")] if backward else [F.asc("ts"), F.asc("id")]


def _both_ways(ordered: Callable[[bool], DataFrame], whole: bool = False) -> DataFrame:
    """Walks the rows of each reading direction."""

    def one(backward: bool) -> DataFrame:
        rows = ordered(backward).select("person_id", "piece", "entry", "tokens")
        return rows.mapInPandas(lambda batches: _walk(batches, backward, whole), PIECE_SCHEMA)

    return one(False).unionByName(one(True))


def _handed_on(pieces: DataFrame) -> DataFrame:
    """(person_id, backward, place, words, count): the open stretch after each piece.

    A piece that restarted has it already. One that did not is composed with the
    ``span`` pieces before it, which are composed in the same step, so spans double
    until each reaches a restart or the person's first piece.
    """
    restarts = F.col("closed") > 0
    open_ = pinned(pieces.select(
        "person_id", "backward", "place", F.when(restarts, F.col("open_words")).otherwise(F.coalesce("own_words", "open_words")).alias("words"),
        F.when(restarts, F.col("open_count")).otherwise(F.col("n")).alias("count"), F.lit(1).alias("span"), (restarts | (F.col("place") == 1)).alias("done"),
    ))
    while not open_.filter(~F.col("done")).isEmpty():
        before = open_.select(
            "person_id", "backward", F.col("place").alias("end"), F.col("words").alias("w"), F.col("count").alias("c"), F.col("span").alias("s"), F.col("done").alias("d")
        )
        longer = open_.filter(~F.col("done")).withColumn("end", F.col("place") - F.col("span")).join(before, ["person_id", "backward", "end"]).select(
            "person_id", "backward", "place", F.sort_array(F.array_union("words", "w")).alias("words"), (F.col("count") + F.col("c")).alias("count"),
            (F.col("span") + F.col("s")).alias("span"), F.col("d").alias("done"),
        )
        open_ = pinned(open_.filter("done").unionByName(longer))
    return open_.select("person_id", "backward", "place", "words", "count")


def mtld_of(rows: DataFrame) -> DataFrame:
    """(person_id, mtld) of ``word_pieces``."""
    fresh = F.lit(0).cast("bigint")
    nothing = F.array().cast("array<string>")
    # one row a piece of a person
    order = W.partitionBy("person_id", "backward").orderBy(F.when(F.col("backward"), -F.col("piece")).otherwise(F.col("piece")))
    pieces = pinned(
        _both_ways(lambda back: rows.withColumn("entry", fresh).sortWithinPartitions("person_id", *_order(back)), True)
    )

    def inputs(done: DataFrame) -> DataFrame:
        """What each piece should have started with: the open stretch of the piece before it."""
        # between their first and last piece, a person's pieces hold nobody else
        stuck = done.groupBy("backward", "piece").agg(F.count(F.lit(1)).alias("people"), F.max("closed").alias("closed"))
        if stuck.filter("people = 1 and closed = 0").limit(SHORT + 1).count() <= SHORT:
            due = done.withColumns({"entry": F.lag("open_count").over(order), "words": F.lag("open_words").over(order)})
        else:
            placed = done.withColumn("place", F.row_number().over(order))
            handed = _handed_on(placed).select("person_id", "backward", (F.col("place") + 1).alias("place"), F.col("count").alias("entry"), "words")
            due = placed.join(handed, ["person_id", "backward", "place"], "left")
        return due.select(*PIECE, F.coalesce("entry", fresh).alias("entry"), F.coalesce("words", nothing).alias("tokens"))

    used = pieces.select(*PIECE, fresh.alias("entry"), nothing.alias("tokens"))
    while True:
        due = inputs(pieces)
        changed = pinned(
            due.alias("d").join(used.alias("u"), PIECE)
            .filter((F.col("d.entry") != F.col("u.entry")) | (F.col("d.tokens") != F.col("u.tokens")))
            .select(*PIECE, F.col("d.entry").alias("entry"), F.col("d.tokens").alias("tokens"))
        )
        if changed.isEmpty():
            break

        def again(back: bool) -> DataFrame:
            starts = changed.filter(F.col("backward") == back)
            return (
                rows.join(starts.select("person_id", "piece"), ["person_id", "piece"], "left_semi")
                .select("person_id", "piece", "ts", "id", fresh.alias("entry"), "tokens", F.lit(1).alias("rank"))
                .unionByName(
                    starts.select(
                        "person_id", "piece", F.lit(None).cast("timestamp_ntz").alias("ts"),
                        F.lit(None).cast("string").alias("id"), "entry", F.array_join("tokens", " ").alias("tokens"), F.lit(0).alias("rank"),
                    )
                )
                .repartition("person_id", "piece")
                .sortWithinPartitions("person_id", "piece", "rank", *_order(back))
            )

        kept = pieces.join(changed.select(*PIECE), PIECE, "left_anti")
        used, pieces = due, pinned(kept.unionByName(_both_ways(again)))
    per = pieces.groupBy("person_id", "backward").agg(
        F.sum("n").alias("n"),
        F.sum("closed").alias("closed"),
        F.max_by(
            F.struct(F.col("open_types").alias("types"), F.col("open_count").alias("count")),
            F.when(F.col("backward"), -F.col("piece")).otherwise(F.col("piece")),
        ).alias("open"),
    )
    rest = F.when(
        F.col("open.count") > 0, (1.0 - F.col("open.types") / F.col("open.count")) / F.lit(1.0 - THRESHOLD)
    ).otherwise(0.0)
    factors = F.col("closed") + rest
    score = (
        F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, 1.0)
        .when(factors == 0.0, F.col("n").cast("double")).otherwise(F.col("n") / factors)
    )
    ahead, back = F.when(~F.col("backward"), score), F.when(F.col("backward"), score)
    return per.groupBy("person_id").agg(((F.max(ahead) + F.max(back)) / 2.0).alias("mtld"))


def word_pieces(rows: DataFrame, pieces: int | None = None) -> tuple[DataFrame, int]:
    """(person_id, ts, id, tokens, piece), pinned, and the number of pieces.

    Words of scoped messages without stop words, joined by blanks, range-partitioned by
    (person, time, id); ``piece`` is the partition. By default their number follows the size of the text.
    """
    count = pieces or shares(rows)
    written = rows.filter(F.coalesce("content", F.lit("")) != "").select(
        F.col("person_id").cast("bigint").alias("person_id"), "ts", "id", "content"
    )
    words = F.filter(tx.tokens(F.col("content")), lambda w: ~tx.is_stop_word(w))
    # text is cut up after the shuffle, so that sampling the ranges does not pay for it
    ranged = written.repartitionByRange(count, "person_id", "ts", "id").select(
        "person_id", "ts", "id", F.array_join(words, " ").alias("tokens"), F.spark_partition_id().alias("piece")
    )
    return pinned(ranged.filter(F.col("tokens") != "")), count


def mtld(rows: DataFrame, pieces: int | None = None) -> DataFrame:
    """(person_id, mtld) from scoped messages with content: mean of both reading directions.

    ``pieces`` is the number of range partitions; by default it follows the size of the text.
    """
    return mtld_of(word_pieces(rows, pieces)[0])
