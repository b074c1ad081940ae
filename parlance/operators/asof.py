"""Point-in-time join: the latest change at or before each row's time stamp."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

LEAF = 1024


def latest_at(items: Column, at: Callable[[Column], Column], ts: Column) -> Column:
    """The last of the sorted ``items`` whose ``at`` is not after ``ts``, by binary search; null where there is none."""
    steps = F.sequence(F.floor(F.log2(F.size(items))).cast("int"), F.lit(0), F.lit(-1))

    def step(place: Column, bit: Column) -> Column:
        ahead = place + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((ahead <= F.size(items)) & (at(F.get(items, ahead - 1)) <= ts), ahead).otherwise(place)

    return F.get(items, F.aggregate(steps, F.lit(0), step) - 1)


def change_leaves(changes: DataFrame, keys: list[str], value: str, tie: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Changes of each key in sorted runs: ``keys``, ``first`` (time of the run's first change), ``items`` (start, value).

    Of changes at the same instant the one with the largest ``tie`` wins; without
    ``tie``, the largest value. The changes are range-partitioned by key and time,
    so those of a key are spread over tasks however they lie in time, and each task
    cuts its stretch into runs of at most ``leaf``.
    """
    rank = F.struct(F.col(tie or value).alias("rank"), F.col(value).alias("value"))
    last = changes.na.drop(subset=[*keys, "ts"]).groupBy(*keys, F.col("ts").alias("start")).agg(F.max(rank).alias("r"))
    ranged = last.select(*keys, F.struct("start", F.col("r.value").alias("value")).alias("item")).repartitionByRange(
        *keys, F.col("item.start")
    )
    stretch = ranged.groupBy(F.spark_partition_id().alias("part"), *keys).agg(F.sort_array(F.collect_list("item")).alias("items"))
    runs = F.transform(F.sequence(F.lit(1), F.size("items"), F.lit(leaf)), lambda i: F.slice("items", i, leaf))
    return written(stretch.select(*keys, F.explode(runs).alias("items")).select(*keys, F.col("items")[0]["start"].alias("first"), "items"))


def as_of(
    facts: DataFrame, changes: DataFrame, keys: list[str], value: str, out: str, tie: str | None = None, leaf: int = LEAF
) -> DataFrame:
    """Left as-of join on ``keys``: adds ``out``, null where no change precedes the row.

    Facts are read once and neither sorted nor windowed. A fact meets the one row
    of its key that lists where the runs of changes begin (see ``change_leaves``),
    finds its run by binary search, meets that one run, and finds its change in
    there. Both joins have at most one partner, on equalities, so few changes are
    broadcast by their written size, and a hot key is split by adaptive execution.
    The work is the logarithm of a key's changes a fact, wherever they lie in time.
    """
    leaves = change_leaves(changes, keys, value, tie, leaf)
    starts = leaves.groupBy(*keys).agg(F.sort_array(F.collect_list("first")).alias("firsts"))
    f, d = facts.alias("f"), starts.alias("d")

    def equal(left: str, right: str) -> Column:
        condition = F.lit(True)
        for key in keys:
            condition = condition & (F.col(f"{left}.`{key}`") == F.col(f"{right}.`{key}`"))
        return condition

    run = latest_at(F.col("d.firsts"), lambda x: x, F.col("f.ts"))
    found = f.join(d, equal("f", "d"), "left").select("f.*", run.alias("run_")).alias("f")
    return found.join(leaves.alias("l"), equal("f", "l") & (F.col("f.run_") == F.col("l.first")), "left").select(
        *[F.col(f"f.`{c}`") for c in facts.columns],
        latest_at(F.col("l.items"), lambda x: x["start"], F.col("f.ts"))["value"].alias(out),
    )
