"""Mixing sources to target weights by Pareto order sampling.

Every source gets a number of words to supply: all words, shared by weight, none asked for
more than ``cap`` times what it has. A source that must supply ``r`` times its words takes
``floor(r)`` whole copies of every document; the words that are left, its quota, come from one
sample without replacement. A document's inclusion in it is proportional to its size class
(sizes by powers of two), at a rate that fills the quota; classes for which that would reach 1
are certain, and the rest of the quota is shared below them. Documents are ranked by the odds
of a random number over the odds of their inclusion (Pareto order), and the first ones that
fill the quota are taken. The random number is a digest of the document's id, so a rerun takes
the same documents.

Nothing sorts a whole source: ranks are cut into about sqrt(n) slices per source, slices are
summed before they are shuffled, and only the slice in which the quota ends is ordered. Rates
need one row a source and class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import staged

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from a digest: 48 bits, never 0 or 1."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Weights repeat over the sources in code point order, null last. Sharing by weight and
    resharing what exceeds a cap ends where every source gets min(cap * size, level * weight):
    with sources in the order in which they reach their cap as the level rises, the level is
    found by running sums. The table has one row per source.
    """
    names = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(cap))
    ranked = totals.withColumn("weight", weight)
    order = W.orderBy(most / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(W.currentRow, W.unboundedFollowing)
    )
    # capping a source below its share raises the level, capping one above it lowers it: the level is the largest of them
    shared = F.max("own").over(everything) * F.col("weight")
    return ranked.withColumn("own", level).select("source", "source_size", "n", "weight", F.least(most, shared).alias("target"))


def rates(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to one row per source (``quota`` and more) what fills its quota: ``rate``, the
    inclusion per unit of size class, ``open``, the largest class that is not certain, and
    ``left``, the quota without the certain documents. All three are null where every document is certain.

    Classes are made certain from the largest down, as long as the rate that fills what is
    left of the quota would give them an inclusion of 1 or more.
    """
    classes = sized.filter("size > 0").groupBy("source", "class").agg(F.sum("size").alias("in_class"))
    s, p = classes.alias("s"), plan.alias("p")
    joined = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.*", "p.quota")
    up = W.partitionBy("source").orderBy("class")
    larger = F.coalesce(F.sum("in_class").over(up.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    product = F.col("in_class").cast("decimal(19,0)") * _unit().cast("decimal(19,0)")
    weighed = F.sum(product).over(up.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("double")
    tried = joined.withColumn("left", F.col("quota") - larger).withColumn("rate", F.col("left") / weighed)
    best = tried.filter(F.col("rate") * _unit() < 1).groupBy("source").agg(F.max(F.struct(F.col("class").alias("open"), "rate", "left")).alias("best"))
    b = best.alias("b")
    return p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")), "left").select("p.*", "b.best.*")


def _unit() -> Column:
    return F.pow(F.lit(2.0), F.col("class"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: str = "") -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source; further columns are kept out) with ``size``,
    ``source_size``, ``target``, ``copies`` (certain whole copies), ``inclusion`` (in the sample
    that fills the quota), ``sampled`` and ``taken``. Another ``seed`` takes another sample.

    Null text has size 0, a null source is a source of its own, rows with equal ids are
    ranked by their size, an empty table gives no rows, and documents without words take 0.
    """
    # five narrow columns, written once: the texts are read a single time
    size = words(F.col("text"))
    key = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = staged(docs.select("doc_id", "source", size.alias("size"), uniform(key).alias("u")).withColumn("class", F.length(F.bin("size")) - 1))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(totals, weights, cap).withColumn("copies", F.floor(times)).withColumn("quota", F.col("target") - F.col("copies") * F.col("source_size"))
    # one row a source, read three times: written once, so that its rates are worked out once
    plan = staged(rates(sized, plan))
    s, p = sized.alias("s"), plan.alias("p")
    joined = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        "s.*", "p.source_size", "p.n", "p.target", "p.copies", "p.quota", "p.rate", "p.open", "p.left"
    )
    inclusion = (
        F.when((F.col("size") == 0) | (F.col("quota") <= 0), F.lit(0.0))
        .when(F.col("open").isNull() | (F.col("class") > F.col("open")), F.lit(1.0))
        .otherwise(F.col("rate") * _unit())
    )
    odds = F.when(
        (F.col("inclusion") > 0) & (F.col("inclusion") < 1),
        (F.col("u") / (1 - F.col("u"))) / (F.col("inclusion") / (1 - F.col("inclusion"))),
    )
    ranked = joined.withColumn("inclusion", inclusion).withColumn("odds", odds).withColumn(
        "slice", F.floor(F.col("odds") / (1 + F.col("odds")) * F.ceil(F.sqrt(F.col("n").cast("double"))))
    )
    slices = ranked.filter(F.col("slice").isNotNull()).groupBy("source", "slice").agg(
        F.sum("size").alias("in_slice"), F.first("left").alias("left")
    )
    run = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    filled = (
        slices.withColumn("before", F.coalesce(F.sum("in_slice").over(run), F.lit(0)))
        .withColumn("ends", F.col("before") + F.col("in_slice") >= F.col("left"))
        .withColumn("first_end", F.min(F.when(F.col("ends"), F.col("slice"))).over(W.partitionBy("source")))
    )
    edge = filled.filter(F.col("slice") == F.col("first_end")).select("source", F.col("slice").alias("edge"), "before")
    r, e = ranked.alias("r"), edge.alias("e")
    placed = r.join(e, F.col("r.source").eqNullSafe(F.col("e.source")), "left").select("r.*", "e.edge", "e.before")
    at_edge = F.coalesce(F.col("slice") == F.col("edge"), F.lit(False))
    order = W.partitionBy("source").orderBy("odds", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.filter(at_edge).withColumn(
        "sampled",
        F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2.0 < F.col("left"),
    )
    outside = placed.filter(~at_edge).withColumn(
        "sampled",
        (F.col("inclusion") >= 1) | (F.col("slice").isNotNull() & (F.col("edge").isNull() | F.coalesce(F.col("slice") < F.col("edge"), F.lit(False)))),
    )
    whole = inside.unionByName(outside)
    return whole.select(
        "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("bigint").alias("copies"), "inclusion", "sampled",
        (F.col("size") * (F.col("copies") + F.col("sampled").cast("bigint"))).cast("bigint").alias("taken"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), pairs AS (
  SELECT a.source, a.source_size, a.weight, 3.0::DOUBLE * a.source_size AS most,
    (SELECT max(lv) FROM (SELECT ((SELECT sum(source_size) FROM totals) - coalesce(sum(3.0::DOUBLE * c.source_size) FILTER (WHERE 3.0::DOUBLE * c.source_size / c.weight < 3.0::DOUBLE * b.source_size / b.weight), 0))
      / sum(c.weight) FILTER (WHERE 3.0::DOUBLE * c.source_size / c.weight >= 3.0::DOUBLE * b.source_size / b.weight) AS lv
      FROM totals b, totals c GROUP BY b.source, b.source_size, b.weight)) AS level
  FROM totals a
), plan AS (
  SELECT source, source_size, target, floor(times) AS copies, target - floor(times) * source_size AS quota
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times
    FROM (SELECT source, source_size, least(most, level * weight) AS target FROM pairs))
), classes AS (
  SELECT source, length(bin(size)) - 1 AS class, sum(size) AS in_class FROM sized WHERE size > 0 GROUP BY ALL
), tried AS (
  SELECT k.source, k.class, p.quota - coalesce(sum(k.in_class) OVER (PARTITION BY k.source ORDER BY k.class ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS rest,
    (sum(k.in_class::HUGEINT * (1::HUGEINT << k.class::INT)) OVER (PARTITION BY k.source ORDER BY k.class ROWS UNBOUNDED PRECEDING))::DOUBLE AS weighed
  FROM classes k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
), opened AS (
  SELECT source, max(class) AS open, arg_max(rest, class) AS rest, arg_max(rest / weighed, class) AS rate
  FROM tried WHERE rest / weighed * pow(2.0, class) < 1 GROUP BY source
), included AS (
  SELECT s.doc_id, s.source, s.size, s.u, p.source_size, p.target, p.copies, o.rest,
    CASE WHEN s.size = 0 OR p.quota <= 0 THEN 0.0::DOUBLE WHEN o.open IS NULL OR length(bin(s.size)) - 1 > o.open THEN 1.0::DOUBLE
      ELSE o.rate * pow(2.0, length(bin(s.size)) - 1) END AS inclusion
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN opened o ON s.source IS NOT DISTINCT FROM o.source
), ranked AS (
  SELECT *, coalesce(sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, CASE WHEN inclusion > 0 AND inclusion < 1 THEN (u / (1 - u)) / (inclusion / (1 - inclusion)) END AS odds FROM included)
)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN inclusion >= 1 OR (odds IS NOT NULL AND before + size / 2.0 < rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""
