"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are brought to unit length. Each of ``tables`` hash tables projects them on
``projections`` random normal directions, shifts, and quantises with step ``width``; vectors
whose quantised values all agree share a bucket. Members of a bucket are compared exactly, in
double precision. At cosine 0.95 (distance 0.316) two vectors agree in one projection of step
2 with probability 0.87 and in one of the tables with 0.98; unrelated ones share a bucket
with 4 in 100,000.

Equal vectors are one vector with a weight. A bucket larger than ``block`` is compared in
pairs of blocks, each a task of its own. A pair that meets in several tables counts in the
first of them only, which each side can tell from the bucket numbers it carries, so links are
counted without ever being listed; connectivity is reported as stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import staged

CHUNK = 1024


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distinct_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vec`` (array of double), ``rep`` (smallest id), ``weight`` (rows) for each usable vector.

    Left out: null and empty arrays, null or non-finite components, and all zeros.
    """
    vec = F.col(embedding).cast("array<double>")
    usable = F.coalesce(
        (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vec, lambda x: x != 0),
        F.lit(False),
    )
    return vectors.filter(usable).groupBy(vec.alias("vec")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))


def bucketed(distinct: DataFrame, tables: int, projections: int, width: float, seed: int = 17) -> DataFrame:
    """Adds ``buckets``: one number a table. Vectors of different length never share one."""

    @F.pandas_udf("array<bigint>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mixer = np.random.default_rng(seed).integers(0, 1 << 63, (tables, projections), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            out: list = [None] * len(batch)
            sizes = batch.map(len).to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    rng = np.random.default_rng((seed, size))
                    planes[size] = rng.standard_normal((size, tables * projections)), rng.uniform(0, width, tables * projections)
                a, b = planes[size]
                at = np.nonzero(sizes == size)[0]
                for part in np.array_split(at, len(at) // CHUNK + 1):
                    if len(part):
                        cells = np.floor((_unit(list(batch.iloc[part])) @ a + b) / width).astype(np.int64).view(np.uint64)
                        numbers = (cells.reshape(len(part), tables, projections) * mixer).sum(axis=2, dtype=np.uint64)
                        numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
                        for i, row in zip(part.tolist(), numbers.view(np.int64)):
                            out[i] = row
            yield pd.Series(out)

    return distinct.withColumn("buckets", hashed("vec"))


def reach(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector the number of one it is linked with, through others; the same for all that are."""
    root, left = np.arange(len(x)), np.arange(len(x))
    while len(left):
        start, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), CHUNK):
                hit |= (x[front[at : at + CHUNK]] @ x[left].T >= threshold).any(axis=0)
            front, left = left[hit], left[~hit]
            root[front] = start
    return root


def linked(distinct: DataFrame, threshold: float, tables: int, projections: int, width: float, block: int) -> DataFrame:
    """(rep, n, root): other vectors newly linked to ``rep`` in one bucket, counted by weight,
    and a vector it is connected with there."""
    hashed = staged(bucketed(distinct, tables, projections, width))
    entries = hashed.select("rep", F.posexplode("buckets").alias("table", "bucket"))
    crowded = entries.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = (
        entries.join(crowded, ["table", "bucket"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("rep", "table", "bucket", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .join(hashed.select("rep", "vec", "weight", "buckets"), "rep")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        rows = pd.concat(whole, ignore_index=True)
        for (table, _, low, high), at in rows.groupby(["table", "bucket", "low", "high"], sort=False).indices.items():
            if len(at) < 2:
                continue
            vec, rep = list(rows["vec"].iloc[at]), rows["rep"].to_numpy(np.int64)[at]
            if len({len(v) for v in vec}) > 1:
                continue  # numbers of different lengths met by chance
            x, weight = _unit(vec), rows["weight"].to_numpy(np.float64)[at]
            earlier = np.stack(list(rows["buckets"].iloc[at]))[:, :table]
            own = rows["own"].to_numpy(np.int64)[at]
            count, has = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            for start in range(0, len(at), CHUNK):
                part = slice(start, start + CHUNK)
                hit = x[part] @ x.T >= threshold
                hit[np.arange(len(hit)), np.arange(start, start + len(hit))] = False
                if low != high:  # pairs inside one block are the business of that block's own task
                    hit &= own[part, None] != own[None, :]
                has[part] = hit.any(axis=1)
                if has[part].any():
                    for column in earlier.T:  # counted where they meet first
                        hit &= column[part, None] != column[None, :]
                    count[part] = np.rint(hit @ weight).astype(np.int64)
            yes = np.nonzero(has)[0]
            if len(yes):
                yield pd.DataFrame({"rep": rep[yes], "n": count[yes], "root": rep[yes][reach(x[yes], threshold)]})

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "table", "bucket", "low", "high").mapInPandas(compare, "rep bigint, n bigint, root bigint")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, tables: int = 24, projections: int = 14, width: float = 2.0, block: int = 2048
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors`` (vec_id, embedding).

    Unusable vectors (see ``distinct_vectors``) have no links and are their own component.
    Equal vectors link with each other; rows that share a vec_id are counted as rows. A null
    vec_id is never a component, and a vector all of whose rows have a null id is compared
    with its equals only. An empty table gives no rows.
    """
    distinct = staged(distinct_vectors(vectors))
    found = staged(linked(distinct, threshold, tables, projections, width, block))
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = (
        distinct.join(counts, "rep", "left")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return rows.join(classes, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
