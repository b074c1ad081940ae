"""Exact k-means of integer vectors by Shallot search.

Every vector carries its nearest and second-nearest centroid, an upper bound of the distance
to the first and a lower bound of the distance to all others. Centroids that moved shift the
bounds by how far they went; a vector whose bounds stay apart (or that lies within half the
way from its centroid to the next one) keeps its centroid unseen. For the rest the search
starts from the closer of the two remembered centroids: all centroids are kept sorted by
distance from it, and one that is nearer to the vector than the second-best so far lies in
the ball around it whose radius is the vector's distance to it plus the second-best distance.
The ball shrinks as better ones are found, and the scan ends at its edge. Bounds are floating
point with slack; whatever survives them is compared by exact squared distances of integers,
ties going to the smaller number.

A round is one pass without a shuffle of vectors. It writes vectors with their new bounds, and
one row of sums a task and centroid, which an aggregation brings down to one number a
component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_frame
from .shared import stage

SLACK = 1e-9
LARGEST = 1 << 27  # components below it: squared distances of 64 of them fit 63 bits
STATE = (
    "vec_id bigint, v array<int>, near int, second int, upper double, lower double, distance bigint, "
    "n bigint, sums array<bigint>, inertia bigint"
)


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(``scale`` * x) of every component of the usable vectors.

    Usable: exactly ``dims`` components, none null, NaN, infinite, or so large that squared
    distances would leave 64 bits.
    """
    scaled = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    usable = F.coalesce(
        (F.size("embedding") == dims) & F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST)))), F.lit(False)
    )
    return vectors.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def search(x: np.ndarray, near: np.ndarray, second: np.ndarray, centres: np.ndarray, apart: np.ndarray, order: np.ndarray):
    """Nearest and second-nearest centroid with squared distances, starting from two known ones."""
    a2, b2 = squared(x, centres[near]), squared(x, centres[second])
    swap = (b2 < a2) | ((b2 == a2) & (second < near))
    anchor, other = np.where(swap, second, near), np.where(swap, near, second)
    best, best2, next_, next2 = anchor.copy(), np.where(swap, b2, a2), other.copy(), np.where(swap, a2, b2)
    reach = np.sqrt(best2) * (1 + SLACK)
    active = np.arange(len(x))
    for rank in range(1, len(centres)):
        j = order[anchor[active], rank]
        inside = apart[anchor[active], j] * (1 - SLACK) <= reach[active] + np.sqrt(next2[active]) * (1 + SLACK)
        active, j = active[inside], j[inside]
        if not len(active):
            break
        unseen = j != other[active]
        at, j = active[unseen], j[unseen]
        d2 = squared(x[at], centres[j])
        wins = (d2 < best2[at]) | ((d2 == best2[at]) & (j < best[at]))
        places = ~wins & ((d2 < next2[at]) | ((d2 == next2[at]) & (j < next_[at])))
        up = at[wins]
        next_[up], next2[up], best[up], best2[up] = best[up], best2[up], j[wins], d2[wins]
        next_[at[places]], next2[at[places]] = j[places], d2[places]
    return best, best2, next_, next2


def one_pass(centres: np.ndarray, moved: np.ndarray | None, last: bool) -> Callable:
    """Assigns vectors to ``centres``, which went ``moved`` since the pass before (None: first pass)."""
    k = len(centres)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2).astype(np.float64))
    order = np.argsort(apart, axis=1, kind="stable")
    order = np.array([[j, *[i for i in row if i != j]] for j, row in enumerate(order.tolist())])
    half = np.array([apart[j, order[j, 1]] / 2 if k > 1 else np.inf for j in range(k)])
    push = np.array([max((moved[i] for i in range(k) if i != j), default=0.0) for j in range(k)]) if moved is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, inertia = np.zeros((k, centres.shape[1]), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            n, v = batch.num_rows, batch.column("v")
            x = v.flatten().to_numpy().reshape(n, -1).astype(np.int64)
            if moved is None:
                near, second = np.zeros(n, np.int64), np.full(n, min(1, k - 1))
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                near, second, upper, lower = (batch.column(c).to_numpy() for c in ("near", "second", "upper", "lower"))
                upper, lower = (upper + moved[near]) * (1 + SLACK), (lower - push[near]) * (1 - SLACK)
            near, second = near.astype(np.int64), second.astype(np.int64)
            if k == 1:
                lower = np.full(n, np.inf)
            open_ = np.nonzero(~(upper < np.maximum(lower, half[near] * (1 - SLACK))))[0]
            upper[open_] = np.sqrt(squared(x[open_], centres[near[open_]])) * (1 + SLACK)
            open_ = open_[~(upper[open_] < np.maximum(lower[open_], half[near[open_]] * (1 - SLACK)))]
            if len(open_):
                best, best2, next_, next2 = search(x[open_], near[open_], second[open_], centres, apart, order)
                near[open_], second[open_] = best, next_
                upper[open_], lower[open_] = np.sqrt(best2) * (1 + SLACK), np.sqrt(next2) * (1 - SLACK)
            distance = squared(x, centres[near]) if last else np.zeros(n, np.int64)
            for j in range(k):
                mine = near == j
                sums[j] += x[mine].sum(axis=0)
                count[j] += mine.sum()
                inertia[j] += distance[mine].sum()
            none = pa.nulls(n, pa.int64())
            yield state(batch.column("vec_id"), v, near, second, upper, lower, pa.array(distance), none, pa.nulls(n, pa.list_(pa.int64())), none)
        has = np.nonzero(count)[0]
        if len(has):
            none = pa.nulls(len(has), pa.int64())
            yield state(
                none, pa.nulls(len(has), pa.list_(pa.int32())), has, has, np.zeros(len(has)), np.zeros(len(has)), none,
                pa.array(count[has]), pa.array(list(sums[has]), pa.list_(pa.int64())), pa.array(inertia[has]),
            )

    return run


def state(vec_id, v, near, second, upper, lower, distance, n, sums, inertia) -> pa.RecordBatch:
    cols = [vec_id, v, pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), distance, n, sums, inertia]
    return pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "near", "second", "upper", "lower", "distance", "n", "sums", "inertia"])


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids; ids that repeat count each, null ids never."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.filter("vec_id is not null").orderBy(rank, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def _totals(passed: DataFrame, dims: int) -> tuple[dict, dict]:
    """Exact sums of each centroid: ``dims`` numbers, and (vectors, inertia)."""
    parts = passed.filter("n is not null")
    wide = parts.select("near", F.posexplode("sums").alias("i", "x")).groupBy("near", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    sums: dict[int, list[int]] = {}
    for r in wide.collect():
        sums.setdefault(r["near"], [0] * dims)[r["i"]] = int(r["x"])
    return sums, {r["near"]: (r["n"], int(r["inertia"])) for r in parts.groupBy("near").agg(
        F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia")).collect()}


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) for every usable vector.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Vectors that are
    not usable (see ``integer_vectors``) have no row. Equal vectors, and rows that share an id,
    count each; a null id is clustered but never a start. With fewer than ``k`` vectors with an
    id each is a start; with none there are no rows. The driver holds ``k`` centroids only.
    """
    spark = vectors.sparkSession
    base, done = stage(integer_vectors(vectors, dims, scale))
    centres = start(base, k, seed)
    if not len(centres):
        done()
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    now, moved = base, None
    for turn in range(rounds + 1):
        passed, delete = stage(now.mapInArrow(one_pass(centres, moved, turn == rounds), STATE))
        done()  # the new state has all of the old
        done = delete
        sums, sizes = _totals(passed, dims)
        if turn == rounds:
            break
        fresh_ = np.array([[s // sizes[j][0] for s in sums[j]] if j in sums else centres[j] for j in range(len(centres))], np.int64)
        moved = np.sqrt(((fresh_ - centres) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        centres, now = fresh_, passed.filter("n is null")
    total = sum(i for _, i in sizes.values())
    rows = [(j, sizes[j][1], hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for j, c in enumerate(centres.tolist()) if j in sizes]
    table = local_frame(spark, rows, "cluster int, cluster_inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return passed.filter("n is null").select("vec_id", F.col("near").alias("cluster"), "distance").join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256", "centroid"
    )


def _oracle(k: int = 16, rounds: int = 3) -> str:
    assign = """
a{r} AS (
  SELECT vec_id, v, c, d FROM (
    SELECT x.vec_id, x.v, y.c, y.d, row_number() OVER (PARTITION BY x.vec_id ORDER BY y.d, y.c) AS nth
    FROM kept AS x, LATERAL (
      SELECT c, list_sum(list_transform(list_zip(x.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM m{r} AS m) AS y)
  WHERE nth = 1)"""
    move = """
s{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i),
m{next} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM s{r} GROUP BY c
  UNION ALL SELECT c, v FROM m{r} WHERE c NOT IN (SELECT c FROM s{r}))"""
    steps = [assign.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, next=r + 1), assign.format(r=r + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
m0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h LIMIT {k})),
{",".join(steps)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN m{rounds} AS m USING (c)
"""


ORACLE = _oracle()
