"""Exact integer k-means with equal-average equal-variance nearest-centroid search.

Vectors become integers; every distance, sum and centroid is exact. The nearest centroid of a
vector is found without comparing it with all: centroids are sorted by component mean, a vector
starts at the one whose mean is nearest to its own and goes outward on both sides, the nearer
mean first. With m the mean and s the deviation of components, and d their number, a squared
distance is at least d * (m - m')^2 + d * (s - s')^2. Once the first term alone exceeds the best
distance, no centroid further out can win and the search ends; where the sum exceeds it, the
centroid is skipped; otherwise the distance is computed in integers. Bounds are floating-point
numbers, lowered by more than their rounding error, so ties go to the smaller number exactly.

Each round is one pass over the vectors: tasks assign their rows and emit one row of sums per
centroid, which Spark adds up; the driver holds the centroids alone.

Defined cases: a vector takes part if it has exactly ``dims`` components, none null or
non-finite; others are left out. A component beyond LIMIT after scaling raises an error, since
squared distances wouldn't fit 64 bits. Rows of equal vec_id, and of null vec_id (which hashes as
the empty string), are vectors of their own; equal hashes are ordered by the vector. With fewer
vectors than centroids there are as many centroids as vectors; an empty table gives an empty
result; an inertia beyond 64 bits is null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, release_memory, require_columns

DIMS, SCALE, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, "3"
#: Largest absolute component: 64 squares of differences stay below 2^63.
LIMIT = 1 << 27
#: Rows that are searched at once.
ROWS = 4_096
#: Bounds are lowered by this share and by one: more than they can be wrong.
SLACK = 1e-9


def usable(embedding: Column, dims: int) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dims) & fine, F.lit(False))


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that take part."""
    require_columns(vectors, "vec_id", "embedding")
    if dims * (2 * LIMIT) ** 2 >= 1 << 63:
        raise ValueError(f"distances of {dims} components don't fit 64 bits")
    scaled = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    too_large = F.exists("embedding", lambda v: F.abs(v.cast("double") * F.lit(float(scale))) > F.lit(float(LIMIT)))
    rows = vectors.where(usable(F.col("embedding"), dims))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.when(too_large, F.raise_error(F.lit(f"a scaled component is beyond {LIMIT}")).cast("array<bigint>"))
                       .otherwise(scaled).alias("x"))


class Search:
    """Nearest centroids by mean and deviation."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, dtype=np.int64)
        sums = self.centroids.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.deviations = _deviations(self.centroids)[self.order]
        self.compared = 0  # distances computed so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties: smaller number."""
        n, d, k = len(x), x.shape[1], len(self.centroids)
        sums, deviations = x.sum(1), _deviations(x)
        number = np.full(n, k, dtype=np.int64)
        best = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        active = np.arange(n)
        far = np.iinfo(np.int64).max
        for _ in range(k):
            lo, hi = low[active], high[active]
            down = np.where(lo >= 0, sums[active] - self.sums[np.maximum(lo, 0)], far)
            up = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[active], far)
            left = down <= up
            at = np.where(left, lo, hi)
            low[active[left]] -= 1
            high[active[~left]] += 1
            gap = np.where(left, down, up).astype(np.float64)
            bound = gap * gap / d
            limit = best[active].astype(np.float64)
            going = bound * (1 - SLACK) - 1 <= limit
            active, at, bound, limit = active[going], at[going], bound[going], limit[going]
            if not len(active):
                break
            apart = deviations[active] - self.deviations[at]
            close = (bound + d * apart * apart) * (1 - SLACK) - 1 <= limit
            rows, which = active[close], self.order[at[close]]
            diff = x[rows] - self.centroids[which]
            distance = np.einsum("ij,ij->i", diff, diff)
            self.compared += len(rows)
            better = (distance < best[rows]) | ((distance == best[rows]) & (which < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], which[better]
        return number, best


def _deviations(x: np.ndarray) -> np.ndarray:
    """The population deviation of each row's components."""
    return x.astype(np.float64).std(axis=1)


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, (k, dims) = Search(centroids), centroids.shape
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _parts(batches, dims):
            number, _ = search.nearest(x)
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            total[own] += np.add.reduceat(x[order], first, axis=0)
        own = np.flatnonzero(count)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for part, x in _parts(batches, centroids.shape[1]):
            number, distance = search.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])
        release_memory()

    return run


def seeds(rows: DataFrame, centroids: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The vectors of the smallest hashes of their ids, in the order of the hashes."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(centroids).collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def step(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floors of the means of what each centroid is nearest to; others stay."""
    parts = rows.mapInArrow(_sums(centroids), "cluster int, n long, sums array<bigint>")
    total = (parts.select("cluster", "n", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at")
             .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    out = centroids.copy()
    for r in total:
        out[r["cluster"], r["at"]] = int(r["v"]) // r["n"]
    return out


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that
    takes part."""
    spark = prepare(vectors.sparkSession)
    rows = materialize(integers(vectors, dims, scale), "centroid-vectors")
    found = seeds(rows, centroids, salt)
    columns = "vec_id long, cluster int, distance long"
    totals = "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string"
    if not len(found):
        assigned, per = rows.sparkSession.createDataFrame([], columns), []
    else:
        for _ in range(rounds):
            found = step(rows, found)
        assigned = materialize(rows.mapInArrow(_assign(found), columns), "centroid-assigned")
        own = {r["cluster"]: r["v"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")).collect()}
        marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found]
        per = [(k, v, sum(own.values()), marks[k]) for k, v in own.items()]
    wide = assigned.join(F.broadcast(spark.createDataFrame(per, totals)), "cluster")
    return wide.select("vec_id", "cluster", "distance", F.expr("try_cast(cluster_inertia as bigint)").alias("cluster_inertia"),
                       F.expr("try_cast(inertia as bigint)").alias("inertia"), "centroid_sha256")
