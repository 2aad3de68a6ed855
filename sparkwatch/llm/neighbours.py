"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt by a hash of their id over shards of bounded size; a task builds a shard's
tree in memory. A node keeps one vantage point and, for either half of its vectors, the range
of distances to it; the triangle inequality bounds how near a half can be to a query. A half
is skipped when that bound times ``factor`` exceeds the query's k-th best distance so far: at
factor 1 only halves that cannot hold a better vector are skipped and the search is exact,
larger factors skip more. A node is visited once for all queries that still need it, so the
work is in matrix operations.

Queries travel to every shard, as the search of a stated query set needs; each shard returns
k rows per query at most, and a window keeps the best k overall, cut down before its shuffle.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without an id, take no part; vectors are compared with those of the same length only;
rows with the id of a query are never its neighbours; a query id that occurs repeatedly is
searched once, with its smallest vector; repeated candidates each count; ties go to the
smaller id; with fewer than k candidates all are returned; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, prepare, require_columns
from .vectors import matrix, usable

K = 10
#: Relaxation of the pruning; 1 is exact.
FACTOR = 1.0
SHARD_ROWS, LEAF, QUERY_BLOCK = 8_192, 64, 256
RESULT = "query_id long, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``. The squared differences
    are added component by component, so a pair's distance never depends on its place."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        diff = x[:, None] - y[None, :]
        total += diff * diff
    return np.sqrt(total)


class VantageTree:
    """A tree over the rows of ``x`` with their ``ids``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x, self.leaf = ids, x, leaf
        #: node: (vantage row, inner node, outer node, ranges) or a leaf's row numbers
        self.nodes: list = []
        self._build(np.arange(len(ids)), np.random.default_rng(7))

    def _build(self, rows: np.ndarray, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(rows)
        if len(rows) > self.leaf:
            pick = int(rng.integers(len(rows)))
            vantage, rest = rows[pick], np.delete(rows, pick)
            d = distances(self.x[vantage : vantage + 1], self.x[rest])[0]
            order = np.argsort(d, kind="stable")
            half = len(rest) // 2
            ranges = (d[order[0]], d[order[half - 1]], d[order[half]], d[order[-1]])
            inner = self._build(rest[order[:half]], rng)
            outer = self._build(rest[order[half:]], rng)
            self.nodes[at] = (vantage, inner, outer, ranges)
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest rows of each query, infinite and -1 where there are
        fewer; rows with the query's id are left out."""
        q = len(queries)
        best, found = np.full((q, k), np.inf), np.full((q, k), -1, dtype=np.int64)
        home = np.full(q, -1)

        def offer(who: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
            d = np.where(self.ids[rows][None, :] == query_ids[who][:, None], np.inf, d)
            better = (d <= best[who, -1][:, None]).any(axis=1)
            who, d = who[better], d[better]
            if len(who):
                all_d = np.hstack([best[who], d])
                all_i = np.hstack([found[who], np.broadcast_to(self.ids[rows], d.shape)])
                order = np.lexsort((all_i, all_d))[:, :k]
                best[who] = np.take_along_axis(all_d, order, 1)
                found[who] = np.where(np.isinf(best[who]), -1, np.take_along_axis(all_i, order, 1))

        def descend(node: int, who: np.ndarray) -> None:
            """Each query to the leaf on its side of all vantage points, for a first radius."""
            if not len(who):
                return
            n = self.nodes[node]
            if isinstance(n, tuple):
                vantage, inner, outer, (_, in_hi, out_lo, _) = n
                inside = distances(queries[who], self.x[vantage : vantage + 1])[:, 0] <= (in_hi + out_lo) / 2
                descend(inner, who[inside])
                descend(outer, who[~inside])
            else:
                home[who] = node
                offer(who, n, distances(queries[who], self.x[n]))

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            n = self.nodes[node]
            if not isinstance(n, tuple):
                who = who[home[who] != node]
                if len(who):
                    offer(who, n, distances(queries[who], self.x[n]))
                return
            vantage, inner, outer, (in_lo, in_hi, out_lo, out_hi) = n
            d = distances(queries[who], self.x[vantage : vantage + 1])
            offer(who, np.array([vantage]), d)
            d = d[:, 0]
            for child, lo, hi in ((inner, in_lo, in_hi), (outer, out_lo, out_hi)):
                bound = np.maximum(0.0, np.maximum(d - hi, lo - d))
                # a little slack, so that rounding never prunes a tie
                visit(child, who[bound * factor <= best[who, -1] * (1 + 1e-9) + 1e-12])

        if len(self.ids):
            everyone = np.arange(q)
            descend(0, everyone)
            visit(0, everyone)
        return best, found


def _search(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shards, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "is_query"))
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds.astype(int)) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, len(shards)]):
                if start == end:
                    continue
                if shards[start] != shard:
                    shard, parts, tree = shards[start], [], None
                piece = table.slice(start, end - start)
                ids, x = piece["vec_id"].to_numpy(), matrix(piece["embedding"].combine_chunks())
                if not kinds[start]:
                    parts.append((ids, x))
                    continue
                if tree is None and parts:
                    tree, parts = VantageTree(np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts])), []
                for i in range(0, len(ids) if tree else 0, QUERY_BLOCK):
                    d, found = tree.search(ids[i : i + QUERY_BLOCK], x[i : i + QUERY_BLOCK], k, factor)
                    hit = found >= 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.broadcast_to(ids[i : i + QUERY_BLOCK, None], hit.shape)[hit]), pa.array(found[hit]), pa.array(d[hit])],
                        names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` (vec_id, embedding)
    for those where ``is_query`` holds."""
    prepare(vectors.sparkSession)
    require_columns(vectors, "vec_id", "embedding")
    valid = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                        F.coalesce(is_query, F.lit(False)).alias("is_query"))
    shards = partitions(rows.count(), shard_rows)
    size = F.size("embedding").cast("long") * shards
    candidates = rows.select((size + F.pmod(F.xxhash64("vec_id"), F.lit(shards))).alias("shard"), F.lit(False).alias("is_query"), "vec_id", "embedding")
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: size + s)).alias("shard"),
                             F.lit(True).alias("is_query"), "vec_id", "embedding")
    dealt = candidates.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "is_query")
    found = dealt.mapInArrow(_search(k, factor), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
