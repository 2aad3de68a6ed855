import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import embedding_dedup as dedup
from sparkwatch.llm import neighbours
from sparkwatch.llm.common import read_table
from sparkwatch.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell int, shard int, rank int"


def awkward(rng, n=400, dim=8):
    """Clusters of near copies, exact copies, other lengths, and everything that takes no part."""
    centers = rng.normal(size=(30, dim))
    rows = [(i, (centers[i % 30] * rng.choice([1.0, 3.0]) + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.3])).astype(np.float32).tolist(), i % 3)
            for i in range(n)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(60)]  # copies
    rows += [(2000, None, 1), (2100, [], 1), (2200, [0.0] * dim, 1), (2300, [float("nan")] * dim, 1), (2400, [float("inf")] + [1.0] * (dim - 1), 1),
             (2500, [None] + [1.0] * (dim - 1), 1), (None, rows[3][1], rows[3][2]), (2600, [1.0, 2.0], 0), (2700, [1.0, 2.0], 0), (2800, [2.0, 4.0], 0),
             (2900, rows[5][1], None), (8, rows[8][1], rows[8][2])]  # the last repeats a row
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(4)


def ok(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def test_tree_is_exact_at_factor_one_and_prunes_beyond():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(900, 6)), np.repeat(rng.normal(size=(1, 6)), 100, axis=0)])
    ids = rng.permutation(1000)
    tree = neighbours.VantageTree(ids, x, leaf=10)
    q = x[::50]
    d, found = tree.search(ids[::50], q, 7)
    full = neighbours.distances(q, x)
    for k, (own, row) in enumerate(zip(ids[::50], full)):
        want = sorted((v, i) for v, i in zip(row, ids) if i != own)[:7]
        assert list(zip(d[k], found[k])) == want
    near, _ = tree.search(ids[::50], q, 7, factor=3.0)
    assert (near >= d - 1e-12).all()


@pytest.mark.parametrize("shard_rows", [50, 10_000])
def test_nearest_equals_brute_force(spark, shard_rows):
    rows = awkward(np.random.default_rng(2))
    got = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, k=5, shard_rows=shard_rows).collect()
    valid = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if ok(v) and i is not None]
    want = []
    for q, x in sorted({(i, tuple(v)) for i, v in valid if i % 100 == 0}):
        found = sorted((float(neighbours.distances(np.array([x]), v[None, :])[0, 0]), i) for i, v in valid if i != q and len(v) == len(x))
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_nearest_on_the_table(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    rows = table.collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    for q in ids[ids % 100 == 0]:
        d = neighbours.distances(x[ids == q], x)[0]
        order = np.lexsort((ids, d))
        assert got[q] == [i for i in ids[order] if i != q][:10]
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(table.limit(1), F.lit(True)).count() == 0


def brute(rows, cosine):
    n = len(rows)
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if ok(v) else None for _, v, _ in rows]
    parent, links = list(range(n)), [0] * n

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if (unit[a] is not None and unit[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and rows[a][0] is not None
                    and rows[b][0] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                if x != y:
                    parent[x] = y
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted(((rows[a][0], links[a], c := None if rows[a][0] is None else least[find(a)], rows[a][0] is None or rows[a][0] == c) for a in range(n)), key=str)


@pytest.mark.parametrize("cell_rows, chunk", [(5, 4096), (1000, 20), (40, 3)])
def test_dedup_equals_brute_force(spark, cell_rows, chunk):
    rows = awkward(np.random.default_rng(3))
    got = dedup.near_duplicates(frame(spark, rows), cell_rows=cell_rows, chunk=chunk).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 0.98)


def test_groups_of_a_dense_cell_are_bounded():
    n, visitors = 1000, 3000  # all in or at cell 5, of chunks and parts of about 100
    ids = np.arange(n + visitors)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(len(ids), np.int64)), pa.array(np.full(len(ids), 2, np.int32)), pa.array(ids), pa.array(np.ones(len(ids), np.int64)),
         pa.array([[1.0, 0.0]] * len(ids)), pa.array(np.where(ids < n, 5, 4)), pa.array([[] if i < n else [5] for i in ids], pa.list_(pa.int64()))],
        names=["label", "size", "rep", "copies", "embedding", "cell", "visits"])
    groups, met = {}, set()
    # cell 4 is large, too: its own pairs
    for r in next(dedup._deal({(0, 2, 5): 10, (0, 2, 4): 30}, {(0, 2, 5): 30})([batch])).to_pylist():
        groups.setdefault((r["cell"], r["chunk"], r["other"]), ([], []))[r["visitor"]].append(r["rep"])
    assert max(len(a) + len(b) for a, b in groups.values()) < 400
    for (_, chunk, other), (home, guests) in groups.items():
        pairs = [(a, b) for a in home for b in guests] + [(a, b) for a in home for b in home if a < b and chunk == other]
        for a, b in pairs:
            assert (p := (min(a, b), max(a, b))) not in met
            met.add(p)
    assert len(met) == (n + visitors) * (n + visitors - 1) // 2


def test_rows_of_many_visits_are_dealt_in_bounded_batches():
    rows, dim, visits = 40, 64, 3000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(rows, np.int64)), pa.array(np.full(rows, dim, np.int32)), pa.array(np.arange(rows)), pa.array(np.ones(rows, np.int64)),
         pa.array([[float(i)] * dim for i in range(rows)]), pa.array(np.zeros(rows, np.int64)), pa.array([list(range(1, visits + 1))] * rows, pa.list_(pa.int64()))],
        names=["label", "size", "rep", "copies", "embedding", "cell", "visits"])
    met = []
    for b in dedup._deal({}, {})([batch]):
        assert b.nbytes < 20_000_000
        assert (b.column("embedding").flatten().to_numpy().reshape(-1, dim) == b.column("rep").to_numpy()[:, None]).all()
        met += zip(b.column("rep").to_pylist(), b.column("cell").to_pylist(), b.column("visitor").to_pylist())
    assert sorted(met) == [(i, c, int(c > 0)) for i in range(rows) for c in range(visits + 1)]


def test_links_of_a_group_are_folded():
    rng = np.random.default_rng(4)
    n, home = 6000, 3500
    x = 1 + rng.random((n, 4)) * 0.01
    x[5000:] *= [1, 1, 1, -1]  # visitors that are linked with x[7] only
    x[7] *= [1, 1, 1, -1]
    ids, copies = rng.permutation(n), rng.integers(1, 4, n)
    for own in (True, False):
        cells = [np.zeros(n, np.int64)] * 3 + [np.zeros(n, np.int64), np.full(n, 0 if own else -1)]
        columns = [*map(pa.array, cells), pa.array((np.arange(n) >= home).astype(np.int32)), pa.array(ids), pa.array(copies), pa.array(x.tolist())]
        batch = pa.RecordBatch.from_arrays(columns, names=["label", "size", "cell", "chunk", "other", "visitor", "rep", "copies", "embedding"])
        tracemalloc.start()
        got = {r["rep"]: (r["n"], r["root"]) for out in dedup._link(0.98)([batch]) for r in out.to_pylist()}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150e6
        minus = x[:, 3] < 0
        resident = np.arange(n) < home
        for i in range(n):
            near = (minus == minus[i]) & (resident if not resident[i] else ~resident | own) & (np.arange(n) != i)
            assert got[ids[i]] == (copies[near].sum(), ids[minus == minus[i]].min())


def test_dedup_on_the_table(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [tuple(r) for r in table.collect()]
    for cosine in (0.98, 0.3):  # the lower one links much
        got = dedup.near_duplicates(table, cosine=cosine).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, cosine)
    assert dedup.near_duplicates(table.limit(0)).count() == 0


def test_target_recall_shortens_the_reach():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    x = dedup._unit(np.vstack([base, base + rng.normal(size=base.shape) * 0.06]))
    exact, short = dedup.Grid(x, 8, 0.98), dedup.Grid(x, 8, 0.98, target_recall=0.9)
    assert short.limit <= exact.limit
    pairs = [(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.98)) if a < b]
    for grid, least in ((exact, 1.0), (short, 0.85)):
        own, visits = grid.cells(x)
        found = sum(own[a] == own[b] or own[b] in visits[a] or own[a] in visits[b] for a, b in pairs)
        assert found >= least * len(pairs)


def test_visit_order_is_by_cost():
    rng = np.random.default_rng(6)
    a, b = rng.random(9), rng.random(7)
    got = list(dedup.visit_order(a, b, 1.1))
    want = sorted((a[i] + b[j], i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.1)
    assert [(c, i, j) for i, j, c in got] == want


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
        assert got[start] == min(seen)
    assert set(got) == set(near)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
