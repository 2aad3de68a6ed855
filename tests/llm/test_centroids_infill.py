"""Integer clustering against plain Python, and fill-in-the-middle against regular expressions."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkwatch.llm import centroids, infill


def _plain_clusters(rows, k=8, rounds=10, dims=4):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256), by comparing all with all."""
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    name = lambda i: "" if i is None else str(i)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cents = [[sum(c) // len(o) for c in zip(*o)] if o else cents[j] for j, o in enumerate(own)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in last if j == c) for c in range(len(cents))]
    return sorted(((-1 if i is None else i), j, d, inertia[j], sum(inertia),
                   hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last)


def _clusters(spark, rows, dims=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).repartition(5)
    out = centroids.cluster(df, dims=dims)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in out.collect())


def test_clusters_equal_plain_code(spark):
    rng = np.random.default_rng(0)
    # few distinct values: ties between centroids and equal rows
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 4) / 2]) for i in range(200)]
    rows += [(i, [float(np.float32(x)) for x in rng.standard_normal(4)]) for i in range(200, 320)]
    rows += [(5, rows[5][1]), (None, [0.1, 0.2, 0.3, 0.4]), (None, [0.0] * 4), (900, None), (901, [1.0, 2.0]), (902, []),
             (903, [1.0, None, 2.0, 3.0]), (904, [float("nan"), 1.0, 1.0, 1.0]), (905, [float("inf"), 1.0, 1.0, 1.0]), (906, [-0.0001] * 4)]
    assert _clusters(spark, rows) == _plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, n):
    rows = [(i, [float(i), 0.5, -0.5, 2.0]) for i in range(n)]
    assert _clusters(spark, rows) == _plain_clusters(rows)


def test_equal_vectors_leave_centroids_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    got = _clusters(spark, rows)
    assert got == _plain_clusters(rows) and {r[1] for r in got} == {0}


def test_components_beyond_the_limit_raise(spark):
    with pytest.raises(PySparkException, match="beyond"):
        _clusters(spark, [(1, [1e9, 0.0, 0.0, 0.0])])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.sampled_from([2, 50, 1 << 26]))
def test_search_equals_all_pairs(seed, k, spread):
    rng = np.random.default_rng(seed)
    c, x = rng.integers(-spread, spread, (k, 8)), rng.integers(-spread, spread, (50, 8))
    number, best = centroids.Search(c).nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(-1)
    assert np.array_equal(best, every.min(1)) and np.array_equal(number, every.argmin(1))


def test_search_rejects_most_centroids():
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (256, 8)) + rng.integers(-4000, 4000, (256, 1))
    x = c[rng.integers(0, 256, 2000)] + rng.integers(-100, 100, (2000, 8))
    search = centroids.Search(c)
    search.nearest(x)
    assert search.compared < 0.15 * 256 * 2000


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _plain_example(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    one, two = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", text, None, None
    if h4 % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = ["", None, " ", "\n\n", "one", " one", "one ", "a b c d e f g h i j", "tab\tand\x0bvt \x0c\r\nend  ", "日本語 テキスト é ü  𝄞 x", "nul\x00in \x1f\x0e\x08 side",
         "no break space", "<P> marked", "half <S marks <M >P>", "x" * 9000 + " y", " ".join(["word"] * 3000), "a<", "< <P < S> <M"]


def test_examples_equal_plain_code(spark, monkeypatch):
    rows = [(i, TEXTS[i % len(TEXTS)], "mine", 7) for i in range(25 * len(TEXTS))] + [(None, "a null id\n", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Form string, other int").repartition(3)
    monkeypatch.setattr(infill, "STEP_BYTES", 5_000)
    made = infill.infill(df)
    assert made.columns == ["doc_id", "text", "other", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == _plain_example(r.doc_id, r.text), (r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert infill.infill(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x08\x0e\x1fab\x85\xa0é日𝄞!", max_size=40), max_size=12))
def test_units_of_any_text(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    units = infill.Units(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [UNIT.findall(t) for t in texts]
    assert units.counts.tolist() == [len(w) for w in want]
    for k in range(max(map(len, want), default=0) + 1):
        n = np.minimum(k, units.counts)
        cuts = units.cut(n)
        for i, w in enumerate(want):
            head = "".join(w[: n[i]])
            assert cuts[i] - offsets[i] == len(head.encode())
        assert units.length(units.starts, cuts).tolist() == [len("".join(w[: n[i]])) for i, w in enumerate(want)]
