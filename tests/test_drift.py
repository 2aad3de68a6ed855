import math

import pytest
from pyspark.sql import functions as F

from sparkwatch.operators import drift, profile
from sparkwatch.operators.ranking import exact_percentiles, running_totals


def frame(spark, xs, col="x"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in xs], f"{col} double")


def score(df):
    return {r["feature"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("fn", [drift.psi, drift.ks, drift.js])
def test_self_is_zero(spark, fn):
    x = frame(spark, [1, 2, 2, 3, 5, 8, 13, 21, 34, 55, 89, 1, 2])
    assert abs(score(fn(x, x, ["x"]))["x"]) < 1e-12


def test_ks_disjoint_is_one(spark):
    r = drift.ks(frame(spark, [1, 2, 3]), frame(spark, [7, 8, 9]), ["x"]).first()
    assert r["score"] == pytest.approx(1.0)


def test_js_disjoint_is_ln2(spark):
    s = score(drift.js(frame(spark, [0, 0, 1, 1]), frame(spark, [9, 9, 10, 10]), ["x"]))["x"]
    assert s == pytest.approx(math.log(2), abs=1e-6)


def test_constant_baseline_psi_zero(spark):
    c = frame(spark, [4] * 10)
    assert score(drift.psi(c, c, ["x"]))["x"] == pytest.approx(0.0, abs=1e-12)


def test_psi_edges_interpolated(spark):
    b = frame(spark, [-1, -1, -1, 1, 1, 1, 1])
    cnt = drift.pair_counts(b, b, ["x"])
    edges = drift.psi_edges(cnt).first()["edges"]
    assert edges == pytest.approx([-1.0, -0.2, 1.0])


def test_outside_values_dropped_but_counted(spark):
    # baseline percentiles of {1,5,9} -> edges include 1,5,9 plus interpolated ones; use the bin helper directly
    from sparkwatch.functions.exprs import histogram_bin
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 5.0, 9.0, 10.0]], "v double")
    bins = [r[0] for r in df.select(histogram_bin(F.col("v"), F.array(F.lit(1.0), F.lit(5.0), F.lit(9.0)))).collect()]
    assert bins == [None, 0, 1, 1, None]  # counts 1, 2 - 0 and 10 dropped


def test_ks_js_symmetric(spark):
    a = frame(spark, [1, 2, 3, 4, 4, 5, 9])
    b = frame(spark, [2, 2, 3, 6, 7])
    assert score(drift.ks(a, b, ["x"]))["x"] == pytest.approx(score(drift.ks(b, a, ["x"]))["x"])
    assert score(drift.js(a, b, ["x"]))["x"] == pytest.approx(score(drift.js(b, a, ["x"]))["x"])


def test_psi_non_negative_and_insufficient(spark):
    a = frame(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    b = frame(spark, [5, 6, 7, 8, 30])
    assert score(drift.psi(a, b, ["x"]))["x"] > 0
    empty = frame(spark, [None, None])
    r = drift.psi(a, empty, ["x"]).first()
    assert r["score"] is None and r["status"] == "insufficient_data"


def test_blocks_do_not_change_results(spark):
    import random
    rnd = random.Random(3)
    a = frame(spark, [rnd.randint(0, 200) for _ in range(500)])
    b = frame(spark, [rnd.randint(20, 220) for _ in range(400)])
    r1 = drift.ks(a, b, ["x"], blocks=1).first()["score"]
    r7 = drift.ks(a, b, ["x"], blocks=7).first()["score"]
    assert r1 == pytest.approx(r7)
    p1 = score(drift.psi(a, b, ["x"], blocks=1))["x"]
    p9 = score(drift.psi(a.repartition(5), b.repartition(3), ["x"], blocks=9))["x"]
    assert p1 == pytest.approx(p9)


def test_exact_percentiles_match_numpy(spark):
    import numpy as np
    xs = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    df = spark.createDataFrame([("f", float(v)) for v in xs], "feature string, value double").groupBy("feature", "value").agg(F.count("*").alias("c"))
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for blocks in (1, 4):
        got = {r["p"]: r["q"] for r in exact_percentiles(df, ["feature"], "value", probs, blocks=blocks).collect()}
        for p in probs:
            assert got[p] == pytest.approx(float(np.percentile(xs, p * 100)))


def test_running_totals_blocked_equals_plain(spark):
    df = spark.createDataFrame([("k", i, i % 3) for i in range(200)], "key string, t long, v long")
    a = {r["t"]: r["cum_v"] for r in running_totals(df, ["key"], ["t"], ["v"], blocks=1).collect()}
    b = {r["t"]: r["cum_v"] for r in running_totals(df, ["key"], ["t"], ["v"], blocks=13).collect()}
    assert a == b


def test_profile_matches_pandas(spark):
    import pandas as pd
    xs = [1.0, 2.0, 2.0, 7.0, None, 10.0]
    p = profile.feature_profile(frame(spark, xs), ["x"]).first()
    s = pd.Series(xs).dropna()
    assert p["n"] == 5 and p["mean"] == pytest.approx(s.mean()) and p["std"] == pytest.approx(s.std())
    assert p["q25"] == pytest.approx(s.quantile(0.25)) and p["q75"] == pytest.approx(s.quantile(0.75))


def test_model_drift_new_class_ignored(spark):
    b = spark.createDataFrame([(0,), (1,), (1,), (0,)], "prediction int")
    c = spark.createDataFrame([(0,), (1,), (2,), (2,)], "prediction int")
    r = drift.model_drift(b, c).first()
    assert r["class_distribution_shift"] == pytest.approx(0.5)  # |.25-.5| + |.25-.5|
    r2 = drift.model_drift(b, c, include_new_classes=True).first()
    assert r2["class_distribution_shift"] == pytest.approx(1.0)


def test_unknown_method_is_error(spark):
    x = frame(spark, [1, 2])
    with pytest.raises(ValueError):
        drift.data_drift(x, x, ["x"], method="kl")


def test_nan_dropped_before_statistics(spark):
    clean = frame(spark, [1, 2, 3, 4, 5, 6])
    dirty = spark.createDataFrame([(v,) for v in [1.0, 2.0, float("nan"), 3.0, 4.0, None, 5.0, 6.0]], "x double")
    for fn in (drift.psi, drift.ks, drift.js):
        assert score(fn(clean, dirty, ["x"]))["x"] == pytest.approx(0.0, abs=1e-12)
    r = drift.ks(clean, dirty, ["x"]).first()
    assert (r["n_baseline"], r["n_current"]) == (6, 6)


def test_all_null_feature_is_insufficient_not_drift(spark):
    a = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    out = {r["feature"]: r for r in drift.data_drift(a, a, ["x", "y"], method="ks").collect()}
    assert out["y"]["status"] == "insufficient_data" and out["y"]["drift"] is False and out["y"]["score"] is None
    assert out["x"]["status"] == "ok"


def test_single_class_model_drift(spark):
    b = spark.createDataFrame([(1,)] * 4, "prediction int")
    c = spark.createDataFrame([(0,)] * 4, "prediction int")
    r = drift.model_drift(b, c).first()
    assert r["class_distribution_shift"] == pytest.approx(1.0) and r["model_drift_detected"] is True


def test_exact_pvalues_equal_all_permutations():
    """Every way to deal the ranks to two samples is as likely as any other."""
    from itertools import combinations

    from sparkwatch.functions.exprs import exact_ks_pvalue

    for n1, n2 in ((1, 1), (2, 3), (4, 4), (3, 6)):
        found = []
        for own in combinations(range(n1 + n2), n1):
            a = b = 0
            most = 0
            for i in range(n1 + n2):
                a, b = (a + 1, b) if i in own else (a, b + 1)
                most = max(most, abs(a * n2 - b * n1))
            found.append(most)
        for most in set(found):
            assert exact_ks_pvalue(most / (n1 * n2), n1, n2) == pytest.approx(sum(f >= most for f in found) / len(found))
    assert exact_ks_pvalue(0.0, 5, 7) == 1.0 and exact_ks_pvalue(1.0, 300, 200) < 1e-100 + 1e-12
    # towards the asymptotic series for large samples
    lam = 0.05 * math.sqrt(3000 * 2000 / 5000)
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 50))
    assert exact_ks_pvalue(0.05, 3000, 2000) == pytest.approx(series, rel=0.1)


def test_exact_and_asymptotic_by_size(spark):
    b, c = frame(spark, [1, 2, 3, 4]), frame(spark, [3.5, 4.5, 5, 6, 7])
    exact = drift.ks(b, c, ["x"], exact_cells=20).first()
    other = drift.ks(b, c, ["x"], exact_cells=19).first()
    assert exact["p_value"] != other["p_value"] and exact["score"] == other["score"]
    empty = drift.ks(b, c.limit(0), ["x"], exact_cells=20).first()
    assert empty["p_value"] is None and empty["status"] == "insufficient_data"
