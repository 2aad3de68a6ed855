"""Sketched profiles and drift against exact ones, merged from parts."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwatch.operators import drift, profile, sketch
from sparkwatch.sources import io


def rows(seed, n, shift=0.0):
    rng = random.Random(seed)
    return [(rng.gauss(shift, 1), float(rng.randint(0, 3)), rng.choice([None, float("nan"), 5.0]), i % 7) for i in range(n)]


SCHEMA = "u double, v double, w double, day int"


def exact_rank(values, q):
    return sum(x < q for x in values) / len(values), sum(x <= q for x in values) / len(values)


def test_profile_of_merged_parts(spark):
    data = rows(1, 3000)
    df = spark.createDataFrame(data, SCHEMA)
    parts = sketch.feature_sketches(df, ["u", "v", "w"], ["day"], accuracy=0.02)
    assert parts.count() == 21
    got = {r["feature"]: r for r in sketch.profile_from_sketches(sketch.merge_sketches(parts), 0.02).collect()}
    want = {r["feature"]: r for r in profile.feature_profile(df, ["u", "v", "w"]).collect()}
    for f in "uvw":
        assert got[f]["n"] == want[f]["n"] and got[f]["mean"] == pytest.approx(want[f]["mean"]) and got[f]["rank_error"] == 0.02
        assert got[f]["std"] == pytest.approx(want[f]["std"], abs=1e-9)
        values = [r["uvw".index(f)] for r in data if r["uvw".index(f)] is not None and r["uvw".index(f)] == r["uvw".index(f)]]
        for name, p in sketch.QUARTILES:
            low, high = exact_rank(values, got[f][name])
            assert low - 0.02 <= p <= high + 0.02
    whole = profile.feature_profile(df, ["u"], accuracy=0.02).first()
    assert whole["n"] == 3000 and abs(whole["q50"]) < 0.2


@pytest.mark.parametrize("shift", [0.0, 0.7])
def test_drift_is_within_the_stated_error(spark, shift):
    b, c = spark.createDataFrame(rows(2, 2500), SCHEMA), spark.createDataFrame(rows(3, 2000, shift), SCHEMA)
    sides = [sketch.merge_sketches(sketch.feature_sketches(x, ["u", "v"], ["day"], 0.01)) for x in (b, c)]
    exact = {r["feature"]: r["score"] for r in drift.ks(b, c, ["u", "v"]).collect()}
    for r in sketch.ks_from_sketches(*sides, 0.01).collect():
        assert abs(r["score"] - exact[r["feature"]]) <= r["error"] < 0.1
    exact = {r["feature"]: r["score"] for r in drift.psi(b, c, ["u"]).collect()}
    for r in sketch.psi_from_sketches(*sides, accuracy=0.01).where("feature = 'u'").collect():
        assert r["n_baseline"] == 2500 and abs(r["score"] - exact["u"]) <= r["error"]
        assert (r["score"] > 0.2) == (shift > 0)


def test_stored_baseline_of_sketches(spark, tmp_path):
    df = spark.createDataFrame(rows(4, 800), SCHEMA).withColumn("prediction", F.lit(1))
    for version, at in (("v1", "2024-01-01 00:00:00"), ("v2", "2024-01-02 00:00:00")):
        io.baseline_store(df, ["u", "v"], str(tmp_path), version, at, accuracy=0.05, part_cols=["day"])
    base = io.latest_baseline(spark, str(tmp_path), tables=io.SKETCH_TABLES)
    assert base["sketches"].count() == 14 and base["sketches"].select("model_version").distinct().collect()[0][0] == "v2"
    week = sketch.merge_sketches(base["sketches"].where("day < 3"))
    assert {r["feature"]: r["n"] for r in week.collect()} == {f: sum(r[3] < 3 for r in rows(4, 800)) for f in "uv"}


def test_edges(spark):
    none = spark.createDataFrame([(None, None, None, 1)], SCHEMA)
    assert sketch.feature_sketches(none, ["u"]).count() == 0
    one = spark.createDataFrame([(2.0, 2.0, 2.0, 1)] * 5, SCHEMA)
    s = sketch.merge_sketches(sketch.feature_sketches(one, ["u"]))
    r = sketch.profile_from_sketches(s).first()
    assert (r["n"], r["mean"], r["std"], r["q50"]) == (5, 2.0, 0.0, 2.0)
    assert sketch.ks_from_sketches(s, s).first()["score"] == 0.0 and sketch.psi_from_sketches(s, s).first()["score"] == 0.0
    with pytest.raises(ValueError):
        sketch.sketch_size(0.0)
    with pytest.raises(ValueError):
        sketch.sketch_size(1e-6)
