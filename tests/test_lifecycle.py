"""Models saved, promoted, loaded and scored from; the retraining job; hot keys and carried rows."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkwatch.operators import feedback as FB
from sparkwatch.operators import models as ML
from sparkwatch.operators import ranking, retrain
from sparkwatch.plans.pipeline import retrain as retrain_job
from sparkwatch.schema import FEATURE_COLUMNS
from sparkwatch.sources import io


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        x = [rng.choice([-1, 0, 1]) if rng.random() > 0.02 else None for _ in FEATURE_COLUMNS]
        rows.append((f"k{i}", *x, 1 if (x[0] or 0) + (x[1] or 0) > 0 else -1))
    return spark.createDataFrame(rows, "row_key string, " + ", ".join(f"{c} long" for c in FEATURE_COLUMNS) + ", Result long").cache()


@pytest.mark.parametrize("name, options", [("decision_tree", {}), ("logistic_regression", {}), ("adaboost", {"n_estimators": 3}), ("knn", {"k": 3})])
def test_promoted_models_score_as_fitted(spark, table, tmp_path, name, options):
    train = ML.prepare(table, FEATURE_COLUMNS)
    model = ML.fit_candidate(name, train, FEATURE_COLUMNS, **options)
    want = {r["row_key"]: r["prediction"] for r in model.transform(train).collect()}
    ML.promote_model(spark, model, str(tmp_path / "m"), str(tmp_path / "r"), "v7", True, 0.9, 0.1, "2024-01-01 00:00:00")
    version, loaded = ML.load_current(spark, str(tmp_path / "r"))
    assert version == "v7"
    assert {r["row_key"]: r["prediction"] for r in loaded.transform(train.repartition(3)).collect()} == want
    ML.score_and_log(spark, str(tmp_path / "r"), table, FEATURE_COLUMNS, "row_key", str(tmp_path / "log"), "2024-02-01 00:00:00")
    logged = {r["request_id"]: r["prediction"] for r in io.feedback_scan(spark, str(tmp_path / "log")).collect()}
    assert logged == {k: int(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        ML.promote_model(spark, model, str(tmp_path / "m"), str(tmp_path / "r"), "v8", False, 0.1, 0.0)


def test_retraining_job(spark, table, tmp_path):
    log = spark.createDataFrame([(f"r{i}", 1, '{"k": 1}', "v1", 0.9) for i in range(20)],
                                "request_id string, prediction int, features string, model_version string, confidence double") \
        .withColumn("ts", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    labels = log.select("request_id", F.lit("2024-01-21 00:00:00").cast("timestamp").alias("label_ts"), F.lit(1).alias("actual_label"),
                        F.lit(None).cast("string").alias("user_feedback"))
    ML.append_labels(labels, str(tmp_path / "labels"))
    view = FB.feedback_view(log, spark.read.parquet(str(tmp_path / "labels")))
    args = dict(features=FEATURE_COLUMNS, feedback_keys=["k"], key_col="row_key", runs_path=str(tmp_path / "runs"), work_dir=str(tmp_path / "w"),
                trigger_type="manual", candidates=["decision_tree"], stop_on_drift=False, min_f1=0.0, max_gap=1.0)
    first = retrain_job(spark, table, view, as_of="2024-02-01 00:00:00", **args)
    assert first["status"] == "promoted" and first["data_version"]["n_rows"] == 260
    assert retrain_job(spark, table, view, as_of="2024-02-01 10:00:00", **args)["status"] == "too_soon"
    runs = retrain.read_runs(spark, str(tmp_path / "runs")).collect()
    assert [(r["trigger_type"], r["strategy"], r["n_rows"]) for r in runs] == [("manual", "full", 260)]
    assert ML.load_current(spark, str(tmp_path / "w" / "registry"))[0] == first["model_version"]
    entries = spark.read.parquet(str(tmp_path / "w" / "experiments"))
    assert entries.filter("kind = 'param'").count() == 3 and entries.filter("kind = 'metric'").count() == 6
    with pytest.raises(ValueError):
        retrain_job(spark, table, view, as_of="2024-02-05 00:00:00", min_samples=5, **args)


def test_versions_add_up_and_tell_values_apart(spark):
    version = lambda rows, schema="a string, b string": retrain.data_version(spark.createDataFrame(rows, schema)).first()
    assert version([("a|1=vb", "c")]) != version([("a", "b|1=vc")]) and version([("1", None)]) != version([("", "n")])
    assert version([("x", "y"), ("x", "y")]) != version([("x", "y")]) and version([])["n_rows"] == 0
    a, b = [("x", "1"), ("y", None)], [("z", "2"), ("x", "1")]
    parts = spark.createDataFrame([(r, 1) for r in a + b], "r struct<a:string,b:string>, sign int")
    whole = version(a + b)
    both = retrain.data_version(spark.createDataFrame(a, "a string, b string")).unionByName(retrain.data_version(spark.createDataFrame(b, "a string, b string")))
    assert retrain.add_versions(both).first() == whole and parts.count() == 4
    signed = both.withColumn("sign", F.lit(1)).unionByName(retrain.data_version(spark.createDataFrame(b, "a string, b string")).withColumn("sign", F.lit(-1)))
    assert retrain.add_versions(signed, "sign").first() == version(a)


def test_feature_keys_of_any_shape(spark):
    df = spark.createDataFrame([({"k": "1", "x y": "0.5"}, 1), ({"z": "word"}, 0), ({}, 1), (None, 0)], "features map<string,string>, actual_label int")
    assert {(r["key"], r["n_rows"], r["n_numbers"]) for r in FB.feature_keys(df).collect()} == {("k", 1, 1), ("x y", 1, 1), ("z", 1, 0)}
    union = FB.expand_features(df)
    assert union.columns == ["k", "x y", "z", "Result"]
    assert sorted(map(tuple, union.collect()), key=str) == sorted([(1.0, 0.5, None, 1), (None, None, None, 0), (None, None, None, 1), (None, None, None, 0)], key=str)
    assert FB.expand_features(df, ["k"], undeclared="drop").count() == 4
    with pytest.raises(PySparkException, match="aren't declared: x y|aren't declared: z"):
        FB.expand_features(df, ["k"]).collect()
    assert FB.expand_features(df.limit(0)).columns == ["Result"]


def test_routes_are_one_write(spark, tmp_path):
    from pyspark.sql import types as T

    from sparkwatch.operators import validate

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    train = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    test = spark.createDataFrame([("2",), ("3",)], "a string")
    paths = validate.route_valid_invalid(train, test, True, str(tmp_path / "o"), schema)
    got = {(r["split"], r["route"]): r["n"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy("split", "route").agg(F.count("*").alias("n")).collect()}
    assert got == {("train", "valid"): 2, ("train", "invalid"): 1, ("test", "valid"): 2}
    assert spark.read.parquet(paths["train"]).count() == 2


def test_fingerprint_marks_nulls_and_positions(spark):
    f = lambda rows: retrain.data_version(spark.createDataFrame(rows, "a int, b int")).first()
    assert f([(None, 1), (2, 3)]) != f([(1, None), (2, 3)])
    assert f([(None, 1), (2, 3)]) == f([(2, 3), (None, 1)])


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_windows_over_a_hot_key(spark, k):
    rng = random.Random(k)
    rows = [("hot" if i % 10 else rng.choice(["a", None]), i // 3, i, rng.randint(0, 5), rng.random() < 0.8) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, t long, id long, v long, c boolean").repartition(5)
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for blocks in (1, 4, 50):
        got = {r["id"]: r for r in ranking.trailing_sums(df, ["key"], ["t", "id"], ["v"], k, blocks=blocks).collect()}
        runs = {r["id"]: r["run_start"] for r in ranking.runs_of_true(df, ["key"], ["t", "id"], "c", "t", blocks=blocks).collect()}
        total = {r["id"]: r["cum_v"] for r in ranking.running_totals(df, ["key"], ["t", "id"], ["v"], blocks=blocks).collect()}
        for part in by.values():
            start = None
            for n, r in enumerate(part):
                start = (start if start is not None else r[1]) if r[4] else None
                assert (got[r[2]]["rn"], got[r[2]]["fill"]) == (n + 1, min(n + 1, k))
                assert got[r[2]]["win_v"] == sum(x[3] for x in part[max(0, n - k + 1) : n + 1])
                assert total[r[2]] == sum(x[3] for x in part[: n + 1]) and runs[r[2]] == start
