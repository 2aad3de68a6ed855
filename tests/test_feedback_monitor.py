import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkwatch.operators import feedback as FB
from sparkwatch.operators import metrics as M
from sparkwatch.operators import monitor as MO
from sparkwatch.operators import retrain as R

PRED = "request_id string, ts timestamp, prediction int, features string, model_version string, confidence double"
LAB = "request_id string, label_ts timestamp, actual_label int, user_feedback string"
T0 = dt.datetime(2024, 1, 1)


def h(n):
    return T0 + dt.timedelta(hours=n)


def test_restore_clears_label(spark):
    pred = spark.createDataFrame([("a", h(0), 1, '{"x": 1}', "v1", None), ("a", h(2), 0, '{"x": 2}', "v1", None)], PRED)
    lab = spark.createDataFrame([("a", h(1), 1, "correct")], LAB)
    r = FB.feedback_view(pred, lab).first()
    assert r["prediction"] == 0 and r["actual_label"] is None and r["user_feedback"] is None


def test_last_label_wins_and_missing_feedback_null(spark):
    pred = spark.createDataFrame([("a", h(0), 1, "{}", "v1", None)], PRED)
    lab = spark.createDataFrame([("a", h(1), 1, "correct"), ("a", h(2), 0, None)], LAB)
    r = FB.feedback_view(pred, lab).first()
    assert r["actual_label"] == 0 and r["user_feedback"] is None


def test_unknown_id_is_noop_and_reported(spark):
    pred = spark.createDataFrame([("a", h(0), 1, "{}", "v1", None)], PRED)
    lab = spark.createDataFrame([("zz", h(1), 1, None)], LAB)
    assert FB.feedback_view(pred, lab).count() == 1
    assert [r.request_id for r in FB.unmatched_feedback(pred, lab).collect()] == ["zz"]


def test_zero_accuracy_triggers(spark):
    pred = spark.createDataFrame([(str(i), h(i), 1, "{}", "v1", None) for i in range(5)], PRED)
    lab = spark.createDataFrame([(str(i), h(i + 1), 0, None) for i in range(5)], LAB)
    st = FB.feedback_stats(FB.feedback_view(pred, lab))
    assert st.first()["accuracy"] == 0.0
    t = FB.should_trigger_retraining(st).first()
    assert t["should_retrain"] and t["reason"] == "Accuracy dropped to 0.00% (threshold: 75.00%)"


def test_rolling_window_101_pairs(spark):
    rows = [(f"r{i:04d}", h(i), 1, 0 if i == 0 else 1, "v1") for i in range(101)]
    pairs = spark.createDataFrame(rows, "request_id string, timestamp timestamp, prediction int, actual_label int, "
                                        "model_version string")
    roll = MO.rolling_accuracy(pairs)
    by_rn = {r["rn"]: r for r in roll.collect()}
    assert by_rn[1]["rolling_accuracy"] == 0.0 and by_rn[1]["window_fill"] == 1
    assert by_rn[100]["rolling_accuracy"] == pytest.approx(0.99) and by_rn[100]["window_fill"] == 100
    assert by_rn[101]["rolling_accuracy"] == 1.0 and by_rn[101]["window_fill"] == 100
    cd = MO.concept_drift(roll).first()
    assert cd["concept_drift_detected"] and cd["rolling_accuracy"] == 1.0


def test_histogram_quantile(spark):
    bounds = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([([2, 2, 0, 0],), ([0, 0, 0, 5],), ([0, 0, 0, 0],)], "c array<long>")
    got = [r[0] for r in df.select(MO.histogram_quantile(0.5, F.col("c"), bounds)).collect()]
    # rank 2 of 4 falls at the top of the first bucket [0, 1] -> 1.0; all in +Inf -> highest bound; empty -> NULL
    assert got == [pytest.approx(1.0), 4.0, None]


def test_frequency_guard_boundary(spark):
    runs = spark.createDataFrame([(h(0),)], "run_ts timestamp")
    assert R.frequency_guard(runs, "2024-01-02 00:00:00").first()["allowed"] is True
    assert R.frequency_guard(runs, "2024-01-01 23:59:00").first()["allowed"] is False
    empty = spark.createDataFrame([], "run_ts timestamp")
    assert R.frequency_guard(empty, "2024-01-02 00:00:00").first()["allowed"] is True


def test_champion_challenger_strict_gain(spark):
    # challenger F1 = 0.8, champion F1 = 0.78 would need exact float; use identical models: gain 0 -> rejected
    sc = spark.createDataFrame([(1, 1, 1), (0, 0, 0), (1, 0, 0)], "label int, champion int, challenger int")
    r = M.champion_challenger(sc).first()
    assert r["is_model_accepted"] is False and r["improved_accuracy"] == 0.0
    first = M.champion_challenger(sc, champion_col=None).first()
    assert first["is_model_accepted"] is True and first["improved_accuracy"] == first["challenger_f1"]


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    m = M.classification_metrics(df).first()
    assert (m["f1_score"], m["precision_score"], m["recall_score"]) == (0.0, 0.0, 0.0)


def test_alert_reason(spark):
    df = spark.createDataFrame([('{"status":"firing","alerts":[{"labels":{"alertname":"HighDataDrift"},'
                                 '"annotations":{"description":"psi 0.7"}}]}',),
                                ('{"status":"firing","alerts":[{"labels":{}}]}',),
                                ('{"status":"firing","alerts":[]}',), (None,)], "payload string")
    got = [r[0] for r in df.select(R.alert_reason("payload")).collect()]
    assert got == ["HighDataDrift: psi 0.7", "Unknown: ", "Webhook trigger", "Webhook trigger"]


def test_results_unchanged_by_repartition(spark):
    import random
    rnd = random.Random(5)
    rows = [(f"r{i:04d}", h(i // 3), rnd.randint(0, 1), "{}", f"v{i % 2}", None) for i in range(300)]
    pred = spark.createDataFrame(rows, PRED)
    lab = spark.createDataFrame([(f"r{i:04d}", h(i // 3 + 1), rnd.randint(0, 1), None) for i in range(0, 300, 2)], LAB)
    def roll(p, l):
        return sorted(tuple(r) for r in MO.rolling_accuracy(FB.feedback_view(p, l)).collect())
    assert roll(pred, lab) == roll(pred.repartition(7), lab.repartition(3))
