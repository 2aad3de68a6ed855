"""Registered feedback-store, retraining and metric queries
(SURVEY 2.2 PRJ/FLT, 2.3 SRT/TOP, 2.4 AGG-01..03/07..10, 2.6 FBK, 2.7 RET, 2.8 ML-10..12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture_df, load_table, with_clause
from ..functions.exprs import class_name, recode_label
from ..operators import feedback as FB
from ..operators import metrics as M
from ..operators import retrain as R
from ..operators.ranking import running_totals
from ..schema import FEATURE_COLUMNS
from ..session import cut_lineage, scratch_path
from .registry import entries_text, register

# DuckDB twin of the feedback view: latest prediction per id, latest label per id,
# label attached only if not older than the prediction.
FV_DERIVED = """
lp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id
          ORDER BY ts DESC, prediction DESC, model_version DESC) AS rn FROM pred) WHERE rn = 1),
ll AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id
          ORDER BY label_ts DESC, actual_label DESC) AS rn FROM fb) WHERE rn = 1),
fv AS (SELECT lp.request_id, lp.ts AS "timestamp", lp.prediction,
              CASE WHEN ll.label_ts >= lp.ts THEN ll.actual_label END AS actual_label,
              CASE WHEN ll.label_ts >= lp.ts THEN ll.user_feedback END AS user_feedback,
              lp.features, lp.model_version, lp.confidence, lp.ts AS created_at,
              lp.endpoint, lp.latency_s, lp.error_type
       FROM lp LEFT JOIN ll USING (request_id)),
lab AS (SELECT * FROM fv WHERE actual_label IS NOT NULL)
"""
FV = with_clause("pred", "fb").rstrip() + "," + FV_DERIVED

AS_OF = "2024-02-01 00:00:00"
#: Declared keys of the stored feature payloads.
FEEDBACK_KEYS = ["k"]


def view(spark, sf_dir):
    return FB.feedback_view(fixture_df(spark, sf_dir, "pred"), fixture_df(spark, sf_dir, "fb"))


def _original(spark, sf_dir):
    return fixture_df(spark, sf_dir, "phish").drop("row_key", "side")


# ------------------------------------------------------------------ feedback store

@register("store_prediction", FV + "SELECT request_id, ts, prediction, model_version, confidence FROM lp")
def q_store_prediction(spark, sf_dir):
    """FBK-01: latest stored prediction per request id (re-store replaces)."""
    return FB.latest_predictions(fixture_df(spark, sf_dir, "pred")).select(
        "request_id", "ts", "prediction", "model_version", "confidence")


@register("update_ground_truth", FV + """SELECT request_id, "timestamp", prediction, actual_label, user_feedback,
       model_version FROM fv""")
def q_update_ground_truth(spark, sf_dir):
    """FBK-02: feedback view; labels older than a re-store are cleared, last label wins."""
    return view(spark, sf_dir).select("request_id", "timestamp", "prediction", "actual_label",
                                      "user_feedback", "model_version")


@register("unmatched_feedback", with_clause("pred", "fb") + """
SELECT request_id, label_ts, actual_label, user_feedback FROM fb
WHERE request_id NOT IN (SELECT request_id FROM pred)""")
def q_unmatched_feedback(spark, sf_dir):
    """FBK-03: label updates for unknown request ids (anti join)."""
    return FB.unmatched_feedback(fixture_df(spark, sf_dir, "pred"), fixture_df(spark, sf_dir, "fb"))


@register("labeled_only", FV + "SELECT request_id, actual_label FROM lab")
def q_labeled_only(spark, sf_dir):
    """FLT-03: rows with a ground-truth label."""
    return FB.labeled_data(view(spark, sf_dir), parse=False).select("request_id", "actual_label")


@register("labeled_range", FV + """SELECT request_id, "timestamp", actual_label FROM lab
WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-20 00:00:00'""")
def q_labeled_range(spark, sf_dir):
    """FLT-04: labeled rows in an inclusive time range."""
    return FB.labeled_data(view(spark, sf_dir), start="2024-01-10 00:00:00", end="2024-01-20 00:00:00",
                           parse=False).select("request_id", "timestamp", "actual_label")


@register("labeled_version", FV + "SELECT request_id, model_version, actual_label FROM lab WHERE model_version = 'v1.1'")
def q_labeled_version(spark, sf_dir):
    """FLT-05: labeled rows of one model version."""
    return FB.labeled_data(view(spark, sf_dir), model_version="v1.1", parse=False).select(
        "request_id", "model_version", "actual_label")


@register("labeled_recent", FV + """SELECT request_id, "timestamp",
       row_number() OVER (ORDER BY "timestamp" DESC, request_id) AS recency_rank FROM lab""")
def q_labeled_recent(spark, sf_dir):
    """SRT-01: labeled rows newest first; the position is computed with distributed running
    counts (blocked on time), not a single-partition window."""
    lab = cut_lineage(FB.labeled_data(view(spark, sf_dir), parse=False).select("request_id", "timestamp").withColumn("one", F.lit(1)))
    neg_ts = -F.unix_micros(F.col("timestamp").cast("timestamp"))
    ranked = running_totals(lab, [], [F.col("timestamp").desc(), F.col("request_id")], ["one"], block_expr=neg_ts.cast("double"))
    return ranked.select("request_id", "timestamp", F.col("cum_one").cast("long").alias("recency_rank"))


@register("labeled_recent_limit", FV + """SELECT request_id, "timestamp", actual_label FROM lab
ORDER BY "timestamp" DESC, request_id LIMIT 100""")
def q_labeled_recent_limit(spark, sf_dir):
    """TOP-01: newest 100 labeled rows (top-k report; TakeOrderedAndProject)."""
    return FB.labeled_data(view(spark, sf_dir), limit=100, parse=False).select("request_id", "timestamp", "actual_label")


@register("labeled_data", FV + """SELECT request_id, "timestamp", prediction, actual_label,
       CAST(CAST(features AS JSON) AS MAP(VARCHAR, DOUBLE)) AS features, model_version, confidence
FROM lab WHERE "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND model_version = 'v1.0'
ORDER BY "timestamp" DESC, request_id LIMIT 500""")
def q_labeled_data(spark, sf_dir):
    """FBK-04: filters + newest-first + limit + parsed features, the 7-column result."""
    return FB.labeled_data(view(spark, sf_dir), start="2024-01-05 00:00:00", model_version="v1.0", limit=500)


@register("parse_features", with_clause("pred") + """
SELECT request_id, ts, CAST(CAST(features AS JSON) AS MAP(VARCHAR, DOUBLE)) AS features FROM pred""")
def q_parse_features(spark, sf_dir):
    """PRJ-05: JSON feature text -> map<string,double>."""
    pred = fixture_df(spark, sf_dir, "pred")
    return pred.select("request_id", "ts", FB.parse_features(F.col("features")).alias("features"))


@register("serialize_features", with_clause("pred") + """
SELECT request_id, ts, to_json(CAST(CAST(features AS JSON) AS MAP(VARCHAR, DOUBLE))) AS features_json FROM pred""")
def q_serialize_features(spark, sf_dir):
    """PRJ-06: map -> JSON text (round trip of the stored features)."""
    pred = fixture_df(spark, sf_dir, "pred")
    return pred.select("request_id", "ts",
                       FB.serialize_features(FB.parse_features(F.col("features"))).alias("features_json"))


@register("expand_features", FV + """SELECT CAST(json_extract(features, '$.k') AS DOUBLE) AS k,
       actual_label AS Result FROM lab""")
def q_expand_features(spark, sf_dir):
    """PRJ-07: feature map -> one column per declared key, plus Result."""
    lab = FB.labeled_data(view(spark, sf_dir))
    return FB.expand_features(lab, FEEDBACK_KEYS)


#: Payloads of three shapes, and none.
_SHAPES = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('{"k": ', CAST(user_id AS STRING), '}')
                                   WHEN 1 THEN concat('{"k": ', CAST(user_id AS STRING), ', "extra key": 0.5}')
                                   WHEN 2 THEN concat('{"late": ', CAST(event_id % 9 AS STRING), ', "text": "no number"}')
                                   WHEN 3 THEN '{}' END AS payload, event_id % 2 AS actual_label
FROM @events"""


def _shapes(spark, sf_dir):
    text = _SHAPES.replace("{", "{{").replace("}", "}}").replace("@events", "{events}")
    rows = spark.sql(text, events=load_table(spark, sf_dir, "events"))
    return rows.withColumn("features", F.from_json("payload", "map<string,string>"))


@register("feature_keys", "WITH s AS (" + _SHAPES.replace("@", "").replace("STRING", "VARCHAR") + """)
SELECT "key", count(*) AS n_rows, count(TRY_CAST(json_extract_string(payload, '$."' || "key" || '"') AS DOUBLE)) AS n_numbers
FROM (SELECT payload, unnest(json_keys(payload)) AS "key" FROM s) GROUP BY "key\"""")
def q_feature_keys(spark, sf_dir):
    """PRJ-07: the keys that payloads of any shape hold, with the rows and numbers of each."""
    return FB.feature_keys(_shapes(spark, sf_dir))


@register("expand_features_union", "WITH s AS (" + _SHAPES.replace("@", "").replace("STRING", "VARCHAR") + """)
SELECT event_id, TRY_CAST(json_extract_string(payload, '$."extra key"') AS DOUBLE) AS "extra key", TRY_CAST(json_extract_string(payload, '$.k') AS DOUBLE) AS k,
       TRY_CAST(json_extract_string(payload, '$.late') AS DOUBLE) AS late, TRY_CAST(json_extract_string(payload, '$.text') AS DOUBLE) AS text,
       actual_label AS Result FROM s""")
def q_expand_features_union(spark, sf_dir):
    """PRJ-07: one column for each key that any payload holds, absent ones NULL."""
    return FB.expand_features(_shapes(spark, sf_dir), keep=["event_id"])


@register("recode_label", with_clause("phish") + """
SELECT row_key, CASE WHEN Result = -1 THEN 0 ELSE Result END AS label FROM phish""")
def q_recode_label(spark, sf_dir):
    """PRJ-02: -1 -> 0 in the label."""
    ph = fixture_df(spark, sf_dir, "phish")
    return ph.select("row_key", recode_label("Result").alias("label"))


@register("class_name", with_clause("pred") + """
SELECT request_id, ts, CASE WHEN prediction = 1 THEN 'phishing' ELSE 'legitimate' END AS class_label FROM pred""")
def q_class_name(spark, sf_dir):
    """PRJ-03: class label text of a prediction."""
    pred = fixture_df(spark, sf_dir, "pred")
    return pred.select("request_id", "ts", class_name("prediction").alias("class_label"))


@register("split_features_label", with_clause("phish") + "SELECT * EXCLUDE (Result) FROM phish")
def q_split_features_label(spark, sf_dir):
    """PRJ-01: feature frame X (target dropped); y is ``select(target)``."""
    ph = fixture_df(spark, sf_dir, "phish")
    return ph.drop("Result")


@register("split_label", with_clause("phish") + "SELECT row_key, Result FROM phish")
def q_split_label(spark, sf_dir):
    """PRJ-01: y, the target alone, with the key that joins it to X."""
    return fixture_df(spark, sf_dir, "phish").select("row_key", "Result")


@register("feedback_totals", FV + """SELECT count(*) AS total_records, count(actual_label) AS labeled_records,
       count(*) - count(actual_label) AS unlabeled_records,
       round(coalesce(count(actual_label) / nullif(count(*), 0), 0.0), 6) AS labeling_rate FROM fv""")
def q_feedback_totals(spark, sf_dir):
    """AGG-01: total, labeled, unlabeled, labeling rate."""
    return FB.feedback_totals(view(spark, sf_dir))


@register("feedback_by_version", FV + "SELECT model_version, count(*) AS n_records FROM fv GROUP BY model_version")
def q_feedback_by_version(spark, sf_dir):
    """AGG-02: records per model version."""
    return FB.feedback_by_version(view(spark, sf_dir))


@register("feedback_accuracy", FV + """SELECT model_version,
       round(avg(CASE WHEN prediction = actual_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
       count(*) AS labeled_records FROM lab GROUP BY model_version""")
def q_feedback_accuracy(spark, sf_dir):
    """AGG-03: accuracy over labeled rows per model version."""
    return FB.feedback_accuracy(FB.labeled_data(view(spark, sf_dir), parse=False), by=["model_version"])


STATS_SQL = """
st AS (SELECT count(*) AS total_records, count(actual_label) AS labeled_records,
              sum(CASE WHEN actual_label IS NOT NULL AND prediction = actual_label THEN 1 ELSE 0 END)
                / nullif(count(actual_label), 0) AS accuracy FROM fv)"""


@register("feedback_stats", FV + "," + STATS_SQL + """,
bv AS (SELECT list(model_version || '=' || n ORDER BY model_version) AS records_by_version
       FROM (SELECT model_version, count(*) AS n FROM fv GROUP BY model_version))
SELECT total_records, labeled_records, total_records - labeled_records AS unlabeled_records,
       round(labeled_records / total_records, 6) AS labeling_rate, round(accuracy, 6) AS accuracy,
       records_by_version FROM st, bv""")
def q_feedback_stats(spark, sf_dir):
    """FBK-05: one-row statistics with the per-version record map."""
    stats = FB.feedback_stats(view(spark, sf_dir))
    return stats.withColumn("records_by_version", entries_text("records_by_version", "%d"))


def _trigger_sql(min_n: int, thr: float) -> str:
    return f"""SELECT labeled_records, round(accuracy, 6) AS accuracy,
       labeled_records >= {min_n} OR coalesce(accuracy < {thr}, false) AS should_retrain,
       CASE WHEN labeled_records >= {min_n} THEN 'Sufficient labeled data: ' || labeled_records || ' samples'
            WHEN accuracy < {thr} THEN 'Accuracy dropped to ' || printf('%.2f', round(accuracy * 100, 2))
                 || '% (threshold: {thr:.2%})'
            ELSE 'No retraining trigger conditions met' END AS reason
FROM st"""


@register("should_trigger_retraining", FV + "," + STATS_SQL + "\n" + _trigger_sql(10000, 0.75))
def q_should_trigger(spark, sf_dir):
    """FBK-07: retrain trigger with a 10,000-label minimum so the accuracy rule decides."""
    return FB.should_trigger_retraining(FB.feedback_stats(view(spark, sf_dir)), min_new_samples=10000)


@register("should_trigger_retraining_count", FV + "," + STATS_SQL + "\n" + _trigger_sql(1000, 0.75))
def q_should_trigger_count(spark, sf_dir):
    """FBK-07 with the default 1,000-label rule (fires on count)."""
    return FB.should_trigger_retraining(FB.feedback_stats(view(spark, sf_dir)))


@register("export_for_retraining", FV + """SELECT CAST(json_extract(features, '$.k') AS DOUBLE) AS k,
       actual_label AS Result FROM lab WHERE (SELECT count(*) FROM lab) >= 100""")
def q_export_for_retraining(spark, sf_dir):
    """FBK-06: gated export (>= 100 labeled rows) of the expanded feedback table."""
    out = FB.export_for_retraining(view(spark, sf_dir), FEEDBACK_KEYS, min_samples=100)
    if out is None:
        return spark.createDataFrame([], "k double, Result int")
    return out


@register("retraining_size", FV + """SELECT count(*) AS n_rows, 1000 AS min_samples, count(*) >= 1000 AS sufficient
FROM lab""")
def q_retraining_size(spark, sf_dir):
    """AGG-10: size of the prepared set against the minimum."""
    lab = FB.labeled_data(view(spark, sf_dir), parse=False)
    return lab.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(1000).alias("min_samples"), (F.col("n_rows") >= 1000).alias("sufficient"))


# ------------------------------------------------------------------ retraining

_FEATS = ", ".join(FEATURE_COLUMNS)
_ORIG = f"SELECT {_FEATS}, CASE WHEN Result = -1 THEN 0 ELSE Result END AS Result, CAST(NULL AS DOUBLE) AS k FROM phish"
_FBROWS = ", ".join(f"CAST(NULL AS BIGINT) AS {c}" for c in FEATURE_COLUMNS)


def _fb_rows_sql(where: str = "") -> str:
    return (f"SELECT {_FBROWS}, CAST(CASE WHEN actual_label = -1 THEN 0 ELSE actual_label END AS BIGINT) AS Result, "
            f"CAST(json_extract(features, '$.k') AS DOUBLE) AS k FROM lab {where}")


@register("retrain_full", FV.rstrip() + ",\n" + with_clause("phish")[5:] + f"{_ORIG}\nUNION ALL\n{_fb_rows_sql()}")
def q_retrain_full(spark, sf_dir):
    """RET-01: original table (labels -> 0/1) UNION ALL labeled feedback by column name."""
    return R.retrain_full(_original(spark, sf_dir), view(spark, sf_dir), FEEDBACK_KEYS)


@register("retrain_incremental", FV.rstrip() + ",\n" + with_clause("phish")[5:]
          + f"{_ORIG}\nUNION ALL\n{_fb_rows_sql(chr(10) + 'WHERE timestamp > TIMESTAMP ' + repr('2024-01-20 00:00:00'))}")
def q_retrain_incremental(spark, sf_dir):
    """RET-02: original plus feedback newer than the last run (2024-01-20)."""
    return R.retrain_incremental(_original(spark, sf_dir), view(spark, sf_dir), FEEDBACK_KEYS, since="2024-01-20 00:00:00")


@register("retrain_windowed", FV + f"""SELECT CAST(json_extract(features, '$.k') AS DOUBLE) AS k,
       CAST(CASE WHEN actual_label = -1 THEN 0 ELSE actual_label END AS BIGINT) AS Result
FROM lab WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS""")
def q_retrain_windowed(spark, sf_dir):
    """RET-03: labeled feedback of the last 90 days (enough rows, no fallback)."""
    out, _ = R.retrain_windowed(_original(spark, sf_dir), view(spark, sf_dir), FEEDBACK_KEYS, as_of=AS_OF, window_days=90)
    return out


@register("retrain_windowed_fallback", FV.rstrip() + ",\n" + with_clause("phish")[5:]
          + f"{_ORIG}\nUNION ALL\n{_fb_rows_sql()}")
def q_retrain_windowed_fallback(spark, sf_dir):
    """RET-03: a 2-day window holds fewer than 1,000 labels, so the full set is used."""
    out, _ = R.retrain_windowed(_original(spark, sf_dir), view(spark, sf_dir), FEEDBACK_KEYS, as_of=AS_OF, window_days=2)
    return out


def _guard_sql(as_of: str) -> str:
    return with_clause("runs") + f"""
SELECT max(run_ts) AS last_run_ts,
       round(epoch_us(TIMESTAMP '{as_of}' - max(run_ts)) / 3.6e9, 6) AS hours_since,
       max(run_ts) IS NULL OR TIMESTAMP '{as_of}' - max(run_ts) >= INTERVAL 24 HOURS AS allowed
FROM runs"""


@register("retrain_frequency_guard", _guard_sql("2024-01-31 02:00:00"))
def q_frequency_guard(spark, sf_dir):
    """RET-04: last run exactly 24 h before as_of -> allowed."""
    return R.frequency_guard(fixture_df(spark, sf_dir, "runs"), "2024-01-31 02:00:00")


@register("retrain_frequency_guard_blocked", _guard_sql("2024-01-31 01:59:00"))
def q_frequency_guard_blocked(spark, sf_dir):
    """RET-04: 23 h 59 m after the last run -> blocked."""
    return R.frequency_guard(fixture_df(spark, sf_dir, "runs"), "2024-01-31 01:59:00")


@register("retrain_conditions", FV + "," + STATS_SQL + """
SELECT labeled_records,
       labeled_records >= 20000 OR coalesce(accuracy < 0.7, false) OR labeled_records >= 20000 AS should_retrain,
       CASE WHEN labeled_records >= 20000 THEN 'Sufficient labeled data: ' || labeled_records || ' samples'
            WHEN accuracy < 0.7 THEN 'Accuracy dropped to ' || printf('%.2f', round(accuracy * 100, 2))
                 || '% (threshold: 70.00%)'
            ELSE 'Insufficient data: ' || labeled_records || ' labeled samples (minimum: 20000)' END AS reason
FROM st""")
def q_retrain_conditions(spark, sf_dir):
    """RET-05: no trigger fires (min 20,000, accuracy floor 0.70) -> 'Insufficient data'."""
    return R.retrain_conditions(FB.feedback_stats(view(spark, sf_dir)), min_new_samples=20000, accuracy_threshold=0.7)


@register("manual_retrain_gate", FV + "," + STATS_SQL + """
SELECT labeled_records, CASE WHEN labeled_records < 100 THEN 'insufficient_data' ELSE 'accepted' END AS status,
       CASE WHEN labeled_records < 100 THEN 'Only ' || labeled_records || ' labeled samples available (minimum: 100)'
            ELSE 'Retraining triggered' END AS message FROM st""")
def q_manual_retrain_gate(spark, sf_dir):
    """RET-06: manual trigger gate on the labeled count."""
    return R.manual_retrain_gate(FB.feedback_stats(view(spark, sf_dir)))


@register("alert_reason", with_clause("alerts_json") + """
SELECT event_id,
       CASE WHEN payload IS NULL OR json_array_length(payload, '$.alerts') = 0 THEN 'Webhook trigger'
            ELSE coalesce(json_extract_string(payload, '$.alerts[0].labels.alertname'), 'Unknown') || ': '
                 || coalesce(json_extract_string(payload, '$.alerts[0].annotations.description'), '') END AS reason
FROM alerts_json""")
def q_alert_reason(spark, sf_dir):
    """RET-07: alert payload -> retraining reason text."""
    a = fixture_df(spark, sf_dir, "alerts_json")
    return a.select("event_id", R.alert_reason("payload").alias("reason"))


@register("retrain_run_log", with_clause("runs") + """
SELECT trigger_type, max(run_ts) AS run_ts, arg_max(reason, run_ts) AS reason, arg_max(strategy, run_ts) AS strategy,
       arg_max(n_rows, run_ts) AS n_rows, count(*) AS n_runs FROM runs GROUP BY trigger_type""")
def q_retrain_run_log(spark, sf_dir):
    """RET-08: latest run per trigger type from the run log."""
    return R.last_run(fixture_df(spark, sf_dir, "runs"), by=["trigger_type"])


_VERSION_COLS = [*FEATURE_COLUMNS, "Result"]
_ROW_TEXT = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in [*_VERSION_COLS, "k"])
_VERSION_SQL = FV.rstrip() + ",\n" + with_clause("phish")[5:].rstrip() + f""",
u AS ({_ORIG}
UNION ALL
{_fb_rows_sql()}),
h AS (SELECT md5({_ROW_TEXT}) AS h FROM u)
SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(h, 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS hash_sum,
       CAST(sum(CAST(('0x' || substr(h, 16, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS hash_sum2 FROM h"""


@register("data_version", _VERSION_SQL)
def q_data_version(spark, sf_dir):
    """RET-09: order-free version of the full retraining set."""
    return R.data_version(R.retrain_full(_original(spark, sf_dir), view(spark, sf_dir), FEEDBACK_KEYS))


@register("data_version_incremental", _VERSION_SQL)
def q_data_version_incremental(spark, sf_dir):
    """RET-09, kept up to date: stored versions of snapshots of the retraining set (the original rows,
    the feedback, and rows that were in it by mistake and are taken away again) add up to its version."""
    original = _original(spark, sf_dir)
    full = R.retrain_full(original, view(spark, sf_dir), FEEDBACK_KEYS)
    parts = full.withColumn("snapshot_id", F.when(F.col("k").isNull(), "original").otherwise("feedback"))
    mistake = full.where(F.col("k").isNotNull()).withColumn("snapshot_id", F.lit("mistake"))
    path = scratch_path(spark, "versions")
    R.data_version(parts.unionByName(mistake), ["snapshot_id"]).withColumn("sign", F.lit(1)).write.parquet(path)
    R.data_version(mistake, ["snapshot_id"]).withColumn("sign", F.lit(-1)).write.mode("append").parquet(path)
    return R.add_versions(spark.read.parquet(path), "sign")


# ------------------------------------------------------------------ metrics and gates

_LONG = with_clause("scored") + """,
sl AS (SELECT side, label, 'champion' AS model, champion AS prediction FROM scored
       UNION ALL SELECT side, label, 'challenger' AS model, challenger AS prediction FROM scored),
cc AS (SELECT side, model, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
              count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn FROM sl GROUP BY side, model),
mt AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1_score,
              coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision_score,
              coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall_score,
              (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM cc)
"""


def _metric_table(spark, sf_dir):
    sc = fixture_df(spark, sf_dir, "scored")
    return M.classification_metrics(M.long_predictions(sc, "label", ["champion", "challenger"], keys=["side"]),
                                    by=["side", "model"])


@register("confusion_counts", _LONG + "SELECT side, model, tp, fp, fn, tn FROM cc")
def q_confusion_counts(spark, sf_dir):
    """AGG-07: TP/FP/FN/TN per split and model in one conditional aggregate."""
    sc = fixture_df(spark, sf_dir, "scored")
    return M.confusion_counts(M.long_predictions(sc, "label", ["champion", "challenger"], keys=["side"]),
                              by=["side", "model"])


@register("classification_metrics", _LONG + """SELECT side, model, tp, fp, fn, tn, round(f1_score, 6) AS f1_score,
       round(precision_score, 6) AS precision_score, round(recall_score, 6) AS recall_score,
       round(accuracy, 6) AS accuracy FROM mt""")
def q_classification_metrics(spark, sf_dir):
    """AGG-08: F1 / precision / recall (0 on empty denominators) per split and model."""
    return _metric_table(spark, sf_dir)


@register("prediction_summary", with_clause("pred") + """
SELECT model_version, count(*) AS total, count(*) FILTER (WHERE prediction = 1) AS phishing,
       round(100.0 * count(*) FILTER (WHERE prediction = 1) / count(*), 1) AS phishing_pct,
       count(*) FILTER (WHERE prediction IN (0, -1)) AS legitimate,
       round(100.0 * count(*) FILTER (WHERE prediction IN (0, -1)) / count(*), 1) AS legitimate_pct
FROM pred GROUP BY model_version""")
def q_prediction_summary(spark, sf_dir):
    """AGG-09: batch prediction summary (counts and one-decimal percentages)."""
    return M.prediction_summary(fixture_df(spark, sf_dir, "pred"), by=["model_version"])


@register("best_by_metric", _LONG + """SELECT arg_max(model, (f1_score, -candidate_order)) AS best_model,
       round(max(f1_score), 6) AS best_f1_score
FROM (SELECT *, CASE model WHEN 'champion' THEN 0 ELSE 1 END AS candidate_order FROM mt WHERE side = 'current')""")
def q_best_by_metric(spark, sf_dir):
    """TOP-02: best candidate by test F1 (first candidate wins ties)."""
    mt = _metric_table(spark, sf_dir).filter("side = 'current'").withColumn(
        "candidate_order", F.when(F.col("model") == "champion", 0).otherwise(1))
    return M.best_by_metric(mt)


@register("min_score_gate", _LONG + """SELECT model, round(f1_score, 6) AS f1_score, f1_score >= 0.6 AS passes_min_score
FROM mt WHERE side = 'current'""")
def q_min_score_gate(spark, sf_dir):
    """ML-10: test F1 >= 0.6 per candidate."""
    mt = _metric_table(spark, sf_dir).filter("side = 'current'")
    return mt.select("model", "f1_score", M.min_score_gate(F.col("f1_score")).alias("passes_min_score"))


@register("overfit_gate", _LONG + """SELECT tr.model, round(tr.f1_score, 6) AS train_f1, round(te.f1_score, 6) AS test_f1,
       abs(tr.f1_score - te.f1_score) <= 0.05 AS passes_overfit
FROM mt tr JOIN mt te ON tr.model = te.model AND tr.side = 'baseline' AND te.side = 'current'""")
def q_overfit_gate(spark, sf_dir):
    """ML-11: |train F1 - test F1| <= 0.05 (baseline split as train, current as test)."""
    mt = _metric_table(spark, sf_dir)
    piv = mt.groupBy("model").agg(F.max(F.when(F.col("side") == "baseline", F.col("f1_score"))).alias("train_f1"),
                                  F.max(F.when(F.col("side") == "current", F.col("f1_score"))).alias("test_f1"))
    return piv.select("model", "train_f1", "test_f1",
                      M.overfit_gate(F.col("train_f1"), F.col("test_f1")).alias("passes_overfit"))


@register("champion_challenger", _LONG + """SELECT round(ch.f1_score, 6) AS challenger_f1, round(cp.f1_score, 6) AS champion_f1,
       round(ch.f1_score - cp.f1_score, 6) AS improved_accuracy, ch.f1_score - cp.f1_score > 0.02 AS is_model_accepted
FROM mt ch JOIN mt cp ON ch.side = cp.side AND ch.model = 'challenger' AND cp.model = 'champion'
WHERE ch.side = 'current'""")
def q_champion_challenger(spark, sf_dir):
    """ML-12: challenger accepted iff its F1 beats the champion's by more than 0.02."""
    sc = fixture_df(spark, sf_dir, "scored").filter("side = 'current'")
    return M.champion_challenger(sc)
