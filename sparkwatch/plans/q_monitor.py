"""Registered monitoring queries.

Alert rules are exercised on the sparse fixture with scaled windows (1-day window,
6-hour step); the library defaults stay those of the production rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture_df, with_clause
from ..operators import drift as D
from ..operators import monitor as MO
from ..schema import FEATURE_COLUMNS
from . import oracle_sql as O
from .q_drift import NUM_FEATURES
from .q_feedback import FV, FV_DERIVED, view
from .registry import entries_text, register

CUT = "2024-01-16 00:00:00"
STEP_US = 6 * 3600 * 1_000_000
K_DAY = 4  # 1-day window / 6-hour step


def _pred_sides(spark, sf_dir):
    pred = fixture_df(spark, sf_dir, "pred")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return pred.filter(F.col("ts") < cut), pred.filter(F.col("ts") >= cut)


ROLL_SQL = """
roll AS (SELECT model_version, request_id, "timestamp",
                row_number() OVER (PARTITION BY model_version ORDER BY "timestamp", request_id) AS rn,
                count(*) OVER (PARTITION BY model_version ORDER BY "timestamp", request_id ROWS 99 PRECEDING)
                  AS window_fill,
                avg(CASE WHEN prediction = actual_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                  OVER (PARTITION BY model_version ORDER BY "timestamp", request_id ROWS 99 PRECEDING)
                  AS rolling_accuracy
         FROM lab)"""


@register("rolling_accuracy", FV + "," + ROLL_SQL + """
SELECT model_version, request_id, "timestamp", rn, window_fill, round(rolling_accuracy, 6) AS rolling_accuracy
FROM roll""")
def q_rolling_accuracy(spark, sf_dir):
    """DRF-08: accuracy over the last 100 labeled pairs per model version (prefix-sum window)."""
    return MO.rolling_accuracy(view(spark, sf_dir))


@register("window_fill", FV + "," + ROLL_SQL + """
SELECT model_version, arg_max(window_fill, rn) AS window_fill, count(*) AS n_pairs FROM roll GROUP BY model_version""")
def q_window_fill(spark, sf_dir):
    """DRF-09: number of pairs currently in the window, per model version."""
    r = MO.rolling_accuracy(view(spark, sf_dir))
    return r.groupBy("model_version").agg(F.max_by("window_fill", "rn").alias("window_fill"),
                                          F.count(F.lit(1)).alias("n_pairs"))


@register("concept_drift", FV + "," + ROLL_SQL + """
SELECT model_version, count(*) AS n_pairs, coalesce(bool_or(0.85 - rolling_accuracy > 0.1), false)
         AS concept_drift_detected,
       round(arg_max(rolling_accuracy, rn), 6) AS rolling_accuracy,
       round(0.85 - arg_max(rolling_accuracy, rn), 6) AS accuracy_drop
FROM roll GROUP BY model_version""")
def q_concept_drift(spark, sf_dir):
    """DRF-10: concept-drift flag (any window more than 0.1 below 0.85), final accuracy and drop."""
    return MO.concept_drift(MO.rolling_accuracy(view(spark, sf_dir)))


DRIFT_CHECK_SQL = with_clause("pred") + f""",
b AS (SELECT model_version, CAST(prediction AS VARCHAR) AS class,
             count(*) / sum(count(*)) OVER (PARTITION BY model_version) AS p_b
      FROM pred WHERE ts < TIMESTAMP '{CUT}' GROUP BY model_version, prediction),
c AS (SELECT model_version, prediction,
             (row_number() OVER (PARTITION BY model_version ORDER BY ts, request_id) - 1) // 50 AS block
      FROM pred WHERE ts >= TIMESTAMP '{CUT}'),
cc AS (SELECT model_version, block, CAST(prediction AS VARCHAR) AS class, count(*) AS n_c FROM c GROUP BY ALL),
tot AS (SELECT model_version, block, sum(n_c) AS n FROM cc GROUP BY ALL),
g AS (SELECT tot.*, b.class, b.p_b FROM tot JOIN b USING (model_version))
SELECT g.model_version, g.block, g.n, round(sum(abs(coalesce(cc.n_c / g.n, 0) - g.p_b)), 6) AS class_distribution_shift,
       sum(abs(coalesce(cc.n_c / g.n, 0) - g.p_b)) > 0.2 AS model_drift_detected
FROM g LEFT JOIN cc USING (model_version, block, class) GROUP BY g.model_version, g.block, g.n"""


@register("drift_check_interval", DRIFT_CHECK_SQL)
def q_drift_check_interval(spark, sf_dir):
    """DRF-12: prediction-share shift of every block of 50 current predictions per version."""
    b, c = _pred_sides(spark, sf_dir)
    return MO.block_model_drift(b, c)


def _report_sql() -> str:
    psi = O.psi_sql("phish_long", FEATURE_COLUMNS, O.phish_prelude())
    # reuse the PSI twin as a subquery: strip its WITH prelude into the report's CTEs
    return with_clause("pred", "fb", "phish").rstrip() + "," + FV_DERIVED.rstrip() + ",\n" + O.phish_long_cte() + "," + \
        psi[len(O.phish_prelude()) + 1:].replace("\nSELECT tot.feature", "\n, psi_out AS (SELECT tot.feature", 1) + f"""),
dd AS (SELECT coalesce(bool_or(score > 0.2), false) AS data_drift_detected,
              list(feature || '=' || coalesce(printf('%.6f', score), 'null') ORDER BY feature) AS feature_drift_scores,
              list(feature || '=psi' ORDER BY feature) AS feature_drift_type FROM psi_out),
pb AS (SELECT CAST(prediction AS VARCHAR) AS class, count(*) / sum(count(*)) OVER () AS p
       FROM pred WHERE ts < TIMESTAMP '{CUT}' GROUP BY prediction),
pc AS (SELECT CAST(prediction AS VARCHAR) AS class, count(*) / sum(count(*)) OVER () AS p
       FROM pred WHERE ts >= TIMESTAMP '{CUT}' GROUP BY prediction),
md AS (SELECT coalesce(sum(abs(coalesce(pc.p, 0) - pb.p)), 0) AS shift FROM pb LEFT JOIN pc USING (class)),
rg AS (SELECT avg(CASE WHEN prediction = actual_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                OVER (ORDER BY "timestamp", request_id ROWS 99 PRECEDING) AS r,
              row_number() OVER (ORDER BY "timestamp", request_id) AS rn FROM lab),
cd AS (SELECT coalesce(bool_or(0.85 - r > 0.1), false) AS concept, arg_max(r, rn) AS last_r FROM rg)
SELECT TIMESTAMP '2024-02-01 00:00:00' AS "timestamp", data_drift_detected, md.shift > 0.2 AS model_drift_detected,
       cd.concept AS concept_drift_detected, feature_drift_scores, feature_drift_type, round(md.shift, 6) AS class_distribution_shift,
       round(cd.last_r, 6) AS rolling_accuracy, round(0.85 - cd.last_r, 6) AS accuracy_drop,
       list_filter([CASE WHEN data_drift_detected THEN '{MO.RECOMMEND_DATA}' END,
                    CASE WHEN md.shift > 0.2 THEN '{MO.RECOMMEND_MODEL}' END,
                    CASE WHEN cd.concept THEN 'Accuracy dropped by ' || printf('%.2f', round((0.85 - cd.last_r) * 100, 2))
                         || '%. Retrain model immediately.' END,
                    CASE WHEN NOT (data_drift_detected OR md.shift > 0.2 OR cd.concept) THEN '{MO.RECOMMEND_NONE}' END],
                   lambda x: x IS NOT NULL) AS recommendations
FROM dd, md, cd"""


@register("drift_report", _report_sql())
def q_drift_report(spark, sf_dir):
    """DRF-11: the drift report - PSI data drift over the 30 features, prediction-share shift
    (first vs second half of January) and concept drift over all labeled pairs."""
    ph = fixture_df(spark, sf_dir, "phish")
    b, c = _pred_sides(spark, sf_dir)
    report = MO.drift_report(ph.filter("side = 'baseline'"), ph.filter("side = 'current'"), FEATURE_COLUMNS,
                             b, c, pairs=view(spark, sf_dir), as_of="2024-02-01 00:00:00")
    return report.withColumns({"feature_drift_scores": entries_text("feature_drift_scores", "%.6f"),
                               "feature_drift_type": entries_text("feature_drift_type", "%s")})


# ------------------------------------------------------------------ metric series

@register("predictions_total", with_clause("pred") + """
SELECT model_version, endpoint, count(*) AS value FROM pred GROUP BY ALL""")
def q_predictions_total(spark, sf_dir):
    """MON-01: prediction counter by model version and endpoint."""
    return MO.predictions_total(fixture_df(spark, sf_dir, "pred"))


@register("prediction_class_total", with_clause("pred") + """
SELECT CASE WHEN prediction = 1 THEN 'phishing' ELSE 'legitimate' END AS class_label, model_version,
       count(*) AS value FROM pred GROUP BY ALL""")
def q_prediction_class_total(spark, sf_dir):
    """MON-02: prediction counter by class label and model version."""
    return MO.prediction_class_total(fixture_df(spark, sf_dir, "pred"))


def _bounds_list() -> str:
    return "[" + ", ".join(str(float(b)) for b in MO.LATENCY_BUCKETS) + "]"


def _hist_sql() -> str:
    les = [str(b) for b in MO.LATENCY_BUCKETS] + ["+Inf"]
    n = len(MO.LATENCY_BUCKETS)
    rows = []
    for i, le in enumerate(les):
        cond = "true" if i == n else f"latency_s <= {MO.LATENCY_BUCKETS[i]}"
        rows.append(f"SELECT model_version, endpoint, '{le}' AS le, count(*) FILTER (WHERE {cond}) AS bucket_count, "
                    f"round(sum(latency_s), 6) AS sum, count(*) AS count FROM pred WHERE latency_s IS NOT NULL "
                    f"GROUP BY model_version, endpoint")
    return with_clause("pred") + "\n" + "\nUNION ALL\n".join(rows)


@register("latency_histogram", _hist_sql())
def q_latency_histogram(spark, sf_dir):
    """MON-03: cumulative latency buckets, sum and count per model version and endpoint."""
    return MO.latency_histogram(fixture_df(spark, sf_dir, "pred"))


@register("errors_total", with_clause("pred") + """
SELECT error_type, model_version, count(*) AS value FROM pred WHERE error_type IS NOT NULL GROUP BY ALL""")
def q_errors_total(spark, sf_dir):
    """MON-04: error counter by error type and model version."""
    return MO.errors_total(fixture_df(spark, sf_dir, "pred"))


TIMELINE_SQL = f""",
tb AS (SELECT CAST(prediction AS VARCHAR) AS class, count(*) / sum(count(*)) OVER () AS p_b
       FROM pred WHERE ts < TIMESTAMP '{CUT}' GROUP BY prediction),
tc AS (SELECT floor(epoch_us(ts) / 86400000000)::BIGINT AS slot, CAST(prediction AS VARCHAR) AS class, count(*) AS n_c
       FROM pred WHERE ts >= TIMESTAMP '{CUT}' GROUP BY ALL),
tt AS (SELECT slot, sum(n_c) AS n FROM tc GROUP BY slot),
tl AS (SELECT make_timestamp((tt.slot + 1) * 86400000000) AS ts, 'class_distribution' AS feature,
              'distribution_shift' AS drift_type,
              sum(abs(coalesce(tc.n_c / tt.n, 0) - tb.p_b)) AS score
       FROM tt JOIN tb ON true LEFT JOIN tc ON tc.slot = tt.slot AND tc.class = tb.class
       GROUP BY tt.slot)
"""


def _timeline(spark, sf_dir):
    b, c = _pred_sides(spark, sf_dir)
    return MO.class_shift_timeline(b, c, period="1 day")


@register("drift_gauge", with_clause("pred").rstrip() + TIMELINE_SQL + """
SELECT feature, drift_type, round(arg_max(score, ts), 6) AS value, max(ts) AS ts FROM tl GROUP BY ALL""")
def q_drift_gauge(spark, sf_dir):
    """MON-05: latest drift score per feature and drift type (daily class-share shift series)."""
    return MO.drift_gauge(_timeline(spark, sf_dir))


def _feature_gauge_sql() -> str:
    parts = [f"SELECT feature, '{m}' AS drift_type, score AS value, TIMESTAMP '{at}' AS ts FROM ({sql})"
             for m, at, sql in (("psi", "2024-01-02 00:00:00", O.psi_sql("num_long", NUM_FEATURES, O.num_prelude())),
                                ("ks", "2024-01-02 00:00:00", O.ks_sql("num_long", NUM_FEATURES, O.num_prelude(), with_p=False)),
                                ("js", "2024-01-02 00:00:00", O.js_sql("num_long", NUM_FEATURES, O.num_prelude())))]
    return "\nUNION ALL ".join(parts)


@register("drift_gauge_features", _feature_gauge_sql())
def q_drift_gauge_features(spark, sf_dir):
    """MON-05: the latest score of each feature by each drift type, of a series of two computations:
    the baseline against itself first, then the current rows against it."""
    num = fixture_df(spark, sf_dir, "num")
    b, c = num.filter("side = 'baseline'"), num.filter("side = 'current'")
    series = None
    for method in ("psi", "ks", "js"):
        for at, rows in (("2024-01-01 00:00:00", b), ("2024-01-02 00:00:00", c)):
            one = MO.feature_drift_series(D.data_drift(b, rows, NUM_FEATURES, method=method), at)
            series = one if series is None else series.unionByName(one)
    out = MO.drift_gauge(series)
    return out.withColumns({"value": F.round("value", 6), "ts": F.col("ts").cast("timestamp_ntz")})


@register("accuracy_gauge", FV + "," + ROLL_SQL + """
SELECT model_version, round(arg_max(rolling_accuracy, rn), 6) AS value, arg_max(window_fill, rn) AS in_window,
       '100' AS window_size FROM roll GROUP BY model_version""")
def q_accuracy_gauge(spark, sf_dir):
    """MON-06: latest rolling accuracy per model version and window size."""
    return MO.accuracy_gauge(MO.rolling_accuracy(view(spark, sf_dir)))


# ------------------------------------------------------------------ alerts

def _state_sql(src: str, keys: list[str], t: str, hold_us: int, cols: str) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    kk = ", ".join(keys) + ", " if keys else ""
    return f"""
isl AS (SELECT *, sum(CASE WHEN condition THEN 0 ELSE 1 END) OVER ({part}ORDER BY {t} ROWS UNBOUNDED PRECEDING) AS g
        FROM {src}),
st AS (SELECT {kk}g, min({t}) AS run_start FROM isl WHERE condition GROUP BY ALL)
SELECT {kk}{cols}, condition,
       CASE WHEN condition AND epoch_us({t}) - epoch_us(run_start) >= {hold_us} THEN 'firing'
            WHEN condition THEN 'pending' ELSE 'inactive' END AS state
FROM isl LEFT JOIN st USING ({kk}g)"""


def _grid_sql(keys: list[str], src: str, aggs: str, k: int) -> str:
    kk = ", ".join(keys)
    return f"""
per AS (SELECT {kk}, floor(epoch_us(ts) / {STEP_US})::BIGINT AS slot, {aggs} FROM {src} GROUP BY ALL),
rng AS (SELECT {kk}, min(slot) AS lo, max(slot) AS hi FROM per GROUP BY ALL),
grid AS (SELECT {kk}, unnest(range(lo, hi + {k})) AS slot FROM rng),
gj AS (SELECT grid.*, per.* EXCLUDE ({kk}, slot) FROM grid LEFT JOIN per USING ({kk}, slot))"""


ERR_THR = 20 / 86400


def alert_error_sql() -> str:
    return with_clause("pred") + "," + _grid_sql(["model_version"], "pred WHERE error_type IS NOT NULL", "count(*) AS n", K_DAY) + f""",
ev AS (SELECT model_version, make_timestamp((slot + 1) * {STEP_US}) AS eval_ts,
              sum(coalesce(n, 0)) OVER (PARTITION BY model_version ORDER BY slot ROWS {K_DAY - 1} PRECEDING) / 86400.0
                AS rate FROM gj),
evc AS (SELECT *, rate > {ERR_THR} AS condition FROM ev),""" + _state_sql(
        "evc", ["model_version"], "eval_ts", 12 * 3600 * 1_000_000, "eval_ts, round(rate, 6) AS rate")


@register("alert_error_rate", alert_error_sql())
def q_alert_error_rate(spark, sf_dir):
    """ALR-01: error rate over a trailing 1-day window every 6 hours > 20/day, held 12 hours."""
    return MO.alert_error_rate(fixture_df(spark, sf_dir, "pred"), threshold=ERR_THR, window="1 day",
                               step="6 hours", hold="12 hours")


def _p99_sql() -> str:
    n = len(MO.LATENCY_BUCKETS)
    aggs = ", ".join(f"count(*) FILTER (WHERE len(list_filter({_bounds_list()}, lambda b: b < latency_s)) = {i}) AS b{i}"
                     for i in range(n + 1))
    wins = ", ".join(f"sum(coalesce(b{i}, 0)) OVER w AS w{i}" for i in range(n + 1))
    cums = ", ".join("(" + " + ".join(f"w{j}" for j in range(i + 1)) + f") AS c{i}" for i in range(n + 1))
    bsel = " + ".join(f"CASE WHEN c{i} < 0.99 * c{n} THEN 1 ELSE 0 END" for i in range(n))
    counts_list = "[" + ", ".join(f"w{i}" for i in range(n + 1)) + "]"
    cum_list = "[" + ", ".join(f"c{i}" for i in range(n + 1)) + "]"
    keys = ["model_version", "endpoint"]
    return with_clause("pred") + "," + _grid_sql(keys, "pred WHERE latency_s IS NOT NULL", aggs, K_DAY) + f""",
ws AS (SELECT model_version, endpoint, slot, {wins} FROM gj
       WINDOW w AS (PARTITION BY model_version, endpoint ORDER BY slot ROWS {K_DAY - 1} PRECEDING)),
cs AS (SELECT *, {cums} FROM ws),
bs AS (SELECT *, {bsel} AS b, {counts_list} AS cl, {cum_list} AS ul, c{n} AS total FROM cs),
q AS (SELECT model_version, endpoint, make_timestamp((slot + 1) * {STEP_US}) AS eval_ts,
             CASE WHEN total = 0 THEN NULL
                  WHEN b >= {n} THEN {float(MO.LATENCY_BUCKETS[-1])}
                  ELSE (CASE WHEN b = 0 THEN 0.0 ELSE {_bounds_list()}[b] END)
                       + ({_bounds_list()}[b + 1] - CASE WHEN b = 0 THEN 0.0 ELSE {_bounds_list()}[b] END)
                       * ((0.99 * total - CASE WHEN b = 0 THEN 0 ELSE ul[b] END) / cl[b + 1]) END AS p_latency
      FROM bs),
qc AS (SELECT *, coalesce(p_latency > 1.0, false) AS condition FROM q),""" + _state_sql(
        "qc", keys, "eval_ts", 12 * 3600 * 1_000_000, "eval_ts, round(p_latency, 6) AS p_latency")


@register("alert_p99_latency", _p99_sql())
def q_alert_p99_latency(spark, sf_dir):
    """ALR-02: p99 latency (histogram quantile) over a trailing 1-day window > 1 s, held 12 hours."""
    return MO.alert_p99_latency(fixture_df(spark, sf_dir, "pred"), window="1 day", step="6 hours", hold="12 hours")


@register("alert_data_drift", with_clause("pred").rstrip() + TIMELINE_SQL + """,
ev AS (SELECT ts AS eval_ts, max(score) AS max_score FROM tl GROUP BY ts),
evc AS (SELECT *, max_score > 0.02 AS condition FROM ev),""" + _state_sql(
    "evc", [], "eval_ts", 2 * 86400 * 1_000_000, "eval_ts, round(max_score, 6) AS max_score"))
def q_alert_data_drift(spark, sf_dir):
    """ALR-03: max drift score > 0.02 held 2 days, evaluated at each daily score."""
    return MO.alert_data_drift(_timeline(spark, sf_dir), threshold=0.02, hold="2 days")


@register("alert_accuracy", FV + "," + ROLL_SQL + """,
evc AS (SELECT model_version, "timestamp" AS eval_ts, rn, rolling_accuracy, rolling_accuracy < 0.7 AS condition
        FROM roll),
isl AS (SELECT *, sum(CASE WHEN condition THEN 0 ELSE 1 END) OVER (PARTITION BY model_version ORDER BY rn
                    ROWS UNBOUNDED PRECEDING) AS g FROM evc),
st AS (SELECT model_version, g, min(eval_ts) AS run_start FROM isl WHERE condition GROUP BY ALL)
SELECT model_version, eval_ts, round(rolling_accuracy, 6) AS rolling_accuracy, condition,
       CASE WHEN condition AND epoch_us(eval_ts) - epoch_us(run_start) >= 900000000 THEN 'firing'
            WHEN condition THEN 'pending' ELSE 'inactive' END AS state
FROM isl LEFT JOIN st USING (model_version, g)""")
def q_alert_accuracy(spark, sf_dir):
    """ALR-04: rolling accuracy < 0.70 held 15 minutes, per model version."""
    return MO.alert_accuracy(MO.rolling_accuracy(view(spark, sf_dir)))
