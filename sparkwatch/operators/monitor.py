"""Online monitoring as tables: rolling accuracy and concept drift, prediction-shift
timelines, the drift report, metric series (counters / gauges / histograms) and the
alert rules evaluated over event time.

Scale notes
* Rolling windows over labeled pairs and alert windows over time slots run inside
  blocks of a key's time axis, with the last rows before each block carried along
  (``ranking.trailing_sums``) - a hot model version is never one task.
* Alert ``for:`` holds are gaps-and-islands over the same blocks (``ranking.Blocks.runs``): the
  windows of an alert and of its hold run in one stage.
* Evaluation grids have one row per series and time slot: their size grows with the
  time span, not with the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import class_name, safe_div
from .drift import class_distribution, data_drift, data_drift_summary, model_drift
from ..session import cut_lineage
from .ranking import blocked, runs_of_true, trailing_sums

# ---- fixed values: monitoring defaults ----
WINDOW_SIZE = 100
EXPECTED_ACCURACY = 0.85
ACCURACY_DROP_THRESHOLD = 0.1
CHECK_INTERVAL = 50
MODEL_DRIFT_THRESHOLD = 0.2
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
ERROR_RATE_THRESHOLD = 0.05       # errors per second
ERROR_RATE_WINDOW = "5 minutes"
ERROR_RATE_HOLD = "5 minutes"
LATENCY_QUANTILE = 0.99
LATENCY_THRESHOLD = 1.0           # seconds
LATENCY_WINDOW = "5 minutes"
LATENCY_HOLD = "5 minutes"
DRIFT_ALERT_THRESHOLD = 0.5
DRIFT_ALERT_HOLD = "10 minutes"
ACCURACY_ALERT_THRESHOLD = 0.70
ACCURACY_ALERT_HOLD = "15 minutes"
EVAL_STEP = "30 seconds"
RECOMMEND_DATA = "Data drift detected. Consider retraining the model with recent data."
RECOMMEND_MODEL = "Prediction distribution shifted. Investigate if this reflects real changes."
RECOMMEND_CONCEPT = "Accuracy dropped by {drop}. Retrain model immediately."
RECOMMEND_NONE = "No significant drift detected. Model is stable."
# ---- end fixed values ----


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(float(n) * mult)


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


# ------------------------------------------------------------------ rolling accuracy / concept drift

def rolling_accuracy(pairs: DataFrame, keys: Sequence[str] = ("model_version",), ts_col: str = "timestamp",
                     id_col: str = "request_id", window: int = WINDOW_SIZE, pred_col: str = "prediction",
                     label_col: str = "actual_label", blocks: int | None = None) -> DataFrame:
    """DRF-08/09: accuracy over the last ``window`` labeled pairs in (ts, id) order, per key:
    (keys..., id, ts, rn, window_fill, rolling_accuracy). Unlabeled rows are ignored."""
    keys = list(keys)
    lab = pairs.filter(F.col(label_col).isNotNull()).select(
        *keys, id_col, ts_col, F.when(F.col(pred_col) == F.col(label_col), 1).otherwise(0).alias("hit"))
    # narrow rows that several branches read (sizes, windows, carried rows): the view is computed once
    lab = cut_lineage(lab)
    t = trailing_sums(lab, keys, [ts_col, id_col], ["hit"], window, block_expr=_micros(F.col(ts_col)).cast("double"),
                      blocks=blocks)
    return t.select(*keys, id_col, ts_col, "rn", F.col("fill").cast("long").alias("window_fill"),
                    (F.col("win_hit") / F.col("fill")).alias("rolling_accuracy"))


def concept_drift(rolling: DataFrame, keys: Sequence[str] = ("model_version",), expected: float = EXPECTED_ACCURACY,
                  drop_threshold: float = ACCURACY_DROP_THRESHOLD, min_fill: int = 1) -> DataFrame:
    """DRF-10: flag true if the running accuracy ever dropped more than ``drop_threshold``
    below ``expected`` (windows with at least ``min_fill`` pairs); plus the final
    rolling accuracy and drop: (keys..., n_pairs, concept_drift_detected, rolling_accuracy, accuracy_drop)."""
    drop = F.lit(expected) - F.col("rolling_accuracy")
    out = rolling.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.bool_or((drop > drop_threshold) & (F.col("window_fill") >= min_fill)), F.lit(False))
        .alias("concept_drift_detected"),
        F.max_by("rolling_accuracy", "rn").alias("rolling_accuracy"))
    return out.withColumn("accuracy_drop", F.lit(expected) - F.col("rolling_accuracy"))


def block_model_drift(baseline_preds: DataFrame, current_preds: DataFrame, keys: Sequence[str] = ("model_version",),
                      ts_col: str = "ts", id_col: str = "request_id", pred_col: str = "prediction",
                      interval: int = CHECK_INTERVAL, threshold: float = MODEL_DRIFT_THRESHOLD,
                      blocks: int | None = None) -> DataFrame:
    """DRF-12: prediction-share shift of every block of ``interval`` consecutive current
    predictions (per key, in (ts, id) order) against that key's baseline shares:
    (keys..., block, n, class_distribution_shift, model_drift_detected)."""
    keys = list(keys)
    base = class_distribution(baseline_preds, pred_col, keys).withColumnRenamed("share", "p_b")
    cur = cut_lineage(current_preds.select(*keys, ts_col, id_col, pred_col))
    numbered = trailing_sums(cur, keys, [ts_col, id_col], [], 1, block_expr=_micros(F.col(ts_col)).cast("double"), blocks=blocks)
    numbered = numbered.withColumn("block", F.floor((F.col("rn") - 1) / interval).cast("long"))
    cnt = numbered.groupBy(*keys, "block", pred_col).agg(F.count(F.lit(1)).alias("_n"))
    tot = cnt.groupBy(*keys, "block").agg(F.sum("_n").alias("n"))
    shares = (cnt.join(tot, keys + ["block"]).select(
        *keys, "block", F.col(pred_col).cast("long").cast("string").alias("class"), (F.col("_n") / F.col("n")).alias("p_c")))
    # every block meets every baseline class of its key (fan-out bounded by #classes)
    grid = tot.join(base, keys, "inner")
    j = grid.join(shares, keys + ["block", "class"], "left")
    out = j.groupBy(*keys, "block", "n").agg(
        F.sum(F.abs(F.coalesce("p_c", F.lit(0.0)) - F.col("p_b"))).alias("class_distribution_shift"))
    return out.withColumn("model_drift_detected", F.col("class_distribution_shift") > F.lit(threshold))


def class_shift_timeline(baseline_preds: DataFrame, current_preds: DataFrame, period: str = "1 day",
                         ts_col: str = "ts", pred_col: str = "prediction") -> DataFrame:
    """Drift-score series: the class-share shift of each ``period`` of current predictions
    against the baseline shares. (ts = period end, feature, drift_type, score)."""
    base = class_distribution(baseline_preds, pred_col).withColumnRenamed("share", "p_b")
    sec = _seconds(period)
    slot = F.floor(_micros(F.col(ts_col)) / F.lit(sec * 1_000_000)).cast("long")
    cur = current_preds.select(slot.alias("slot"), F.col(pred_col).cast("long").cast("string").alias("class"))
    cnt = cur.groupBy("slot", "class").agg(F.count(F.lit(1)).alias("_n"))
    tot = cnt.groupBy("slot").agg(F.sum("_n").alias("n"))
    sh = cnt.join(tot, "slot").select("slot", "class", (F.col("_n") / F.col("n")).alias("p_c"))
    # sum over baseline classes of |p_c - p_b| = 1 + sum over classes seen in both of (|p_c - p_b| - p_b)
    # (baseline shares sum to 1, an absent class contributes p_b): an equi-join on class only.
    both = sh.join(base, "class", "inner").groupBy("slot").agg(
        F.sum(F.abs(F.col("p_c") - F.col("p_b")) - F.col("p_b")).alias("_d"))
    out = tot.join(both, "slot", "left").select("slot", (F.lit(1.0) + F.coalesce("_d", F.lit(0.0))).alias("score"))
    return out.select(F.timestamp_micros((F.col("slot") + 1) * F.lit(sec * 1_000_000)).alias("ts"),
                      F.lit("class_distribution").alias("feature"), F.lit("distribution_shift").alias("drift_type"),
                      "score")


def drift_report(baseline_features: DataFrame, current_features: DataFrame, features: Sequence[str],
                 baseline_preds: DataFrame, current_preds: DataFrame, pairs: DataFrame | None = None,
                 method: str = "psi", as_of: str | None = None, expected: float = EXPECTED_ACCURACY,
                 drop_threshold: float = ACCURACY_DROP_THRESHOLD, pred_col: str = "prediction") -> DataFrame:
    """DRF-11: one row - data / model / concept drift flags, feature score map, class
    shift, final rolling accuracy and drop, recommendation list."""
    data = data_drift_summary(data_drift(baseline_features, current_features, features, method=method))
    model = model_drift(baseline_preds, current_preds, pred_col)
    if pairs is not None:
        concept = concept_drift(rolling_accuracy(pairs, keys=()), keys=(), expected=expected,
                                drop_threshold=drop_threshold)
    else:
        concept = current_preds.sparkSession.createDataFrame(
            [(0, False, None, None)], "n_pairs bigint, concept_drift_detected boolean, rolling_accuracy double, "
                                      "accuracy_drop double")
    # three one-row frames merged without a join: union by name, then first non-NULL per column
    parts = data.unionByName(model, allowMissingColumns=True).unionByName(concept, allowMissingColumns=True)
    row = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
    drop_txt = F.concat(F.format_string("%.2f", F.round(F.col("accuracy_drop") * 100, 2)), F.lit("%"))
    recs = F.array_compact(F.array(
        F.when(F.col("data_drift_detected"), F.lit(RECOMMEND_DATA)),
        F.when(F.col("model_drift_detected"), F.lit(RECOMMEND_MODEL)),
        F.when(F.col("concept_drift_detected"),
               F.concat(F.lit(RECOMMEND_CONCEPT.split("{drop}")[0]), drop_txt,
                        F.lit(RECOMMEND_CONCEPT.split("{drop}")[1]))),
        F.when(~(F.col("data_drift_detected") | F.col("model_drift_detected") | F.col("concept_drift_detected")),
               F.lit(RECOMMEND_NONE))))
    ts = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return row.select(ts.alias("timestamp"), "data_drift_detected", "model_drift_detected", "concept_drift_detected",
                      "feature_drift_scores", "feature_drift_type", "class_distribution_shift", "rolling_accuracy", "accuracy_drop",
                      recs.alias("recommendations"))


# ------------------------------------------------------------------ metric series

def predictions_total(log: DataFrame) -> DataFrame:
    """MON-01: predictions per model_version and endpoint."""
    return log.groupBy("model_version", "endpoint").agg(F.count(F.lit(1)).alias("value"))


def prediction_class_total(log: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """MON-02: predictions per class label and model_version."""
    return (log.groupBy(class_name(pred_col).alias("class_label"), "model_version")
            .agg(F.count(F.lit(1)).alias("value")))


def _bucket_index(lat: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound >= latency (len(bounds) = +Inf)."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < lat))


def latency_histogram(log: DataFrame, keys: Sequence[str] = ("model_version", "endpoint"),
                      lat_col: str = "latency_s", bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """MON-03: cumulative ``le`` buckets (bounds + +Inf) with sum and count per series:
    (keys..., le, bucket_count, sum, count). ``le`` is text ('0.01' ... '+Inf')."""
    keys = list(keys)
    obs = log.filter(F.col(lat_col).isNotNull())
    idx = _bucket_index(F.col(lat_col), bounds)
    per = obs.groupBy(*keys).agg(*[F.count(F.when(idx == i, 1)).alias(f"_b{i}") for i in range(len(bounds) + 1)],
                                 F.sum(lat_col).alias("sum"), F.count(F.lit(1)).alias("count"))
    les = [str(b) for b in bounds] + ["+Inf"]
    cum = [sum((F.col(f"_b{j}") for j in range(i + 1)), F.lit(0)) for i in range(len(les))]
    rows = F.array(*[F.struct(F.lit(les[i]).alias("le"), cum[i].cast("long").alias("bucket_count"))
                     for i in range(len(les))])
    return per.select(*keys, F.explode(rows).alias("_r"), "sum", "count").select(*keys, "_r.*", "sum", "count")


def errors_total(log: DataFrame) -> DataFrame:
    """MON-04: errors per error_type and model_version."""
    return (log.filter(F.col("error_type").isNotNull())
            .groupBy("error_type", "model_version").agg(F.count(F.lit(1)).alias("value")))


def drift_gauge(timeline: DataFrame) -> DataFrame:
    """MON-05: latest score per (feature, drift_type)."""
    return timeline.groupBy("feature", "drift_type").agg(F.max_by("score", "ts").alias("value"),
                                                         F.max("ts").alias("ts"))


def feature_drift_series(scores: DataFrame, ts: str) -> DataFrame:
    """The scores of ``drift.data_drift`` as a part of a drift series: (ts, feature, drift_type, score)."""
    return scores.select(F.lit(ts).cast("timestamp").alias("ts"), "feature", F.col("method").alias("drift_type"), "score")


def accuracy_gauge(rolling: DataFrame, window: int = WINDOW_SIZE) -> DataFrame:
    """MON-06: latest rolling accuracy (and window fill) per model_version and window size."""
    return (rolling.groupBy("model_version")
            .agg(F.max_by("rolling_accuracy", "rn").alias("value"), F.max_by("window_fill", "rn").alias("in_window"))
            .withColumn("window_size", F.lit(str(window))))


# ------------------------------------------------------------------ alert rules

def _held(eval_ts: Column, hold: str) -> Column:
    """The state of a row with ``condition`` and ``run_start`` evaluated at ``eval_ts``."""
    firing = F.col("condition") & ((_micros(eval_ts) - _micros(F.col("run_start"))) >= F.lit(_seconds(hold) * 1_000_000))
    return F.when(firing, F.lit("firing")).when(F.col("condition"), F.lit("pending")).otherwise(F.lit("inactive")).alias("state")


#: Slots that one array of the evaluation grid holds at most.
GRID_STEP = 4_096


def _slot_grid(events: DataFrame, keys: Sequence[str], ts_col: str, step_s: int, k: int,
               aggs: Sequence[Column]) -> DataFrame:
    """Per series: one row per evaluation slot from its first event slot to its last + k - 1,
    with the per-slot aggregates (0 when the slot is empty)."""
    slot = F.floor(_micros(F.col(ts_col)) / F.lit(step_s * 1_000_000)).cast("long")
    per = cut_lineage(events.groupBy(*keys, slot.alias("slot")).agg(*aggs))
    rng = per.groupBy(*keys).agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
    # in two steps, so that no array is long, however far apart the first and last event are
    last = F.col("_hi") + (k - 1)
    steps = rng.select(*keys, last.alias("_last"), F.explode(F.sequence("_lo", last, F.lit(GRID_STEP))).alias("_from"))
    grid = steps.select(*keys, F.explode(F.sequence("_from", F.least(F.col("_from") + (GRID_STEP - 1), F.col("_last")))).alias("slot"))
    out = grid.join(per, list(keys) + ["slot"], "left")
    # read by the sizes of series and by the windows: the events are read once
    return cut_lineage(out.fillna(0, subset=[c for c in per.columns if c not in list(keys) + ["slot"]]))


def _eval_ts(step_s: int) -> Column:
    return F.timestamp_micros((F.col("slot") + 1) * F.lit(step_s * 1_000_000)).alias("eval_ts")


def alert_error_rate(log: DataFrame, keys: Sequence[str] = ("model_version",), ts_col: str = "ts",
                     threshold: float = ERROR_RATE_THRESHOLD, window: str = ERROR_RATE_WINDOW,
                     step: str = EVAL_STEP, hold: str = ERROR_RATE_HOLD) -> DataFrame:
    """ALR-01: error rate (errors / window seconds) over the trailing window at every
    evaluation step; condition rate > threshold; firing after it held for ``hold``:
    (keys..., eval_ts, rate, condition, state)."""
    keys = list(keys)
    w_s, step_s = _seconds(window), _seconds(step)
    k = max(1, w_s // step_s)
    errs = log.filter(F.col("error_type").isNotNull())
    grid = _slot_grid(errs, keys, ts_col, step_s, k, [F.count(F.lit(1)).alias("n")])
    windows = blocked(grid, keys, ["slot"]).trailing(["n"], k)
    rate = F.col("win_n") / F.lit(float(w_s))
    ev = windows.frame.select(*keys, "_blk", "slot", _eval_ts(step_s), rate.alias("rate"), (rate > F.lit(threshold)).alias("condition"))
    held = replace(windows, frame=ev).runs("condition", "eval_ts").frame
    return held.select(*keys, "eval_ts", "rate", "condition", _held(F.col("eval_ts"), hold))


def histogram_quantile(q: float, counts: Column, bounds: Sequence[float]) -> Column:
    """Quantile from per-bucket counts (array, last = +Inf) with linear interpolation inside
    the bucket; lower edge of the first bucket is 0; a rank in +Inf returns the highest
    finite bound; NULL when there are no observations."""
    n = len(bounds)
    cum = F.transform(counts, lambda x, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"),
                                                       lambda a, y: a + y))
    total = F.element_at(cum, -1)
    rank = F.lit(q) * total
    # first finite bucket whose cumulative count reaches the rank (n = +Inf)
    b = F.size(F.filter(F.slice(cum, 1, n), lambda c: c < rank))
    bnd = F.array(*[F.lit(float(x)) for x in bounds])
    upper = F.get(bnd, b)
    lower = F.when(b == 0, F.lit(0.0)).otherwise(F.get(bnd, b - 1))
    prev = F.when(b == 0, F.lit(0)).otherwise(F.get(cum, b - 1))
    cnt = F.get(counts, b)
    val = lower + (upper - lower) * safe_div(rank - prev, cnt)
    return (F.when(total == 0, F.lit(None).cast("double"))
            .when(b >= n, F.lit(float(bounds[-1])))
            .otherwise(val))


def alert_p99_latency(log: DataFrame, keys: Sequence[str] = ("model_version", "endpoint"), ts_col: str = "ts",
                      lat_col: str = "latency_s", quantile: float = LATENCY_QUANTILE,
                      threshold: float = LATENCY_THRESHOLD, window: str = LATENCY_WINDOW, step: str = EVAL_STEP,
                      hold: str = LATENCY_HOLD, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """ALR-02: histogram quantile of latency over the trailing window per series, condition
    > threshold, held for ``hold``: (keys..., eval_ts, p_latency, condition, state)."""
    keys = list(keys)
    w_s, step_s = _seconds(window), _seconds(step)
    k = max(1, w_s // step_s)
    obs = log.filter(F.col(lat_col).isNotNull())
    idx = _bucket_index(F.col(lat_col), bounds)
    nb = len(bounds) + 1
    grid = _slot_grid(obs, keys, ts_col, step_s, k, [F.count(F.when(idx == i, 1)).alias(f"b{i}") for i in range(nb)])
    windows = blocked(grid, keys, ["slot"]).trailing([f"b{i}" for i in range(nb)], k)
    counts = F.array(*[F.col(f"win_b{i}").cast("long") for i in range(nb)])
    ev = windows.frame.select(*keys, "_blk", "slot", _eval_ts(step_s), histogram_quantile(quantile, counts, bounds).alias("p_latency"))
    ev = ev.withColumn("condition", F.coalesce(F.col("p_latency") > F.lit(threshold), F.lit(False)))
    held = replace(windows, frame=ev).runs("condition", "eval_ts").frame
    return held.select(*keys, "eval_ts", "p_latency", "condition", _held(F.col("eval_ts"), hold))


def alert_data_drift(timeline: DataFrame, threshold: float = DRIFT_ALERT_THRESHOLD,
                     hold: str = DRIFT_ALERT_HOLD) -> DataFrame:
    """ALR-03: max drift score over all features at each evaluation (each time scores are
    written), condition > threshold held for ``hold``: (eval_ts, max_score, condition, state)."""
    ev = timeline.groupBy(F.col("ts").alias("eval_ts")).agg(F.max("score").alias("max_score"))
    ev = cut_lineage(ev.withColumn("condition", F.col("max_score") > F.lit(threshold)))
    held = runs_of_true(ev, [], ["eval_ts"], "condition", "eval_ts", block_expr=_micros(F.col("eval_ts")).cast("double"))
    return held.select("eval_ts", "max_score", "condition", _held(F.col("eval_ts"), hold))


def alert_accuracy(rolling: DataFrame, keys: Sequence[str] = ("model_version",), ts_col: str = "timestamp",
                   threshold: float = ACCURACY_ALERT_THRESHOLD, hold: str = ACCURACY_ALERT_HOLD) -> DataFrame:
    """ALR-04: rolling accuracy < threshold held for ``hold`` of event time, evaluated at every
    update of the gauge: (keys..., eval_ts, rolling_accuracy, condition, state)."""
    keys = list(keys)
    ev = rolling.select(*keys, F.col(ts_col).cast("timestamp").alias("eval_ts"), "rolling_accuracy", "rn")
    ev = cut_lineage(ev.withColumn("condition", F.col("rolling_accuracy") < F.lit(threshold)))
    held = runs_of_true(ev, keys, ["rn"], "condition", "eval_ts", block_expr=F.col("rn").cast("double"))
    return held.select(*keys, "eval_ts", "rolling_accuracy", "condition", _held(F.col("eval_ts"), hold))
