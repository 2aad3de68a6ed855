"""Retraining decisions and retraining-set preparation.

All decisions are expressions over one-row statistic frames (never wall-clock time:
``as_of`` is always a parameter). Preparing a retraining set is a by-name bag union
of the original table with the expanded labeled feedback, labels normalised to 0/1
first on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import recode_label
from ..session import cut_lineage
from .feedback import expand_features, labeled_data, should_trigger_retraining

# ---- fixed values: retraining defaults ----
MIN_NEW_SAMPLES = 1000
WINDOW_DAYS = 90
MIN_TRAIN_SAMPLES = 1000
MAX_RETRAIN_FREQUENCY_HOURS = 24
MANUAL_MIN_LABELED = 100
LEAST_SAMPLES = 100
LEAST_WINDOW_DAYS = 7
STRATEGIES = ("full", "incremental", "windowed")
TRIGGERS = ("scheduled", "drift_based", "data_based", "manual")
# ---- end fixed values ----


def feedback_rows(view: DataFrame, keys: Sequence[str], since=None, target: str = "Result") -> DataFrame:
    """Labeled feedback expanded to feature columns (+ target, 0/1), optionally newer than ``since``."""
    lab = labeled_data(view, start=None, parse=True)
    if since is not None:
        lab = lab.filter(F.col("timestamp") > F.lit(since).cast(view.schema["timestamp"].dataType))
    return expand_features(lab, keys, label_col="actual_label", target=target) \
        .withColumn(target, recode_label(target).cast("long"))


def retrain_full(original: DataFrame, view: DataFrame, keys: Sequence[str], target: str = "Result") -> DataFrame:
    """RET-01: original (target recoded -1 -> 0) UNION ALL labeled feedback, by column name."""
    orig = original.withColumn(target, recode_label(target).cast("long"))
    fb = feedback_rows(view, keys, target=target)
    return orig.unionByName(fb, allowMissingColumns=True)


def retrain_incremental(original: DataFrame, view: DataFrame, keys: Sequence[str], since=None,
                        target: str = "Result") -> DataFrame:
    """RET-02: original plus only the feedback newer than the last run (``since``);
    ``since=None`` is the full set."""
    orig = original.withColumn(target, recode_label(target).cast("long"))
    return orig.unionByName(feedback_rows(view, keys, since=since, target=target), allowMissingColumns=True)


def retrain_windowed(original: DataFrame, view: DataFrame, keys: Sequence[str], as_of, window_days: int = WINDOW_DAYS,
                     min_train_samples: int = MIN_TRAIN_SAMPLES, target: str = "Result") -> tuple[DataFrame, str]:
    """RET-03: labeled feedback from the last ``window_days`` before ``as_of``; with fewer
    than ``min_train_samples`` rows falls back to the full set. Returns (frame, strategy used).
    The labeled rows are computed once, for the count and the set."""
    view = cut_lineage(view.filter(F.col("actual_label").isNotNull()))
    tcol = view.schema["timestamp"].dataType
    cutoff = F.lit(as_of).cast(tcol) - F.expr(f"INTERVAL {int(window_days)} DAYS")
    lab = labeled_data(view, parse=True).filter(F.col("timestamp") >= cutoff)
    n = lab.count()  # one metric row reaches the driver: decides the plan
    if n < min_train_samples:
        return retrain_full(original, view, keys, target), "full"
    out = expand_features(lab, keys, label_col="actual_label", target=target) \
        .withColumn(target, recode_label(target).cast("long"))
    return out, "windowed"


def check_bounds(min_samples: int | None = None, accuracy_threshold: float | None = None,
                 drift_threshold: float | None = None, window_days: int | None = None) -> None:
    """Retraining parameters outside their bounds are an error."""
    if min_samples is not None and min_samples < LEAST_SAMPLES:
        raise ValueError(f"the least number of samples must be {LEAST_SAMPLES} or more, not {min_samples}")
    for name, value in (("accuracy", accuracy_threshold), ("drift", drift_threshold)):
        if value is not None and not 0 < value < 1:
            raise ValueError(f"the {name} threshold must lie between 0 and 1, not be {value}")
    if window_days is not None and window_days < LEAST_WINDOW_DAYS:
        raise ValueError(f"the window must be {LEAST_WINDOW_DAYS} days or more, not {window_days}")


def frequency_guard(runs: DataFrame, as_of, max_hours: int = MAX_RETRAIN_FREQUENCY_HOURS,
                    ts_col: str = "run_ts") -> DataFrame:
    """RET-04: one row (last_run_ts, hours_since, allowed): blocked iff the last run is
    less than ``max_hours`` before ``as_of`` (strict); no run yet -> allowed."""
    now = F.lit(as_of).cast(runs.schema[ts_col].dataType)
    last = runs.agg(F.max(ts_col).alias("last_run_ts"))
    secs = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_run_ts").cast("timestamp"))
    return last.select("last_run_ts", (secs / 3.6e9).alias("hours_since"),
                       (F.col("last_run_ts").isNull() | (secs >= F.lit(max_hours * 3600 * 1_000_000)))
                       .alias("allowed"))


def retrain_conditions(stats: DataFrame, min_new_samples: int = MIN_NEW_SAMPLES, accuracy_threshold: float = 0.75,
                       force: bool = False) -> DataFrame:
    """RET-05: feedback trigger first; else enough labeled rows; else 'Insufficient data'.
    ``force`` overrides."""
    trig = should_trigger_retraining(stats, min_new_samples, accuracy_threshold)
    n = F.col("labeled_records")
    retrain = F.col("should_retrain") | (n >= min_new_samples)
    reason = (F.when(F.col("should_retrain"), F.col("reason"))
              .when(n >= min_new_samples, F.concat(F.lit("Scheduled retraining - "), n.cast("string"),
                                                   F.lit(" labeled samples available")))
              .otherwise(F.concat(F.lit("Insufficient data: "), n.cast("string"),
                                  F.lit(f" labeled samples (minimum: {min_new_samples})"))))
    if force:
        return trig.select("labeled_records", F.lit(True).alias("should_retrain"),
                           F.lit("Forced retraining via --force flag").alias("reason"))
    return trig.select("labeled_records", retrain.alias("should_retrain"), reason.alias("reason"))


def manual_retrain_gate(stats: DataFrame, min_labeled: int = MANUAL_MIN_LABELED) -> DataFrame:
    """RET-06: fewer than ``min_labeled`` labeled rows -> 'insufficient_data', else 'accepted'."""
    n = F.col("labeled_records")
    return stats.select(n, F.when(n < min_labeled, F.lit("insufficient_data")).otherwise(F.lit("accepted"))
                        .alias("status"),
                        F.when(n < min_labeled, F.concat(F.lit("Only "), n.cast("string"),
                                                         F.lit(f" labeled samples available (minimum: {min_labeled})")))
                        .otherwise(F.lit("Retraining triggered")).alias("message"))


ALERT_SCHEMA = ("struct<status:string, alerts:array<struct<labels:struct<alertname:string>, "
                "annotations:struct<description:string>>>>")


def alert_reason(payload_col: str = "payload"):
    """RET-07: reason text of an alert batch: ``alertname: description`` of the first
    alert (defaults 'Unknown' / ''), 'Webhook trigger' without alerts."""
    parsed = F.from_json(F.col(payload_col), ALERT_SCHEMA)
    first = F.get(parsed["alerts"], 0)
    name = F.coalesce(first["labels"]["alertname"], F.lit("Unknown"))
    desc = F.coalesce(first["annotations"]["description"], F.lit(""))
    return F.when(first.isNull(), F.lit("Webhook trigger")).otherwise(F.concat(name, F.lit(": "), desc))


def last_run(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RET-08: the latest run (per ``by``) from the append-only run log."""
    cols = [c for c in runs.columns if c not in by]
    return (runs.groupBy(*by).agg(F.max_by(F.struct(*cols), F.col("run_ts")).alias("_r"),
                                  F.count(F.lit(1)).alias("n_runs"))
            .select(*by, "_r.*", "n_runs"))


RUN_LOG = "run_ts timestamp, trigger_type string, reason string, strategy string, n_rows bigint"


def read_runs(spark, runs_path: str) -> DataFrame:
    """RET-08: the run log; empty before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(runs_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RUN_LOG)
    return spark.read.schema(RUN_LOG).parquet(runs_path)


def append_run(runs_path: str, spark, run_ts, trigger_type: str, reason: str, strategy: str, n_rows: int) -> None:
    """RET-08: append one run record to the Parquet run log."""
    if trigger_type not in TRIGGERS or strategy not in STRATEGIES:
        raise ValueError("unknown trigger type or strategy")
    row = spark.createDataFrame([(run_ts, trigger_type, reason, strategy, int(n_rows))], RUN_LOG)
    row.write.mode("append").parquet(runs_path)


VERSION_COLUMNS = ("n_rows", "hash_sum", "hash_sum2")


def data_version(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RET-09: order-free content version (by..., n_rows, hash_sum, hash_sum2). Each row is written as
    text, every value behind its length and NULL as a mark of its own, so that no two rows read
    alike; two 60-bit parts of its hash are added up. Sums don't depend on row order and
    partitioning, repeated rows count as often as they occur, and versions of parts add up to the
    version of the whole (``add_versions``). With ``by``, e.g. a snapshot id, a version for each
    group, over the other columns."""
    values = [F.col(f"`{c}`").cast("string") for c in df.columns if c not in by]
    h = F.md5(F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("n")) for v in values]))
    number = lambda start: F.conv(F.substring(h, start, 15), 16, 10).cast("long").cast("decimal(38,0)")
    total = lambda start: F.coalesce(F.sum(number(start)), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), total(1).alias("hash_sum"), total(16).alias("hash_sum2"))


def add_versions(versions: DataFrame, sign: str | None = None) -> DataFrame:
    """The version of all parts together, from theirs; parts whose ``sign`` is -1 are taken away. So a
    version is kept up to date by the rows that come and go, and the others aren't read."""
    s = F.col(sign) if sign else F.lit(1)
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)") * s), F.lit(0)).cast("decimal(38,0)")
    return versions.agg(total("n_rows").cast("long").alias("n_rows"), *[total(c).cast("string").alias(c) for c in VERSION_COLUMNS[1:]])
