"""Prediction / ground-truth feedback store on append-only logs.

Instead of a mutable keyed row store, two logs are appended to (Parquet, partitioned
by date and model version so readers prune):

* ``prediction_log``: one row per stored prediction; storing an id again *replaces*
  the prediction and clears any label given before;
* ``label_log``: one row per ground-truth update; the last update wins, an update for
  an unknown id changes nothing.

The feedback *view* is derived: latest prediction per id (``max_by`` of a struct, combined
before the shuffle; Spark plans it as a sort aggregate, as the buffer isn't of fixed width),
latest label per id, joined on ``request_id`` (both sides are already hash-partitioned by the
id after their aggregation) keeping the label only if it is not older than the prediction it
would update.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import safe_div
from ..session import cut_lineage

PREDICTION_COLS = ["request_id", "ts", "prediction", "features", "model_version", "confidence"]
FEATURES_MAP = T.MapType(T.StringType(), T.DoubleType())

# ---- fixed values: defaults of the feedback rules ----
EXPORT_MIN_SAMPLES = 100
TRIGGER_MIN_LABELED = 1000
TRIGGER_ACCURACY = 0.75
# ---- end fixed values ----
#: Map key of records without a model version.
NO_VERSION = "<none>"


def _latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    return (df.groupBy(key)
            .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
            .select(key, "_r.*"))


def latest_predictions(pred_log: DataFrame, tie_break: Sequence[str] = ("prediction", "model_version")) -> DataFrame:
    """FBK-01: one row per request_id, the most recently stored prediction."""
    return _latest(pred_log, "request_id", ["ts", *tie_break])


def latest_labels(label_log: DataFrame) -> DataFrame:
    """Most recent ground-truth update per request_id."""
    return _latest(label_log, "request_id", ["label_ts", "actual_label"])


def feedback_view(pred_log: DataFrame, label_log: DataFrame) -> DataFrame:
    """FBK-02: latest prediction per id with its ground truth; a label given before the
    prediction was (re-)stored does not attach. Columns: request_id, timestamp,
    prediction, actual_label, user_feedback, features, model_version, confidence,
    created_at (+ any extra prediction-log columns)."""
    p = latest_predictions(pred_log)
    lab = latest_labels(label_log).select("request_id", "label_ts", "actual_label", "user_feedback")
    j = p.join(lab, "request_id", "left")
    attach = F.col("label_ts").isNotNull() & (F.col("label_ts") >= F.col("ts"))
    extra = [c for c in p.columns if c not in PREDICTION_COLS]
    return j.select("request_id", F.col("ts").alias("timestamp"), "prediction",
                    F.when(attach, F.col("actual_label")).alias("actual_label"),
                    F.when(attach, F.col("user_feedback")).alias("user_feedback"),
                    "features", "model_version", "confidence", F.col("ts").alias("created_at"), *extra)


def unmatched_feedback(pred_log: DataFrame, label_log: DataFrame) -> DataFrame:
    """FBK-03: label updates for ids that were never stored."""
    ids = pred_log.select("request_id").distinct()
    return label_log.join(ids, "request_id", "left_anti")


def labeled_data(view: DataFrame, start=None, end=None, model_version: str | None = None,
                 limit: int | None = None, parse: bool = True, newest_first: bool = False) -> DataFrame:
    """FBK-04: labeled rows (FLT-03), optional inclusive time range (FLT-04) and version
    (FLT-05), newest first where asked for (SRT-01), at most ``limit`` rows, the newest
    (TOP-01; 0/None = all), features parsed to a map (PRJ-05)."""
    df = view.filter(F.col("actual_label").isNotNull())
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start).cast(view.schema["timestamp"].dataType))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(end).cast(view.schema["timestamp"].dataType))
    if model_version:
        df = df.filter(F.col("model_version") == model_version)
    feats = parse_features(F.col("features")) if parse else F.col("features")
    df = df.select("request_id", "timestamp", "prediction", "actual_label", feats.alias("features"),
                   "model_version", "confidence")
    if limit or newest_first:
        df = df.orderBy(F.col("timestamp").desc(), F.col("request_id"))
    return df.limit(int(limit)) if limit else df


def parse_features(c: Column) -> Column:
    """PRJ-05: JSON text -> map<string,double>."""
    return F.from_json(c, FEATURES_MAP)


def serialize_features(c: Column) -> Column:
    """PRJ-06: map -> JSON text."""
    return F.to_json(c)


#: Columns that the keys of payloads may become.
MAX_KEYS = 2_000


def feature_keys(df: DataFrame, map_col: str = "features") -> DataFrame:
    """PRJ-07: (key, n_rows, n_numbers): the keys that payloads hold, in how many rows, and with how
    many values that are numbers. Combined before the shuffle: one row per key."""
    pairs = df.select(F.explode(F.col(map_col)).alias("key", "value"))
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.expr("try_cast(value as double)")).alias("n_numbers"))


def expand_features(df: DataFrame, keys: Sequence[str] | None = None, map_col: str = "features", label_col: str | None = "actual_label",
                    target: str = "Result", undeclared: str = "raise", keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-07: ``keep``, one double column per key (absent key -> NULL) and the label as ``target``.
    Without ``keys`` the columns are the union of the keys that the rows hold, in their order;
    more than MAX_KEYS are an error. With ``keys``, a row that holds another key is an error when
    it is read, unless ``undeclared`` is "drop"; ``feature_keys`` counts what there is."""
    if undeclared not in ("raise", "drop"):
        raise ValueError("undeclared is 'raise' or 'drop'")
    if keys is None:
        found = [r["key"] for r in feature_keys(df, map_col).select("key").limit(MAX_KEYS + 1).collect()]
        if len(found) > MAX_KEYS:
            raise ValueError(f"the rows hold more than {MAX_KEYS} feature keys")
        keys = sorted(found)
    elif undeclared == "raise":
        other = F.filter(F.map_keys(map_col), lambda k: ~k.isin(list(keys)))
        message = F.concat(F.lit("feature keys that aren't declared: "), F.array_join(other, ", "))
        df = df.filter(F.when(F.coalesce(F.size(other), F.lit(0)) > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    cols = [*[F.col(c) for c in keep], *[F.col(map_col)[k].try_cast("double").alias(k) for k in keys]]
    if label_col:
        cols.append(F.col(label_col).alias(target))
    return df.select(*cols)


# ---------------------------------------------------------------------------------------------
# statistics and triggers

def feedback_totals(view: DataFrame) -> DataFrame:
    """AGG-01: total, labeled, unlabeled, labeling_rate (0 when empty)."""
    return (view.agg(F.count(F.lit(1)).alias("total_records"),
                     F.count("actual_label").alias("labeled_records"))
            .withColumn("unlabeled_records", F.col("total_records") - F.col("labeled_records"))
            .withColumn("labeling_rate", safe_div(F.col("labeled_records"), F.col("total_records"), F.lit(0.0))))


def feedback_by_version(view: DataFrame) -> DataFrame:
    """AGG-02: records per model_version (NULL is a group)."""
    return view.groupBy("model_version").agg(F.count(F.lit(1)).alias("n_records"))


def accuracy_expr() -> Column:
    """Share of labeled rows where prediction = label; NULL only when nothing is labeled."""
    labeled = F.col("actual_label").isNotNull()
    hit = F.when(labeled, F.when(F.col("prediction") == F.col("actual_label"), 1.0).otherwise(0.0))
    return F.avg(hit)


def feedback_accuracy(view: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-03: accuracy over labeled rows (B14 fixed: 0.0 stays 0.0)."""
    return view.groupBy(*by).agg(accuracy_expr().alias("accuracy"),
                                 F.count("actual_label").alias("labeled_records"))


def _version_key(c: str) -> Column:
    """A map key for a version that may be NULL; the text 'null' keeps a key of its own."""
    return F.when(F.col(c).isNull(), F.lit(NO_VERSION)).otherwise(F.col(c))


def feedback_stats(view: DataFrame) -> DataFrame:
    """FBK-05: one row with totals, accuracy and the per-version record map, in version order."""
    hit = F.when(F.col("actual_label").isNotNull() & (F.col("prediction") == F.col("actual_label")), 1).otherwise(0)
    per_v = view.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"), F.count("actual_label").alias("l"),
                                              F.sum(hit).alias("h"))
    return (per_v.agg(F.sum("n").cast("long").alias("total_records"),
                      F.sum("l").cast("long").alias("labeled_records"),
                      F.try_divide(F.sum("h").cast("double"), F.sum("l").cast("double")).alias("accuracy"),
                      F.map_from_entries(F.array_sort(F.collect_list(F.struct(_version_key("model_version"), "n"))))
                      .alias("records_by_version"))
            .select(F.coalesce("total_records", F.lit(0)).alias("total_records"),
                    F.coalesce("labeled_records", F.lit(0)).alias("labeled_records"),
                    (F.col("total_records") - F.col("labeled_records")).alias("unlabeled_records"),
                    safe_div(F.col("labeled_records"), F.col("total_records"), F.lit(0.0)).alias("labeling_rate"),
                    "accuracy", "records_by_version"))


def pct2(c: Column) -> Column:
    """Python-style ``{:.2%}`` text of a ratio."""
    return F.concat(F.format_string("%.2f", F.round(c * 100, 2)), F.lit("%"))


def should_trigger_retraining(stats: DataFrame, min_new_samples: int = TRIGGER_MIN_LABELED,
                              accuracy_threshold: float = TRIGGER_ACCURACY) -> DataFrame:
    """FBK-07: labeled >= min -> retrain; else accuracy < threshold -> retrain; with reason."""
    n = F.col("labeled_records")
    acc = F.col("accuracy")
    by_n = n >= min_new_samples
    by_acc = acc.isNotNull() & (acc < accuracy_threshold)
    reason = (F.when(by_n, F.concat(F.lit("Sufficient labeled data: "), n.cast("string"), F.lit(" samples")))
              .when(by_acc, F.concat(F.lit("Accuracy dropped to "), pct2(acc), F.lit(" (threshold: "),
                                     F.lit(f"{accuracy_threshold:.2%}"), F.lit(")")))
              .otherwise(F.lit("No retraining trigger conditions met")))
    return stats.select(n.alias("labeled_records"), acc.alias("accuracy"),
                        (by_n | by_acc).alias("should_retrain"), reason.alias("reason"))


def export_for_retraining(view: DataFrame, keys: Sequence[str], min_samples: int = EXPORT_MIN_SAMPLES,
                          output_path: str | None = None, fmt: str = "csv") -> DataFrame | None:
    """FBK-06: with at least ``min_samples`` labeled rows, the expanded feature table
    (+ Result); written to ``output_path`` when given. None when there are too few. The
    labeled rows are computed once, for the count and the table."""
    lab = cut_lineage(labeled_data(view, parse=True).select("features", "actual_label"))
    n = lab.count()  # one metric row reaches the driver
    if n < min_samples:
        return None
    out = expand_features(lab, keys)
    if output_path:
        w = out.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(output_path)
        else:
            w.format(fmt).save(output_path)
    return out
