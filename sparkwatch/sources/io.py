"""Sources and sinks: CSV / Parquet / JSON readers with declared schemas, the
partitioned prediction log, immutable raw snapshots, report sinks and the baseline store.

Everything is a directory-style Spark write (one file per task, no driver-side file
handling); reads are declared-schema (no inference pass) so filters and column
pruning reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COL = "_corrupt"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "csv",
               keep_corrupt: bool = False) -> DataFrame:
    """SRC-01: read a headered CSV (or parquet/json) with a declared schema. With
    ``keep_corrupt`` malformed CSV/JSON rows are kept with their raw text in ``_corrupt``."""
    r = spark.read
    if schema is not None:
        s = schema
        if keep_corrupt and fmt in ("csv", "json"):
            s = T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COL, T.StringType(), True)])
            r = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL)
        r = r.schema(s)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    return r.format(fmt).load(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK-01: headered CSV, no index column."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_prediction_log(df: DataFrame, path: str, ts_col: str = "ts", mode: str = "append") -> str:
    """Append to the prediction log, partitioned by date and model_version so that time-range
    and version filters prune whole directories (in place of the two secondary indexes)."""
    (df.withColumn("date", F.to_date(F.col(ts_col)))
       .write.mode(mode).partitionBy("date", "model_version").parquet(path))
    return path


def feedback_scan(spark: SparkSession, path: str, start=None, end=None, model_version: str | None = None,
                  labeled_only: bool = False, ts_col: str = "ts") -> DataFrame:
    """SRC-02: filtered read of the partitioned log; the date bounds are derived from the
    time bounds so the partition filter prunes, the exact bounds are pushed to Parquet."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("date") >= F.to_date(F.lit(start))) & (F.col(ts_col) >= F.lit(start).cast(df.schema[ts_col].dataType)))
    if end is not None:
        df = df.filter((F.col("date") <= F.to_date(F.lit(end))) & (F.col(ts_col) <= F.lit(end).cast(df.schema[ts_col].dataType)))
    if model_version is not None:
        df = df.filter(F.col("model_version") == model_version)
    if labeled_only and "actual_label" in df.columns:
        df = df.filter(F.col("actual_label").isNotNull())
    return df


def feature_store_snapshot(df: DataFrame, root: str, snapshot_id: str) -> str:
    """SNK-02: immutable timestamped copy of raw input: one partition per snapshot id,
    written once (error if the snapshot already exists)."""
    target = f"{root}/snapshot_id={snapshot_id}"
    df.write.mode("errorifexists").parquet(target)
    return target


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(root)
    return df if snapshot_id is None else df.filter(F.col("snapshot_id") == snapshot_id)


def drift_report_sink(report: DataFrame, path: str) -> str:
    """SNK-03: append the drift report rows as JSON lines."""
    report.write.mode("append").json(path)
    return path


def validation_report_sink(report: DataFrame, path: str) -> str:
    """SNK-04: the per-column validation report as JSON lines."""
    report.write.mode("overwrite").json(path)
    return path


def baseline_store(df: DataFrame, features: Sequence[str], path: str, model_version: str, created_at: str,
                   pred_col: str = "prediction", accuracy: float | None = None, part_cols: Sequence[str] = ()) -> str:
    """SNK-05: append the baseline of a model version, computed from its feature rows and their
    predictions: value counts, profile, class distribution and number of samples, as tables
    partitioned by ``model_version`` under ``path``. The counts are what drift is measured
    against later; no row needs to be kept. With ``accuracy``, quantile sketches take the place of
    counts and profile, one for each feature and group of ``part_cols`` (e.g. the day): they have a
    bounded size and merge over any groups (``operators/sketch.py``)."""
    from ..operators.drift import class_distribution, counts_of
    from ..operators.profile import profile_from_counts
    from ..operators.sketch import feature_sketches

    def put(part: DataFrame, name: str) -> None:
        (part.withColumn("created_at", F.lit(created_at).cast("timestamp")).withColumn("model_version", F.lit(model_version))
         .write.mode("append").partitionBy("model_version").parquet(f"{path}/{name}"))

    if accuracy is not None:
        put(feature_sketches(df, features, part_cols, accuracy).withColumn("accuracy", F.lit(float(accuracy))), "sketches")
        put(class_distribution(df, pred_col), "classes")
        put(df.agg(F.count(F.lit(1)).alias("total_samples")), "samples")
        return path
    put(counts_of(df, features), "counts")
    stored = df.sparkSession.read.parquet(f"{path}/counts")
    own = stored.filter((F.col("model_version") == model_version) & (F.col("created_at") == F.lit(created_at).cast("timestamp")))
    put(profile_from_counts(own.select("feature", "value", "c")), "profile")
    put(class_distribution(df, pred_col), "classes")
    # the last table makes the baseline complete: readers start from it
    put(df.agg(F.count(F.lit(1)).alias("total_samples")), "samples")
    return path


BASELINE_TABLES = ("counts", "profile", "classes", "samples")


SKETCH_TABLES = ("sketches", "classes", "samples")


def latest_baseline(spark: SparkSession, path: str, model_version: str | None = None, tables: Sequence[str] = BASELINE_TABLES) -> dict[str, DataFrame]:
    """SNK-05: the tables of the most recently created baseline (by ``created_at``, not by version
    text), or of the latest one of ``model_version``; ``tables``: SKETCH_TABLES for one of sketches."""
    known = spark.read.parquet(f"{path}/samples")
    if model_version is not None:
        known = known.filter(F.col("model_version") == model_version)
    newest = known.agg(F.max_by(F.struct("model_version", "created_at"), "created_at").alias("n")).first()["n"]
    if newest is None:
        raise FileNotFoundError(f"no baseline in {path}")
    one = (F.col("model_version") == newest["model_version"]) & (F.col("created_at") == F.lit(newest["created_at"]))
    return {name: spark.read.parquet(f"{path}/{name}").filter(one) for name in tables}


def assemble_features(df: DataFrame, features: Sequence[str], label_col: str | None = None,
                      keep: Sequence[str] = ()) -> DataFrame:
    """SNK-06: ``features`` vector (+ ``label``) via VectorAssembler; missing values kept as NaN."""
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    cols = [*keep, "features"] + ([F.col(label_col).cast("double").alias("label")] if label_col else [])
    return va.transform(df).select(*cols)


def write_assembled(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def read_assembled(spark: SparkSession, path: str) -> DataFrame:
    """Split the persisted matrix back into an array of features and the label."""
    from pyspark.ml.functions import vector_to_array

    df = spark.read.parquet(path)
    return df.withColumn("x", vector_to_array("features")).drop("features")
