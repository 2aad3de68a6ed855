"""Registered source / sink, validation, split and imputation queries
(SURVEY 2.1 SRC/SNK, 2.2 VAL-01..05, 2.3 SMP-01, 2.8 ML-02).

Sink queries write into the shared scratch folder (``spark.checkpoint.dir``) and read
their own output back, so the check covers the write and the read path."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import fixture_df, with_clause
from ..operators import drift, impute, split
from ..operators import validate as V
from ..schema import ALL_COLUMNS, FEATURE_COLUMNS, feature_schema
from ..session import scratch_path
from ..sources import io
from . import oracle_sql as O
from .q_drift import NUM_FEATURES, _validation_sql
from .q_feedback import FV
from .registry import register

_SUMS = ", ".join(f"sum({c}) AS s_{c}" for c in ALL_COLUMNS)


def _sums_spark(df):
    return df.groupBy("side").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in ALL_COLUMNS])


@register("scan_csv", with_clause("phish") + f"SELECT side, count(*) AS n, {_SUMS} FROM phish GROUP BY side")
def q_scan_csv(spark, sf_dir):
    """SRC-01: the feature table as headered CSV, read back with the declared schema."""
    path = scratch_path(spark, "scan_csv")
    fixture_df(spark, sf_dir, "phish").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("row_key", T.StringType()), T.StructField("side", T.StringType())]
                          + list(feature_schema().fields))
    return _sums_spark(io.read_table(spark, path, schema, "csv"))


@register("sink_csv", with_clause("phish") + f"SELECT side, count(*) AS n, {_SUMS} FROM phish GROUP BY side")
def q_sink_csv(spark, sf_dir):
    """SNK-01: write the table as headered CSV (library sink) and aggregate the re-read."""
    path = scratch_path(spark, "sink_csv")
    io.sink_csv(fixture_df(spark, sf_dir, "phish"), path)
    schema = T.StructType([T.StructField("row_key", T.StringType()), T.StructField("side", T.StringType())]
                          + list(feature_schema().fields))
    return _sums_spark(spark.read.schema(schema).option("header", True).csv(path))


@register("feedback_scan", with_clause("pred") + """
SELECT request_id, ts, prediction, model_version FROM pred
WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-21 12:00:00' AND model_version = 'v1.2'""")
def q_feedback_scan(spark, sf_dir):
    """SRC-02: partitioned prediction log, time-range and version filters (partition pruning)."""
    path = scratch_path(spark, "pred_log")
    io.write_prediction_log(fixture_df(spark, sf_dir, "pred"), path)
    df = io.feedback_scan(spark, path, start="2024-01-08 00:00:00", end="2024-01-21 12:00:00", model_version="v1.2")
    return df.select("request_id", "ts", "prediction", "model_version")


@register("feature_store_snapshot", with_clause("phish") + "SELECT side, count(*) AS n, 'snap-001' AS snapshot_id "
          "FROM phish GROUP BY side")
def q_feature_store_snapshot(spark, sf_dir):
    """SNK-02: immutable snapshot of the raw table, read back by snapshot id."""
    root = scratch_path(spark, "feature_store")
    io.feature_store_snapshot(fixture_df(spark, sf_dir, "phish"), root, "snap-001")
    snap = io.read_snapshot(spark, root, "snap-001")
    return snap.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.first("snapshot_id").alias("snapshot_id"))


@register("validation_report_sink", _validation_sql())
def q_validation_report_sink(spark, sf_dir):
    """SNK-04: validation report written as JSON and read back."""
    ph = fixture_df(spark, sf_dir, "phish")
    b, c = ph.filter("side = 'baseline'"), ph.filter("side = 'current'")
    rep = drift.validation_drift(b.drop("row_key", "side"), c.drop("row_key", "side"))
    path = scratch_path(spark, "validation_report")
    io.validation_report_sink(rep, path)
    return spark.read.schema("column string, p_value double, drift_status string").json(path)


_DRIFT_ROWS = O.drift_flag_sql(O.ks_sql("num_long", NUM_FEATURES, O.num_prelude(), with_p=False), "ks", 0.3)


@register("drift_report_sink", f"SELECT r.run, d.* FROM ({_DRIFT_ROWS}) d, (SELECT unnest([1, 2])::INT AS run) r")
def q_drift_report_sink(spark, sf_dir):
    """SNK-03: per-feature drift rows appended as JSON twice (two runs), read back in full."""
    num = fixture_df(spark, sf_dir, "num")
    rep = drift.data_drift(num.filter("side = 'baseline'"), num.filter("side = 'current'"), NUM_FEATURES, "ks")
    path = scratch_path(spark, "drift_reports")
    io.drift_report_sink(rep.withColumn("run", F.lit(1)), path)
    io.drift_report_sink(rep.withColumn("run", F.lit(2)), path)
    return spark.read.schema("run int, feature string, method string, score double, threshold double, drift boolean, "
                             "status string").json(path)


@register("baseline_store", with_clause("num_long", "num") + """,
cur AS (SELECT * FROM num_long WHERE side = 'current' AND value IS NOT NULL),
pr AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p FROM num WHERE side = 'current'),
prof AS (SELECT feature, count(*)::DOUBLE AS n, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.25) AS q25,
                quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM cur GROUP BY feature)
SELECT 'v9' AS model_version, 'count' AS kind, feature AS name, CAST(value AS DOUBLE) AS item, count(*)::DOUBLE AS amount FROM cur GROUP BY feature, value
UNION ALL SELECT 'v9', stat, feature, NULL, round(amount, 6) FROM prof UNPIVOT (amount FOR stat IN (n, mean, std, q25, q50, q75))
UNION ALL SELECT 'v9', 'class', CAST(p AS VARCHAR), NULL, round(count(*) / sum(count(*)) OVER (), 6) FROM pr GROUP BY p
UNION ALL SELECT 'v9', 'samples', NULL, NULL, count(*)::DOUBLE FROM pr""")
def q_baseline_store(spark, sf_dir):
    """SNK-05: two baselines stored (v10 first, v9 later); the latest by creation time is v9, read
    back in full: value counts, profile, class distribution, number of samples."""
    num = fixture_df(spark, sf_dir, "num").withColumn("prediction", F.when(F.col("l_quantity") > 25, 1).otherwise(0))
    path = scratch_path(spark, "baselines")
    io.baseline_store(num.filter("side = 'baseline'"), NUM_FEATURES, path, "v10", "2024-01-01 00:00:00")
    io.baseline_store(num.filter("side = 'current'"), NUM_FEATURES, path, "v9", "2024-01-02 00:00:00")
    base = io.latest_baseline(spark, path)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    stats = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).cast("double").alias("amount")) for s in ("n", "mean", "std", "q25", "q50", "q75")]))
    parts = [base["counts"].select("model_version", F.lit("count").alias("kind"), F.col("feature").alias("name"), F.col("value").alias("item"),
                                   F.col("c").cast("double").alias("amount")),
             base["profile"].select("model_version", "feature", stats.alias("s")).select("model_version", "s.kind", F.col("feature").alias("name"),
                                                                                        none.alias("item"), "s.amount"),
             base["classes"].select("model_version", F.lit("class").alias("kind"), F.col("class").alias("name"), none.alias("item"), F.col("share").alias("amount")),
             base["samples"].select("model_version", F.lit("samples").alias("kind"), text.alias("name"), none.alias("item"),
                                    F.col("total_samples").cast("double").alias("amount"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FEATURE_COLUMNS)
_FSUM = " + ".join(f"coalesce({c}, 0)" for c in FEATURE_COLUMNS)


@register("assembled_features", with_clause("phish") + f"""
SELECT row_key, CAST({_FSUM} AS DOUBLE) AS x_sum, {_NULLS} AS n_missing,
       CAST(CASE WHEN Result = -1 THEN 0 ELSE Result END AS DOUBLE) AS label FROM phish""")
def q_assembled_features(spark, sf_dir):
    """SNK-06: [X, y] persisted as a vector column and split back into an array."""
    from ..functions.exprs import recode_label

    ph = fixture_df(spark, sf_dir, "phish").withColumn("Result", recode_label("Result"))
    path = scratch_path(spark, "assembled")
    io.write_assembled(io.assemble_features(ph, FEATURE_COLUMNS, "Result", keep=["row_key"]), path)
    back = io.read_assembled(spark, path)
    ok = F.filter("x", lambda v: ~F.isnan(v))
    return back.select("row_key", F.aggregate(ok, F.lit(0.0), lambda a, v: a + v).alias("x_sum"),
                       (F.size("x") - F.size(ok)).alias("n_missing"), "label")


# ------------------------------------------------------------------ validation

@register("check_column_count", with_clause("phish") + f"""
SELECT t.split, t.n AS n_columns, 31 AS expected, t.n = 31 AS ok, s.n_rows, s.n_values
FROM (VALUES ('train', 31), ('scoring', 30)) AS t(split, n)
JOIN (SELECT 'train' AS split, count(*) AS n_rows, {' + '.join(f'count({c})' for c in ALL_COLUMNS)} AS n_values FROM phish
      UNION ALL SELECT 'scoring', count(*), {' + '.join(f'count({c})' for c in FEATURE_COLUMNS)} FROM phish) s USING (split)""")
def q_check_column_count(spark, sf_dir):
    """VAL-01: column count against the declared schema (train table ok, scoring table not), with
    the rows and the non-null values that the declared columns hold."""
    ph = fixture_df(spark, sf_dir, "phish").drop("row_key", "side")
    out = None
    for name, df in (("train", ph), ("scoring", ph.drop("Result"))):
        held = df.agg(F.count(F.lit(1)).alias("n_rows"), sum((F.count(c) for c in df.columns), F.lit(0).cast("long")).alias("n_values"))
        one = V.check_column_count(spark, df, feature_schema(), name).join(F.broadcast(held.withColumn("split", F.lit(name))), "split")
        out = one if out is None else out.unionByName(one)
    return out


@register("check_required_columns", with_clause("phish") + f"""
, f AS (SELECT unnest([{', '.join(f"'{c}'" for c in FEATURE_COLUMNS)}]) AS "column"),
n AS (SELECT * FROM (SELECT {', '.join(f'count({c})::BIGINT AS {c}' for c in FEATURE_COLUMNS if c != 'Statistical_report')} FROM phish)
      UNPIVOT (n_values FOR "column" IN ({', '.join(c for c in FEATURE_COLUMNS if c != 'Statistical_report')})))
SELECT f."column", n."column" IS NOT NULL AS present, coalesce(n_values, 0) AS n_values FROM f LEFT JOIN n USING ("column")""")
def q_check_required_columns(spark, sf_dir):
    """VAL-02: required feature columns present (a table that lost one feature), and how many
    values each holds."""
    ph = fixture_df(spark, sf_dir, "phish").drop("Statistical_report")
    missing = set(V.check_required_columns(spark, ph, FEATURE_COLUMNS, "scoring").first()["missing_columns"])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c not in missing).alias("present"),
                              (F.lit(0).cast("long") if c in missing else F.count(c)).alias("n_values")) for c in FEATURE_COLUMNS])
    return ph.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _string_phish(spark, sf_dir):
    ph = fixture_df(spark, sf_dir, "phish")
    cols = [F.col(c).cast("string").alias(c) for c in ALL_COLUMNS]
    cols[1] = F.when(F.col("having_IP_Address").isNull(), F.lit("n/a")).otherwise(
        F.col("URL_Length").cast("string")).alias("URL_Length")
    return ph.select("row_key", "side", *cols)


_STR_PHISH = ("sp AS (SELECT row_key, side, " + ", ".join(
    (f"CASE WHEN having_IP_Address IS NULL THEN 'n/a' ELSE CAST(URL_Length AS VARCHAR) END AS URL_Length"
     if c == "URL_Length" else f"CAST({c} AS VARCHAR) AS {c}") for c in ALL_COLUMNS) + " FROM phish)")


@register("check_types", with_clause("phish").rstrip() + ",\n" + _STR_PHISH + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", 'bigint' AS declared_type, count({c}) AS n_values, "
    f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS BIGINT) IS NULL) AS n_bad, "
    f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS BIGINT) IS NULL) = 0 AS ok FROM sp"
    for c in ALL_COLUMNS))
def q_check_types(spark, sf_dir):
    """VAL-03: declared BIGINT types checked with try_cast in one aggregate (text input
    where URL_Length holds 'n/a' in some rows)."""
    return V.check_types(_string_phish(spark, sf_dir), feature_schema())


def _verdict_sql() -> str:
    val = _validation_sql()
    return val.replace('\nSELECT feature AS "column"', ',\nvd AS (SELECT feature AS "column"', 1) + """),
chk AS (SELECT 'train' AS split, 'column_count' AS "check", true AS ok
        UNION ALL SELECT 'train', 'required_columns', true
        UNION ALL SELECT 'test', 'column_count', true
        UNION ALL SELECT 'test', 'required_columns', true
        UNION ALL SELECT 'train_vs_test', 'no_drift', coalesce(bool_and(drift_status <> 'true'), true) FROM vd)
SELECT * FROM chk UNION ALL SELECT 'all', 'verdict', bool_and(ok) FROM chk"""


@register("validate_dataset", _verdict_sql())
def q_validate_dataset(spark, sf_dir):
    """VAL-04: count, required-column and drift checks over train and test, AND-ed to a verdict."""
    ph = fixture_df(spark, sf_dir, "phish")
    tr, te = ph.filter("side = 'baseline'").drop("row_key", "side"), ph.filter("side = 'current'").drop("row_key", "side")
    return V.validate_dataset(spark, tr, te, feature_schema(), FEATURE_COLUMNS)


@register("route_valid_invalid", with_clause("phish").rstrip() + ",\n" + _STR_PHISH + """
SELECT CASE side WHEN 'baseline' THEN 'train' ELSE 'test' END AS split,
       CASE WHEN URL_Length = 'n/a' THEN 'invalid' ELSE 'invalid_verdict' END AS route, count(*) AS n
FROM sp GROUP BY ALL""")
def q_route_valid_invalid(spark, sf_dir):
    """VAL-05: the verdict (drift found -> not ok) sends both splits to the invalid folder;
    rows failing the type check are quarantined separately. One write; counts read back per folder."""
    sp = _string_phish(spark, sf_dir)
    tr, te = sp.filter("side = 'baseline'").drop("row_key", "side"), sp.filter("side = 'current'").drop("row_key", "side")
    ph = fixture_df(spark, sf_dir, "phish")
    verdict = V.validate_dataset(spark, ph.filter("side = 'baseline'").drop("row_key", "side"),
                                 ph.filter("side = 'current'").drop("row_key", "side"), feature_schema(),
                                 FEATURE_COLUMNS).filter("check = 'verdict'").first()["ok"]
    root = scratch_path(spark, "validated")
    V.route_valid_invalid(tr, te, verdict, root, schema=feature_schema())
    return spark.read.parquet(root).groupBy("split", "route").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ split and mean imputation

@register("train_test_split", with_clause("phish") + """
SELECT row_key, CASE WHEN ('0x' || substr(md5(row_key), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split
FROM phish""")
def q_train_test_split(spark, sf_dir):
    """SMP-01: deterministic 80/20 split by md5 of the row key."""
    return split.with_split(fixture_df(spark, sf_dir, "phish").select("row_key"), "row_key")


_MEANS = ", ".join(f"avg({c}) AS m_{c}" for c in FEATURE_COLUMNS)
_FILLED = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), m_{c}), 6) AS {c}" for c in FEATURE_COLUMNS)


@register("mean_impute", with_clause("phish") + f""",
m AS (SELECT {_MEANS} FROM phish WHERE side = 'baseline')
SELECT row_key, {_FILLED} FROM phish, m""")
def q_mean_impute(spark, sf_dir):
    """ML-02: column means fit on the baseline split fill both splits."""
    ph = fixture_df(spark, sf_dir, "phish")
    out = impute.mean_impute(ph.filter("side = 'baseline'"), ph, FEATURE_COLUMNS)
    return out.select("row_key", *FEATURE_COLUMNS)
