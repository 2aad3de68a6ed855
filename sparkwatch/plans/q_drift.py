"""Registered drift / profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture_df, load_table, with_clause
from ..operators import drift, profile, sketch
from ..operators import validate as V
from ..schema import FEATURE_COLUMNS
from ..session import scratch_path
from ..sources import io
from . import oracle_sql as O
from .registry import register

NUM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _num_sides(spark, sf_dir):
    num = fixture_df(spark, sf_dir, "num")
    return num.filter(F.col("side") == "baseline"), num.filter(F.col("side") == "current")


def _phish_sides(spark, sf_dir):
    ph = fixture_df(spark, sf_dir, "phish")
    return ph.filter(F.col("side") == "baseline"), ph.filter(F.col("side") == "current")


@register("ks_statistic", O.ks_sql("num_long", NUM_FEATURES, O.num_prelude(), with_p=False))
def q_ks_statistic(spark, sf_dir):
    """DRF-01: two-sample KS statistic per continuous feature (blocked running CDFs)."""
    b, c = _num_sides(spark, sf_dir)
    return drift.ks(b, c, NUM_FEATURES).drop("p_value")


@register("ks_pvalue", O.ks_sql("num_long", NUM_FEATURES, O.num_prelude()))
def q_ks_pvalue(spark, sf_dir):
    """DRF-02: KS statistic with its two-sided asymptotic p-value."""
    b, c = _num_sides(spark, sf_dir)
    return drift.ks(b, c, NUM_FEATURES)


@register("psi", O.psi_sql("num_long", NUM_FEATURES, O.num_prelude()))
def q_psi(spark, sf_dir):
    """DRF-04: population stability index on baseline-percentile bins."""
    b, c = _num_sides(spark, sf_dir)
    return drift.psi(b, c, NUM_FEATURES)


@register("js_divergence", O.js_sql("num_long", NUM_FEATURES, O.num_prelude()))
def q_js(spark, sf_dir):
    """DRF-05: Jensen-Shannon divergence on 10 equal-width joint bins."""
    b, c = _num_sides(spark, sf_dir)
    return drift.js(b, c, NUM_FEATURES)


@register("data_drift", O.drift_flag_sql(
    O.psi_sql("phish_long", FEATURE_COLUMNS, O.phish_prelude()), "psi", 0.2))
def q_data_drift(spark, sf_dir):
    """DRF-06: PSI drift flags over all 30 features of the feature table, the baseline side stored
    before (SNK-05) and only its counts read."""
    b, c = _phish_sides(spark, sf_dir)
    path = scratch_path(spark, "drift_baseline")
    io.baseline_store(b, FEATURE_COLUMNS, path, "v1", "2024-01-01 00:00:00", pred_col="Result")
    counts = io.latest_baseline(spark, path)["counts"]
    return drift.data_drift(None, c, FEATURE_COLUMNS, method="psi", baseline_counts=counts)


@register("data_drift_ks", O.drift_flag_sql(
    O.ks_sql("phish_long", FEATURE_COLUMNS, O.phish_prelude(), with_p=False), "ks", 0.02))
def q_data_drift_ks(spark, sf_dir):
    """DRF-06 with method ks and a lowered threshold (0.02) so the planted drift shows."""
    b, c = _phish_sides(spark, sf_dir)
    return drift.data_drift(b, c, FEATURE_COLUMNS, method="ks", threshold=0.02)


@register("data_drift_js", O.drift_flag_sql(
    O.js_sql("phish_long", FEATURE_COLUMNS, O.phish_prelude()), "js", 0.005))
def q_data_drift_js(spark, sf_dir):
    """DRF-06 with method js and a lowered threshold (0.005)."""
    b, c = _phish_sides(spark, sf_dir)
    return drift.data_drift(b, c, FEATURE_COLUMNS, method="js", threshold=0.005)


_VAL_COLS = FEATURE_COLUMNS + ["Result"]


def _validation_sql(extra_current_null: str | None = None) -> str:
    feats = _VAL_COLS
    pre = O.phish_prelude(features=feats)
    long = "phish_long"
    if extra_current_null:
        pre += (f",\nphish_long2 AS (SELECT * FROM phish_long WHERE NOT (side = 'current' "
                f"AND feature = '{extra_current_null}'))")
        long = "phish_long2"
    core = O.ks_core(long, feats, pre)
    return core + f"""
SELECT feature AS "column", round({O.PVALUE}, 6) AS p_value,
       CASE WHEN d IS NULL THEN 'insufficient_data' WHEN ({O.PVALUE}) < 0.05 THEN 'true' ELSE 'false' END
         AS drift_status
FROM ksd"""


@register("validation_drift", _validation_sql())
def q_validation_drift(spark, sf_dir):
    """DRF-03: KS p-value test per numeric column common to both splits (p < 0.05 = drift)."""
    b, c = _phish_sides(spark, sf_dir)
    return drift.validation_drift(b.drop("row_key", "side"), c.drop("row_key", "side"))


@register("insufficient_data", _validation_sql("port"))
def q_insufficient_data(spark, sf_dir):
    """FLT-02: a column with no values on one side gets status insufficient_data, p NULL
    (current split whose `port` feed is missing)."""
    b, c = _phish_sides(spark, sf_dir)
    c = c.withColumn("port", F.lit(None).cast("bigint"))
    return drift.validation_drift(b.drop("row_key", "side"), c.drop("row_key", "side"))


@register("drop_nulls", with_clause("phish") + f""",
{O.phish_long_cte()[0:]}
SELECT feature, count(*) AS n_present FROM phish_long GROUP BY feature""")
def q_drop_nulls(spark, sf_dir):
    """FLT-01: per-column NULL/NaN removal (count of values kept per feature)."""
    ph = fixture_df(spark, sf_dir, "phish")
    return drift.to_long(ph, FEATURE_COLUMNS).groupBy("feature").agg(F.count(F.lit(1)).alias("n_present"))


_LOST = "Statistical_report"
_BASE_COLUMNS = ["row_key", "side", *FEATURE_COLUMNS]


@register("column_diff", with_clause("phish") + f"""
, f AS (SELECT unnest([{", ".join(f"'{c}'" for c in _BASE_COLUMNS)}]) AS "column"),
n AS (SELECT * FROM (SELECT {", ".join(f"count({c})::BIGINT AS {c}" for c in _BASE_COLUMNS)} FROM phish)
      UNPIVOT (n_values FOR "column" IN ({", ".join(_BASE_COLUMNS)})))
SELECT f."column", CASE WHEN f."column" = '{_LOST}' THEN 'missing_in_current' ELSE 'common' END AS status, n.n_values AS n_base,
       CASE WHEN f."column" = '{_LOST}' THEN NULL ELSE n.n_values END AS n_current FROM f JOIN n USING ("column")
UNION ALL SELECT 'request_ts', 'missing_in_base', NULL, 0""")
def q_column_diff(spark, sf_dir):
    """PRJ-04: columns common to both tables, missing in current and missing in base, with the
    number of values that each table holds in them."""
    ph = fixture_df(spark, sf_dir, "phish")
    base = ph.drop("Result")
    cur = ph.drop("Result", _LOST).withColumn("request_ts", F.lit(None).cast("timestamp"))
    diff = V.column_diff(spark, base, cur).first()
    status = {c: "common" for c in diff["common_columns"]} | {c: "missing_in_current" for c in diff["missing_in_current"]} \
        | {c: "missing_in_base" for c in diff["missing_in_base"]}

    def held(df, name):
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias(name)) for c in df.columns])
        return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")

    both = held(base, "n_base").join(held(cur, "n_current"), "column", "full")
    names = F.create_map(*[F.lit(x) for kv in status.items() for x in kv])
    return both.select("column", names[F.col("column")].alias("status"), "n_base", "n_current")


@register("feature_profile", with_clause("num_long") + """
SELECT side, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75
FROM num_long WHERE value IS NOT NULL GROUP BY side, feature""")
def q_feature_profile(spark, sf_dir):
    """AGG-04: profile (n, mean, std ddof=1, linear quartiles) per side and feature."""
    return profile.feature_profile(fixture_df(spark, sf_dir, "num"), NUM_FEATURES, keys=["side"])


@register("feature_profile_phish", with_clause("phish") + ",\n" + O.phish_long_cte() + """
SELECT side, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75
FROM phish_long GROUP BY side, feature""")
def q_feature_profile_phish(spark, sf_dir):
    """AGG-04 on the 30 discrete features of the feature table (NULLs dropped), both sides."""
    return profile.feature_profile(fixture_df(spark, sf_dir, "phish"), FEATURE_COLUMNS, keys=["side"])


@register("feature_histogram", with_clause("phish") + ",\n" + O.phish_long_cte() + """
SELECT side, feature, value, count(*) AS n FROM phish_long GROUP BY ALL""")
def q_feature_histogram(spark, sf_dir):
    """AGG-05: per side and feature, count of each distinct value."""
    ph = fixture_df(spark, sf_dir, "phish")
    return profile.feature_histogram(ph, FEATURE_COLUMNS, keys=["side"])


@register("class_distribution", with_clause("pred") + """
SELECT model_version, CAST(prediction AS VARCHAR) AS class,
       round(count(*) / sum(count(*)) OVER (PARTITION BY model_version), 6) AS share
FROM pred GROUP BY model_version, prediction""")
def q_class_distribution(spark, sf_dir):
    """AGG-06: share of each predicted class, per model version."""
    pred = fixture_df(spark, sf_dir, "pred")
    return drift.class_distribution(pred, "prediction", keys=["model_version"])


@register("model_drift", with_clause("pred") + """,
b AS (SELECT CAST(prediction AS VARCHAR) AS class, count(*) / sum(count(*)) OVER () AS p
      FROM pred WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY prediction),
c AS (SELECT CAST(prediction AS VARCHAR) AS class, count(*) / sum(count(*)) OVER () AS p
      FROM pred WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY prediction)
SELECT round(coalesce(sum(abs(coalesce(c.p, 0) - b.p)), 0), 6) AS class_distribution_shift,
       coalesce(sum(abs(coalesce(c.p, 0) - b.p)), 0) > 0.2 AS model_drift_detected
FROM b LEFT JOIN c USING (class)""")
def q_model_drift(spark, sf_dir):
    """DRF-07: prediction-class share shift, baseline = first half of January,
    current = second half."""
    pred = fixture_df(spark, sf_dir, "pred")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    b = pred.filter(F.col("ts") < cut)
    c = pred.filter(F.col("ts") >= cut)
    return drift.model_drift(b, c)


_ACCOUNTS = ("SELECT s_acctbal AS balance, s_nationkey AS nation FROM @supplier", "SELECT c_acctbal AS balance, c_nationkey AS nation FROM @customer")


@register("ks_pvalue_exact", f"""
WITH RECURSIVE b AS ({_ACCOUNTS[0].replace("@", "")}), c AS ({_ACCOUNTS[1].replace("@", "")}),
l AS (SELECT 'b' AS side, * FROM (UNPIVOT (SELECT balance::DOUBLE AS balance, nation::DOUBLE AS nation FROM b) ON balance, nation INTO NAME feature VALUE v)
      UNION ALL SELECT 'c', * FROM (UNPIVOT (SELECT balance::DOUBLE AS balance, nation::DOUBLE AS nation FROM c) ON balance, nation INTO NAME feature VALUE v)),
n AS (SELECT feature, count(*) FILTER (side = 'b') AS n1, count(*) FILTER (side = 'c') AS n2 FROM l GROUP BY feature),
cdf AS (SELECT feature, v, sum(count(*) FILTER (side = 'b')) OVER (PARTITION BY feature ORDER BY v) AS k1,
               sum(count(*) FILTER (side = 'c')) OVER (PARTITION BY feature ORDER BY v) AS k2 FROM l GROUP BY feature, v),
d AS (SELECT feature, n1, n2, max(abs(k1 / n1 - k2 / n2)) AS d, ceil(max(abs(k1 / n1 - k2 / n2)) * n1 * n2 - 1e-6) AS bound
      FROM cdf JOIN n USING (feature) GROUP BY feature, n1, n2),
walk AS (
  SELECT feature, 0::BIGINT AS s, 0::BIGINT AS x, 1.0::DOUBLE AS u FROM d
  UNION ALL
  SELECT feature, s + 1, nx, sum(u * share) FROM (
    SELECT walk.feature, s, x + dx AS nx, u, CASE dx WHEN 1 THEN (x + 1) / (s + 1) ELSE (s + 1 - x) / (s + 1) END AS share, n1, n2, bound
    FROM walk JOIN d USING (feature), (VALUES (0), (1)) AS t(dx))
  WHERE nx <= n1 AND s + 1 - nx <= n2 AND abs(nx * n2 - (s + 1 - nx) * n1) < bound GROUP BY feature, s + 1, nx)
SELECT d.feature, n1 AS n_baseline, n2 AS n_current, round(d, 6) AS score, round(1 - coalesce(u, 0), 6) AS p_value
FROM d LEFT JOIN walk ON walk.feature = d.feature AND s = n1 + n2 AND x = n1""")
def q_ks_pvalue_exact(spark, sf_dir):
    """DRF-02 by counting lattice paths: balances and nations of all suppliers against all customers."""
    b, c = (spark.sql(q.replace("@supplier", "{supplier}").replace("@customer", "{customer}"), supplier=load_table(spark, sf_dir, "supplier"),
                      customer=load_table(spark, sf_dir, "customer")) for q in _ACCOUNTS)
    out = drift.ks(b, c, ["balance", "nation"], exact_cells=1_000_000_000)
    return out.select("feature", "n_baseline", "n_current", F.round("score", 6).alias("score"), F.round("p_value", 6).alias("p_value"))


#: Of a thousand and more rows a side, ranks within one per cent.
ACCURACY = 0.01


def _stored_sketches(spark, sf_dir):
    """Baselines of sketches of both sides, kept by a tenth of the parts, merged after reading back."""
    num = fixture_df(spark, sf_dir, "num").withColumn("prediction", F.lit(0))
    num = num.withColumn("part", F.pmod(F.xxhash64("l_extendedprice"), F.lit(10)))
    path = scratch_path(spark, "sketched")
    for at, side in ((1, "baseline"), (2, "current")):
        io.baseline_store(num.filter(F.col("side") == side), NUM_FEATURES, path, side, f"2024-01-0{at} 00:00:00", accuracy=ACCURACY, part_cols=["part"])
    return num, [sketch.merge_sketches(io.latest_baseline(spark, path, side, io.SKETCH_TABLES)["sketches"]) for side in ("baseline", "current")]


@register("feature_profile_sketch", with_clause("num_long") + """
SELECT side, feature, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, true AS quartiles_within
FROM num_long WHERE value IS NOT NULL GROUP BY side, feature""")
def q_feature_profile_sketch(spark, sf_dir):
    """AGG-04 / SNK-05 with accuracy=0.01: profiles from stored, merged sketches; each quartile's exact
    rank is within the stated bound of its own."""
    num, sides = _stored_sketches(spark, sf_dir)
    out = None
    for side, merged in zip(("baseline", "current"), sides):
        prof = sketch.profile_from_sketches(merged, ACCURACY)
        counts = drift.counts_of(num.filter(F.col("side") == side), NUM_FEATURES)
        ranked = counts.join(F.broadcast(prof.select("feature", "n", "q25", "q50", "q75")), "feature").groupBy("feature", "n").agg(
            *[F.sum(F.when(F.col("value") < F.col(q), F.col("c")).otherwise(0)).alias(f"{q}_below") for q, _ in sketch.QUARTILES],
            *[F.sum(F.when(F.col("value") <= F.col(q), F.col("c")).otherwise(0)).alias(f"{q}_upto") for q, _ in sketch.QUARTILES])
        within = F.lit(True)
        for q, p in sketch.QUARTILES:
            within = within & (F.col(f"{q}_below") / F.col("n") <= p + ACCURACY) & (F.col(f"{q}_upto") / F.col("n") >= p - ACCURACY)
        one = prof.join(ranked.select("feature", within.alias("quartiles_within")), "feature").select(
            F.lit(side).alias("side"), "feature", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "quartiles_within")
        out = one if out is None else out.unionByName(one)
    return out


@register("ks_sketch", f"SELECT feature, n_baseline, n_current, round(score, 6) AS score, true AS within FROM ({O.ks_sql('num_long', NUM_FEATURES, O.num_prelude(), with_p=False)})")
def q_ks_sketch(spark, sf_dir):
    """DRF-01 from sketches: the exact statistic, and whether the sketched one is within its error."""
    num, (b, c) = _stored_sketches(spark, sf_dir)
    found = sketch.ks_from_sketches(b, c, ACCURACY).select("feature", F.col("score").alias("sketched"), "error")
    exact = drift.ks(num.filter("side = 'baseline'"), num.filter("side = 'current'"), NUM_FEATURES)
    return exact.join(found, "feature").select("feature", "n_baseline", "n_current", F.round("score", 6).alias("score"),
                                               (F.abs(F.col("score") - F.col("sketched")) <= F.col("error")).alias("within"))
