"""Drift statistics between a baseline and a current table.

Every function takes two *wide* DataFrames and a feature list. Both sides are
unpivoted once into ``(side, feature, value)`` and reduced to one row per
``(feature, value)`` with a count per side; everything afterwards works on that
count table (map-side combined, so the shuffle carries distinct values only).
All per-feature ordering goes through the blocked running totals of
``ranking.py`` so a feature is never one task. Frames of one row per feature (totals,
edges) are broadcast to the counts. The baseline side can be a stored table of counts
instead of rows (``counts_of`` / ``baseline_counts``).

Missing values (NULL/NaN) are dropped per feature before any statistic. A feature
with no value on either side gets a NULL score and status ``insufficient_data``
(it is never reported as drift).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import exact_ks_pvalue, histogram_bin, kolmogorov_pvalue, linspace
from ..session import cut_lineage
from .ranking import exact_percentiles, percentile_array, running_totals

BASE, CUR = "b", "c"

# ---- fixed values: default thresholds and constants of the drift rules ----
PSI_THRESHOLD = 0.2
KS_THRESHOLD = 0.3
JS_THRESHOLD = 0.15
PSI_BINS = 10            # 11 percentile edges 0, 10, ..., 100
PSI_MIN_EDGES = 3        # fewer unique edges -> equal-width edges over baseline min..max
PSI_FLOOR = 0.0001       # empty bin share
JS_BINS = 10
JS_FLOOR = 1e-10
KS_PVALUE_ALPHA = 0.05   # validation: p < alpha means drift
# ---- end fixed values ----


def to_long(df: DataFrame, features: Sequence[str], id_cols: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``features`` into (id_cols..., feature, value DOUBLE); NULL/NaN dropped."""
    cast = df.select(*id_cols, *[F.col(f).cast("double").alias(f) for f in features])
    long = cast.unpivot(list(id_cols), list(features), "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def counts_of(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), name: str = "c") -> DataFrame:
    """(keys..., feature, value, ``name``): how often each distinct non-missing value occurs. Rows
    are grouped by the feature's number; its name is put in after the aggregation."""
    if not features:
        return df.select(*keys).limit(0).select(*keys, F.lit("").alias("feature"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias(name))
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    long = df.select(*keys, F.posexplode(values).alias("_f", "value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy(*keys, "_f", "value").agg(F.count(F.lit(1)).alias(name))
    names = F.array(*[F.lit(f) for f in features])
    return counts.select(*keys, F.element_at(names, F.col("_f") + 1).alias("feature"), "value", name)


def pair_counts(baseline: DataFrame | None, current: DataFrame, features: Sequence[str],
                materialize: bool = True, baseline_counts: DataFrame | None = None) -> DataFrame:
    """(feature, value, c_b, c_c): per distinct value, count on each side.

    This is the only pass over the raw rows; every statistic reads the count table from
    several branches, so it is materialised once (reliable checkpoint) instead of having
    each branch re-read and re-unpivot the input. With ``baseline_counts`` (feature, value,
    c), a stored baseline, no baseline row is read."""
    zero = F.lit(0).cast("long")
    if baseline_counts is None:
        baseline_counts = counts_of(baseline, features)
    else:
        baseline_counts = baseline_counts.select("feature", "value", "c").filter(F.col("feature").isin(list(features)))
    b = baseline_counts.select("feature", "value", F.col("c").alias("c_b"), zero.alias("c_c"))
    c = counts_of(current, features).select("feature", "value", zero.alias("c_b"), F.col("c").alias("c_c"))
    counts = b.unionByName(c).groupBy("feature", "value").agg(F.sum("c_b").alias("c_b"), F.sum("c_c").alias("c_c"))
    return cut_lineage(counts) if materialize else counts


def _feature_frame(spark, features: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in features], "feature string")


def _side_totals(counts: DataFrame, features: Sequence[str]) -> DataFrame:
    tot = counts.groupBy("feature").agg(F.sum("c_b").alias("n_baseline"), F.sum("c_c").alias("n_current"))
    return (_feature_frame(counts.sparkSession, features).join(tot, "feature", "left")
            .select("feature", F.coalesce("n_baseline", F.lit(0)).cast("long").alias("n_baseline"),
                    F.coalesce("n_current", F.lit(0)).cast("long").alias("n_current")))


def _status(score_col: str = "score"):
    ok = (F.col("n_baseline") > 0) & (F.col("n_current") > 0)
    return ok, F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient_data")).alias("status")


def _bin_shares(counts: DataFrame, edges: DataFrame, totals: DataFrame, floor: float) -> DataFrame:
    """Per (feature, bin): share of each side, counting only values inside the edges but
    dividing by all values of that side; empty share -> ``floor``."""
    binned = (counts.join(F.broadcast(edges), "feature", "inner")
              .withColumn("bin", histogram_bin(F.col("value"), F.col("edges")))
              .filter(F.col("bin").isNotNull())
              .groupBy("feature", "bin").agg(F.sum("c_b").alias("k_b"), F.sum("c_c").alias("k_c")))
    all_bins = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    return (all_bins.join(binned, ["feature", "bin"], "left").join(F.broadcast(totals), "feature", "inner")
            .select("feature", "bin",
                    F.coalesce(F.try_divide(F.col("k_b"), F.col("n_baseline")), F.lit(0.0)).alias("e"),
                    F.coalesce(F.try_divide(F.col("k_c"), F.col("n_current")), F.lit(0.0)).alias("a"))
            .withColumn("e", F.when(F.col("e") == 0, F.lit(floor)).otherwise(F.col("e")))
            .withColumn("a", F.when(F.col("a") == 0, F.lit(floor)).otherwise(F.col("a"))))


def psi_edges(counts: DataFrame, bins: int = PSI_BINS, blocks: int | None = None) -> DataFrame:
    """(feature, edges): unique linear-interpolated baseline percentiles 0..100 in
    ``bins`` steps; equal-width edges over baseline min..max when fewer than 3."""
    base = counts.filter(F.col("c_b") > 0).select("feature", "value", F.col("c_b").alias("c"))
    probs = [i / bins for i in range(bins + 1)]
    pct = exact_percentiles(base, ["feature"], "value", probs, blocks=blocks)
    arr = percentile_array(pct, ["feature"], "q")
    uniq = F.array_sort(F.array_distinct(F.col("q")))
    lo, hi = F.element_at("q", 1), F.element_at("q", -1)
    return arr.select("feature", F.when(F.size(uniq) < PSI_MIN_EDGES, linspace(lo, hi, bins))
                      .otherwise(uniq).alias("edges"))


def psi(baseline: DataFrame, current: DataFrame, features: Sequence[str],
        bins: int = PSI_BINS, blocks: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Population stability index per feature:
    (feature, n_baseline, n_current, n_edges, score, status)."""
    counts = counts if counts is not None else pair_counts(baseline, current, features)
    totals = _side_totals(counts, features)
    # one row per feature, read by three branches: computed once
    edges = cut_lineage(psi_edges(counts, bins, blocks))
    shares = _bin_shares(counts, edges, totals, PSI_FLOOR)
    score = shares.groupBy("feature").agg(
        F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("_s"))
    ok, status = _status()
    return (totals.join(edges, "feature", "left").join(score, "feature", "left")
            .select("feature", "n_baseline", "n_current",
                    F.when(ok, F.size("edges")).cast("int").alias("n_edges"),
                    F.when(ok, F.col("_s")).alias("score"), status))


@F.pandas_udf(T.DoubleType())
def _exact_pvalues(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else exact_ks_pvalue(x, int(a), int(b)) for x, a, b in zip(d, n1, n2)], dtype="float64")


def ks(baseline: DataFrame, current: DataFrame, features: Sequence[str],
       blocks: int | None = None, counts: DataFrame | None = None, exact_cells: int = 0) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value per feature: (feature, n_baseline,
    n_current, score, p_value, status). The p-value is the asymptotic one, or the exact one (of
    samples without ties) where n_baseline * n_current is at most ``exact_cells``."""
    counts = counts if counts is not None else pair_counts(baseline, current, features)
    totals = _side_totals(counts, features)
    cum = running_totals(counts, ["feature"], ["value"], ["c_b", "c_c"], blocks=blocks)
    d = (cum.join(F.broadcast(totals), "feature", "inner")
         .groupBy("feature").agg(F.max(F.abs(F.try_divide(F.col("cum_c_b"), F.col("n_baseline"))
                                             - F.try_divide(F.col("cum_c_c"), F.col("n_current")))).alias("_d")))
    ok, status = _status()
    out = totals.join(d, "feature", "left")
    n1, n2 = F.col("n_baseline"), F.col("n_current")
    p = kolmogorov_pvalue(F.col("_d"), n1, n2)
    if exact_cells:
        small = n1 * n2 <= exact_cells
        p = F.when(small, _exact_pvalues(F.when(ok & small, F.col("_d")), n1, n2)).otherwise(p)
    return out.select("feature", "n_baseline", "n_current", F.when(ok, F.col("_d")).alias("score"), F.when(ok, p).alias("p_value"), status)


def js(baseline: DataFrame, current: DataFrame, features: Sequence[str],
       bins: int = JS_BINS, counts: DataFrame | None = None) -> DataFrame:
    """Jensen-Shannon divergence (natural log) on ``bins`` equal-width bins over the
    joint min..max: (feature, n_baseline, n_current, score, status)."""
    counts = counts if counts is not None else pair_counts(baseline, current, features)
    totals = _side_totals(counts, features)
    rng = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    edges = rng.select("feature", linspace(F.col("lo"), F.col("hi"), bins).alias("edges"))
    shares = _bin_shares(counts, edges, totals, JS_FLOOR)
    m = (F.col("e") + F.col("a")) / 2
    score = shares.groupBy("feature").agg(
        (0.5 * F.sum(F.col("e") * F.log(F.col("e") / m)) + 0.5 * F.sum(F.col("a") * F.log(F.col("a") / m)))
        .alias("_s"))
    ok, status = _status()
    return (totals.join(score, "feature", "left")
            .select("feature", "n_baseline", "n_current", F.when(ok, F.col("_s")).alias("score"), status))


METHODS = {"psi": (psi, PSI_THRESHOLD), "ks": (ks, KS_THRESHOLD), "js": (js, JS_THRESHOLD)}


def data_drift(baseline: DataFrame | None, current: DataFrame, features: Sequence[str] | None = None,
               method: str = "psi", threshold: float | None = None, baseline_counts: DataFrame | None = None, **kw) -> DataFrame:
    """Per-feature drift: (feature, method, score, threshold, drift, status). The baseline is a
    table of rows, or the stored value counts (feature, value, c) of ``baseline_counts``.
    Features of ``current`` missing from the baseline are skipped; drift is strict
    ``score > threshold``; an unknown method is an error."""
    if method not in METHODS:
        raise ValueError(f"unknown drift method: {method}")
    fn, default_thr = METHODS[method]
    thr = default_thr if threshold is None else float(threshold)
    if baseline_counts is not None:
        # the stored feature names are as many as the features of a model
        known = {r["feature"] for r in baseline_counts.select("feature").distinct().collect()}
    else:
        known = set(baseline.columns)
    features = [c for c in (current.columns if features is None else features) if c in known and c in set(current.columns)]
    res = fn(baseline, current, features, counts=pair_counts(baseline, current, features, baseline_counts=baseline_counts), **kw)
    return res.select("feature", F.lit(method).alias("method"), "score", F.lit(thr).alias("threshold"),
                      F.coalesce(F.col("score") > F.lit(thr), F.lit(False)).alias("drift"), "status")


def data_drift_summary(per_feature: DataFrame) -> DataFrame:
    """One row: any feature drifting, and the score and method by feature, in feature order."""
    return per_feature.agg(
        F.coalesce(F.bool_or("drift"), F.lit(False)).alias("data_drift_detected"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "score")))).alias("feature_drift_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "method")))).alias("feature_drift_type"),
        F.count(F.when(F.col("drift"), 1)).alias("n_drifted"))


def validation_drift(base_df: DataFrame, current_df: DataFrame, alpha: float = KS_PVALUE_ALPHA,
                     blocks: int | None = None, exact_cells: int = 0) -> DataFrame:
    """KS p-value test per numeric column present in both tables (exact p-values up to
    ``exact_cells`` as in ``ks``): (column, p_value, drift_status) with drift_status
    'true'/'false'/'insufficient_data'."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    bt = dict(base_df.dtypes)
    ct = dict(current_df.dtypes)
    cols = [c for c in base_df.columns if c in ct
            and (bt[c] in numeric or bt[c].startswith("decimal"))
            and (ct[c] in numeric or ct[c].startswith("decimal"))]
    res = ks(base_df, current_df, cols, blocks=blocks, exact_cells=exact_cells)
    return res.select(F.col("feature").alias("column"), "p_value",
                      F.when(F.col("status") == "insufficient_data", F.lit("insufficient_data"))
                      .when(F.col("p_value") < alpha, F.lit("true")).otherwise(F.lit("false"))
                      .alias("drift_status"))


# ---------------------------------------------------------------------------------------------
# prediction-distribution (model) drift

def class_distribution(preds: DataFrame, pred_col: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., class, share): share of each predicted class; class key = str(int(c))."""
    keys = list(keys)
    cnt = preds.groupBy(*keys, pred_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return cnt.select(*keys, F.col(pred_col).cast("long").cast("string").alias("class"),
                      (F.col("_n") / F.sum("_n").over(w)).alias("share"))


def model_drift(baseline_preds: DataFrame, current_preds: DataFrame, pred_col: str = "prediction",
                threshold: float = 0.2, include_new_classes: bool = False) -> DataFrame:
    """One row (class_distribution_shift, model_drift_detected): sum over baseline
    classes of |p_current - p_baseline| (classes only in current are ignored unless
    ``include_new_classes``); drift iff shift > threshold."""
    b = class_distribution(baseline_preds, pred_col).withColumnRenamed("share", "p_b")
    c = class_distribution(current_preds, pred_col).withColumnRenamed("share", "p_c")
    how = "full" if include_new_classes else "left"
    j = b.join(c, "class", how)
    return (j.agg(F.coalesce(F.sum(F.abs(F.coalesce("p_c", F.lit(0.0)) - F.coalesce("p_b", F.lit(0.0)))),
                             F.lit(0.0)).alias("class_distribution_shift"))
            .withColumn("model_drift_detected", F.col("class_distribution_shift") > F.lit(threshold)))
