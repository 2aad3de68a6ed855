"""Classification metrics and model gates as single conditional aggregates.

Nothing is collected: confusion counts and F1/precision/recall are one aggregate (per
model when ``by`` is given), and gates/selection are expressions over the small metric
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div

# ---- fixed values: model gates ----
MIN_TEST_F1 = 0.6
MAX_F1_GAP = 0.05
MIN_IMPROVEMENT = 0.02
# ---- end fixed values ----


def confusion_counts(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """AGG-07: tp, fp, fn, tn (positive class 1)."""
    y, p = F.col(label_col), F.col(pred_col)
    pos_y, pos_p = (y == positive), (p == positive)
    return df.groupBy(*by).agg(
        F.count(F.when(pos_y & pos_p, 1)).alias("tp"),
        F.count(F.when(~pos_y & pos_p, 1)).alias("fp"),
        F.count(F.when(pos_y & ~pos_p, 1)).alias("fn"),
        F.count(F.when(~pos_y & ~pos_p, 1)).alias("tn"))


def metrics_from_counts(cc: DataFrame) -> DataFrame:
    """AGG-08: f1, precision, recall; 0 when a denominator is 0; plus accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return cc.select(*[c for c in cc.columns if c not in ("tp", "fp", "fn", "tn")],
                     "tp", "fp", "fn", "tn",
                     safe_div(2 * tp, 2 * tp + fp + fn, zero).alias("f1_score"),
                     safe_div(tp, tp + fp, zero).alias("precision_score"),
                     safe_div(tp, tp + fn, zero).alias("recall_score"),
                     safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                           by: Sequence[str] = ()) -> DataFrame:
    return metrics_from_counts(confusion_counts(df, label_col, pred_col, by))


def long_predictions(df: DataFrame, label_col: str, model_cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., label, model, prediction): several prediction columns side by side -> long."""
    return df.select(*keys, F.col(label_col).alias("label"), *model_cols).unpivot(
        [*keys, "label"], list(model_cols), "model", "prediction")


def prediction_summary(df: DataFrame, pred_col: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """AGG-09: total, phishing (=1) count/%, legitimate (0 or -1) count/% with one
    decimal; NULL percentages when there are no rows."""
    p = F.col(pred_col)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                              F.count(F.when(p == 1, 1)).alias("phishing"),
                              F.count(F.when((p == 0) | (p == -1), 1)).alias("legitimate"))
    return out.select(*by, "total", "phishing",
                      F.round(safe_div(100 * F.col("phishing"), F.col("total")), 1).alias("phishing_pct"),
                      "legitimate",
                      F.round(safe_div(100 * F.col("legitimate"), F.col("total")), 1).alias("legitimate_pct"))


def best_by_metric(metric_table: DataFrame, metric: str = "f1_score", name_col: str = "model",
                   order_col: str = "candidate_order") -> DataFrame:
    """TOP-02: arg-max of ``metric``; among equal scores the first candidate wins."""
    return metric_table.agg(
        F.max_by(F.col(name_col), F.struct(F.col(metric), -F.col(order_col))).alias("best_model"),
        F.max(metric).alias(f"best_{metric}"))


def min_score_gate(f1: Column, min_f1: float = MIN_TEST_F1) -> Column:
    """ML-10: reject when the best test F1 is below the minimum."""
    return f1 >= F.lit(min_f1)


def overfit_gate(train_f1: Column, test_f1: Column, max_gap: float = MAX_F1_GAP) -> Column:
    """ML-11: reject when |train F1 - test F1| > max_gap."""
    return F.abs(train_f1 - test_f1) <= F.lit(max_gap)


def champion_challenger(scored: DataFrame, label_col: str = "label", champion_col: str | None = "champion",
                        challenger_col: str = "challenger", min_improvement: float = MIN_IMPROVEMENT) -> DataFrame:
    """ML-12: F1 of both models on the same rows in ONE pass; accept the challenger iff
    there is no champion (improvement := its F1) or F1 gain > min_improvement (strict)."""
    models = [challenger_col] + ([champion_col] if champion_col else [])
    m = classification_metrics(long_predictions(scored, label_col, models), "label", "prediction", by=["model"])
    agg = m.agg(F.max(F.when(F.col("model") == challenger_col, F.col("f1_score"))).alias("challenger_f1"),
                F.max(F.when(F.col("model") == (champion_col or ""), F.col("f1_score"))).alias("champion_f1"))
    impr = F.when(F.col("champion_f1").isNull(), F.col("challenger_f1")) \
        .otherwise(F.col("challenger_f1") - F.col("champion_f1"))
    return agg.select("challenger_f1", "champion_f1", impr.alias("improved_accuracy"),
                      F.when(F.col("champion_f1").isNull(), F.lit(True))
                      .otherwise(impr > F.lit(min_improvement)).alias("is_model_accepted"))
