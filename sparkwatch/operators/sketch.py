"""Profiles and drift from mergeable quantile sketches: the ``accuracy=`` option.

Exact quantiles and drift need the count of every distinct value. A sketch (KLL, Spark's own
functions) of a feature has a few kilobytes whatever its rows, and sketches of days, files or
versions merge into one of the whole; counts, means and sums of squared deviations merge too. So a
baseline can be kept by day and any span of days compared without reading rows.

Ranks that a sketch gives are wrong by at most ``rank_error(k)`` of the rows with a probability of
99 %; ``accuracy`` chooses k so that twice that holds. Scores come with ``error``, the most by which
they can differ from the exact score while the ranks are within the bound.

Missing values are left out, as in the exact operators; a feature without values has n 0 and
null statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drift import PSI_BINS, PSI_FLOOR

#: Sizes that a sketch can have.
LEAST_K, MOST_K = 8, 65_535
QUARTILES = (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
#: Points of a distribution at which two are compared.
GRID = 200
#: Quantiles that a rank is read from.
RANKS = 1_000


def rank_error(k: int) -> float:
    """The error of a rank difference, in shares of the rows, that a sketch of size k keeps with 99 %."""
    return 2.446 / k**0.9433


def sketch_size(accuracy: float) -> int:
    """The smallest k whose rank error is half of ``accuracy``."""
    if not 0 < accuracy < 1:
        raise ValueError("the accuracy is a share of the rows")
    k = min(MOST_K, max(LEAST_K, math.ceil((2.446 / (accuracy / 2)) ** (1 / 0.9433))))
    if rank_error(k) > accuracy:
        raise ValueError(f"no sketch is as accurate as {accuracy}")
    return k


def feature_sketches(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), accuracy: float = 0.01) -> DataFrame:
    """(keys..., feature, sketch, n, mean, m2, lo, hi): one pass, combined before the shuffle; ``m2`` is
    the sum of squared deviations from the mean."""
    k = sketch_size(accuracy)
    values = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    long = df.select(*keys, F.posexplode(values).alias("_f", "v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    out = long.groupBy(*keys, "_f").agg(
        F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
        (F.var_pop("v") * F.count(F.lit(1))).alias("m2"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = F.array(*[F.lit(f) for f in features])
    return out.select(*keys, F.element_at(names, F.col("_f") + 1).alias("feature"), "sketch", "n", "mean", "m2", "lo", "hi")


def merge_sketches(parts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """The sketches, counts and moments of all parts with the same ``keys`` as one row."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    m2 = F.sum(F.col("m2") + F.col("n") * F.col("mean") ** 2) - n * mean**2
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), n.alias("n"), mean.alias("mean"),
                                    F.greatest(m2, F.lit(0.0)).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _quantiles(sketch: Column, lo: Column, hi: Column, shares: Sequence[float]) -> Column:
    """Values at ``shares``; the ends are exact."""
    inner = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in shares]))
    return F.transform(inner, lambda q: F.least(F.greatest(q, lo), hi))


def profile_from_sketches(sketches: DataFrame, accuracy: float = 0.01) -> DataFrame:
    """(..., n, mean, std, q25, q50, q75, rank_error): quartiles whose ranks are within
    ``rank_error`` of theirs."""
    keys = [c for c in sketches.columns if c not in ("sketch", "n", "mean", "m2", "lo", "hi")]
    q = _quantiles(F.col("sketch"), F.col("lo"), F.col("hi"), [p for _, p in QUARTILES])
    return sketches.withColumn("_q", q).select(
        *keys, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
        *[F.get("_q", F.lit(i)).alias(name) for i, (name, _) in enumerate(QUARTILES)], F.lit(float(accuracy)).alias("rank_error"))


def _both(baseline: DataFrame, current: DataFrame) -> DataFrame:
    sides = [s.select("feature", *[F.col(c).alias(f"{c}_{x}") for c in ("sketch", "n", "lo", "hi")]) for s, x in ((baseline, "b"), (current, "c"))]
    return sides[0].join(sides[1], "feature")


def _ranks(side: str, at: Column) -> Column:
    """Shares of rows up to each of the values ``at``: how many of RANKS evenly spaced quantiles are
    at most the value (Spark gives ranks of constants alone); beyond the ends they are known."""
    lo, hi = F.col(f"lo_{side}"), F.col(f"hi_{side}")
    quantiles = _quantiles(F.col(f"sketch_{side}"), lo, hi, [i / RANKS for i in range(RANKS + 1)])
    share = lambda v: F.greatest((F.size(F.filter(quantiles, lambda q: q <= v)) - 1) / F.lit(float(RANKS)), F.lit(0.0))
    return F.transform(at, lambda v: F.when(v < lo, 0.0).when(v >= hi, 1.0).otherwise(share(v)))


def ks_from_sketches(baseline: DataFrame, current: DataFrame, accuracy: float = 0.01) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of merged sketches: (feature, n_baseline, n_current,
    score, error). The distributions are compared at GRID quantiles of each."""
    shares = [i / GRID for i in range(GRID + 1)]
    points = F.array_distinct(F.concat(_quantiles(F.col("sketch_b"), F.col("lo_b"), F.col("hi_b"), shares),
                                       _quantiles(F.col("sketch_c"), F.col("lo_c"), F.col("hi_c"), shares)))
    both = _both(baseline, current).withColumn("_at", F.array_sort(points))
    both = both.withColumn("_b", _ranks("b", F.col("_at"))).withColumn("_c", _ranks("c", F.col("_at")))
    gaps = F.transform(F.arrays_zip(F.col("_b").alias("b"), F.col("_c").alias("c")), lambda x: F.abs(x["b"] - x["c"]))
    # each rank is within the accuracy, and between two points a distribution gains what lies between them
    return both.select("feature", F.col("n_b").alias("n_baseline"), F.col("n_c").alias("n_current"), F.array_max(gaps).alias("score"),
                       F.lit(4 * accuracy + 1 / GRID + 2 / RANKS).alias("error"))


def psi_from_sketches(baseline: DataFrame, current: DataFrame, bins: int = PSI_BINS, accuracy: float = 0.01) -> DataFrame:
    """Population stability index of merged sketches over bins between the baseline's quantiles:
    (feature, n_baseline, n_current, score, error). The error is that of the score over these bins:
    the shares of a bin are within twice the accuracy."""
    shares = [i / bins for i in range(bins + 1)]
    edges = F.array_sort(F.array_distinct(_quantiles(F.col("sketch_b"), F.col("lo_b"), F.col("hi_b"), shares)))
    both = _both(baseline, current).withColumn("_e", edges)
    both = both.withColumn("_b", _ranks("b", F.col("_e"))).withColumn("_c", _ranks("c", F.col("_e")))

    def share(ranks: str):
        # the first bin holds its lower edge too
        return lambda i: F.get(F.col(ranks), i + 1) - F.when(i == 0, F.lit(0.0)).otherwise(F.get(F.col(ranks), i))

    def term(a: Column, e: Column) -> Column:
        a, e = F.greatest(a, F.lit(PSI_FLOOR)), F.greatest(e, F.lit(PSI_FLOOR))
        return (a - e) * F.log(a / e)

    width, a, e = 2 * accuracy + 1 / RANKS, share("_c"), share("_b")

    def off(i: Column) -> Column:
        own = term(a(i), e(i))
        corners = [F.abs(term(a(i) + x, e(i) + y) - own) for x in (-width, width) for y in (-width, width)]
        return F.greatest(*corners)

    each = F.sequence(F.lit(0), F.size("_e") - 2)
    total = lambda f: F.aggregate(F.transform(each, f), F.lit(0.0), lambda s, v: s + v)
    some = F.size("_e") > 1
    return both.select("feature", F.col("n_b").alias("n_baseline"), F.col("n_c").alias("n_current"),
                       F.when(some, total(lambda i: term(a(i), e(i)))).otherwise(0.0).alias("score"),
                       F.when(some, total(off)).otherwise(0.0).alias("error"))
