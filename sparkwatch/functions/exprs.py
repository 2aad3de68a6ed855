"""Column expressions shared by the operators: built-in Spark expressions (JVM side, whole-stage
codegen), and the exact p-value of small samples, a plain function for one row per feature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode_label(c: str | Column) -> Column:
    """-1 -> 0, anything else unchanged (label / prediction recoding)."""
    c = col_(c)
    return F.when(c == -1, F.lit(0)).otherwise(c)


def class_name(c: str | Column) -> Column:
    """1 -> 'phishing', anything else -> 'legitimate'."""
    return F.when(col_(c) == 1, F.lit("phishing")).otherwise(F.lit("legitimate"))


def safe_div(num: Column, den: Column, default: Column | None = None) -> Column:
    """num / den as double; ``default`` (NULL if not given) when den is 0 or NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, default)


def linspace(lo: Column, hi: Column, bins: int) -> Column:
    """``bins + 1`` equally spaced edges lo..hi; element i = i*step + lo, last = hi exactly."""
    step = (hi - lo) / F.lit(float(bins))
    return F.transform(F.sequence(F.lit(0), F.lit(bins)),
                       lambda i: F.when(i == bins, hi).otherwise(i.cast("double") * step + lo))


def histogram_bin(value: Column, edges: Column) -> Column:
    """0-based histogram bin of ``value`` for sorted ``edges``: bin i holds
    edges[i] <= v < edges[i+1]; the last bin is closed on the right. NULL when the
    value lies outside [edges[0], edges[-1]] (such values are not counted)."""
    n_le = F.size(F.filter(edges, lambda e: e <= value))
    m = F.size(edges)
    return (F.when(value < F.element_at(edges, 1), F.lit(None))
            .when(value > F.element_at(edges, -1), F.lit(None))
            .otherwise(F.least(n_le - 1, m - 2)))


def kolmogorov_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic p-value of the two-sample KS statistic:
    2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), lambda = D sqrt(n1 n2 / (n1 + n2)),
    clamped to [0, 1]; lambda < 0.2 gives 1."""
    lam = d * F.sqrt((n1 * n2).cast("double") / (n1 + n2).cast("double"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0).cast("double"),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series))
    return F.when(lam.isNull(), F.lit(None).cast("double")).when(lam < 0.2, F.lit(1.0)).otherwise(p)


def exact_ks_pvalue(d: float, n1: int, n2: int) -> float:
    """P(D >= d) of two samples without ties: one less the share of lattice paths from (0, 0) to
    (n1, n2) that stay where abs(x / n1 - y / n2) < d. Shares are formed diagonal by diagonal, as
    probabilities that a random path is inside, so that nothing overflows."""
    x = np.arange(n1 + 1)
    # x and y count in units of 1 / (n1 * n2): whole numbers, and a bound between two of them
    bound = np.ceil(d * n1 * n2 - 1e-6)
    share = np.zeros(n1 + 1)
    share[0] = 1.0 if bound > 0 else 0.0
    for s in range(1, n1 + n2 + 1):
        # a path to (x, s - x) comes from (x - 1, s - x) with probability x / s
        step = np.zeros(n1 + 1)
        step[1:] = share[:-1] * x[1:] / s
        share = step + share * (s - x) / s
        y = s - x
        share[(y < 0) | (y > n2) | (np.abs(x * n2 - y * n1) >= bound)] = 0.0
    return float(min(1.0, max(0.0, 1.0 - share[n1])))
