"""Feature profiles and histograms (the baseline statistics of a model version).

One scan: the table is unpivoted and reduced to per-(feature, value) counts; mean,
sample standard deviation (two-pass over the counts) and exact linear-interpolated
quartiles (blocked running ranks) are all derived from that count table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .drift import counts_of
from .ranking import exact_percentiles

QUARTILES = (0.25, 0.5, 0.75)


def feature_histogram(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, value, n): count of every distinct non-missing value."""
    return counts_of(df, features, keys, "n")


def profile_from_counts(counts: DataFrame, keys: Sequence[str] = ("feature",),
                        blocks: int | None = None) -> DataFrame:
    """counts: (keys..., value, c). Returns (keys..., n, mean, std, q25, q50, q75)."""
    keys = list(keys)
    s1 = counts.groupBy(*keys).agg(F.sum("c").alias("n"),
                                   (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"))
    dev = (counts.join(F.broadcast(s1), keys, "inner")
           .groupBy(*keys).agg(F.sum(F.col("c") * (F.col("value") - F.col("mean")) ** 2).alias("_ss")))
    pct = exact_percentiles(counts, keys, "value", list(QUARTILES), blocks=blocks)
    q = pct.groupBy(*keys).agg(*[F.max(F.when(F.col("p_idx") == i, F.col("q"))).alias(n)
                                 for i, n in enumerate(("q25", "q50", "q75"))])
    return (s1.join(dev, keys, "inner").join(q, keys, "left")
            .select(*keys, F.col("n").cast("long").alias("n"), "mean",
                    F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).alias("std"),
                    "q25", "q50", "q75"))


def feature_profile(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
                    blocks: int | None = None, accuracy: float | None = None) -> DataFrame:
    """Per feature: n, mean, sample std (ddof=1), q25/q50/q75 (linear interpolation). With
    ``accuracy``, quartiles from sketches, whose ranks are right within that share of the rows, and
    that share as ``rank_error``."""
    keys = list(keys)
    if accuracy is not None:
        from .sketch import feature_sketches, profile_from_sketches
        return profile_from_sketches(feature_sketches(df, features, keys, accuracy), accuracy)
    # one pass over the rows; moments and quartiles read the materialised count table
    return profile_from_counts(cut_lineage(counts_of(df, features, keys)), keys + ["feature"], blocks)
