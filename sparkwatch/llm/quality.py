"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (log lengths, log-odds of character
shares, word and line diversity, ...). Each class is a Gaussian with its own covariance,
shrunk towards the pooled one and towards a scaled identity. A text's log odds are half the
difference of the squared Mahalanobis distances, plus the difference of the log determinants
and log priors; the inverse Cholesky factors are computed once and travel with the model.

Fitting reads moments only: counts, sums and sums of products by class and fold, added up by
Spark; the driver sees a table whose size depends on the number of statistics alone. The
shrinkage and the calibration of the log odds (a logistic curve, so that 0.7 means 0.7) are
chosen on log odds that each fold gets from the other folds' moments, gathered as histograms.
All labelled rows count; there is no sample.

Defined cases: null text counts as empty, and empty texts get a score from the same model;
labels that are null or other than 0 and 1, and documents with contradicting labels, are not
learned from; repeated rows count as often as they occur; with no labelled row, or labels of
one class only, all scores are the share of label 1 (0.5 without any); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, release_memory, require_columns, slices, text_bytes

THRESHOLD = 0.7
#: Share of the pooled covariance, and of the scaled identity, in a class covariance.
POOLED = (0.0, 0.2, 0.6)
IDENTITY = (0.001, 0.02, 0.1)
#: Bins of the log odds' histogram, over sign * log(1 + |log odds|) from -LIMIT to LIMIT.
BINS, LIMIT = 400, 10.0

# classes of bytes: lower, upper, digit, space, line break, sentence marks, ! and ?, other ASCII, beyond ASCII
_LOWER, _UPPER, _DIGIT, _SPACE, _BREAK, _MARK, _LOUD, _SYMBOL, _BEYOND = range(9)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, dtype=np.int64)
    out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[9, 11, 12, 13, 32]], out[10] = _SPACE, _BREAK
    for chars, cls in ((b".,;:'\"()-", _MARK), (b"!?", _LOUD)):
        out[list(chars)] = cls
    out[128:] = _BEYOND
    return out


_CLASS = _byte_classes()
STATISTICS = ("bytes", "words", "word_length", "word_spread", "longest_word", "short_words", "upper", "digits", "spaces", "breaks",
              "marks", "loud", "symbols", "beyond", "entropy", "distinct_words", "distinct_pairs", "repeated_words",
              "distinct_lines", "line_words")


def _odds(share: float) -> float:
    return float(np.log((share + 0.002) / (1.002 - share)))


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one whole text, in the order of STATISTICS."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=counts, minlength=9) / max(len(data), 1)
    words = data.lower().split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    p = counts[counts > 0] / max(len(data), 1)
    pairs = max(len(words) - 1, 1)
    lines = [x for x in data.split(b"\n") if x]
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()),
        _odds(float((lengths <= 3).mean())), *(_odds(by_class[c]) for c in (_UPPER, _DIGIT, _SPACE, _BREAK, _MARK, _LOUD, _SYMBOL, _BEYOND)),
        float(-(p * np.log(p)).sum()),
        # vocabulary grows as a power of the length; the exponent compares texts of all lengths
        np.log(max(len(set(words)), 1)) / np.log(n + 1.0), np.log1p(len(set(zip(words, words[1:])))) / np.log(pairs + 1.0),
        _odds(sum(map(operator.eq, words, words[1:])) / pairs),
        _odds(len(set(lines)) / max(len(lines), 1)), np.log1p(len(words) / max(len(lines), 1)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])
    release_memory()


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    require_columns(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        _features, "doc_id long, x array<double>")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 marks the held-out rows. A null id counts as 'null'."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4).cast("int")


@dataclass
class Model:
    """Means, inverse Cholesky factors and constants of both classes, and the calibration."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    constants: list[float] = field(default_factory=list)
    slope: float = 1.0
    intercept: float = 0.0
    share: float = 0.5

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        return _sigmoid(self.slope * _squash(self.log_odds(x)) + self.intercept)


def _squash(v: np.ndarray) -> np.ndarray:
    return np.clip(np.sign(v) * np.log1p(np.abs(v)), -LIMIT, LIMIT)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))


def _gaussians(moments: dict[int, np.ndarray], pooled: float, identity: float) -> Model | None:
    """A model from (1, x) (1, x)' sums by class; None without both classes."""
    if any(k not in moments or moments[k][0, 0] < 2 for k in (0, 1)):
        return None
    total = moments[0] + moments[1]
    center = total[0, 1:] / total[0, 0]
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - center**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    own, means = [], []
    for k in (0, 1):
        n, mean = moments[k][0, 0], moments[k][0, 1:] / moments[k][0, 0]
        own.append((moments[k][1:, 1:] / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - center) / scale)
    both = sum(moments[k][0, 0] * own[k] for k in (0, 1)) / total[0, 0]
    model = Model(center, scale, means)
    for k in (0, 1):
        cov = (1 - pooled) * own[k] + pooled * both
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        model.factors.append(np.linalg.inv(factor))
        model.constants.append(float(np.log(moments[k][0, 0] / total[0, 0]) - np.log(np.diag(factor)).sum()))
    return model


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        if len(b):
            x = np.hstack([np.ones((len(b), 1)), np.stack(b["x"].to_numpy())])
            fold, label = b["fold"].to_numpy(), b["label"].to_numpy()
            for k in set(zip(fold.tolist(), label.tolist())):
                part = x[(fold == k[0]) & (label == k[1])]
                sums[k] = sums.get(k, 0) + part.T @ part
    for (fold, label), m in sums.items():
        i, j = np.triu_indices(len(m))
        yield pd.DataFrame({"fold": fold, "label": label, "i": i, "j": j, "v": m[i, j]})


def _histograms(models: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            x, fold, label = np.stack(b["x"].to_numpy()), b["fold"].to_numpy(), b["label"].to_numpy()
            for (f, setting), model in models.items():
                for k in (0, 1):
                    part = x[(fold == f) & (label == k)]
                    if len(part):
                        at = ((_squash(model.log_odds(part)) + LIMIT) / (2 * LIMIT) * (BINS - 1)).round().astype(int)
                        counts[setting, k] = counts.get((setting, k), 0) + np.bincount(at, minlength=BINS)
        for (setting, k), c in counts.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"setting": setting, "label": k, "bin": at, "n": c[at]})

    return run


def _calibrate(neg: np.ndarray, pos: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and log loss of a logistic curve over the histogram's bins."""
    v = np.linspace(-LIMIT, LIMIT, BINS)
    x, n = np.stack([v, np.ones(BINS)], axis=1), neg + pos
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (n * p - pos) + 1e-3 * w
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    w[0] = max(w[0], 1e-3)
    p = np.clip(_sigmoid(x @ w), 1e-12, 1 - 1e-12)
    return float(w[0]), float(w[1]), float(-(pos * np.log(p) + neg * np.log(1 - p)).sum())


def fit(feats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from the rows of ``feats`` (doc_id, x) that have a label and are not held out."""
    require_columns(labels, "doc_id", label)
    d = len(STATISTICS) + 1
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where("label in (0, 1) and doc_id is not null").groupBy("doc_id")
             .agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))
    rows = feats.withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 2").join(known, "doc_id").select("fold", "label", "x")
    sums = rows.mapInPandas(_moments, "fold int, label int, i int, j int, v double").groupBy("fold", "label", "i", "j").agg(
        F.sum("v").alias("v")).collect()
    by: dict[int, dict[int, np.ndarray]] = {}
    for r in sums:
        m = by.setdefault(r["fold"], {}).setdefault(r["label"], np.zeros((d, d)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]

    def without(fold: int | None) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for f, classes in by.items():
            if f != fold:
                for k, m in classes.items():
                    out[k] = out.get(k, 0) + m
        return out

    everything = without(None)
    n = {k: everything[k][0, 0] if k in everything else 0.0 for k in (0, 1)}
    share = float(n[1] / (n[0] + n[1])) if n[0] + n[1] else 0.5
    settings = [(p, i) for p in POOLED for i in IDENTITY]
    if _gaussians(everything, *settings[-1]) is None:
        return Model(np.zeros(d - 1), np.ones(d - 1), share=share)
    tried = {(f, s): m for s, x in enumerate(settings) for f in by if (m := _gaussians(without(f), *x))}
    found = np.zeros((len(settings), 2, BINS))
    if tried:
        hist = rows.mapInPandas(_histograms(tried), "setting int, label int, bin int, n long")
        for r in hist.groupBy("setting", "label", "bin").agg(F.sum("n").alias("n")).collect():
            found[r["setting"], r["label"], r["bin"]] = r["n"]
    curves = [_calibrate(*found[s]) for s in range(len(settings))]
    best = min(range(len(settings)), key=lambda s: curves[s][2])
    model = _gaussians(everything, *settings[best])
    model.share = share
    if found[best].sum(axis=1).all():
        model.slope, model.intercept = curves[best][:2]
    return model


def score(feats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) from (doc_id, x)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(np.stack(b["x"].to_numpy())) if len(b) else []})

    scored = feats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): fits on the labelled documents, scores all."""
    prepare(docs.sparkSession)
    feats = materialize(features(docs), "quality-features")
    return score(feats, fit(feats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted 1, with all their columns. Texts are read twice and not shuffled."""
    prepare(docs.sparkSession)
    model = fit(materialize(features(docs), "quality-features"), labels)

    @F.pandas_udf("double")
    def good(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))
        release_memory()
        return pd.Series(model.score(x))

    return docs.where(good(text_bytes()) >= THRESHOLD)
