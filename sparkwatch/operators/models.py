"""Candidate classifiers, model selection with gates, scoring, promotion and the
experiment log.

Built-in ``pyspark.ml`` estimators for forest / tree / gradient boosting / logistic
regression; boosted stumps (``boost.py``) and k-NN voting (``knn.py``) for the two
algorithms Spark lacks. Missing values are filled by the k-NN imputer, a fitted stage that is
saved, promoted and loaded with the model. All metrics are Spark aggregates; only metric rows
reach the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import recode_label
from ..session import cut_lineage
from . import metrics as M
from .boost import BoostedStumps, BoostedStumpsModel
from .impute import KnnImputer, mean_imputer

# ---- fixed values: candidates in their selection order (first wins ties) ----
CANDIDATES = ["random_forest", "decision_tree", "gradient_boosting", "logistic_regression", "adaboost", "knn"]
LOGISTIC_MAX_ITER = 1000
# ---- end fixed values ----


def make_estimator(name: str, seed: int = 42, **kw):
    from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                           RandomForestClassifier)
    common = dict(featuresCol="features", labelCol="label")
    if name == "random_forest":
        return RandomForestClassifier(seed=seed, **common, **kw)
    if name == "decision_tree":
        return DecisionTreeClassifier(seed=seed, **common, **kw)
    if name == "gradient_boosting":
        return GBTClassifier(seed=seed, **common, **kw)
    if name == "logistic_regression":
        return LogisticRegression(maxIter=LOGISTIC_MAX_ITER, **common, **kw)
    if name == "adaboost":
        return BoostedStumps(seed=seed, **kw)
    if name == "knn":
        return KnnVote(**kw)
    raise ValueError(f"unknown model {name}")


def prepare(df: DataFrame, features: Sequence[str], target: str | None = "Result") -> DataFrame:
    """Features as doubles and label recoded -1 -> 0 (double)."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    if target and target in df.columns:
        cols.append(recode_label(target).cast("double").alias("label"))
    keep = [c for c in df.columns if c not in features and c != target]
    return df.select(*keep, *cols)


def preprocessing_stages(features: Sequence[str], imputer: str = "knn"):
    """Imputer fit on training data (k nearest neighbours, or column means) + VectorAssembler."""
    from pyspark.ml.feature import VectorAssembler
    if imputer not in ("knn", "mean"):
        raise ValueError(f"unknown imputer {imputer}")
    first = KnnImputer(inputCols=list(features)) if imputer == "knn" else mean_imputer(features)
    return [first, VectorAssembler(inputCols=list(features), outputCol="features")]


class KnnVote:
    """k-NN vote as an estimator over the imputed feature columns."""

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, df: DataFrame) -> "KnnVoteModel":
        from pyspark.ml.functions import vector_to_array

        # donors as rows of their own: equal vectors with equal labels are the same donor to a vote
        donors = df.select(vector_to_array("features").alias("x"), F.col("label").cast("long").alias("label"))
        return KnnVoteModel(cut_lineage(donors), self.k)


class KnnVoteModel:
    """The donors (x, label) and k. Every distinct vector of a frame is voted on once, and the
    vote joined back on the vector itself. A donor's id is its vector as text, then its label, so ties
    don't depend on partitions."""

    def __init__(self, donors: DataFrame, k: int):
        self.donors, self.k = donors, k

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        from . import knn
        q = df.withColumn("_x", vector_to_array("features"))
        named = F.concat(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), F.lit("|"), F.col("label").cast("string"))
        counts = self.donors.groupBy("x", "label").agg(F.count(F.lit(1)).alias("n"))
        groups = counts.select("x", "label", F.array_repeat(named, F.least(F.col("n"), F.lit(self.k)).cast("int")).alias("ids"))
        asked = cut_lineage(q.select(F.col("_x").alias("x")).distinct())
        best = knn.nearest(asked, groups, self.k, knn._width(asked), payload="label")
        votes = best.select("x", F.explode("best").alias("b")).groupBy("x", F.col("b.value").alias("label")).agg(F.count(F.lit(1)).alias("v"))
        voted = votes.groupBy("x").agg(F.max_by("label", F.struct(F.col("v"), -F.col("label"))).cast("double").alias("prediction"))
        return q.join(voted.withColumnRenamed("x", "_vx"), F.col("_x") == F.col("_vx"), "left").drop("_x", "_vx")

    def save(self, path: str) -> None:
        self.donors.withColumn("k", F.lit(self.k)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "KnnVoteModel":
        stored = spark.read.parquet(path)
        return cls(stored.drop("k"), int(stored.agg(F.max("k")).first()[0]))


def fit_preprocessing(train: DataFrame, features: Sequence[str], imputer: str = "knn"):
    """The fitted preprocessing stages, shared by all candidates."""
    from pyspark.ml import Pipeline

    return Pipeline(stages=preprocessing_stages(features, imputer)).fit(train)


def fit_candidate(name: str, train: DataFrame, features: Sequence[str], seed: int = 42, pre=None, assembled: DataFrame | None = None,
                  imputer: str = "knn", **kw):
    """Fit preprocessing + one candidate on ``train`` (prepared frame), or the candidate alone on
    ``assembled``, what the fitted preprocessing ``pre`` made of it. Returns a model with
    ``transform`` producing ``prediction``."""
    from pyspark.ml import PipelineModel

    if pre is None:
        pre = fit_preprocessing(train, features, imputer)
    if assembled is None:
        assembled = cut_lineage(pre.transform(train))
    est = make_estimator(name, seed, **kw)
    fitted = est.fit(assembled)
    if hasattr(est, "_java_obj"):
        return PipelineModel(stages=[*pre.stages, fitted])
    return _Chained(pre, fitted)


def last_stage(model):
    """The classifier of a fitted candidate, for frames that are preprocessed already."""
    return model.model if isinstance(model, _Chained) else model.stages[-1]


class _Chained:
    """Preprocessing PipelineModel followed by a custom model."""

    def __init__(self, pre, model):
        self.pre, self.model = pre, model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.pre.transform(df))


def confidence(scored: DataFrame):
    """The probability of the predicted class; NULL for models without probabilities."""
    from pyspark.ml.functions import vector_to_array
    if "probability" not in scored.columns:
        return F.lit(None).cast("double")
    return F.array_max(vector_to_array(F.col("probability")))


def evaluate(model, df: DataFrame) -> DataFrame:
    """One-row metrics (tp/fp/fn/tn, f1, precision, recall, accuracy) of a model on ``df``."""
    return M.classification_metrics(model.transform(df), "label", "prediction")


def select_best_model(train: DataFrame, test: DataFrame, features: Sequence[str],
                      candidates: Sequence[str] = CANDIDATES, params: dict | None = None, seed: int = 42):
    """ML-09: fit every candidate on the imputed training frame, score train and test,
    return (metric table DataFrame, {name: model}, best name). The metric table has one
    row per candidate with its order, train/test F1, precision and recall."""
    spark = train.sparkSession
    params = params or {}
    rows, models = [], {}
    # fitted once, and both frames filled once: every candidate reads the stored rows
    pre = fit_preprocessing(train, features)
    ready = [cut_lineage(pre.transform(f)) for f in (train, test)]
    for order, name in enumerate(candidates):
        model = models[name] = fit_candidate(name, train, features, seed, pre, ready[0], **params.get(name, {}))
        tr, te = (evaluate(last_stage(model), f).first() for f in ready)
        rows.append((name, order, tr["f1_score"], te["f1_score"], tr["precision_score"], te["precision_score"],
                     tr["recall_score"], te["recall_score"], te["accuracy"]))
    table = spark.createDataFrame(rows, "model string, candidate_order int, train_f1 double, f1_score double, train_precision double, "
                                        "precision_score double, train_recall double, recall_score double, accuracy double")
    best = M.best_by_metric(table).first()["best_model"]
    return table, models, best


def apply_gates(table: DataFrame, min_f1: float = M.MIN_TEST_F1, max_gap: float = M.MAX_F1_GAP) -> DataFrame:
    """ML-10/11 over the metric table."""
    return table.withColumn("passes_min_score", M.min_score_gate(F.col("f1_score"), min_f1)) \
        .withColumn("passes_overfit", M.overfit_gate(F.col("train_f1"), F.col("f1_score"), max_gap))


def batch_score(model, df: DataFrame, features: Sequence[str], output_path: str | None = None,
                pred_col: str = "predicted_column") -> DataFrame:
    """ML-13 / PRJ-08: impute + predict on any table with the feature columns, prediction
    appended as ``predicted_column`` (0/1); written to Parquet when a path is given."""
    prepared = prepare(df, features, target=None)
    out = model.transform(prepared)
    keep = [c for c in prepared.columns] + [F.col("prediction").cast("int").alias(pred_col)]
    out = out.select(*keep)
    if output_path:
        out.write.mode("overwrite").parquet(output_path)
    return out


_OWN_MODELS = {"boosted_stumps": BoostedStumpsModel, "knn_vote": KnnVoteModel}


def save_model(spark: SparkSession, model, path: str) -> None:
    """Persists any candidate with its preprocessing; ``load_model`` reads it back."""
    if isinstance(model, _Chained):
        kind = next((k for k, c in _OWN_MODELS.items() if isinstance(model.model, c)), None)
        if kind is None:
            raise ValueError(f"a {type(model.model).__name__} can't be saved")
        model.pre.write().overwrite().save(f"{path}/pre")
        model.model.save(f"{path}/model")
    else:
        kind = "pipeline"
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(kind,)], "kind string").write.mode("overwrite").json(f"{path}/kind")


def load_model(spark: SparkSession, path: str):
    """The model that ``save_model`` has written to ``path``."""
    from pyspark.ml import PipelineModel

    kind = spark.read.schema("kind string").json(f"{path}/kind").first()["kind"]
    if kind == "pipeline":
        return PipelineModel.load(f"{path}/model")
    return _Chained(PipelineModel.load(f"{path}/pre"), _OWN_MODELS[kind].load(spark, f"{path}/model"))


def load_current(spark: SparkSession, registry_path: str):
    """(model_version, model) in production, from the registry."""
    row = current_model(spark.read.parquet(registry_path)).first()
    if row is None or row["model_version"] is None:
        raise FileNotFoundError(f"no accepted model in {registry_path}")
    return row["model_version"], load_model(spark, row["model_path"])


def score_and_log(spark: SparkSession, registry_path: str, df: DataFrame, features: Sequence[str], id_col: str, log_path: str,
                  scored_at) -> DataFrame:
    """Scores ``df`` with the model in production and appends the predictions to the partitioned
    prediction log: (request_id, ts, prediction, features as JSON, confidence, model_version).
    Returns the logged rows."""
    from ..sources.io import write_prediction_log

    version, model = load_current(spark, registry_path)
    scored = model.transform(prepare(df, features, target=None))
    log = scored.select(F.col(id_col).cast("string").alias("request_id"), F.lit(scored_at).cast("timestamp").alias("ts"),
                        F.col("prediction").cast("int").alias("prediction"), F.to_json(F.struct(*features)).alias("features"),
                        confidence(scored).alias("confidence"), F.lit(version).alias("model_version"))
    log = cut_lineage(log)
    write_prediction_log(log, log_path)
    return log


def append_labels(label_log: DataFrame, path: str) -> None:
    """Appends ground truth (request_id, label_ts, actual_label, user_feedback) to the label log."""
    label_log.select("request_id", "label_ts", "actual_label", "user_feedback").write.mode("append").parquet(path)


def promote_model(spark: SparkSession, model, model_dir: str, registry_path: str, model_version: str,
                  accepted: bool, f1: float, improvement: float | None, promoted_at: str | None = None) -> str:
    """ML-14: persist an accepted model and append it to the registry; a rejected model is an error."""
    if not accepted:
        raise ValueError("model was not accepted; it cannot be promoted")
    path = f"{model_dir}/{model_version}"
    save_model(spark, model, path)
    ts = promoted_at or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    spark.createDataFrame([(model_version, path, True, float(f1), improvement, ts)],
                          "model_version string, model_path string, accepted boolean, f1_score double, "
                          "improvement double, promoted_at string") \
        .withColumn("promoted_at", F.col("promoted_at").cast("timestamp")) \
        .write.mode("append").parquet(registry_path)
    return path


def current_model(registry: DataFrame) -> DataFrame:
    """The model in production: the latest accepted registry entry."""
    return registry.filter("accepted").agg(
        F.max_by(F.struct("model_version", "model_path", "f1_score"), "promoted_at").alias("m")).select("m.*")


def experiment_log(spark: SparkSession, run_id: str, params: dict, metrics: dict, path: str | None = None) -> DataFrame:
    """ML-15: one long table (run_id, kind, key, value) of parameters and metrics; appended
    to ``path`` when given."""
    rows = [(run_id, "param", k, str(v)) for k, v in params.items()] + \
           [(run_id, "metric", k, str(v)) for k, v in metrics.items()]
    df = spark.createDataFrame(rows, "run_id string, kind string, key string, value string")
    if path:
        df.write.mode("append").parquet(path)
    return df


def run_entries(model_name: str, row, expected_accuracy: float = M.MIN_TEST_F1, overfitting_threshold: float = M.MAX_F1_GAP) -> tuple[dict, dict]:
    """The 3 parameters and 6 metrics of a training run, from the winner's metric row."""
    params = {"model_name": model_name, "expected_accuracy": expected_accuracy, "overfitting_threshold": overfitting_threshold}
    names = {"train_f1": "train_f1", "test_f1": "f1_score", "train_precision": "train_precision", "test_precision": "precision_score",
             "train_recall": "train_recall", "test_recall": "recall_score"}
    return params, {k: f"{row[c]:.6f}" for k, c in names.items()}
