"""Registered model queries.

Model fitting is not SQL-expressible: these are rows-only checks except k-NN voting on
``embeddings`` (exact, so a brute-force DuckDB twin exists), the registry and the experiment log.
Training data = all rows of the feature table, split 80/20 by row-key hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fixture_df, load_table, with_clause
from ..operators import knn, models as ML, split
from ..operators import metrics as M
from ..schema import FEATURE_COLUMNS
from ..session import cut_lineage, scratch_path
from ..sources import io
from .pipeline import training_pipeline
from .registry import register


def _train_test(spark, sf_dir):
    ph = fixture_df(spark, sf_dir, "phish").drop("side")
    tr, te = split.train_test_split(ph, "row_key")
    # iterative fitting passes over the training rows many times: materialise them once
    return cut_lineage(ML.prepare(tr, FEATURE_COLUMNS)), cut_lineage(ML.prepare(te, FEATURE_COLUMNS))


def _fit_eval(spark, sf_dir, name, **kw):
    tr, te = _train_test(spark, sf_dir)
    model = ML.fit_candidate(name, tr, FEATURE_COLUMNS, **kw)
    return ML.evaluate(model, te).select(F.lit(name).alias("model"), "*")


@register("fit_random_forest")
def q_fit_random_forest(spark, sf_dir):
    """ML-03: random forest (Spark defaults, seed 42) - test metrics."""
    return _fit_eval(spark, sf_dir, "random_forest")


@register("fit_decision_tree")
def q_fit_decision_tree(spark, sf_dir):
    """ML-04: decision tree - test metrics."""
    return _fit_eval(spark, sf_dir, "decision_tree")


@register("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    """ML-05: gradient-boosted trees - test metrics."""
    return _fit_eval(spark, sf_dir, "gradient_boosting")


@register("fit_logistic")
def q_fit_logistic(spark, sf_dir):
    """ML-06: logistic regression, maxIter 1000 - test metrics."""
    return _fit_eval(spark, sf_dir, "logistic_regression")


@register("fit_adaboost")
def q_fit_adaboost(spark, sf_dir):
    """ML-07: boosted decision stumps (50 rounds, SAMME weights) - test metrics."""
    return _fit_eval(spark, sf_dir, "adaboost")


@register("knn_classify", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label,
                  ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 AS is_query
           FROM embeddings),
q AS (SELECT * FROM e WHERE is_query), d AS (SELECT * FROM e WHERE NOT is_query),
pairs AS (SELECT q.vec_id AS qid, d.vec_id AS did, d.label,
                 sqrt(list_sum(list_transform(list_zip(q.x, d.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS dist
          FROM q, d),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, did) AS r FROM pairs) WHERE r <= 5),
votes AS (SELECT qid, label, count(*) AS v FROM top GROUP BY qid, label)
SELECT qid AS vec_id, arg_max(label, (v, -label)) AS prediction, sum(v) AS n_neighbors FROM votes GROUP BY qid""")
def q_knn_classify(spark, sf_dir):
    """ML-08: k=5 nearest-neighbour vote over the whole embeddings table: the 20 % hash split
    of vector ids are queries, the rest donors (distance ties -> smaller id, vote ties ->
    smaller label)."""
    emb = load_table(spark, sf_dir, "embeddings")
    is_q = split.hash_bucket(F.col("vec_id")) < 20
    out = knn.knn_classify(emb.filter(is_q), emb.filter(~is_q), ["embedding"], "vec_id", "vec_id", "label",
                           k=5, features_are_array=True)
    return out.select("vec_id", F.col("prediction").cast("int").alias("prediction"), "n_neighbors")


@register("knn_impute")
def q_knn_impute(spark, sf_dir):
    """ML-01: k=3 NaN-aware nearest-neighbour imputation of every row of the feature table,
    donors = the baseline rows (checked against brute force in tests, and on a smaller table by
    ``knn_impute_customer``)."""
    ph = fixture_df(spark, sf_dir, "phish")
    donors = ph.filter("side = 'baseline'")
    out = knn.knn_impute(ph, donors, FEATURE_COLUMNS, "row_key", k=3)
    return out.select("row_key", "side", *FEATURE_COLUMNS)


#: Numbers of a customer, a part of them missing.
_CUSTOMER = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS nation,
       CASE WHEN c_custkey % 5 <> 1 THEN CAST(round(c_acctbal / 1000) AS DOUBLE) END AS balance,
       CASE WHEN c_custkey % 11 <> 3 THEN CAST(length(c_name) + c_custkey % 4 AS DOUBLE) END AS tier,
       CASE WHEN c_custkey % 3 <> 2 THEN CAST((c_custkey * 37) % 101 AS DOUBLE) END AS score
FROM @customer"""
_CUSTOMER_FEATURES = ["nation", "balance", "tier", "score"]


def _customer_impute_sql() -> str:
    f = _CUSTOMER_FEATURES
    shared = " + ".join(f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in f)
    total = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in f)
    fills = ",\n".join(f"""f_{c} AS (SELECT id, avg(v) AS v FROM (
  SELECT q AS id, v_{c} AS v, row_number() OVER (PARTITION BY q ORDER BY dist, d) AS r FROM pairs WHERE miss_{c} AND v_{c} IS NOT NULL)
  WHERE r <= 3 GROUP BY id)""" for c in f)
    return "WITH rows AS (" + _CUSTOMER.replace("@", "") + f"""),
pairs AS (SELECT q.id AS q, d.id AS d, sqrt(({total}) * {len(f)} / ({shared})) AS dist,
                 {", ".join(f"q.{c} IS NULL AS miss_{c}, d.{c} AS v_{c}" for c in f)}
          FROM rows q, rows d WHERE ({shared}) > 0),
{fills}
SELECT rows.id, {", ".join(f"coalesce(rows.{c}, f_{c}.v, (SELECT avg({c}) FROM rows)) AS {c}" for c in f)}
FROM rows {" ".join(f"LEFT JOIN f_{c} ON f_{c}.id = rows.id" for c in f)}"""


@register("knn_impute_customer", _customer_impute_sql())
def q_knn_impute_customer(spark, sf_dir):
    """ML-01 on all customers, each the donor of the others: the same operator where all pairs can be
    compared in SQL."""
    rows = spark.sql(_CUSTOMER.replace("@customer", "{customer}"), customer=load_table(spark, sf_dir, "customer"))
    return knn.knn_impute(rows, rows, _CUSTOMER_FEATURES, "id", k=3)


@register("select_best_model")
def q_select_best_model(spark, sf_dir):
    """ML-09: fit all six candidates on the training split; metric table with gates and the
    best model flag (test F1, first candidate wins ties)."""
    tr, te = _train_test(spark, sf_dir)
    table, _, best = ML.select_best_model(tr, te, FEATURE_COLUMNS)
    return ML.apply_gates(table).withColumn("is_best", F.col("model") == best)


def _promoted(spark, sf_dir, name: str) -> str:
    """The registry of one promoted model."""
    tr, te = _train_test(spark, sf_dir)
    work = scratch_path(spark, "registry")
    model = ML.fit_candidate(name, tr, FEATURE_COLUMNS)
    f1 = ML.evaluate(model, te).first()["f1_score"]
    ML.promote_model(spark, model, f"{work}/models", f"{work}/registry", "v1", True, f1, f1, "2024-01-01 00:00:00")
    return f"{work}/registry"


@register("batch_score")
def q_batch_score(spark, sf_dir):
    """ML-13: the model in production, loaded from the registry, scores all rows of the table and
    logs its predictions."""
    registry = _promoted(spark, sf_dir, "decision_tree")
    rows = fixture_df(spark, sf_dir, "phish").drop("side", "Result")
    log = scratch_path(spark, "scored_log")
    ML.score_and_log(spark, registry, rows, FEATURE_COLUMNS, "row_key", log, "2024-02-01 00:00:00")
    return io.feedback_scan(spark, log).select("request_id", "prediction", "confidence", "model_version")


@register("prediction_column")
def q_prediction_column(spark, sf_dir):
    """PRJ-08: the scored table keeps every input column and appends ``predicted_column``."""
    _, model = ML.load_current(spark, _promoted(spark, sf_dir, "logistic_regression"))
    rows = fixture_df(spark, sf_dir, "phish").drop("side", "Result")
    return ML.batch_score(model, rows, FEATURE_COLUMNS)


@register("promote_model", with_clause("phish") + """
SELECT 'v2' AS model_version, 2 AS n_promoted, true AS accepted, TIMESTAMP '2024-01-02 00:00:00' AS promoted_at,
       count(*) AS n_scored, count(*) AS n_as_fitted, count(*) FILTER (WHERE Result = 1) AS n_positive
FROM phish WHERE ('0x' || substr(md5(row_key), 1, 8))::BIGINT % 100 < 20""")
def q_promote_model(spark, sf_dir):
    """ML-14: two accepted models promoted in turn; the registry's current model is the later one. It
    scores all test rows, each as the fitted one does."""
    tr, te = _train_test(spark, sf_dir)
    work = scratch_path(spark, "registry")
    pre = ML.fit_preprocessing(tr, FEATURE_COLUMNS)
    ready = cut_lineage(pre.transform(tr))
    m1 = ML.fit_candidate("decision_tree", tr, FEATURE_COLUMNS, pre=pre, assembled=ready)
    ML.promote_model(spark, m1, f"{work}/models", f"{work}/registry", "v1", True, 0.7, 0.7, "2024-01-01 00:00:00")
    m2 = ML.fit_candidate("logistic_regression", tr, FEATURE_COLUMNS, pre=pre, assembled=ready)
    test = cut_lineage(pre.transform(te))
    f2 = ML.evaluate(ML.last_stage(m2), test).first()["f1_score"]
    ML.promote_model(spark, m2, f"{work}/models", f"{work}/registry", "v2", True, f2, f2 - 0.7, "2024-01-02 00:00:00")
    version, loaded = ML.load_current(spark, f"{work}/registry")
    # the loaded model from raw rows, the fitted classifier on the rows that were filled before
    mine = loaded.transform(te).select("row_key", "label", F.col("prediction").alias("loaded"))
    both = mine.join(ML.last_stage(m2).transform(test).select("row_key", F.col("prediction").alias("fitted")), "row_key")
    counts = both.agg(F.count(F.lit(1)).alias("n_scored"), F.count(F.when(F.col("loaded") == F.col("fitted"), 1)).alias("n_as_fitted"),
                      F.count(F.when(F.col("label") == 1, 1)).alias("n_positive")).first()
    reg = spark.read.parquet(f"{work}/registry")
    return reg.agg(F.lit(version).alias("model_version"), F.count(F.lit(1)).cast("int").alias("n_promoted"), F.bool_and("accepted").alias("accepted"),
                   F.max("promoted_at").cast("timestamp_ntz").alias("promoted_at"), *[F.lit(counts[c]).alias(c) for c in counts.asDict()])


def _exp_log_sql() -> str:
    metrics = "\n".join(f"UNION ALL SELECT 'run-1', 'metric', '{split}_{name}', printf('%.6f', {col}) FROM m WHERE side = '{side}'"
                        for split, side in (("train", "baseline"), ("test", "current"))
                        for name, col in (("f1", "f1"), ("precision", "p"), ("recall", "r")))
    return with_clause("scored") + f""",
cc AS (SELECT side, count(*) FILTER (WHERE label = 1 AND challenger = 1) AS tp,
              count(*) FILTER (WHERE label <> 1 AND challenger = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND challenger <> 1) AS fn
       FROM scored GROUP BY side),
m AS (SELECT side, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM cc)
SELECT 'run-1' AS run_id, 'param' AS kind, 'model_name' AS "key", 'challenger' AS value
UNION ALL SELECT 'run-1', 'param', 'expected_accuracy', '{M.MIN_TEST_F1}'
UNION ALL SELECT 'run-1', 'param', 'overfitting_threshold', '{M.MAX_F1_GAP}'
{metrics}"""


@register("experiment_log", _exp_log_sql())
def q_experiment_log(spark, sf_dir):
    """ML-15: the 3 parameters and 6 metrics of a run (baseline split as train, current as test),
    appended to the log after an earlier run and read back."""
    sc = fixture_df(spark, sf_dir, "scored")
    m = {r["side"]: r for r in M.classification_metrics(M.long_predictions(sc, "label", ["challenger"], keys=["side"]), by=["side", "model"]).collect()}
    row = {"train_f1": m["baseline"]["f1_score"], "f1_score": m["current"]["f1_score"], "train_precision": m["baseline"]["precision_score"],
           "precision_score": m["current"]["precision_score"], "train_recall": m["baseline"]["recall_score"], "recall_score": m["current"]["recall_score"]}
    path = scratch_path(spark, "experiments")
    ML.experiment_log(spark, "run-0", *ML.run_entries("champion", row), path)
    ML.experiment_log(spark, "run-1", *ML.run_entries("challenger", row), path)
    return spark.read.parquet(path).filter("run_id = 'run-1'")


@register("training_pipeline")
def q_training_pipeline(spark, sf_dir):
    """ML-16: end to end over all rows: split, validate, train the six candidates, gate, promote;
    one status row."""
    ph = fixture_df(spark, sf_dir, "phish").drop("side")
    res = training_pipeline(spark, ph, FEATURE_COLUMNS, "row_key", work_dir=scratch_path(spark, "training"))
    return spark.createDataFrame([(res["status"], res.get("best_model"), res.get("model_version"))],
                                 "status string, best_model string, model_version string")
