from pyspark.sql import functions as F

from sparkwatch.operators import split
from sparkwatch.operators import validate as V
from sparkwatch.schema import FEATURE_COLUMNS, feature_schema


def test_split_disjoint_complete_partition_independent(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    tr, te = split.train_test_split(df, "k")
    a = {r.k for r in te.collect()}
    tr2, te2 = split.train_test_split(df.repartition(7), "k")
    assert a == {r.k for r in te2.collect()}
    assert tr.count() + te.count() == 2000 and not ({r.k for r in tr.collect()} & a)
    assert 300 < len(a) < 500


def test_check_types_counts_bad_values(spark):
    rows = [("1", "x"), ("-1", "0"), (None, "1")]
    df = spark.createDataFrame(rows, f"{FEATURE_COLUMNS[0]} string, {FEATURE_COLUMNS[1]} string")
    out = {r["column"]: (r["n_values"], r["n_bad"]) for r in V.check_types(df, feature_schema()).collect()}
    assert out[FEATURE_COLUMNS[0]] == (2, 0) and out[FEATURE_COLUMNS[1]] == (3, 1)
    routed = {r["route"]: r["count"] for r in V.route_rows(df, feature_schema()).groupBy("route").count().collect()}
    assert routed == {"valid": 2, "invalid": 1}


def test_generated_methods_stay_within_what_the_jvm_compiles(spark):
    from sparkwatch.session import METHOD_CONF, METHOD_DEFAULT, METHOD_LIMIT, bound_methods

    before = spark.conf.get(METHOD_CONF, METHOD_DEFAULT)
    try:
        spark.conf.set(METHOD_CONF, METHOD_DEFAULT)
        bound_methods(spark)
        assert spark.conf.get(METHOD_CONF) == METHOD_LIMIT
        spark.conf.set(METHOD_CONF, "20000")  # a limit of the session's own
        bound_methods(spark)
        assert spark.conf.get(METHOD_CONF) == "20000"
    finally:
        spark.conf.set(METHOD_CONF, before)
