"""A representative subset of the queries is compared with its DuckDB twin on sf0.001 (all of them
with SPARKWATCH_FULL_ORACLE=1)."""

import math
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SUBSET = ["psi", "ks_pvalue", "feature_profile", "update_ground_truth", "rolling_accuracy", "alert_p99_latency",
          "retrain_full", "champion_challenger", "check_types", "drift_report", "ks_sketch", "feature_profile_sketch", "data_version_incremental",
          "expand_features_union", "route_valid_invalid", "drift_gauge_features", "alert_error_rate"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())  # in the order they are stored
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from sparkwatch.fixtures import BASE_TABLES
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1


NAMES = sorted(E.oracle_sql()) if os.environ.get("SPARKWATCH_FULL_ORACLE") else SUBSET


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = [dcols.index(c) for c in sdf.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=key)
    d = sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=key)
    assert s == d


def test_every_query_has_a_docstring():
    missing = [n for n, f in E.queries().items() if not (f.__doc__ or "").strip()]
    assert not missing
