"""Fixture views over the driver's read-only tables.

Each fixture is plain SQL text that both Spark and DuckDB run, so the Spark query and
its DuckDB twin see the same rows. A fixture only shapes rows into the schema a job
expects (feature table, prediction log, label log, ...); it does none of the job's
work. Spark side: ``fixture_df(spark, sf_dir, name)``; DuckDB side: ``with_clause``.

Table references are written ``@lineitem``; for Spark they become DataFrame
parameters of ``spark.sql``, for DuckDB the plain view name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .schema import FEATURE_COLUMNS, TARGET_COLUMN
from .session import table_path

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

SPLIT_DATE = "1998-06-01 00:00:00"


def _g(i: int) -> str:
    """Clean value of feature i in {-1, 0, 1}."""
    return (f"((l_orderkey*{2 * i + 3} + l_partkey*{i + 5} + l_suppkey*{i + 11} + l_linenumber)"
            f" % {2 * i + 7} % 3 - 1)")


def _phish_raw() -> str:
    gs = ",\n       ".join(f"{_g(i)} AS g_{i}" for i in range(len(FEATURE_COLUMNS)))
    return f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DATE}' THEN 'baseline' ELSE 'current' END AS side,
       {gs}
FROM @lineitem"""


def _phish() -> str:
    feats = []
    for i, name in enumerate(FEATURE_COLUMNS):
        drift = f"WHEN side = 'current' AND l_partkey % 4 = 0 THEN CAST(1 AS BIGINT) " if i <= 4 else ""
        feats.append(
            f"CAST(CASE WHEN (l_orderkey + l_partkey*{i + 1}) % 23 = 0 THEN NULL "
            f"{drift}ELSE g_{i} END AS BIGINT) AS {name}")
    body = ",\n       ".join(feats)
    return f"""
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS row_key,
       side,
       {body},
       CAST(CASE WHEN (g_0 + g_1 + g_2 - g_7 > 0) <> (l_suppkey % 50 = 0) THEN 1 ELSE -1 END AS BIGINT)
         AS {TARGET_COLUMN}
FROM phish_raw"""


def _num_wide() -> str:
    return f"""
SELECT CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DATE}' THEN 'baseline' ELSE 'current' END AS side,
       l_partkey,
       l_quantity AS l_quantity_raw, l_extendedprice, l_discount, l_tax
FROM @lineitem"""


def _num() -> str:
    # wide form: planted shift of +10 on l_quantity for a quarter of the current rows
    return """
SELECT side,
       CASE WHEN side = 'current' AND l_partkey % 4 = 0 THEN l_quantity_raw + 10
            ELSE l_quantity_raw END AS l_quantity,
       l_extendedprice, l_discount, l_tax
FROM num_wide"""


def _num_long() -> str:
    return """
SELECT side, 'l_quantity' AS feature, l_quantity AS value FROM num
UNION ALL SELECT side, 'l_extendedprice' AS feature, l_extendedprice AS value FROM num
UNION ALL SELECT side, 'l_discount' AS feature, l_discount AS value FROM num
UNION ALL SELECT side, 'l_tax' AS feature, l_tax AS value FROM num"""


def _pred_base() -> str:
    return """
SELECT CAST(event_id AS STRING) AS request_id, ts,
       CASE WHEN value > 15 THEN 1 ELSE 0 END AS prediction,
       props AS features,
       concat('v1.', CAST(user_id % 3 AS STRING)) AS model_version,
       event_type AS endpoint,
       value / 100 AS latency_s,
       CASE WHEN event_type = 'error' THEN 'ValueError' END AS error_type,
       CAST(CASE WHEN value > 15 THEN 0.5 + (value % 50) / 100 ELSE 0.5 + (value % 40) / 100 END AS DOUBLE)
         AS confidence,
       event_id
FROM @events"""


def _pred() -> str:
    # prediction log with re-stored predictions (same id, 12 hours later)
    return """
SELECT request_id, ts, prediction, features, model_version, endpoint, latency_s, error_type, confidence
FROM pred_base
UNION ALL
SELECT request_id, ts + INTERVAL 12 HOURS AS ts, prediction, features, model_version, endpoint,
       latency_s, error_type, confidence
FROM pred_base WHERE event_id % 49 = 3"""


def _fb() -> str:
    return """
SELECT CAST(event_id AS STRING) AS request_id,
       CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 1 HOURS ELSE ts + INTERVAL 6 HOURS END AS label_ts,
       CASE WHEN event_id % 4 = 0 THEN 1 - (CASE WHEN value > 15 THEN 1 ELSE 0 END)
            ELSE (CASE WHEN value > 15 THEN 1 ELSE 0 END) END AS actual_label,
       CASE WHEN event_id % 3 = 0 THEN 'correct' END AS user_feedback
FROM @events WHERE event_id % 5 <> 0
UNION ALL
SELECT request_id, CAST(TIMESTAMP '2024-01-15 00:00:00' AS TIMESTAMP) AS label_ts, 1 AS actual_label,
       CAST(NULL AS STRING) AS user_feedback
FROM (VALUES ('x0'), ('x1'), ('x2'), ('x3'), ('x4'), ('x5'), ('x6'), ('x7'), ('x8'), ('x9')) AS x(request_id)"""


def _alerts_json() -> str:
    return """
SELECT event_id, ts,
       CASE WHEN event_id % 13 = 0 THEN NULL
            WHEN event_id % 7 = 0 THEN '{"status":"firing","alerts":[]}'
            ELSE concat('{"status":"firing","alerts":[{"labels":{"alertname":"', event_type,
                        '"},"annotations":{"description":"', CAST(user_id AS STRING), '"}}]}')
       END AS payload
FROM @events"""


def _scored() -> str:
    return """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS row_key,
       side,
       CASE WHEN (g_0 + g_1 + g_2 - g_7 > 0) <> (l_suppkey % 50 = 0) THEN 1 ELSE 0 END AS label,
       CASE WHEN g_0 + g_1 > 0 THEN 1 ELSE 0 END AS champion,
       CASE WHEN g_0 + g_1 + g_2 - g_7 > 0 THEN 1 ELSE 0 END AS challenger
FROM phish_raw"""


def _runs() -> str:
    # retraining run log: one run per distinct event day (types of trigger rotate)
    return """
SELECT CAST(d AS TIMESTAMP) + INTERVAL 2 HOURS AS run_ts,
       CASE WHEN day(d) % 3 = 0 THEN 'scheduled' WHEN day(d) % 3 = 1 THEN 'data_based' ELSE 'drift_based' END
         AS trigger_type,
       'run' AS reason, 'full' AS strategy, CAST(n AS BIGINT) AS n_rows
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM @events GROUP BY CAST(ts AS DATE)) t"""


FIXTURES: dict[str, tuple[callable, list[str]]] = {
    # name: (sql builder, fixtures it depends on)
    "phish_raw": (_phish_raw, []),
    "phish": (_phish, ["phish_raw"]),
    "scored": (_scored, ["phish_raw"]),
    "num_wide": (_num_wide, []),
    "num": (_num, ["num_wide"]),
    "num_long": (_num_long, ["num"]),
    "pred_base": (_pred_base, []),
    "pred": (_pred, ["pred_base"]),
    "fb": (_fb, []),
    "alerts_json": (_alerts_json, []),
    "runs": (_runs, []),
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in FIXTURES[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def duckdb_sql(name: str) -> str:
    return re.sub(r"@(\w+)", r"\1", FIXTURES[name][0]())


def with_clause(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the DuckDB twin (fixtures + dependencies)."""
    parts = [f"{n} AS ({duckdb_sql(n)}\n)" for n in _closure(list(names))]
    return "WITH " + ",\n".join(parts) + "\n"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table."""
    return spark.read.parquet(table_path(sf_dir, name))


def fixture_df(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a fixture view; base tables are read from ``sf_dir``."""
    frames: dict[str, DataFrame] = {}
    for n in _closure([name]):
        text = FIXTURES[n][0]().replace("{", "{{").replace("}", "}}")
        refs = set(re.findall(r"@(\w+)", text))
        kwargs = {}
        for r in refs:
            kwargs[r] = load_table(spark, sf_dir, r)
        text = re.sub(r"@(\w+)", r"{\1}", text)
        # fixtures referenced by bare name
        for dep in FIXTURES[n][1]:
            text = re.sub(rf"\b{dep}\b", "{" + dep + "}", text)
            kwargs[dep] = frames[dep]
        frames[n] = spark.sql(text, **kwargs)
    return frames[name]
