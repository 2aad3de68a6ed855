"""DuckDB twins of the drift statistics, written as plain SQL (brute force: whole-group
quantiles and unpartitioned running sums, fine at the oracle's small scale).

Every builder takes the name of a CTE with columns (side, feature, value) where side is
'baseline' or 'current', and the feature list (so features without data still appear).
"""

from __future__ import annotations

from ..fixtures import with_clause
from ..schema import FEATURE_COLUMNS


def feature_values(features) -> str:
    return "(VALUES " + ", ".join(f"('{f}')" for f in features) + ") AS fl(feature)"


def phish_long_cte(features=FEATURE_COLUMNS, extra_where: str = "") -> str:
    cols = ", ".join(features)
    where = f"WHERE {extra_where}" if extra_where else ""
    return f"""phish_long AS (
  SELECT side, feature, CAST(value AS DOUBLE) AS value
  FROM (UNPIVOT (SELECT side, {cols} FROM phish {where}) ON {cols} INTO NAME feature VALUE value)
)"""


def _base_ctes(long: str, features) -> str:
    return f"""
fl AS (SELECT feature FROM {feature_values(features)}),
vb AS (SELECT feature, value FROM {long} WHERE side = 'baseline' AND value IS NOT NULL AND NOT isnan(value)),
vc AS (SELECT feature, value FROM {long} WHERE side = 'current' AND value IS NOT NULL AND NOT isnan(value)),
tot AS (SELECT fl.feature,
               (SELECT count(*) FROM vb WHERE vb.feature = fl.feature) AS n_baseline,
               (SELECT count(*) FROM vc WHERE vc.feature = fl.feature) AS n_current
        FROM fl)"""


def _shares(edges_cte: str, floor: str) -> str:
    return f"""
bins AS (SELECT feature, unnest(range(0, len(edges) - 1)) AS bin FROM {edges_cte}),
kb AS (SELECT vb.feature, least(len(list_filter(edges, lambda x: x <= value)) - 1, len(edges) - 2) AS bin,
              count(*) AS k
       FROM vb JOIN {edges_cte} USING (feature)
       WHERE value >= edges[1] AND value <= edges[len(edges)] GROUP BY ALL),
kc AS (SELECT vc.feature, least(len(list_filter(edges, lambda x: x <= value)) - 1, len(edges) - 2) AS bin,
              count(*) AS k
       FROM vc JOIN {edges_cte} USING (feature)
       WHERE value >= edges[1] AND value <= edges[len(edges)] GROUP BY ALL),
sh0 AS (SELECT bins.feature, bins.bin,
               coalesce(kb.k, 0) / tot.n_baseline AS e, coalesce(kc.k, 0) / tot.n_current AS a
        FROM bins LEFT JOIN kb USING (feature, bin) LEFT JOIN kc USING (feature, bin) JOIN tot USING (feature)),
sh AS (SELECT feature, bin, CASE WHEN e = 0 THEN {floor} ELSE e END AS e,
              CASE WHEN a = 0 THEN {floor} ELSE a END AS a FROM sh0)"""


def psi_sql(long: str, features, prelude: str) -> str:
    probs = ", ".join(f"{i / 10}" for i in range(11))
    return prelude + "," + _base_ctes(long, features) + f""",
q AS (SELECT feature, quantile_cont(value, [{probs}]) AS qs FROM vb GROUP BY feature),
ed AS (SELECT feature,
              CASE WHEN len(list_distinct(qs)) < 3
                   THEN list_transform(range(0, 11), lambda i: CASE WHEN i = 10 THEN qs[11]
                                                        ELSE i * ((qs[11] - qs[1]) / 10.0) + qs[1] END)
                   ELSE list_sort(list_distinct(qs)) END AS edges
       FROM q),""" + _shares("ed", "0.0001")[1:] + """,
sc AS (SELECT feature, sum((a - e) * ln(a / e)) AS s FROM sh GROUP BY feature)
SELECT tot.feature, tot.n_baseline, tot.n_current,
       CASE WHEN n_baseline > 0 AND n_current > 0 THEN CAST(len(ed.edges) AS INTEGER) END AS n_edges,
       CASE WHEN n_baseline > 0 AND n_current > 0 THEN round(sc.s, 6) END AS score,
       CASE WHEN n_baseline > 0 AND n_current > 0 THEN 'ok' ELSE 'insufficient_data' END AS status
FROM tot LEFT JOIN ed USING (feature) LEFT JOIN sc USING (feature)"""


def js_sql(long: str, features, prelude: str) -> str:
    return prelude + "," + _base_ctes(long, features) + """,
rg AS (SELECT feature, min(value) AS lo, max(value) AS hi
       FROM (SELECT * FROM vb UNION ALL SELECT * FROM vc) GROUP BY feature),
ed AS (SELECT feature, list_transform(range(0, 11), lambda i: CASE WHEN i = 10 THEN hi
                                                  ELSE i * ((hi - lo) / 10.0) + lo END) AS edges FROM rg),""" + \
        _shares("ed", "1e-10")[1:] + """,
sc AS (SELECT feature, 0.5 * sum(e * ln(e / ((e + a) / 2))) + 0.5 * sum(a * ln(a / ((e + a) / 2))) AS s
       FROM sh GROUP BY feature)
SELECT tot.feature, tot.n_baseline, tot.n_current,
       CASE WHEN n_baseline > 0 AND n_current > 0 THEN round(sc.s, 6) END AS score,
       CASE WHEN n_baseline > 0 AND n_current > 0 THEN 'ok' ELSE 'insufficient_data' END AS status
FROM tot LEFT JOIN sc USING (feature)"""


def ks_core(long: str, features, prelude: str) -> str:
    """CTEs ending in ``ksd(feature, n_baseline, n_current, d)``."""
    return prelude + "," + _base_ctes(long, features) + """,
cnt AS (SELECT feature, value, sum(cb) AS cb, sum(cc) AS cc FROM (
          SELECT feature, value, 1 AS cb, 0 AS cc FROM vb UNION ALL SELECT feature, value, 0, 1 FROM vc)
        GROUP BY feature, value),
cum AS (SELECT feature, value,
               sum(cb) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS fb,
               sum(cc) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS fc
        FROM cnt),
dd AS (SELECT cum.feature, max(abs(fb / tot.n_baseline - fc / tot.n_current)) AS d
       FROM cum JOIN tot USING (feature) GROUP BY cum.feature),
ksd AS (SELECT tot.feature, tot.n_baseline, tot.n_current,
               CASE WHEN n_baseline > 0 AND n_current > 0 THEN dd.d END AS d
        FROM tot LEFT JOIN dd USING (feature))
"""


PVALUE = """CASE WHEN d IS NULL THEN NULL
     WHEN d * sqrt(n_baseline * n_current / (n_baseline + n_current)) < 0.2 THEN 1.0
     ELSE least(1.0, greatest(0.0, 2.0 * list_sum(list_transform(range(1, 101), lambda k:
          (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)
          * exp(-2.0 * k * k * power(d * sqrt(n_baseline * n_current / (n_baseline + n_current)), 2))))))
END"""


def ks_sql(long: str, features, prelude: str, with_p: bool = True) -> str:
    p = f", round({PVALUE}, 6) AS p_value" if with_p else ""
    return ks_core(long, features, prelude) + f"""
SELECT feature, n_baseline, n_current, round(d, 6) AS score{p},
       CASE WHEN d IS NOT NULL THEN 'ok' ELSE 'insufficient_data' END AS status
FROM ksd"""


def drift_flag_sql(stat_sql: str, method: str, threshold: float) -> str:
    return f"""SELECT feature, '{method}' AS method, score, CAST({threshold} AS DOUBLE) AS threshold,
       coalesce(score > {threshold}, false) AS drift, status
FROM ({stat_sql}) s"""


def num_prelude() -> str:
    return with_clause("num_long").rstrip()


def phish_prelude(extra_where: str = "", features=FEATURE_COLUMNS) -> str:
    return with_clause("phish").rstrip() + ",\n" + phish_long_cte(features, extra_where)
