"""Drift queries (M-1)."""

from deliveryrisk.operators import drift as DR
from deliveryrisk.plans.registry import query, sql_rate

RATE = sql_rate("items_missing", "items_delivered")


def _halves(cte, where):
    return f"{cte} AS (SELECT *, {RATE} AS missing_rate, {where} AS cur FROM ord)"


HALVES = _halves(
    "hv", "ROW_NUMBER() OVER (ORDER BY order_date, order_id) > (SELECT COUNT(*) FROM ord) // 2"
)
MONTHS = _halves("hv", "order_date >= DATE '1996-01-01'")
PERFORMANCE = f"""{HALVES},
perf0 AS (SELECT AVG(CASE WHEN NOT cur THEN CASE WHEN items_missing > 0 THEN 100.0 ELSE 0.0 END END) AS reference_anomaly_rate,
  AVG(CASE WHEN cur THEN CASE WHEN items_missing > 0 THEN 100.0 ELSE 0.0 END END) AS current_anomaly_rate FROM hv),
perf AS (SELECT *, (current_anomaly_rate - reference_anomaly_rate) / reference_anomaly_rate * 100.0 AS rate_change_pct,
  CASE WHEN ABS(current_anomaly_rate - reference_anomaly_rate) < 2 THEN 'Stable' ELSE 'Degrading' END AS status FROM perf0)"""


def sql_ks(feature):
    return f"""SELECT '{feature}' AS feature, MAX(ABS(a * 1.0 / na - b * 1.0 / nb)) AS ks_stat,
  CAST(MAX(na) AS BIGINT) AS n_ref, CAST(MAX(nb) AS BIGINT) AS n_curr,
  (SELECT AVG(CASE WHEN NOT cur THEN {feature} END) FROM hv) AS ref_mean,
  (SELECT AVG(CASE WHEN cur THEN {feature} END) FROM hv) AS curr_mean
FROM (SELECT {feature} AS v, SUM(SUM(CASE WHEN NOT cur THEN 1 ELSE 0 END)) OVER (ORDER BY {feature}) AS a,
  SUM(SUM(CASE WHEN cur THEN 1 ELSE 0 END)) OVER (ORDER BY {feature}) AS b,
  SUM(SUM(CASE WHEN NOT cur THEN 1 ELSE 0 END)) OVER () AS na, SUM(SUM(CASE WHEN cur THEN 1 ELSE 0 END)) OVER () AS nb
  FROM hv GROUP BY {feature})"""


def sql_drift(source):
    union = " UNION ALL ".join(sql_ks(f) for f in DR.DRIFT_FEATURES)
    return f"""WITH {source}, ks AS ({union})
SELECT *, (curr_mean - ref_mean) / ref_mean * 100.0 AS shift_pct FROM ks"""


D_DOUBLES = "ks_stat ref_mean curr_mean shift_pct"


@query("drift_by_halves", sql_drift(HALVES), D_DOUBLES)
def _(t):
    return DR.drift_by_halves(t.orders).drop("p_value", "is_drifting", "status")


@query("drift_by_months", sql_drift(MONTHS), D_DOUBLES)
def _(t):
    return DR.drift_table(DR.months_split(t.orders, "1996-01-01")).drop("p_value", "is_drifting", "status")


@query("drift_status")
def _(t):
    return DR.drift_by_halves(t.orders).select("feature", "ks_stat", "p_value", "is_drifting", "status")


@query(
    "drift_performance",
    f"WITH {PERFORMANCE} SELECT * FROM perf",
    "reference_anomaly_rate current_anomaly_rate rate_change_pct",
)
def _(t):
    return DR.half_performance(t.orders)
