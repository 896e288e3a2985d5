"""Driver queries D-1 to D-13."""

from deliveryrisk.operators import drivers as D
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import (
    DF_DOUBLES,
    DR_DOUBLES,
    DRIVER_FEATURES,
    DRIVER_METRICS,
    DRIVER_RISK,
    DRIVER_SUMMARY,
    DS_DOUBLES,
    FM_DOUBLES,
    HR_DOUBLES,
    high_risk,
)


def features(t):
    return D.driver_features(t.drivers, t.orders)


def metrics(t):
    return D.driver_fraud_metrics(t.drivers, t.orders, t.missing_items, t.products)


@query("driver_features", f"WITH {DRIVER_FEATURES} SELECT * FROM df", DF_DOUBLES)
def _(t):
    return features(t)


@query("driver_risk_scores", f"WITH {DRIVER_RISK} SELECT * FROM dr", DR_DOUBLES)
def _(t):
    return D.driver_risk_scores(features(t))


SUSPICIOUS = f"""WITH {DRIVER_FEATURES},
s AS (SELECT AVG(missing_rate) AS m, STDDEV_SAMP(missing_rate) AS sd FROM df)
SELECT df.* FROM df, s WHERE total_orders >= 5 AND (missing_rate >= {{limit}} OR missing_rate > m + 2 * sd)"""


@query("suspicious_drivers", SUSPICIOUS.format(limit=20), DF_DOUBLES)
def _(t):
    return D.suspicious_drivers(features(t))


@query("suspicious_drivers_35", SUSPICIOUS.format(limit=35), DF_DOUBLES)
def _(t):
    return D.suspicious_drivers(features(t), rate_limit=35.0)


@query(
    "compare_drivers",
    f"""WITH {DRIVER_FEATURES},
s AS (SELECT AVG(missing_rate) AS m, STDDEV_SAMP(missing_rate) AS sd FROM df)
SELECT df.*, missing_rate - m AS vs_avg, missing_rate > m AS is_above_avg,
       COALESCE(missing_rate > m + 2 * sd, FALSE) AS is_outlier FROM df, s""",
    DF_DOUBLES + " vs_avg",
)
def _(t):
    return D.compare_drivers(features(t))


@query(
    "driver_comparison_stats",
    f"""WITH {DRIVER_FEATURES}
SELECT AVG(missing_rate) AS avg_missing_rate, STDDEV_SAMP(missing_rate) AS std_missing_rate,
  COUNT(*) AS total_drivers,
  COUNT(CASE WHEN missing_rate > (SELECT AVG(missing_rate) FROM df) THEN 1 END) AS drivers_above_avg,
  QUANTILE_CONT(missing_rate, 0.5) AS median_missing_rate, QUANTILE_CONT(missing_rate, 0.25) AS q1_missing_rate,
  QUANTILE_CONT(missing_rate, 0.75) AS q3_missing_rate FROM df""",
    "avg_missing_rate std_missing_rate median_missing_rate q1_missing_rate q3_missing_rate",
)
def _(t):
    return D.driver_comparison_stats(features(t))


@query("driver_fraud_metrics", f"WITH {DRIVER_METRICS} SELECT * FROM dm", FM_DOUBLES)
def _(t):
    return metrics(t)


@query(
    "driver_daily_performance",
    """SELECT o.driver_id, d.driver_name, o.order_date, COUNT(*) AS daily_orders,
  CAST(SUM(items_delivered) AS BIGINT) AS daily_items_delivered,
  CAST(SUM(items_missing) AS BIGINT) AS daily_items_missing, SUM(order_amount) AS daily_order_value,
  ROUND(SUM(items_missing) / CAST(NULLIF(SUM(items_delivered), 0) AS DOUBLE) * 100.0, 2) AS daily_missing_rate_pct
FROM ord o JOIN drv d USING (driver_id) GROUP BY o.driver_id, d.driver_name, o.order_date""",
    "daily_order_value daily_missing_rate_pct",
)
def _(t):
    return D.driver_daily_performance(t.drivers, t.orders)


@query(
    "driver_fraud_stats",
    f"""SELECT d.driver_id, d.driver_name, d.age, d.trips, COUNT(o.order_id) AS total_orders,
  CAST(SUM(items_missing) AS BIGINT) AS total_items_missing,
  CAST(SUM(items_delivered) AS BIGINT) AS total_items_delivered,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing,
  ROUND({sql_rate('SUM(items_missing)', 'SUM(items_delivered)')}, 2) AS missing_rate_pct
FROM drv d LEFT JOIN ord o USING (driver_id) GROUP BY d.driver_id, d.driver_name, d.age, d.trips""",
    "missing_rate_pct",
)
def _(t):
    return D.driver_fraud_stats(t.drivers, t.orders)


@query(
    "high_risk_drivers", f"WITH {DRIVER_METRICS}, {high_risk('dm', 'driver_id, driver_name', 5)}", HR_DOUBLES
)
def _(t):
    return D.high_risk_entities_view(metrics(t), ["driver_id", "driver_name"], 5)


@query("driver_summary", f"WITH {DRIVER_SUMMARY} SELECT * FROM ds", DS_DOUBLES)
def _(t):
    return D.driver_summary(t.drivers, t.orders)


@query(
    "driver_monthly",
    f"""SELECT driver_id, CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS month,
  STRFTIME(order_date, '%B') AS month_name, COUNT(*) AS orders,
  CAST(SUM(items_delivered) AS BIGINT) AS items_delivered, CAST(SUM(items_missing) AS BIGINT) AS items_missing,
  SUM(order_amount) AS revenue, CAST(SUM(items_delivered + items_missing) AS BIGINT) AS total_items,
  {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} AS missing_rate
FROM ord GROUP BY 1, 2, 3""",
    "revenue missing_rate",
)
def _(t):
    return D.driver_monthly(t.orders)


@query(
    "driver_primary_region",
    """SELECT driver_id, region AS primary_region FROM (
  SELECT driver_id, region, ROW_NUMBER() OVER (PARTITION BY driver_id ORDER BY COUNT(*) DESC, region) AS rn
  FROM ord GROUP BY driver_id, region) WHERE rn = 1""",
)
def _(t):
    return D.driver_primary_region(t.orders)


RADAR_SQL = ", ".join(
    f"CASE WHEN MAX({m}) OVER () = MIN({m}) OVER () THEN 0.0 ELSE ({m} - MIN({m}) OVER ()) "
    f"/ CAST(MAX({m}) OVER () - MIN({m}) OVER () AS DOUBLE) * 100.0 END AS {m}_norm, "
    f"CASE WHEN MAX({m}) OVER () = MIN({m}) OVER () THEN 0.0 ELSE (AVG({m}) OVER () - MIN({m}) OVER ()) "
    f"/ CAST(MAX({m}) OVER () - MIN({m}) OVER () AS DOUBLE) * 100.0 END AS {m}_fleet"
    for m in D.RADAR_METRICS
)


@query(
    "driver_profile_radar",
    f"WITH {DRIVER_FEATURES} SELECT driver_id, {RADAR_SQL} FROM df WHERE total_orders > 0",
    " ".join(f"{m}_norm {m}_fleet" for m in D.RADAR_METRICS),
)
def _(t):
    return D.driver_profile_radar(features(t).where("total_orders > 0"))


def _segments(by):
    return f"""WITH {DRIVER_FEATURES}, snap AS (SELECT * FROM df WHERE total_orders > 0)
SELECT {by}, COUNT(*) AS drivers, CAST(SUM(total_items_missing) * 15.0 AS DOUBLE) AS missing_value,
  AVG(missing_rate) AS missing_rate,
  SUM(total_items_missing) * 100.0 / (SELECT SUM(total_items_missing) FROM snap) AS missing_share
FROM snap GROUP BY {by}"""


for _name, _by in (("driver_experience_segments", "experience_level"), ("driver_age_segments", "age_group")):

    @query(_name, _segments(_by), "missing_value missing_rate missing_share")
    def _(t, by=_by):
        return D.driver_segments(D.driver_snapshot(t.drivers, t.orders), by)
