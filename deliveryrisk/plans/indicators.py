"""Indicator queries R-1 to R-13."""

from pyspark.sql import functions as F

from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drivers as D
from deliveryrisk.operators import indicators as I
from deliveryrisk.operators import overview as A
from deliveryrisk.operators import pairs as P
from deliveryrisk.operators import regions as G
from deliveryrisk.operators import temporal as T
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import (
    CF_DOUBLES,
    CUSTOMER_FEATURES,
    CUSTOMER_SUMMARY,
    DF_DOUBLES,
    DRIVER_FEATURES,
    DRIVER_SUMMARY,
    PAIRS,
    REGIONAL,
    RISK_CASE,
    sql_min_max,
)


def _stats(cte, key):
    return f"""{cte} AS (SELECT {key}, COUNT(*) AS total_orders, SUM(items_missing) AS items_missing,
  SUM(order_amount) AS total_spent, {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} AS missing_rate,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) * 100.0 / COUNT(*) AS share FROM ord GROUP BY {key})"""


def driver_sql(k):
    return f"""{_stats('si', 'driver_id')},
di0 AS (SELECT driver_id, LEAST(
  CASE WHEN missing_rate > (SELECT AVG(missing_rate) + {k} * STDDEV_SAMP(missing_rate) FROM si) THEN 40 ELSE 0 END
  + CASE WHEN share > (SELECT AVG(share) + {k} * STDDEV_SAMP(share) FROM si) THEN 35 ELSE 0 END
  + CASE WHEN items_missing > (SELECT QUANTILE_CONT(CAST(items_missing AS DOUBLE), 0.95) FROM si) THEN 25 ELSE 0 END, 100)
  AS score FROM si),
di AS (SELECT 'driver' AS entity_type, CAST(driver_id AS VARCHAR) AS entity_id,
  'suspicious_driver_pattern' AS indicator_name, CAST(score AS DOUBLE) AS score FROM di0 WHERE score > 0)"""


def customer_sql(k):
    return f"""{_stats('ci0', 'customer_id')},
ci1 AS (SELECT customer_id, LEAST(
  CASE WHEN missing_rate > (SELECT AVG(missing_rate) + {k} * STDDEV_SAMP(missing_rate) FROM ci0) THEN 35 ELSE 0 END
  + CASE WHEN share = 100 AND total_orders >= 3 THEN 40 ELSE 0 END
  + CASE WHEN total_spent > (SELECT QUANTILE_CONT(total_spent, 0.75) FROM ci0)
      AND missing_rate > (SELECT AVG(missing_rate) FROM ci0) * 1.5 THEN 25 ELSE 0 END, 100) AS score
  FROM ci0 WHERE total_orders >= 2),
ci AS (SELECT 'customer' AS entity_type, CAST(customer_id AS VARCHAR) AS entity_id,
  'suspicious_customer_pattern' AS indicator_name, CAST(score AS DOUBLE) AS score FROM ci1 WHERE score > 0)"""


def region_sql(k):
    return f"""{_stats('ri0', 'region')},
ri AS (SELECT 'region' AS entity_type, region AS entity_id, 'high_risk_region' AS indicator_name,
  LEAST(missing_rate, 100.0) AS score FROM ri0
  WHERE missing_rate > (SELECT AVG(missing_rate) + {k} * STDDEV_SAMP(missing_rate) FROM ri0))"""


def all_sql(k):
    return f"""{driver_sql(k)}, {customer_sql(k)}, {region_sql(k)}, {PAIRS},
pi AS (SELECT 'pair' AS entity_type, CAST(driver_id AS VARCHAR) || '_' || CAST(customer_id AS VARCHAR) AS entity_id,
  'potential_collusion' AS indicator_name, LEAST(missing_rate, 100.0) AS score FROM pr
  WHERE interactions >= 3 AND missing_rate >= 50),
ai AS (SELECT *, 'driver_patterns' AS pattern_type FROM di UNION ALL SELECT *, 'customer_patterns' FROM ci
  UNION ALL SELECT *, 'collusion_patterns' FROM pi UNION ALL SELECT *, 'regional_patterns' FROM ri),
fr AS (SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS risk_level FROM ai)"""


def indicators(t, k):
    return I.all_indicators(t.orders, k)


def ds(t):
    return D.driver_summary(t.drivers, t.orders)


def cs(t):
    return C.customer_summary(t.customers, t.orders)


@query("driver_indicators", f"WITH {driver_sql(2)} SELECT * FROM di", "score")
def _(t):
    return I.driver_indicators(t.orders).drop("details")


@query(
    "driver_indicator_details",
    f"""WITH {_stats('si', 'driver_id')}
SELECT CAST(driver_id AS VARCHAR) AS entity_id, CASE WHEN missing_rate > (SELECT AVG(missing_rate)
  + STDDEV_SAMP(missing_rate) FROM si) THEN missing_rate END AS rate_value,
  CASE WHEN share > (SELECT AVG(share) + STDDEV_SAMP(share) FROM si) THEN share END AS share_value FROM si
WHERE missing_rate > (SELECT AVG(missing_rate) + STDDEV_SAMP(missing_rate) FROM si)
  OR share > (SELECT AVG(share) + STDDEV_SAMP(share) FROM si)
  OR items_missing > (SELECT QUANTILE_CONT(CAST(items_missing AS DOUBLE), 0.95) FROM si)""",
    "rate_value share_value",
)
def _(t):
    return I.driver_indicators(t.orders, 1.0).select(
        "entity_id",
        F.col("details")["missing_rate_anomaly"].alias("rate_value"),
        F.col("details")["pct_orders_anomaly"].alias("share_value"),
    )


@query("customer_indicators", f"WITH {customer_sql(2)} SELECT * FROM ci", "score")
def _(t):
    return I.customer_indicators(t.orders).drop("details")


@query("region_indicators", f"WITH {region_sql(0.5)} SELECT * FROM ri", "score")
def _(t):
    return I.region_indicators(t.orders, 0.5).drop("details")


@query("all_indicators", f"WITH {all_sql(1)} SELECT * FROM ai", "score")
def _(t):
    return indicators(t, 1.0).drop("details")


@query("fraud_report", f"WITH {all_sql(2)} SELECT * FROM fr", "score")
def _(t):
    return I.fraud_report(indicators(t, 2.0)).drop("details")


@query(
    "fraud_report_counts",
    f"""WITH {all_sql(1)} SELECT pattern_type, risk_level, CAST(GROUPING(pattern_type, risk_level) AS INTEGER) AS level,
  COUNT(*) AS indicators FROM fr GROUP BY ROLLUP (pattern_type, risk_level)""",
)
def _(t):
    return I.fraud_report_counts(I.fraud_report(indicators(t, 1.0)))


@query(
    "risk_alerts",
    f"""WITH {DRIVER_SUMMARY}, {CUSTOMER_SUMMARY}, {REGIONAL}
SELECT 'Driver' AS entity_type, CAST(driver_id AS VARCHAR) AS entity_id, driver_name AS entity_name, risk_score,
  risk_category, 'Missing rate: ' || PRINTF('%.2f', missing_rate) || '%' AS primary_metric,
  'Orders with issues: ' || CAST(orders_with_missing AS VARCHAR) AS secondary_metric,
  'Review delivery patterns and consider audit' AS recommendation FROM ds WHERE risk_score >= 70
UNION ALL SELECT 'Customer', CAST(customer_id AS VARCHAR), customer_name, risk_score, risk_category,
  'Claim rate: ' || PRINTF('%.2f', claim_rate) || '%', 'Orders with claims: ' || CAST(orders_with_claims AS VARCHAR),
  'Verify claims and consider enhanced verification' FROM cs WHERE risk_score >= 70
UNION ALL SELECT 'Region', region, region, missing_rate,
  CASE WHEN missing_rate > (SELECT AVG(missing_rate) FROM rp) * 1.5 THEN 'High' ELSE 'Medium' END,
  'Missing rate: ' || PRINTF('%.2f', missing_rate) || '%', 'Items missing: ' || CAST(items_missing AS VARCHAR),
  'Investigate regional patterns and driver assignments' FROM rp
WHERE missing_rate > (SELECT AVG(missing_rate) FROM rp) * 0.75""",
    "risk_score",
)
def _(t):
    return I.risk_alerts(ds(t), cs(t), G.regional_summary(t.orders))


@query("overall_report")
def _(t):
    return I.overall_report(
        A.overall_statistics(t.orders, t.drivers, t.customers),
        I.fraud_report(indicators(t, 2.0)),
        G.regional_extremes(G.regional_performance(t.orders)),
        T.temporal_summary(t.orders),
    )


@query(
    "top_suspicious",
    f"""WITH {DRIVER_SUMMARY}, {CUSTOMER_SUMMARY}
SELECT * FROM (SELECT 'Driver' AS entity_type, driver_id AS entity_id, driver_name AS entity_name,
  orders_completed AS orders, missing_rate, pct_orders_with_missing AS pct_orders, risk_score, risk_category FROM ds
  ORDER BY risk_score DESC, driver_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'Customer', customer_id, customer_name, total_orders, claim_rate, pct_orders_with_claims,
  risk_score, risk_category FROM cs ORDER BY risk_score DESC, customer_id LIMIT 10)""",
    "missing_rate pct_orders risk_score",
)
def _(t):
    return I.top_suspicious(ds(t), cs(t))


@query(
    "risk_distribution",
    f"""WITH {DRIVER_SUMMARY}, {CUSTOMER_SUMMARY}, b AS (SELECT UNNEST(['Low', 'Medium', 'High', 'Critical']) AS risk_category)
SELECT 'driver' AS entity_type, risk_category, (SELECT COUNT(*) FROM ds WHERE ds.risk_category = b.risk_category) AS n FROM b
UNION ALL
SELECT 'customer', risk_category, (SELECT COUNT(*) FROM cs WHERE cs.risk_category = b.risk_category) FROM b""",
)
def _(t):
    return I.risk_distribution(ds(t), cs(t))


@query(
    "behavior_snapshot",
    f"""WITH {all_sql(2)},
c AS (SELECT COUNT(CASE WHEN pattern_type = 'driver_patterns' THEN 1 END) AS driver_patterns,
  COUNT(CASE WHEN pattern_type = 'customer_patterns' THEN 1 END) AS customer_patterns,
  COUNT(CASE WHEN pattern_type = 'collusion_patterns' THEN 1 END) AS collusion_patterns,
  COUNT(CASE WHEN pattern_type = 'regional_patterns' THEN 1 END) AS regional_patterns, COUNT(*) AS total_findings FROM ai)
SELECT *, CASE WHEN total_findings = 0 THEN 'No dominant entity signal'
  WHEN driver_patterns >= GREATEST(customer_patterns, collusion_patterns, regional_patterns)
    THEN 'Driver-linked signals dominate'
  WHEN customer_patterns >= GREATEST(collusion_patterns, regional_patterns) THEN 'Customer-linked signals dominate'
  WHEN collusion_patterns >= regional_patterns THEN 'Network collusion signals dominate'
  ELSE 'Regional hotspot signals dominate' END AS dominant FROM c""",
)
def _(t):
    return I.behavior_snapshot(indicators(t, 2.0))


def _simple(cte):
    return f"""a AS (SELECT *, {sql_min_max('missing_rate', '0.5')} * 100.0 AS missing_rate_score,
  {sql_min_max('pct_orders_with_missing', '0.5')} * 100.0 AS pct_orders_score FROM {cte}),
b AS (SELECT *, missing_rate_score * 0.5 + pct_orders_score * 0.5 AS risk_score FROM a)
SELECT *, {RISK_CASE.format(s='risk_score')} AS risk_category FROM b"""


SIMPLE = " missing_rate_score pct_orders_score risk_score"


@query("simple_driver_risk", f"WITH {DRIVER_FEATURES}, {_simple('df')}", DF_DOUBLES + SIMPLE)
def _(t):
    return I.simple_entity_risk(D.driver_features(t.drivers, t.orders))


@query("simple_customer_risk", f"WITH {CUSTOMER_FEATURES}, {_simple('cf')}", CF_DOUBLES + SIMPLE)
def _(t):
    return I.simple_entity_risk(C.customer_features(t.customers, t.orders))


def _engine(cte, entity, key, third, third_name):
    return f"""e0 AS (SELECT '{entity}' AS entity_type, CAST({key} AS VARCHAR) AS entity_id,
  {sql_min_max('missing_rate', '0.5')} * 100.0 AS factor_missing_rate,
  {sql_min_max('pct_orders_with_missing', '0.5')} * 100.0 AS factor_pct_orders_with_issues,
  {sql_min_max(third, '0.5')} * 100.0 AS factor_{third_name} FROM {cte}),
e1 AS (SELECT *, LEAST(factor_missing_rate * 0.4 + factor_pct_orders_with_issues * 0.35 + factor_{third_name} * 0.25, 100)
  AS risk_score FROM e0),
eng AS (SELECT *, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High'
  WHEN risk_score >= 25 THEN 'Medium' ELSE 'Low' END AS risk_category FROM e1)"""


FACTORS = "risk_score factor_missing_rate factor_pct_orders_with_issues "
ENGINE_D = f"{DRIVER_FEATURES}, {_engine('df', 'driver', 'driver_id', 'total_items_missing', 'volume_missing')}"
ENGINE_C = f"{CUSTOMER_FEATURES}, {_engine('cf', 'customer', 'customer_id', 'orders_with_missing', 'issue_frequency')}"


@query("score_drivers", f"WITH {ENGINE_D} SELECT * FROM eng", FACTORS + "factor_volume_missing")
def _(t):
    return I.risk_report(I.score_drivers(D.driver_features(t.drivers, t.orders)))


@query("score_customers", f"WITH {ENGINE_C} SELECT * FROM eng", FACTORS + "factor_issue_frequency")
def _(t):
    return I.risk_report(I.score_customers(C.customer_features(t.customers, t.orders)))


@query(
    "high_risk_scores", f"WITH {ENGINE_C} SELECT * FROM eng WHERE risk_score >= 50", FACTORS + "factor_issue_frequency"
)
def _(t):
    scores = I.score_customers(C.customer_features(t.customers, t.orders))
    return I.risk_report(I.high_risk_scores(scores))
