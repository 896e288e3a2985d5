"""Customer queries C-1 to C-18."""

from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drivers as D
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import (
    ACTIVITY_SQL,
    CF_DOUBLES,
    CR_DOUBLES,
    CS_DOUBLES,
    CUSTOMER_FEATURES,
    CUSTOMER_METRICS,
    CUSTOMER_RISK,
    CUSTOMER_SUMMARY,
    CUSTOMER_WORKSPACE,
    CW_DOUBLES,
    DRIVER_SUMMARY,
    FM_DOUBLES,
    HR_DOUBLES,
    high_risk,
)


def features(t):
    return C.customer_features(t.customers, t.orders)


def metrics(t):
    return C.customer_fraud_metrics(t.customers, t.orders, t.missing_items, t.products)


def summary(t):
    return C.customer_summary(t.customers, t.orders)


def workspace(t):
    return C.customer_workspace(t.customers, t.orders)


def links(t):
    return C.driver_links(t.orders, D.driver_summary(t.drivers, t.orders), summary(t))


@query("customer_features", f"WITH {CUSTOMER_FEATURES} SELECT * FROM cf", CF_DOUBLES)
def _(t):
    return features(t)


@query("customer_risk_scores", f"WITH {CUSTOMER_RISK} SELECT * FROM cr", CR_DOUBLES)
def _(t):
    return C.customer_risk_scores(features(t))


@query(
    "suspicious_customers",
    f"""WITH {CUSTOMER_FEATURES},
s AS (SELECT AVG(missing_rate) AS m, STDDEV_SAMP(missing_rate) AS sd FROM cf)
SELECT cf.* FROM cf, s WHERE total_orders >= 3 AND (missing_rate >= 30 OR missing_rate > m + 2 * sd)""",
    CF_DOUBLES,
)
def _(t):
    return C.suspicious_customers(features(t))


@query(
    "customer_patterns",
    f"""WITH {CUSTOMER_FEATURES}
SELECT COUNT(*) AS total_customers, COUNT(CASE WHEN orders_with_missing > 0 THEN 1 END) AS customers_with_issues,
  AVG(CASE WHEN orders_with_missing > 0 THEN 1.0 ELSE 0.0 END) * 100.0 AS pct_customers_with_issues,
  AVG(missing_rate) AS avg_missing_rate, COUNT(CASE WHEN orders_with_missing > 1 THEN 1 END) AS repeat_offenders,
  QUANTILE_CONT(missing_rate, 0.5) AS median_missing_rate FROM cf""",
    "pct_customers_with_issues avg_missing_rate median_missing_rate",
)
def _(t):
    return C.customer_patterns(features(t))


def _by(group, where):
    return f"""WITH {CUSTOMER_FEATURES}
SELECT {group}, COUNT(*) AS customer_count, AVG(missing_rate) AS avg_missing_rate, SUM(total_spent) AS total_spent,
  CAST(SUM(orders_with_missing) AS BIGINT) AS total_issues, CAST(SUM(total_items_missing) AS BIGINT) AS total_missing
FROM cf {where} GROUP BY {group}"""


for _name, _group, _active in (
    ("customer_patterns_by_age", "age_group", False),
    ("customer_patterns_by_segment", "customer_segment", False),
    ("customer_segments_by_age", "age_group", True),
    ("customer_segments_by_spend", "customer_segment", True),
):

    @query(
        _name,
        _by(_group, "WHERE total_orders > 0" if _active else ""),
        "avg_missing_rate total_spent",
    )
    def _(t, group=_group, active=_active):
        df = features(t)
        return C.customer_patterns_by(df.where("total_orders > 0") if active else df, group)


@query("customer_fraud_metrics", f"WITH {CUSTOMER_METRICS} SELECT * FROM cm", FM_DOUBLES)
def _(t):
    return metrics(t)


@query(
    "customer_fraud_stats",
    f"""SELECT c.customer_id, c.customer_name, c.customer_age, COUNT(o.order_id) AS total_orders,
  CAST(SUM(items_missing) AS BIGINT) AS total_items_missing, SUM(order_amount) AS total_spent,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing,
  ROUND({sql_rate('SUM(items_missing)', 'SUM(items_delivered)')}, 2) AS missing_rate_pct
FROM cus c LEFT JOIN ord o USING (customer_id) GROUP BY c.customer_id, c.customer_name, c.customer_age""",
    "total_spent missing_rate_pct",
)
def _(t):
    return C.customer_fraud_stats(t.customers, t.orders)


@query(
    "high_risk_customers", f"WITH {CUSTOMER_METRICS}, {high_risk('cm', 'customer_id, customer_name', 3)}", HR_DOUBLES
)
def _(t):
    return D.high_risk_entities_view(metrics(t), ["customer_id", "customer_name"], 3)


@query("customer_summary", f"WITH {CUSTOMER_SUMMARY} SELECT * FROM cs", CS_DOUBLES)
def _(t):
    return summary(t)


@query("customer_activity", ACTIVITY_SQL)
def _(t):
    return C.customer_activity(t.orders)


@query(
    "behavior_signature",
    f"WITH {CUSTOMER_WORKSPACE} SELECT customer_id, behavior_signature, signature_rank FROM cw",
)
def _(t):
    return C.behavior_signature(summary(t)).select("customer_id", "behavior_signature", "signature_rank")


@query(
    "case_priority",
    f"WITH {CUSTOMER_WORKSPACE} SELECT customer_id, priority_score, priority_tier FROM cw",
    "priority_score",
)
def _(t):
    return C.case_priority(summary(t)).select("customer_id", "priority_score", "priority_tier")


@query("customer_workspace", f"WITH {CUSTOMER_WORKSPACE} SELECT * FROM cw", CW_DOUBLES)
def _(t):
    return workspace(t)


@query(
    "case_queue",
    f"""WITH {CUSTOMER_WORKSPACE}
SELECT *, CASE risk_category WHEN 'Critical' THEN '4h' WHEN 'High' THEN '12h' WHEN 'Medium' THEN '48h' ELSE '72h' END
  AS sla
FROM cw ORDER BY priority_score DESC, risk_score DESC, orders_with_claims DESC, claim_rate DESC, customer_id LIMIT 12""",
    CW_DOUBLES,
)
def _(t):
    return C.case_queue(workspace(t))


@query(
    "segment_matrix",
    f"""WITH {CUSTOMER_SUMMARY}
SELECT spending_segment, COUNT(CASE WHEN risk_category = 'Low' THEN 1 END) AS "Low",
  COUNT(CASE WHEN risk_category = 'Medium' THEN 1 END) AS "Medium",
  COUNT(CASE WHEN risk_category = 'High' THEN 1 END) AS "High",
  COUNT(CASE WHEN risk_category = 'Critical' THEN 1 END) AS "Critical" FROM cs GROUP BY spending_segment""",
)
def _(t):
    return C.segment_matrix(summary(t))


@query(
    "customer_monthly",
    f"""SELECT customer_id, CAST(DATE_TRUNC('month', order_date) AS DATE) AS month_date, COUNT(*) AS orders,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS claim_orders, CAST(SUM(items_missing) AS BIGINT) AS items_missing,
  CAST(SUM(items_missing + items_delivered) AS BIGINT) AS total_items, SUM(order_amount) AS revenue,
  {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} AS claim_rate,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) * 100.0 / COUNT(*) AS claim_order_rate
FROM ord GROUP BY 1, 2""",
    "revenue claim_rate claim_order_rate",
)
def _(t):
    return C.customer_monthly(t.orders)


LINKS_SQL = f"""{DRIVER_SUMMARY},
lk0 AS (SELECT customer_id, driver_id, COUNT(*) AS interactions, CAST(SUM(items_missing) AS BIGINT) AS items_missing,
  CAST(SUM(items_missing + items_delivered) AS BIGINT) AS total_items, MAX(order_date) AS last_order,
  {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} AS pair_missing_rate
  FROM ord GROUP BY customer_id, driver_id),
lk1 AS (SELECT lk0.*, COALESCE(ds.driver_name, CAST(lk0.driver_id AS VARCHAR)) AS driver_name,
  COALESCE(ds.risk_category, 'Low') AS driver_risk_category, COALESCE(ds.risk_score, 0.0) AS driver_risk_score,
  ds.missing_rate AS driver_missing_rate,
  ROUND(COALESCE(ds.risk_score, 0.0) - COALESCE(cs.risk_score, 0.0), 2) AS risk_gap,
  STRFTIME(last_order, '%Y-%m') AS period_label
  FROM lk0 LEFT JOIN ds USING (driver_id) LEFT JOIN cs USING (customer_id)),
lk2 AS (SELECT *, CASE WHEN interactions >= 3 AND pair_missing_rate >= 20 AND driver_risk_category IN ('High', 'Critical')
    THEN 'High Link Risk' WHEN interactions >= 2 AND pair_missing_rate >= 10 THEN 'Watch Link'
    ELSE 'Low Link Risk' END AS link_status FROM lk1),
lk AS (SELECT *, CASE link_status WHEN 'High Link Risk' THEN '24h' WHEN 'Watch Link' THEN '48h' ELSE '72h' END
  AS sla_hours FROM lk2)"""


@query(
    "driver_links",
    f"WITH {CUSTOMER_SUMMARY}, {LINKS_SQL} SELECT * FROM lk",
    "pair_missing_rate driver_risk_score driver_missing_rate risk_gap",
)
def _(t):
    return links(t)


@query(
    "case_actions",
    f"""WITH {CUSTOMER_WORKSPACE}, {LINKS_SQL}
SELECT customer_id, priority_tier, behavior_signature,
  CASE priority_tier WHEN 'Immediate' THEN 'Manual claim validation + proof-of-delivery required.'
    WHEN 'Fast Track' THEN 'Apply selective friction: one-time PIN on high-value orders.'
    WHEN 'Review' THEN 'Monitor next 3 orders and trigger alert if another claim appears.'
    ELSE 'Standard monitoring only.' END AS primary_action,
  CASE WHEN customer_id IN (SELECT customer_id FROM lk WHERE link_status = 'High Link Risk')
      THEN 'Audit repeated customer-driver pairs with high missing rates.'
    WHEN behavior_signature = 'High-Value Opportunist' THEN 'Prioritize basket-level review on premium products.'
    WHEN behavior_signature = 'Chronic Reporter' THEN 'Run behavioral interview workflow before refunds.'
    ELSE 'No collusion signal; keep baseline control policy.' END AS secondary_action
FROM cw""",
)
def _(t):
    return C.case_actions(workspace(t), links(t))


@query(
    "customer_kpis",
    f"""WITH {CUSTOMER_SUMMARY}
SELECT COUNT(*) AS customers, COUNT(CASE WHEN risk_category = 'Critical' THEN 1 END) AS critical_count,
  COUNT(CASE WHEN orders_with_claims >= 3 THEN 1 END) AS repeat_count, AVG(claim_rate) AS avg_claim_rate,
  CAST(SUM(items_reported_missing) * 15.0 AS DOUBLE) AS exposure_usd,
  QUANTILE_CONT(avg_order_value, 0.75) AS p75_order_value FROM cs""",
    "avg_claim_rate exposure_usd p75_order_value",
)
def _(t):
    return C.customer_kpis(summary(t))
