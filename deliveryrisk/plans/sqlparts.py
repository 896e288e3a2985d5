"""Common table expressions shared by the check SQL of several query families."""

from deliveryrisk.plans.registry import sql_rate, sql_round


def sql_bucket(value: str, edges: list, labels: list[str]) -> str:
    """CASE text for right-closed intervals, independent of the Spark expression builder."""
    whens = []
    for low, high, label in zip(edges, edges[1:], labels):
        parts = []
        if low is not None:
            parts.append(f"{value} > {low}")
        if high is not None:
            parts.append(f"{value} <= {high}")
        whens.append(f"WHEN {' AND '.join(parts) or 'TRUE'} THEN '{label}'")
    return f"CASE {' '.join(whens)} END"


# Exact sum of order amounts.
MONEY = "CAST(SUM(CAST(order_amount AS DECIMAL(18, 2))) AS DOUBLE)"

RISK_CASE = (
    "CASE WHEN {s} <= 25 THEN 'Low' WHEN {s} <= 50 THEN 'Medium' WHEN {s} <= 75 THEN 'High' "
    "WHEN {s} <= 100 THEN 'Critical' END"
)

SUMS = f"""COUNT(*) AS total_orders, CAST(SUM(items_delivered) AS BIGINT) AS total_items_delivered,
  CAST(SUM(items_missing) AS BIGINT) AS total_items_missing, {MONEY} AS total_revenue,
  {MONEY} / COUNT(*) AS avg_order_value, COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing"""

RATES = f"""{sql_rate('total_items_missing', 'total_items_delivered')} AS missing_rate,
  CAST(orders_with_missing AS DOUBLE) / total_orders * 100.0 AS pct_orders_with_missing"""

DRIVER_AGE = (
    "CASE WHEN age <= 25 THEN '18-25' WHEN age <= 35 THEN '26-35' WHEN age <= 45 THEN '36-45' "
    "WHEN age <= 55 THEN '46-55' WHEN age <= 100 THEN '55+' END"
)
EXPERIENCE = (
    "CASE WHEN trips <= 25 THEN 'Novice' WHEN trips <= 50 THEN 'Intermediate' "
    "WHEN trips <= 100 THEN 'Experienced' ELSE 'Expert' END"
)
CUSTOMER_AGE = (
    "CASE WHEN customer_age <= 25 THEN '18-25' WHEN customer_age <= 35 THEN '26-35' "
    "WHEN customer_age <= 45 THEN '36-45' WHEN customer_age <= 55 THEN '46-55' "
    "WHEN customer_age <= 65 THEN '56-65' WHEN customer_age <= 100 THEN '65+' END"
)

# Driver features: dstat (active drivers), df (all drivers).
DRIVER_FEATURES = f"""
dstat0 AS (SELECT driver_id, {SUMS} FROM ord GROUP BY driver_id),
dstat AS (SELECT *, {RATES} FROM dstat0),
df AS (
  SELECT d.driver_id, d.driver_name, d.age, d.trips,
         COALESCE(s.total_orders, 0) AS total_orders,
         COALESCE(s.total_items_delivered, 0) AS total_items_delivered,
         COALESCE(s.total_items_missing, 0) AS total_items_missing,
         COALESCE(s.total_revenue, 0.0) AS total_revenue,
         COALESCE(s.avg_order_value, 0.0) AS avg_order_value,
         COALESCE(s.orders_with_missing, 0) AS orders_with_missing,
         COALESCE(s.missing_rate, 0.0) AS missing_rate,
         COALESCE(s.pct_orders_with_missing, 0.0) AS pct_orders_with_missing,
         {DRIVER_AGE} AS age_group, {EXPERIENCE} AS experience_level
  FROM drv d LEFT JOIN dstat s USING (driver_id))"""
DF_DOUBLES = "total_revenue avg_order_value missing_rate pct_orders_with_missing"

# Driver risk: dr.
DRIVER_RISK = f"""{DRIVER_FEATURES},
dr0 AS (
  SELECT *,
    CASE WHEN MAX(missing_rate) OVER () = MIN(missing_rate) OVER () THEN 0.5 ELSE
      (missing_rate - MIN(missing_rate) OVER ()) / (MAX(missing_rate) OVER () - MIN(missing_rate) OVER ()) END
      AS missing_rate_score,
    CASE WHEN MAX(pct_orders_with_missing) OVER () = MIN(pct_orders_with_missing) OVER () THEN 0.5 ELSE
      (pct_orders_with_missing - MIN(pct_orders_with_missing) OVER ())
        / (MAX(pct_orders_with_missing) OVER () - MIN(pct_orders_with_missing) OVER ()) END AS pct_orders_score,
    CASE WHEN MAX(total_items_missing) OVER () = MIN(total_items_missing) OVER () THEN 0.5 ELSE
      CAST(total_items_missing - MIN(total_items_missing) OVER () AS DOUBLE)
        / (MAX(total_items_missing) OVER () - MIN(total_items_missing) OVER ()) END AS volume_score
  FROM df),
dr1 AS (SELECT *, (missing_rate_score * 0.4 + pct_orders_score * 0.35 + volume_score * 0.25) * 100.0 AS risk_score
        FROM dr0),
dr AS (SELECT *, {RISK_CASE.format(s='risk_score')} AS risk_category FROM dr1)"""
DR_DOUBLES = DF_DOUBLES + " missing_rate_score pct_orders_score volume_score risk_score"

# Driver summary: ds.
DRIVER_SUMMARY = f"""
ds0 AS (
  SELECT driver_id, COUNT(*) AS orders_completed, {MONEY} AS total_revenue,
         CAST(SUM(items_delivered) AS BIGINT) AS items_delivered, CAST(SUM(items_missing) AS BIGINT) AS items_missing,
         COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing
  FROM ord GROUP BY driver_id),
ds1 AS (
  SELECT d.driver_id, d.driver_name, d.age, d.trips,
         COALESCE(s.orders_completed, 0) AS orders_completed, COALESCE(s.total_revenue, 0.0) AS total_revenue,
         COALESCE(s.items_delivered, 0) AS items_delivered, COALESCE(s.items_missing, 0) AS items_missing,
         COALESCE(s.orders_with_missing, 0) AS orders_with_missing,
         COALESCE(s.items_delivered + s.items_missing, 0) AS total_items,
         COALESCE({sql_rate('s.items_missing', 's.items_delivered')}, 0.0) AS missing_rate,
         COALESCE(CAST(s.orders_with_missing AS DOUBLE) / s.orders_completed * 100.0, 0.0) AS pct_orders_with_missing,
         COALESCE(s.total_revenue / s.orders_completed, 0.0) AS avg_order_value
  FROM drv d LEFT JOIN ds0 s USING (driver_id)),
ds2 AS (
  SELECT *, CASE WHEN MAX(missing_rate) OVER () > 0 AND MAX(pct_orders_with_missing) OVER () > 0 THEN
    missing_rate / MAX(missing_rate) OVER () * 50.0
    + pct_orders_with_missing / MAX(pct_orders_with_missing) OVER () * 50.0 ELSE 0.0 END AS risk_score FROM ds1),
ds AS (SELECT *, {RISK_CASE.format(s='risk_score')} AS risk_category FROM ds2)"""
DS_DOUBLES = "total_revenue missing_rate pct_orders_with_missing avg_order_value risk_score"

# Value of missing items per order: ov.
ORDER_VALUE = """
ov AS (SELECT m.order_id, SUM(p.price) AS v, COUNT(*) AS n FROM mis m JOIN prd p USING (product_id) GROUP BY m.order_id)"""


def fraud_metrics(cte: str, entity: str, key: str, columns: str, extra: str = "", extra_out: str = "") -> str:
    """The metrics view of one entity: rates against delivered items and the 40/30/30 score."""
    score = (
        "orders_with_missing / CAST(NULLIF(orders_count, 0) AS DOUBLE) * 40.0"
        " + total_items_missing / CAST(NULLIF(total_items_delivered, 0) AS DOUBLE) * 30.0"
        " + total_missing_value / NULLIF(total_order_value, 0) * 30.0"
    )
    return f"""{ORDER_VALUE},
{cte}_o AS (
  SELECT {key}, COUNT(*) AS orders_count, COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing,
         CAST(SUM(items_delivered) AS BIGINT) AS total_items_delivered,
         CAST(SUM(items_missing) AS BIGINT) AS total_items_missing,
         {MONEY} AS total_order_value, {MONEY} / COUNT(*) AS avg_order_value{extra}
  FROM ord GROUP BY {key}),
{cte}_v AS (SELECT o.{key}, SUM(ov.v) AS total_missing_value FROM ord o JOIN ov USING (order_id) GROUP BY o.{key}),
{cte}_j AS (
  SELECT {columns}, COALESCE(o.orders_count, 0) AS orders_count,
         COALESCE(o.orders_with_missing, 0) AS orders_with_missing, o.total_items_delivered, o.total_items_missing,
         o.total_order_value, o.avg_order_value{extra_out}, COALESCE(v.total_missing_value, 0.0) AS total_missing_value
  FROM {entity} e LEFT JOIN {cte}_o o USING ({key}) LEFT JOIN {cte}_v v USING ({key})),
{cte} AS (
  SELECT * REPLACE ({sql_round('total_order_value', 2)} AS total_order_value,
    {sql_round('avg_order_value', 2)} AS avg_order_value),
    ROUND(orders_with_missing / CAST(NULLIF(orders_count, 0) AS DOUBLE) * 100.0, 2) AS missing_order_rate_pct,
    ROUND(total_items_missing / CAST(NULLIF(total_items_delivered, 0) AS DOUBLE) * 100.0, 2) AS missing_item_rate_pct,
    ROUND(total_missing_value / NULLIF(total_order_value, 0) * 100.0, 2) AS missing_value_rate_pct,
    ROUND({score}, 2) AS fraud_risk_score
  FROM {cte}_j)"""


FM_DOUBLES = (
    "total_order_value avg_order_value total_missing_value missing_order_rate_pct missing_item_rate_pct "
    "missing_value_rate_pct fraud_risk_score"
)
DRIVER_METRICS = fraud_metrics(
    "dm", "drv", "driver_id", "e.driver_id, e.driver_name, e.age AS driver_age, e.trips AS total_trips"
)


def high_risk(cte: str, ids: str, min_orders: int) -> str:
    return f"""
base AS (SELECT {ids}, orders_count, total_items_missing, missing_item_rate_pct, fraud_risk_score
         FROM {cte} WHERE orders_count >= {min_orders}),
th AS (SELECT AVG(missing_item_rate_pct) AS m, STDDEV_SAMP(missing_item_rate_pct) AS s FROM base)
SELECT base.*, th.m AS population_mean_rate, th.s AS population_stddev_rate,
  ROUND((missing_item_rate_pct - th.m) / NULLIF(th.s, 0), 2) AS z_score,
  CASE WHEN missing_item_rate_pct > th.m + 2 * th.s THEN 'HIGH'
       WHEN missing_item_rate_pct > th.m + th.s THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM base, th WHERE missing_item_rate_pct > th.m + th.s"""


HR_DOUBLES = "missing_item_rate_pct fraud_risk_score population_mean_rate population_stddev_rate z_score"

# Customer features: cf. Customer risk: cr.
CUSTOMER_FEATURES = f"""
cstat0 AS (SELECT customer_id, {SUMS} FROM ord GROUP BY customer_id),
cstat AS (SELECT *, {RATES} FROM cstat0),
cf0 AS (
  SELECT c.customer_id, c.customer_name, c.customer_age,
         COALESCE(s.total_orders, 0) AS total_orders, COALESCE(s.total_revenue, 0.0) AS total_spent,
         COALESCE(s.avg_order_value, 0.0) AS avg_order_value,
         COALESCE(s.total_items_delivered, 0) AS total_items_delivered,
         COALESCE(s.total_items_missing, 0) AS total_items_missing,
         COALESCE(s.total_items_delivered + s.total_items_missing, 0) AS total_items_ordered,
         COALESCE(s.orders_with_missing, 0) AS orders_with_missing,
         COALESCE(s.missing_rate, 0.0) AS missing_rate,
         COALESCE(s.pct_orders_with_missing, 0.0) AS pct_orders_with_missing, {CUSTOMER_AGE} AS age_group
  FROM cus c LEFT JOIN cstat s USING (customer_id)),
cq AS (SELECT QUANTILE_CONT(total_spent, 0.25) AS q1, QUANTILE_CONT(total_spent, 0.5) AS q2,
              QUANTILE_CONT(total_spent, 0.75) AS q3 FROM cf0),
cf AS (
  SELECT cf0.*, CASE WHEN total_spent <= q1 THEN 'Low Value' WHEN total_spent <= q2 THEN 'Medium Value'
    WHEN total_spent <= q3 THEN 'High Value' ELSE 'VIP' END AS customer_segment FROM cf0, cq)"""
CF_DOUBLES = "total_spent avg_order_value missing_rate pct_orders_with_missing"


def sql_min_max(c: str, flat: str) -> str:
    return (
        f"CASE WHEN MAX({c}) OVER () = MIN({c}) OVER () THEN {flat} ELSE CAST({c} - MIN({c}) OVER () AS DOUBLE) "
        f"/ (MAX({c}) OVER () - MIN({c}) OVER ()) END"
    )


CUSTOMER_RISK = f"""{CUSTOMER_FEATURES},
cr0 AS (SELECT *, {sql_min_max('missing_rate', '0.5')} AS missing_rate_score,
  {sql_min_max('pct_orders_with_missing', '0.5')} AS pct_orders_score,
  {sql_min_max('orders_with_missing', '0.5')} AS frequency_score FROM cf),
cr1 AS (SELECT *, (missing_rate_score * 0.4 + pct_orders_score * 0.35 + frequency_score * 0.25) * 100.0 AS risk_score
        FROM cr0),
cr AS (SELECT *, {RISK_CASE.format(s='risk_score')} AS risk_category FROM cr1)"""
CR_DOUBLES = CF_DOUBLES + " missing_rate_score pct_orders_score frequency_score risk_score"

CUSTOMER_METRICS = fraud_metrics(
    "cm",
    "cus",
    "customer_id",
    "e.customer_id, e.customer_name, e.customer_age",
    ", MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date",
    """, o.first_order_date, o.last_order_date, COALESCE((SELECT COUNT(DISTINCT m.product_id) FROM mis m
       JOIN ord x USING (order_id) WHERE x.customer_id = e.customer_id), 0) AS unique_missing_products""",
)

# Customer summary: cs. Workspace with activity, signature and priority: cw.
CUSTOMER_SUMMARY = f"""
cs0 AS (
  SELECT customer_id, COUNT(*) AS total_orders, {MONEY} AS total_spent,
         CAST(SUM(items_delivered) AS BIGINT) AS items_received,
         CAST(SUM(items_missing) AS BIGINT) AS items_reported_missing,
         COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_claims
  FROM ord GROUP BY customer_id),
cs1 AS (
  SELECT c.customer_id, c.customer_name, c.customer_age, COALESCE(s.total_orders, 0) AS total_orders,
         COALESCE(s.total_spent, 0.0) AS total_spent, COALESCE(s.items_received, 0) AS items_received,
         COALESCE(s.items_reported_missing, 0) AS items_reported_missing,
         COALESCE(s.orders_with_claims, 0) AS orders_with_claims,
         COALESCE(s.items_received + s.items_reported_missing, 0) AS total_items,
         COALESCE({sql_rate('s.items_reported_missing', 's.items_received')}, 0.0) AS claim_rate,
         COALESCE(CAST(s.orders_with_claims AS DOUBLE) / s.total_orders * 100.0, 0.0) AS pct_orders_with_claims,
         COALESCE(s.total_spent / s.total_orders, 0.0) AS avg_order_value
  FROM cus c LEFT JOIN cs0 s USING (customer_id)),
cs2 AS (
  SELECT *, CASE WHEN MAX(claim_rate) OVER () > 0 AND MAX(pct_orders_with_claims) OVER () > 0 THEN
    claim_rate / MAX(claim_rate) OVER () * 50.0
    + pct_orders_with_claims / MAX(pct_orders_with_claims) OVER () * 50.0 ELSE 0.0 END AS risk_score FROM cs1),
cs AS (
  SELECT *, {RISK_CASE.format(s='risk_score')} AS risk_category,
    CASE WHEN total_spent <= 500 THEN 'Low Value' WHEN total_spent <= 2000 THEN 'Medium Value'
         WHEN total_spent <= 5000 THEN 'High Value' ELSE 'Premium' END AS spending_segment FROM cs2)"""
CS_DOUBLES = "total_spent claim_rate pct_orders_with_claims avg_order_value risk_score"

ACTIVITY_SQL = """SELECT customer_id, MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
  COUNT(DISTINCT driver_id) AS unique_drivers, COUNT(DISTINCT region) AS unique_regions,
  CAST(MAX(order_date) - MIN(order_date) AS INTEGER) + 1 AS active_days FROM ord GROUP BY customer_id"""

CUSTOMER_WORKSPACE = f"""{CUSTOMER_SUMMARY},
act AS ({ACTIVITY_SQL}),
cwq AS (SELECT GREATEST(8.0, QUANTILE_CONT(claim_rate, 0.85)) AS a,
  GREATEST(35.0, QUANTILE_CONT(pct_orders_with_claims, 0.8)) AS b,
  GREATEST(120.0, QUANTILE_CONT(avg_order_value, 0.75)) AS c,
  GREATEST(2, FLOOR(QUANTILE_CONT(orders_with_claims, 0.8))) AS d FROM cs),
cw0 AS (
  SELECT cs.*, act.first_order_date, act.last_order_date, COALESCE(act.unique_drivers, 0) AS unique_drivers,
    COALESCE(act.unique_regions, 0) AS unique_regions, COALESCE(act.active_days, 0) AS active_days,
    CASE WHEN pct_orders_with_claims >= 80 AND total_orders >= 3 THEN 'Always Claiming'
      WHEN claim_rate >= a AND pct_orders_with_claims >= b AND avg_order_value >= c AND orders_with_claims >= 2
        THEN 'High-Value Opportunist'
      WHEN orders_with_claims >= d AND total_orders >= 4 THEN 'Chronic Reporter'
      WHEN risk_score >= 60 AND total_orders < 4 THEN 'Emerging Risk' ELSE 'Baseline Pattern' END
      AS behavior_signature
  FROM cs LEFT JOIN act USING (customer_id), cwq),
cw1 AS (
  SELECT *, CASE behavior_signature WHEN 'Always Claiming' THEN 1 WHEN 'High-Value Opportunist' THEN 2
      WHEN 'Chronic Reporter' THEN 3 WHEN 'Emerging Risk' THEN 4 ELSE 5 END AS signature_rank,
    LEAST(GREATEST(risk_score * 0.5 + pct_orders_with_claims * 0.2
      + {sql_min_max('total_spent', '0.0')} * 100.0 * 0.15
      + {sql_min_max('orders_with_claims', '0.0')} * 100.0 * 0.15, 0.0), 100.0) AS priority_score
  FROM cw0),
cw AS (SELECT *, CASE WHEN priority_score <= 35 THEN 'Monitor' WHEN priority_score <= 60 THEN 'Review'
         WHEN priority_score <= 80 THEN 'Fast Track' ELSE 'Immediate' END AS priority_tier FROM cw1)"""
CW_DOUBLES = CS_DOUBLES + " priority_score"

# Driver-customer pairs: pr.
PAIRS = f"""
pr AS (SELECT driver_id, customer_id, COUNT(*) AS interactions, CAST(SUM(items_missing) AS BIGINT) AS items_missing,
  CAST(SUM(items_delivered) AS BIGINT) AS items_delivered,
  CAST(SUM(items_missing + items_delivered) AS BIGINT) AS total_items,
  {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} AS missing_rate FROM ord GROUP BY driver_id, customer_id)"""

PERIOD_CLOCK = (
    "CASE WHEN delivery_hour BETWEEN 6 AND 11 THEN 'Morning' WHEN delivery_hour BETWEEN 12 AND 17 THEN 'Afternoon' "
    "WHEN delivery_hour BETWEEN 18 AND 21 THEN 'Evening' ELSE 'Night' END"
)
PERIOD_CUT = (
    "CASE WHEN delivery_hour <= 6 THEN 'Night' WHEN delivery_hour <= 12 THEN 'Morning' "
    "WHEN delivery_hour <= 18 THEN 'Afternoon' ELSE 'Evening' END"
)

# Regions: rp (performance), rs (summary), geo.
REGIONAL = f"""
rp0 AS (
  SELECT region, COUNT(*) AS total_orders, {MONEY} AS total_revenue, {MONEY} / COUNT(*) AS avg_order_value,
    CAST(SUM(items_delivered) AS BIGINT) AS items_delivered, CAST(SUM(items_missing) AS BIGINT) AS items_missing,
    COUNT(DISTINCT driver_id) AS unique_drivers, COUNT(DISTINCT customer_id) AS unique_customers,
    COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing FROM ord GROUP BY region),
rp AS (
  SELECT *, items_delivered + items_missing AS total_items, {sql_rate('items_missing', 'items_delivered')} AS missing_rate,
    CAST(orders_with_missing AS DOUBLE) / total_orders * 100.0 AS pct_orders_with_missing,
    CAST(total_orders AS DOUBLE) / unique_drivers AS orders_per_driver,
    total_revenue / unique_customers AS revenue_per_customer FROM rp0)"""
RP_DOUBLES = (
    "total_revenue avg_order_value missing_rate pct_orders_with_missing orders_per_driver revenue_per_customer"
)
GEO = f"""{REGIONAL},
rs AS (
  SELECT * EXCLUDE (revenue_per_customer), CAST(total_orders AS DOUBLE) / unique_customers AS orders_per_customer,
    total_revenue / SUM(total_revenue) OVER () * 100.0 AS revenue_share,
    CAST(FLOOR(RANK() OVER (ORDER BY missing_rate DESC)
      + (COUNT(*) OVER (PARTITION BY missing_rate) - 1) / 2.0) AS INTEGER) AS risk_rank FROM rp),
geo AS (
  SELECT *, CASE WHEN risk_rank <= 1 THEN 'Critical' WHEN risk_rank <= 2 THEN 'High' WHEN risk_rank <= 4 THEN 'Medium'
    ELSE 'Low' END AS risk_tier, CAST(items_missing * 15.0 AS DOUBLE) AS estimated_loss_usd,
    missing_rate - AVG(missing_rate) OVER () AS missing_rate_gap, CAST(28.5383 AS DOUBLE) AS lat,
    CAST(-81.3792 AS DOUBLE) AS lon FROM rs)"""
RS_DOUBLES = (
    "total_revenue avg_order_value missing_rate pct_orders_with_missing orders_per_driver orders_per_customer "
    "revenue_share"
)
GEO_DOUBLES = RS_DOUBLES + " estimated_loss_usd missing_rate_gap lat lon"
