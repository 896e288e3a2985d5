"""Product queries P-1 to P-35."""

from pyspark.sql import functions as F

from deliveryrisk.functions.scalar import delivery_period, price_segment
from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drift as DR
from deliveryrisk.operators import products as P
from deliveryrisk.operators import temporal as T
from deliveryrisk.plans.drift import PERFORMANCE
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import CUSTOMER_SUMMARY, MONEY, PERIOD_CLOCK
from deliveryrisk.plans.temporal import SUMMARY

# The generated catalogue costs 900 to 1000, so the price edges are parameters.
BANDS = [None, 920, 940, 960, 980, None]
REFERENCE_DATE = "2002-01-31"


def facts(t):
    return P.missing_facts(t.missing_items, t.orders, t.products)


def exposed(t):
    return P.pattern_exposure(t.missing_items, t.orders, t.products)


def scope(t):
    return P.product_scope(t.products, exposed(t), BANDS)


def categories(t):
    return P.category_scope(scope(t), facts(t))


def forecast(t):
    return P.loss_forecast(P.daily_loss(facts(t)))


PM = "pm AS (SELECT product_id, COUNT(*) AS n, COUNT(DISTINCT order_id) AS o FROM mis GROUP BY product_id)"


@query("missing_facts", "SELECT * FROM facts", "order_amount price")
def _(t):
    return facts(t)


@query(
    "product_features",
    f"""WITH {PM}, f AS (SELECT prd.*, COALESCE(n, 0) AS times_reported_missing,
  CASE WHEN price <= 920 THEN 'Very Low' WHEN price <= 940 THEN 'Low' WHEN price <= 960 THEN 'Medium'
    WHEN price <= 980 THEN 'High' ELSE 'Premium' END AS price_category FROM prd LEFT JOIN pm USING (product_id))
SELECT *, CAST(SUM(times_reported_missing) OVER (PARTITION BY category) AS BIGINT) AS category_total_missing FROM f""",
    "price",
)
def _(t):
    return P.product_features(t.products, t.missing_items, [-1, 920, 940, 960, 980, None])


@query(
    "product_summary",
    f"""WITH {PM} SELECT prd.*, COALESCE(n, 0) AS times_reported_missing, COALESCE(o, 0) AS orders_affected,
  COALESCE(n, 0) * price AS estimated_loss FROM prd LEFT JOIN pm USING (product_id)""",
    "price estimated_loss",
)
def _(t):
    return P.product_summary(t.products, t.missing_items)


@query(
    "product_fraud_metrics",
    f"""WITH {PM} SELECT product_id, product_name, category AS category_name, price, COALESCE(n, 0) AS times_missing,
  COALESCE(o, 0) AS orders_affected, ROUND(COALESCE(n, 0) * price, 2) AS total_missing_value,
  CAST(RANK() OVER (PARTITION BY category ORDER BY COALESCE(n, 0) DESC) AS INTEGER) AS rank_in_category
FROM prd LEFT JOIN pm USING (product_id)""",
    "price total_missing_value",
)
def _(t):
    return P.product_fraud_metrics(t.products, t.missing_items)


@query(
    "category_fraud_metrics",
    """SELECT category AS category_name, COUNT(DISTINCT p.product_id) AS products_in_category,
  COUNT(m.missing_item_id) AS total_items_missing, COUNT(DISTINCT m.order_id) AS orders_affected,
  ROUND(SUM(price), 2) AS total_missing_value, ROUND(AVG(price), 2) AS avg_missing_item_price
FROM prd p LEFT JOIN mis m USING (product_id) GROUP BY category""",
    "total_missing_value avg_missing_item_price",
)
def _(t):
    return P.category_fraud_metrics(t.products, t.missing_items)


MBP = f"{PM}, mbp AS (SELECT prd.*, n AS times_missing, n * price AS value_lost FROM prd JOIN pm USING (product_id))"


@query("missing_by_product", f"WITH {MBP} SELECT * FROM mbp", "price value_lost")
def _(t):
    return P.missing_by_product(t.products, t.missing_items)


@query(
    "product_risk_60_40",
    f"""WITH {MBP}, a AS (SELECT *, times_missing * 100.0 / MAX(times_missing) OVER () AS frequency_score,
  price / MAX(price) OVER () * 100.0 AS value_score FROM mbp),
b AS (SELECT *, frequency_score * 0.6 + value_score * 0.4 AS risk_score FROM a)
SELECT *, CASE WHEN risk_score >= 70 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' WHEN risk_score >= 30 THEN 'Medium'
  ELSE 'Low' END AS risk_category FROM b""",
    "price value_lost frequency_score value_score risk_score",
)
def _(t):
    return P.product_risk_60_40(P.missing_by_product(t.products, t.missing_items))


@query(
    "category_distribution",
    """SELECT category, COUNT(*) AS product_count, AVG(price) AS avg_price, MIN(price) AS min_price,
  MAX(price) AS max_price, SUM(price) AS total_value, COUNT(*) * 100.0 / (SELECT COUNT(*) FROM prd) AS pct_of_catalog
FROM prd GROUP BY category""",
    "avg_price min_price max_price total_value pct_of_catalog",
)
def _(t):
    return P.category_distribution(t.products)


@query(
    "missing_by_category",
    """SELECT category, COUNT(*) AS items_missing, SUM(price) AS total_value_lost,
  COUNT(DISTINCT m.product_id) AS unique_products_missing,
  (SELECT COUNT(*) FROM prd x WHERE x.category = p.category) AS product_count,
  COUNT(DISTINCT m.product_id) * 100.0 / (SELECT COUNT(*) FROM prd x WHERE x.category = p.category) AS pct_products_missing,
  SUM(price) / COUNT(*) AS avg_value_per_missing
FROM mis m JOIN prd p USING (product_id) GROUP BY category""",
    "total_value_lost pct_products_missing avg_value_per_missing",
)
def _(t):
    return P.missing_by_category(t.products, t.missing_items)


SEGMENT = (
    "CASE WHEN price < 925 THEN 'Budget (<$925)' WHEN price < 950 THEN 'Mid-Range ($925-$950)' "
    "WHEN price < 975 THEN 'Premium ($950-$975)' ELSE 'High-Value ($975+)' END"
)


@query(
    "missing_by_price_segment",
    f"""SELECT {SEGMENT} AS price_segment, COUNT(*) AS items_missing, SUM(price) AS total_value_lost,
  COUNT(*) * 100.0 / (SELECT COUNT(*) FROM mis) AS pct_of_missing FROM mis JOIN prd USING (product_id) GROUP BY 1""",
    "total_value_lost pct_of_missing",
)
def _(t):
    return P.missing_by_price_segment(t.products, t.missing_items, (925, 950, 975))


@query(
    "driver_product",
    """SELECT g.*, driver_name FROM (
  SELECT driver_id, product_id, product_name, category, COUNT(*) AS times_missing, SUM(price) AS value_lost FROM facts
  GROUP BY 1, 2, 3, 4 ORDER BY times_missing DESC, driver_id, product_id LIMIT 20) g LEFT JOIN drv USING (driver_id)""",
    "value_lost",
)
def _(t):
    return P.driver_product(facts(t), t.drivers)


@query(
    "high_value_driver_losses",
    """SELECT driver_id, driver_name, COUNT(*) AS high_value_items_missing, SUM(price) AS high_value_lost
FROM facts LEFT JOIN drv USING (driver_id) WHERE price >= 950 GROUP BY 1, 2""",
    "high_value_lost",
)
def _(t):
    return P.high_value_driver_losses(facts(t), t.drivers, 950.0)


@query(
    "driver_category_matrix",
    """WITH td AS (SELECT driver_id FROM facts GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 5),
tc AS (SELECT category FROM facts GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 5)
SELECT td.driver_id, tc.category, COUNT(f.order_id) AS items_missing FROM td CROSS JOIN tc
LEFT JOIN facts f ON f.driver_id = td.driver_id AND f.category = tc.category GROUP BY 1, 2""",
)
def _(t):
    return P.driver_category_matrix(facts(t))


def _crosstab(*keys):
    names = ", ".join(f"{e} AS {n}" for n, e in keys)
    by = ", ".join(str(i + 1) for i in range(len(keys)))
    return f"SELECT {names}, COUNT(*) AS items_missing, SUM(price) AS value_lost FROM facts GROUP BY {by}"


@query("region_category", _crosstab(("region", "region"), ("category", "category")), "value_lost")
def _(t):
    return P.crosstab(facts(t), "region", "category")


CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "region_category_matrix",
    "SELECT region, "
    + ", ".join(f"COUNT(CASE WHEN category = '{c}' THEN 1 END) AS \"{c}\"" for c in CATEGORIES)
    + " FROM facts GROUP BY region",
)
def _(t):
    return P.region_category_matrix(facts(t), CATEGORIES)


@query(
    "top_products_per_region",
    """SELECT * FROM (SELECT region, product_name, COUNT(*) AS times_missing,
  CAST(ROW_NUMBER() OVER (PARTITION BY region ORDER BY COUNT(*) DESC, product_name) AS INTEGER) AS rank
  FROM facts GROUP BY 1, 2) WHERE rank <= 3""",
)
def _(t):
    return P.top_products_per_region(facts(t))


MONTH_SQL = "CAST(EXTRACT(MONTH FROM order_date) AS INTEGER)"


@query("month_category", _crosstab(("month", MONTH_SQL), ("category", "category")), "value_lost")
def _(t):
    return P.crosstab(facts(t), F.month("order_date").alias("month"), "category")


@query(
    "weekday_category",
    _crosstab(("day_of_week", "STRFTIME(order_date, '%A')"), ("category", "category")),
    "value_lost",
)
def _(t):
    return P.crosstab(facts(t), F.date_format("order_date", "EEEE").alias("day_of_week"), "category")


@query("hour_price_segment", _crosstab(("hour", "delivery_hour"), ("price_segment", SEGMENT)), "value_lost")
def _(t):
    return P.crosstab(
        facts(t), F.col("delivery_hour").alias("hour"), price_segment("price", (925, 950, 975)).alias("price_segment")
    )


@query("period_category", _crosstab(("period", PERIOD_CLOCK), ("category", "category")), "value_lost")
def _(t):
    return P.crosstab(facts(t), delivery_period("delivery_hour").alias("period"), "category")


@query(
    "high_value_by_period",
    f"""SELECT {PERIOD_CLOCK} AS period, COUNT(*) AS high_value_missing, SUM(price) AS value_lost FROM facts
WHERE price >= 950 GROUP BY 1""",
    "value_lost",
)
def _(t):
    return P.high_value_by_period(facts(t), 950.0)


def _signal(cte, key, expr, name, flag, p):
    """Flag, mean rate and event percentile of one small attribute."""
    return f"""
{cte}a AS (SELECT {expr} AS {key}, AVG(order_missing_rate) AS mr, {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} AS ar
  FROM oe GROUP BY 1),
{cte}b AS (SELECT *, ar > (SELECT AVG(ar) + 2 * STDDEV_SAMP(ar) FROM {cte}a) AS f FROM {cte}a),
{cte} AS (SELECT {key}, mr AS {name}_missing_rate, CASE WHEN (SELECT COUNT(*) FROM {cte}b WHERE f) > 0 THEN f
  ELSE mr >= (SELECT QUANTILE_CONT(mr, {p}) FROM {cte}a) END AS {flag} FROM {cte}b)"""


def _pct(rate, name):
    return (
        f"CASE WHEN (SELECT COUNT(DISTINCT {rate}) FROM fj) <= 1 THEN 50.0 ELSE (RANK() OVER (ORDER BY {rate}) "
        f"+ (COUNT(*) OVER (PARTITION BY {rate}) - 1) / 2.0) / COUNT(*) OVER () * 100.0 END AS {name}_signal"
    )


EXPOSURE = f"""
oe AS (SELECT *, {sql_rate('items_missing', 'items_delivered')} AS order_missing_rate,
  STRFTIME(order_date, '%A') AS day_of_week FROM ord),
{_signal('ed', 'day_of_week', 'day_of_week', 'day', 'is_anomaly_day', 0.80)},
{_signal('eh', 'delivery_hour', 'delivery_hour', 'hour', 'is_anomaly_hour', 0.85)},
{_signal('er', 'region', 'region', 'region', 'is_high_risk_region', 0.85)},
ep0 AS (SELECT driver_id, customer_id, COUNT(*) AS k, AVG(order_missing_rate) AS pair_missing_rate,
  COUNT(*) >= 3 AND {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} >= 50 AS f FROM oe GROUP BY 1, 2),
ep AS (SELECT driver_id, customer_id, pair_missing_rate, CASE WHEN (SELECT COUNT(*) FROM ep0 WHERE f) > 0 THEN f
  ELSE k >= 2 AND pair_missing_rate > 0 AND pair_missing_rate >= (SELECT QUANTILE_CONT(pair_missing_rate, 0.95) FROM ep0)
  END AS is_collusion_pair FROM ep0),
fj AS (SELECT facts.*, STRFTIME(order_date, '%A') AS day_of_week,
  {sql_rate('items_missing', 'items_delivered')} AS order_missing_rate, day_missing_rate, is_anomaly_day,
  hour_missing_rate, is_anomaly_hour, region_missing_rate, is_high_risk_region, pair_missing_rate, is_collusion_pair
  FROM facts LEFT JOIN ed ON ed.day_of_week = STRFTIME(order_date, '%A') LEFT JOIN eh USING (delivery_hour)
  LEFT JOIN er USING (region) LEFT JOIN ep USING (driver_id, customer_id)),
fs AS (SELECT *, {_pct('day_missing_rate', 'day')}, {_pct('hour_missing_rate', 'hour')},
  {_pct('region_missing_rate', 'region')}, {_pct('pair_missing_rate', 'pair')} FROM fj),
fx AS (SELECT *, LEAST(GREATEST(day_signal * 0.3 + hour_signal * 0.2 + region_signal * 0.25 + pair_signal * 0.25
  + CASE WHEN is_anomaly_day THEN 8 ELSE 0 END + CASE WHEN is_anomaly_hour THEN 7 ELSE 0 END
  + CASE WHEN is_high_risk_region THEN 7 ELSE 0 END + CASE WHEN is_collusion_pair THEN 10 ELSE 0 END, 0), 100)
  AS pattern_exposure_points FROM fs)"""
FX_DOUBLES = (
    "order_amount price order_missing_rate day_missing_rate hour_missing_rate region_missing_rate pair_missing_rate "
    "day_signal hour_signal region_signal pair_signal pattern_exposure_points"
)


@query("pattern_exposure", f"WITH {EXPOSURE} SELECT * FROM fx", FX_DOUBLES)
def _(t):
    return exposed(t)


BAND_SQL = (
    "CASE WHEN price <= 920 THEN 'Budget (<$10)' WHEN price <= 940 THEN 'Core ($10-$25)' "
    "WHEN price <= 960 THEN 'Premium ($25-$50)' WHEN price <= 980 THEN 'High Value ($50-$100)' "
    "ELSE 'Critical Value ($100+)' END"
)
SCOPE = f"""{EXPOSURE},
sc0 AS (SELECT product_id, COUNT(*) AS times_reported_missing, COUNT(DISTINCT order_id) AS orders_affected,
  CAST(SUM(CAST(price AS DECIMAL(18, 2))) AS DOUBLE) AS estimated_loss, COUNT(DISTINCT customer_id) AS unique_customers, COUNT(DISTINCT region) AS unique_regions,
  AVG(CASE WHEN is_anomaly_day THEN 1.0 ELSE 0.0 END) AS anomaly_day_rate,
  AVG(CASE WHEN is_anomaly_hour THEN 1.0 ELSE 0.0 END) AS anomaly_hour_rate,
  AVG(CASE WHEN is_high_risk_region THEN 1.0 ELSE 0.0 END) AS high_risk_region_rate,
  AVG(CASE WHEN is_collusion_pair THEN 1.0 ELSE 0.0 END) AS collusion_pair_rate,
  AVG(pattern_exposure_points) AS pattern_exposure_index FROM fx GROUP BY product_id),
sc1 AS (SELECT prd.*, COALESCE(times_reported_missing, 0) AS times_reported_missing,
  COALESCE(orders_affected, 0) AS orders_affected, COALESCE(estimated_loss, 0.0) AS estimated_loss,
  COALESCE(unique_customers, 0) AS unique_customers, COALESCE(unique_regions, 0) AS unique_regions,
  COALESCE(anomaly_day_rate, 0.0) AS anomaly_day_rate, COALESCE(anomaly_hour_rate, 0.0) AS anomaly_hour_rate,
  COALESCE(high_risk_region_rate, 0.0) AS high_risk_region_rate, COALESCE(collusion_pair_rate, 0.0) AS collusion_pair_rate,
  COALESCE(pattern_exposure_index, 0.0) AS pattern_exposure_index, {BAND_SQL} AS price_band, 0.22 AS margin_rate
  FROM prd LEFT JOIN sc0 USING (product_id)),
sc2 AS (SELECT *, CASE WHEN times_reported_missing > 0 THEN estimated_loss / times_reported_missing ELSE price END
    AS avg_unit_price,
  estimated_loss * 0.22 AS margin_loss, estimated_loss * 1.1 AS replacement_cost,
  (RANK() OVER (PARTITION BY category ORDER BY orders_affected)
    + (COUNT(*) OVER (PARTITION BY category, orders_affected) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY category) * 100.0
    AS stock_turnover_proxy,
  times_reported_missing * 100.0 / GREATEST(MAX(times_reported_missing) OVER (), 1) AS frequency_score,
  estimated_loss / GREATEST(MAX(estimated_loss) OVER (), 1.0) * 100.0 AS value_score, 100.0 AS margin_score,
  pattern_exposure_index / GREATEST(MAX(pattern_exposure_index) OVER (), 1.0) * 100.0 AS pattern_score,
  estimated_loss / SUM(estimated_loss) OVER () * 100.0 AS loss_pct_of_total FROM sc1),
sc3 AS (SELECT *, ROUND(LEAST(GREATEST(frequency_score * 0.4 + value_score * 0.3 + margin_score * 0.2
  + pattern_score * 0.1, 0), 100), 8) AS risk_score FROM sc2),
sc4 AS (SELECT *, CASE WHEN risk_score <= 30 THEN 'Low' WHEN risk_score <= 55 THEN 'Medium' WHEN risk_score <= 75 THEN 'High'
  ELSE 'Critical' END AS risk_tier FROM sc3),
sc5 AS (SELECT *, CASE WHEN risk_tier IN ('High', 'Critical') THEN estimated_loss * 0.42 ELSE estimated_loss * 0.3 END
  AS prevention_cost, estimated_loss * 1.25 AS opportunity_cost FROM sc4),
sc AS (SELECT *, CASE WHEN prevention_cost > 0 THEN (replacement_cost - prevention_cost) / prevention_cost * 100.0
  ELSE 0.0 END AS prevention_roi FROM sc5)"""
SC_DOUBLES = (
    "price estimated_loss anomaly_day_rate anomaly_hour_rate high_risk_region_rate collusion_pair_rate "
    "pattern_exposure_index margin_rate avg_unit_price margin_loss replacement_cost stock_turnover_proxy "
    "frequency_score value_score margin_score pattern_score loss_pct_of_total risk_score prevention_cost "
    "opportunity_cost prevention_roi"
)


@query(
    "product_scope",
    f"WITH {SCOPE} SELECT *, CAST(DENSE_RANK() OVER (ORDER BY risk_score DESC) AS INTEGER) AS risk_rank FROM sc",
    SC_DOUBLES,
)
def _(t):
    return P.with_risk_rank(scope(t))


CATEGORY_SCOPE = f"""{SCOPE},
cg0 AS (SELECT category, COUNT(*) AS sku_count, COUNT(CASE WHEN risk_tier IN ('High', 'Critical') THEN 1 END)
  AS high_risk_skus, CAST(SUM(times_reported_missing) AS BIGINT) AS times_reported_missing,
  SUM(estimated_loss) AS estimated_loss, SUM(margin_loss) AS margin_loss, SUM(replacement_cost) AS replacement_cost,
  SUM(prevention_cost) AS prevention_cost, AVG(risk_score) AS avg_risk_score FROM sc GROUP BY category),
cgr AS (SELECT category, {MONEY} AS revenue_proxy FROM (SELECT DISTINCT order_id, category, order_amount FROM facts)
  GROUP BY category),
cg AS (SELECT cg0.*, COALESCE(revenue_proxy, 0.0) AS revenue_proxy, CASE WHEN COALESCE(revenue_proxy, 0) > 0
  THEN estimated_loss / revenue_proxy * 100.0 ELSE 0.0 END AS loss_pct_revenue, CASE WHEN prevention_cost > 0
  THEN (replacement_cost - prevention_cost) / prevention_cost * 100.0 ELSE 0.0 END AS prevention_roi
  FROM cg0 LEFT JOIN cgr USING (category))"""


@query(
    "category_scope",
    f"WITH {CATEGORY_SCOPE} SELECT * FROM cg",
    "estimated_loss margin_loss replacement_cost prevention_cost avg_risk_score revenue_proxy loss_pct_revenue "
    "prevention_roi",
)
def _(t):
    return categories(t)


MCL = """mcl AS (SELECT CAST(DATE_TRUNC('month', order_date) AS DATE) AS month_start, category, SUM(price) AS estimated_loss,
  COUNT(*) AS missing_events, STRFTIME(DATE_TRUNC('month', order_date), '%b %Y') AS month_label FROM facts
  WHERE order_date IS NOT NULL GROUP BY 1, 2, 5)"""


@query("monthly_category_loss", f"WITH {MCL} SELECT * FROM mcl", "estimated_loss")
def _(t):
    return P.monthly_category_loss(facts(t))


@query(
    "scoped_revenue",
    f"""SELECT {MONEY} AS scoped_revenue FROM (SELECT DISTINCT order_id, order_amount FROM facts
WHERE category = 'PROMO')""",
    "scoped_revenue",
)
def _(t):
    return P.scoped_revenue(facts(t).where("category = 'PROMO'"))


DAILY = """dl0 AS (SELECT order_date, SUM(price) AS loss FROM facts WHERE order_date IS NOT NULL GROUP BY 1),
dls AS (SELECT CAST(UNNEST(GENERATE_SERIES((SELECT MIN(order_date) FROM dl0), (SELECT MAX(order_date) FROM dl0),
  INTERVAL 1 DAY)) AS DATE) AS order_date),
dl AS (SELECT order_date, COALESCE(loss, 0.0) AS loss, ROW_NUMBER() OVER (ORDER BY order_date) - 1 AS i
  FROM dls LEFT JOIN dl0 USING (order_date))"""
FORECAST = f"""{DAILY},
ft AS (SELECT COUNT(*) AS n, STDDEV_POP(loss) AS sd, REGR_SLOPE(loss, i) AS a, REGR_INTERCEPT(loss, i) AS b FROM dl),
hz AS (SELECT UNNEST([30, 60, 90]) AS h),
fp AS (SELECT h, sd, SUM(GREATEST(a * (n + d) + b, 0.0)) AS y
  FROM ft, hz, (SELECT UNNEST(GENERATE_SERIES(0, 89)) AS d) WHERE d < h GROUP BY h, sd),
fc AS (SELECT CAST(h AS INTEGER) AS horizon_days, y AS projected_loss, GREATEST(y - sd * SQRT(h), 0.0)
  AS projected_loss_low, y + sd * SQRT(h) AS projected_loss_high FROM fp)"""


@query(
    "loss_forecast", f"WITH {FORECAST} SELECT * FROM fc", "projected_loss projected_loss_low projected_loss_high"
)
def _(t):
    return forecast(t)


@query(
    "cumulative_history",
    f"""WITH {DAILY}, l AS (SELECT * FROM dl ORDER BY order_date DESC LIMIT 60)
SELECT order_date, loss, SUM(loss) OVER (ORDER BY order_date) AS cumulative_loss,
  (SELECT AVG(loss) FROM dl) * ROW_NUMBER() OVER (ORDER BY order_date) AS baseline_target FROM l""",
    "loss cumulative_loss baseline_target",
)
def _(t):
    return P.cumulative_history(P.daily_loss(facts(t)))


@query(
    "behavior_shift",
    """WITH m AS (SELECT product_id, product_name, DATE_TRUNC('month', order_date) AS ms, SUM(price) AS v FROM facts
  GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY ms DESC) AS r FROM m),
s AS (SELECT product_id, product_name, AVG(CASE WHEN r > 3 THEN v END) AS baseline_loss,
  AVG(CASE WHEN r <= 3 THEN v END) AS recent_loss FROM r GROUP BY 1, 2 HAVING COUNT(*) >= 4)
SELECT *, CASE WHEN baseline_loss = 0 THEN 0.0 ELSE (recent_loss - baseline_loss) / baseline_loss * 100.0 END AS change_pct
FROM s""",
    "baseline_loss recent_loss change_pct",
)
def _(t):
    return P.behavior_shift(facts(t))


DELTA = f"""{MCL}, mt AS (SELECT month_start, SUM(estimated_loss) AS v, ROW_NUMBER() OVER (ORDER BY month_start DESC) AS r
  FROM mcl GROUP BY month_start),
bd0 AS (SELECT AVG(CASE WHEN r > 3 THEN v END) AS baseline_loss, AVG(CASE WHEN r <= 3 THEN v END) AS recent_loss FROM mt),
bd AS (SELECT *, (recent_loss - baseline_loss) / baseline_loss * 100.0 AS delta_pct FROM bd0)"""


@query("baseline_delta", f"WITH {DELTA} SELECT * FROM bd", "baseline_loss recent_loss delta_pct")
def _(t):
    return P.baseline_delta(P.monthly_category_loss(facts(t)))


@query(
    "sku_triage_queue",
    f"""WITH {SCOPE},
le AS (SELECT product_id, MAX(order_date) AS last_event_date FROM facts GROUP BY product_id),
q0 AS (SELECT sc.product_id, product_name, category, risk_tier, risk_score, estimated_loss, times_reported_missing,
  last_event_date, GREATEST(COALESCE(CAST(DATE '{REFERENCE_DATE}' - last_event_date AS INTEGER), 999), 0) AS recency_days,
  (RANK() OVER (ORDER BY estimated_loss) + (COUNT(*) OVER (PARTITION BY estimated_loss) - 1) / 2.0)
    / COUNT(*) OVER () * 100.0 AS loss_percentile,
  estimated_loss >= (SELECT QUANTILE_CONT(estimated_loss, 0.9) FROM sc) AND estimated_loss > 0 AS top_decile_flag,
  COALESCE(STRFTIME(last_event_date, '%Y-%m-%d'), 'No events') AS last_event_label
  FROM sc LEFT JOIN le USING (product_id)),
q1 AS (SELECT *, LEAST(GREATEST(100.0 - recency_days * 3.33, 0), 100) AS recency_score FROM q0),
q2 AS (SELECT *, LEAST(GREATEST(risk_score * 0.6 + loss_percentile * 0.25 + recency_score * 0.15, 0), 100)
  AS priority_score FROM q1),
q3 AS (SELECT *, CASE WHEN priority_score >= 80 THEN 'Immediate' WHEN priority_score >= 60 THEN 'Fast Track'
  WHEN priority_score >= 40 THEN 'Review' ELSE 'Monitor' END AS priority_tier FROM q2)
SELECT *, CASE priority_tier WHEN 'Immediate' THEN '4h' WHEN 'Fast Track' THEN '12h' WHEN 'Review' THEN '24h'
  ELSE '48h' END AS sla_target FROM q3""",
    "risk_score estimated_loss loss_percentile recency_score priority_score",
)
def _(t):
    return P.sku_triage_queue(scope(t), facts(t), REFERENCE_DATE)


@query(
    "margin_loss_frame",
    f"""WITH {SCOPE}
SELECT product_id, product_name, category, estimated_loss, times_reported_missing, risk_score, 22.0 AS margin_pct,
  10.0 + (times_reported_missing - MIN(times_reported_missing) OVER ()) * 24.0
    / (MAX(times_reported_missing) OVER () - MIN(times_reported_missing) OVER ()) AS bubble_size
FROM sc WHERE estimated_loss > 0""",
    "estimated_loss risk_score margin_pct bubble_size",
)
def _(t):
    return P.margin_loss_frame(scope(t))


@query(
    "category_accuracy_proxy",
    f"""WITH {CATEGORY_SCOPE}, {PERFORMANCE}
SELECT category, estimated_loss, LEAST(GREATEST(LEAST(GREATEST(86.0 - ABS(rate_change_pct) * 0.1, 72), 94)
  - (estimated_loss - (SELECT AVG(estimated_loss) FROM cg)) / (SELECT STDDEV_SAMP(estimated_loss) FROM cg) * 2.5, 65), 96)
  AS model_accuracy_proxy FROM cg, perf""",
    "estimated_loss model_accuracy_proxy",
)
def _(t):
    drift = DR.drift_by_halves(t.orders)
    proxy = P.category_accuracy_proxy(categories(t), DR.half_performance(t.orders), drift)
    return proxy.drop("drift_status")


@query(
    "segment_risk_matrix",
    f"""WITH {CUSTOMER_SUMMARY}
SELECT spending_segment, """
    + ", ".join(
        f"COUNT(CASE WHEN risk_category = '{c}' THEN 1 END) AS \"{c}\"" for c in ("Low", "Medium", "High", "Critical")
    )
    + " FROM facts JOIN cs USING (customer_id) GROUP BY spending_segment",
)
def _(t):
    return P.segment_risk_matrix(facts(t), C.customer_summary(t.customers, t.orders))


@query(
    "customer_exposure",
    f"""WITH {SCOPE}, {CUSTOMER_SUMMARY},
rk AS (SELECT product_id FROM sc WHERE CASE WHEN (SELECT COUNT(*) FROM sc WHERE risk_tier IN ('High', 'Critical')) > 0
  THEN risk_tier IN ('High', 'Critical') ELSE risk_score >= (SELECT QUANTILE_CONT(risk_score, 0.8) FROM sc) END)
SELECT product_name, COUNT(CASE WHEN risk_category IN ('High', 'Critical') THEN 1 END) * 100.0 / COUNT(*)
  AS critical_customer_share, COUNT(DISTINCT customer_id) AS unique_customers, SUM(price) AS estimated_loss
FROM facts LEFT JOIN cs USING (customer_id) WHERE product_id IN (SELECT product_id FROM rk)
GROUP BY product_name ORDER BY critical_customer_share DESC, product_name LIMIT 12""",
    "critical_customer_share estimated_loss",
)
def _(t):
    return P.customer_exposure(facts(t), C.customer_summary(t.customers, t.orders), scope(t))


def _top(n):
    return (
        f"tp AS (SELECT product_id FROM sc ORDER BY estimated_loss DESC, times_reported_missing DESC, product_id LIMIT {n})"
    )


@query(
    "product_region_loss",
    f"""WITH {SCOPE}, {_top(5)}
SELECT region, product_id, product_name, SUM(price) AS estimated_loss, COUNT(*) AS missing_events FROM facts
WHERE product_id IN (SELECT product_id FROM tp) GROUP BY 1, 2, 3""",
    "estimated_loss",
)
def _(t):
    return P.product_region_loss(facts(t), scope(t))


@query(
    "category_roi",
    f"""WITH {CATEGORY_SCOPE}
SELECT category, replacement_cost, prevention_cost, prevention_roi,
  replacement_cost - prevention_cost AS potential_savings_usd,
  (replacement_cost - prevention_cost) / replacement_cost * 100.0 AS potential_savings_pct,
  replacement_cost >= prevention_cost * 1.5 AS opportunity_flag FROM cg""",
    "replacement_cost prevention_cost prevention_roi potential_savings_usd potential_savings_pct",
)
def _(t):
    return P.category_roi(categories(t))


@query(
    "insights",
    f"""WITH {CATEGORY_SCOPE}, {DELTA}, {SUMMARY}
SELECT 'top_category' AS insight, category AS subject,
  estimated_loss / (SELECT SUM(estimated_loss) FROM sc) * 100.0 AS value
FROM (SELECT * FROM cg ORDER BY estimated_loss DESC, category LIMIT 1)
UNION ALL SELECT 'top_product', product_name, risk_score
FROM (SELECT * FROM sc ORDER BY estimated_loss DESC, times_reported_missing DESC, product_id LIMIT 1)
UNION ALL SELECT 'temporal_anomalies', worst_day, CAST(anomalies_total AS DOUBLE) FROM ts WHERE anomalies_total > 0
UNION ALL SELECT 'baseline_delta', 'loss', delta_pct FROM bd""",
    "value",
)
def _(t):
    delta = P.baseline_delta(P.monthly_category_loss(facts(t)))
    return P.insights(scope(t), categories(t), delta, T.temporal_summary(t.orders))


@query(
    "recommendations",
    f"""WITH {CATEGORY_SCOPE}, {FORECAST}
SELECT 'Strengthen delivery proof for top 10 highest-risk SKUs' AS action, COALESCE((SELECT SUM(estimated_loss) FROM sc
  WHERE risk_tier IN ('High', 'Critical')), 0.0) * 0.28 AS impact_usd, 'Medium' AS effort
UNION ALL SELECT 'Review operational process for ' || category || ' category', estimated_loss * 0.22, 'Low'
FROM (SELECT * FROM cg ORDER BY estimated_loss DESC, category LIMIT 1)
UNION ALL SELECT 'Activate enhanced surveillance for regional clusters + high-risk customers', projected_loss * 0.16, 'High'
FROM fc WHERE horizon_days = 90""",
    "impact_usd",
)
def _(t):
    return P.recommendations(scope(t), categories(t), forecast(t))


@query(
    "product_weekday_heatmap",
    f"WITH {SCOPE}, {_top(12)} SELECT product_name, "
    + ", ".join(f"COUNT(CASE WHEN STRFTIME(order_date, '%A') = '{d}' THEN 1 END) AS \"{d}\"" for d in P.WEEKDAYS)
    + " FROM facts WHERE product_id IN (SELECT product_id FROM tp) GROUP BY product_name",
)
def _(t):
    return P.product_weekday_heatmap(facts(t), scope(t))


@query(
    "product_kpis",
    f"""WITH {SCOPE}, {FORECAST},
k AS (SELECT CAST(SUM(times_reported_missing) AS BIGINT) AS total_units_missing, SUM(estimated_loss) AS total_estimated_loss,
  COUNT(CASE WHEN risk_score >= 60 THEN 1 END) AS high_risk_skus, SUM(margin_loss) AS margin_at_risk,
  SUM(opportunity_cost) AS opportunity_cost, (SELECT projected_loss FROM fc WHERE horizon_days = 90) AS forecast_90,
  (SELECT {MONEY} FROM (SELECT DISTINCT order_id, order_amount FROM facts)) AS scoped_revenue,
  (SELECT QUANTILE_CONT(price, 0.5) FROM sc WHERE times_reported_missing > 0) AS median_price,
  (SELECT QUANTILE_CONT(CAST(times_reported_missing AS DOUBLE), 0.5) FROM sc WHERE times_reported_missing > 0)
    AS median_frequency FROM sc)
SELECT *, total_estimated_loss / scoped_revenue * 100.0 AS loss_pct_revenue FROM k""",
    "total_estimated_loss margin_at_risk opportunity_cost forecast_90 scoped_revenue median_price median_frequency "
    "loss_pct_revenue",
)
def _(t):
    return P.product_kpis(scope(t), facts(t), forecast(t))


@query(
    "loss_hierarchy",
    f"""WITH {SCOPE}
SELECT category, price_band, product_name, CAST(GROUPING(category, price_band, product_name) AS INTEGER) AS level,
  SUM(estimated_loss) AS estimated_loss, AVG(risk_score) AS avg_risk_score FROM sc WHERE estimated_loss > 0
GROUP BY ROLLUP (category, price_band, product_name)""",
    "estimated_loss avg_risk_score",
)
def _(t):
    return P.loss_hierarchy(scope(t))
