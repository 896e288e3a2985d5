"""Feature, scope and scalar queries F-1 to F-10 and SC-1 to SC-7."""

from pyspark.sql import functions as F

from deliveryrisk.functions import scalar as S
from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drivers as D
from deliveryrisk.operators import features as O
from deliveryrisk.operators import products as P
from deliveryrisk.operators import regions as G
from deliveryrisk.operators import scope
from deliveryrisk.plans.registry import query, sql_rate, sql_round
from deliveryrisk.plans.sqlparts import (
    CUSTOMER_WORKSPACE,
    CW_DOUBLES,
    DRIVER_RISK,
    GEO,
    GEO_DOUBLES,
    PERIOD_CLOCK,
    PERIOD_CUT,
)

RATE = sql_rate("items_missing", "items_delivered")

ORDER_FEATURES = f"""of AS (SELECT ord.*, items_delivered + items_missing AS total_items, {RATE} AS missing_rate,
  order_amount > (SELECT QUANTILE_CONT(order_amount, 0.75) FROM ord) AS is_high_value,
  {PERIOD_CUT} AS delivery_period, STRFTIME(order_date, '%A') AS day_of_week,
  EXTRACT(ISODOW FROM order_date) >= 6 AS is_weekend, CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS month,
  CAST(EXTRACT(WEEK FROM order_date) AS INTEGER) AS week_of_year,
  CASE WHEN items_delivered + items_missing <= 5 THEN 'Small' WHEN items_delivered + items_missing <= 10 THEN 'Medium'
    ELSE 'Large' END AS order_size, items_missing > 0 AS has_missing FROM ord)"""


@query("order_features", f"WITH {ORDER_FEATURES} SELECT * FROM of", "order_amount missing_rate")
def _(t):
    return O.order_features(t.orders)


@query(
    "temporal_features",
    f"""SELECT ord.*, delivery_hour AS hour, {PERIOD_CUT} AS period, STRFTIME(order_date, '%A') AS day_of_week,
  CAST(EXTRACT(ISODOW FROM order_date) - 1 AS INTEGER) AS day_of_week_num,
  EXTRACT(ISODOW FROM order_date) >= 6 AS is_weekend, CAST(EXTRACT(WEEK FROM order_date) AS INTEGER) AS week_of_year,
  CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS month, STRFTIME(order_date, '%B') AS month_name,
  CAST(EXTRACT(DAY FROM order_date) AS INTEGER) AS day_of_month, EXTRACT(DAY FROM order_date) <= 7 AS is_month_start,
  EXTRACT(DAY FROM order_date) >= 24 AS is_month_end, CAST(EXTRACT(QUARTER FROM order_date) AS INTEGER) AS quarter
FROM ord""",
    "order_amount",
)
def _(t):
    return O.temporal_features(t.orders)


@query(
    "orders_enriched",
    f"""SELECT ord.*, items_delivered + items_missing AS total_items, {RATE} AS missing_rate,
  items_missing > 0 AS has_missing, CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS month,
  STRFTIME(order_date, '%B') AS month_name, STRFTIME(order_date, '%A') AS day_of_week,
  CAST(EXTRACT(ISODOW FROM order_date) - 1 AS INTEGER) AS day_of_week_num FROM ord""",
    "order_amount missing_rate",
)
def _(t):
    return O.orders_enriched(t.orders)


@query(
    "orders_full",
    f"""SELECT order_id, order_date, order_amount, region AS region_name, items_delivered, items_missing, delivery_hour,
  o.driver_id, driver_name, age AS driver_age, trips AS driver_total_trips, o.customer_id, customer_name, customer_age,
  CAST(EXTRACT(YEAR FROM order_date) AS INTEGER) AS order_year,
  CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS order_month,
  CAST(EXTRACT(DOW FROM order_date) AS INTEGER) AS day_of_week, STRFTIME(order_date, '%A') AS day_name,
  {PERIOD_CLOCK} AS delivery_period, items_missing > 0 AS has_missing_items,
  ROUND(items_missing / CAST(NULLIF(items_delivered, 0) AS DOUBLE) * 100.0, 2) AS missing_rate_pct,
  {sql_round('order_amount / NULLIF(items_delivered, 0)', 2)} AS avg_item_value
FROM ord o JOIN drv d USING (driver_id) JOIN cus c USING (customer_id) WHERE region IS NOT NULL""",
    "order_amount missing_rate_pct avg_item_value",
)
def _(t):
    return O.orders_full(t.orders, t.drivers, t.customers)


@query(
    "missing_items_full",
    """SELECT m.missing_item_id, m.order_id, m.item_position, m.product_id, p.product_name,
  p.category AS product_category, p.price AS product_price, o.order_date, o.order_amount, o.region AS region_name,
  o.driver_id, d.driver_name, o.customer_id, c.customer_name
FROM mis m JOIN prd p USING (product_id) JOIN ord o USING (order_id) JOIN drv d USING (driver_id)
  JOIN cus c USING (customer_id) WHERE o.region IS NOT NULL""",
    "product_price order_amount",
)
def _(t):
    return O.missing_items_full(t.positioned_items, t.products, t.orders, t.drivers, t.customers)


@query(
    "bucketize_bands",
    """SELECT product_id, price,
  CASE WHEN price <= 920 THEN 'Very Low' WHEN price <= 940 THEN 'Low' WHEN price <= 960 THEN 'Medium'
       WHEN price <= 980 THEN 'High' ELSE 'Premium' END AS price_category,
  CASE WHEN price < 920 THEN 'Very Low' WHEN price < 940 THEN 'Low' WHEN price < 960 THEN 'Medium'
       WHEN price < 980 THEN 'High' ELSE 'Premium' END AS price_category_left,
  CAST(CASE WHEN price <= 920 THEN 1 WHEN price <= 940 THEN 2 WHEN price <= 960 THEN 3
       WHEN price <= 980 THEN 4 ELSE 5 END AS INTEGER) AS price_rank FROM prd""",
    "price",
)
def _(t):
    edges, labels = [-1, 920, 940, 960, 980, None], ["Very Low", "Low", "Medium", "High", "Premium"]
    return t.products.select(
        "product_id",
        "price",
        S.bucketize("price", edges, labels).alias("price_category"),
        S.bucketize("price", edges, labels, right=False).alias("price_category_left"),
        S.band_rank(S.bucketize("price", edges, labels), labels).alias("price_rank"),
    )


@query(
    "price_segment",
    """SELECT product_id, CASE WHEN price < 20 THEN 'Budget (<$20)' WHEN price < 50 THEN 'Mid-Range ($20-$50)'
  WHEN price < 100 THEN 'Premium ($50-$100)' ELSE 'High-Value ($100+)' END AS segment,
  CASE WHEN price < 925 THEN 'Budget (<$925)' WHEN price < 950 THEN 'Mid-Range ($925-$950)'
  WHEN price < 975 THEN 'Premium ($950-$975)' ELSE 'High-Value ($975+)' END AS segment_900 FROM prd""",
)
def _(t):
    return t.products.select(
        "product_id",
        S.price_segment("price").alias("segment"),
        S.price_segment("price", (925, 950, 975)).alias("segment_900"),
    )


@query(
    "delivery_period",
    f"""SELECT delivery_hour, {PERIOD_CLOCK} AS clock_period, {PERIOD_CUT} AS cut_period, COUNT(*) AS orders
FROM ord GROUP BY delivery_hour""",
)
def _(t):
    return (
        t.orders.groupBy("delivery_hour")
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumns(
            {
                "clock_period": S.delivery_period("delivery_hour"),
                "cut_period": S.delivery_period("delivery_hour", "cut"),
            }
        )
    )


@query(
    "normalizers",
    """WITH b AS (SELECT MIN(price) AS lo, MAX(price) AS hi, AVG(price) AS m FROM prd)
SELECT product_id, (price - lo) / (hi - lo) AS unit_scale, price / hi * 100.0 AS max_scaled,
  price / m AS ratio_to_mean, (price - m) / m * 100.0 AS pct_vs_mean, LEAST(GREATEST(price, 910.0), 990.0) AS clipped
FROM prd, b""",
    "unit_scale max_scaled ratio_to_mean pct_vs_mean clipped",
)
def _(t):
    s = S.Scalars(t.products, lo=F.min("price"), hi=F.max("price"), m=F.avg("price"))
    return s.attach(t.products).select(
        "product_id",
        S.min_max("price", s.lo, s.hi, 0.5).alias("unit_scale"),
        S.max_scale("price", s.hi).alias("max_scaled"),
        S.safe_ratio("price", s.m).alias("ratio_to_mean"),
        S.pct_change_safe("price", s.m).alias("pct_vs_mean"),
        S.clip("price", 910, 990).alias("clipped"),
    )


@query(
    "risk_band",
    f"""WITH {DRIVER_RISK}
SELECT driver_id, risk_category AS cut_band, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High'
  WHEN risk_score >= 25 THEN 'Medium' ELSE 'Low' END AS threshold_band, risk_score >= 75 AS is_critical,
  risk_score >= 50 AS is_high, risk_score >= 25 AS is_medium, risk_score >= 70 AS is_alert,
  risk_score BETWEEN 0 AND 100 AS is_valid_score FROM dr""",
)
def _(t):
    scored = D.driver_risk_scores(D.driver_features(t.drivers, t.orders))
    return scored.select(
        "driver_id",
        S.risk_band("risk_score").alias("cut_band"),
        S.risk_band("risk_score", "threshold").alias("threshold_band"),
        *[c.alias(n) for n, c in S.risk_predicates("risk_score").items()],
    )


@query(
    "apply_filters",
    """SELECT * FROM ord WHERE order_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
  AND region IN ('ASIA', 'EUROPE') AND LOWER(region) LIKE '%euro%'""",
    "order_amount",
)
def _(t):
    return scope.apply_filters(
        t.orders, ("1995-01-01", "1996-12-31"), ["ASIA", "EUROPE"], "Euro", ["region", "order_id"]
    )


@query(
    "filter_customers",
    f"""WITH {CUSTOMER_WORKSPACE}
SELECT * FROM cw WHERE risk_category IN ('High', 'Critical') AND spending_segment = 'Premium' AND priority_score >= 40
  AND total_orders >= 2 AND orders_with_claims >= 2
  AND (LOWER(customer_name) LIKE '%12%' OR CAST(customer_id AS VARCHAR) LIKE '%12%')""",
    CW_DOUBLES,
)
def _(t):
    return scope.filter_customers(
        C.customer_workspace(t.customers, t.orders), ["High", "Critical"], "Premium", 40, 2, True, "12"
    )


@query(
    "filter_sort_regions",
    f"WITH {GEO} SELECT * FROM geo WHERE LOWER(region) LIKE '%a%' AND risk_tier IN ('Critical', 'High', 'Medium')",
    GEO_DOUBLES,
)
def _(t):
    geo = G.geo_dataset(G.regional_summary(t.orders))
    return scope.filter_sort_regions(geo, "a", ["Critical", "High", "Medium"], "Revenue Share (Highest)")


@query(
    "scope_orders_by_product",
    """SELECT * FROM ord WHERE order_id IN (SELECT order_id FROM mis JOIN prd USING (product_id)
  WHERE category = 'ECONOMY')""",
    "order_amount",
)
def _(t):
    return scope.scope_orders_by_product(t.orders, t.missing_items, t.products, "ECONOMY")


@query(
    "summary_table",
    """SELECT region, SUM(order_amount) AS order_amount_sum, AVG(order_amount) AS order_amount_mean,
  MAX(items_missing) AS items_missing_max, COUNT(DISTINCT driver_id) AS driver_id_nunique FROM ord GROUP BY region""",
    "order_amount_sum order_amount_mean",
)
def _(t):
    aggs = {"order_amount": ["sum", "mean"], "items_missing": ["max"], "driver_id": ["nunique"]}
    return scope.summary_table(t.orders, "region", aggs, "order_amount_sum")


@query(
    "scope_facts",
    """SELECT category, COUNT(*) AS events, SUM(price) AS loss FROM facts
WHERE category IN ('ECONOMY', 'PROMO') AND order_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY category""",
    "loss",
)
def _(t):
    facts = P.missing_facts(t.missing_items, t.orders, t.products)
    return (
        scope.scope_facts(facts, ["ECONOMY", "PROMO"], "1996-01-01", "1997-12-31")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("price").alias("loss"))
    )


@query(
    "high_risk_orders",
    f"""WITH {ORDER_FEATURES} SELECT * FROM of WHERE missing_rate >= 50
  OR (has_missing AND order_amount >= (SELECT QUANTILE_CONT(order_amount, 0.5) FROM ord))""",
    "order_amount missing_rate",
)
def _(t):
    return scope.high_risk_orders(O.order_features(t.orders))
