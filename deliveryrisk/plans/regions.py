"""Region queries G-1 to G-13."""

from deliveryrisk.operators import regions as G
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import GEO, GEO_DOUBLES, MONEY, ORDER_VALUE, REGIONAL, RP_DOUBLES, RS_DOUBLES


def regional(t):
    return G.regional_performance(t.orders)


def geo(t):
    return G.geo_dataset(G.regional_summary(t.orders))


@query("regional_performance", f"WITH {REGIONAL} SELECT * FROM rp", RP_DOUBLES)
def _(t):
    return regional(t)


for _name, _metric in (("compare_regions", "missing_rate"), ("compare_regions_avg_value", "avg_order_value")):

    @query(
        _name,
        f"""WITH {REGIONAL}, s AS (SELECT AVG({_metric}) AS m, STDDEV_SAMP({_metric}) AS sd FROM rp)
SELECT rp.*, {_metric} - m AS vs_avg, ({_metric} - m) / m * 100.0 AS vs_avg_pct, ({_metric} - m) / sd AS z_score,
  {_metric} > m AS is_above_avg, ABS(({_metric} - m) / sd) > 2 AS is_outlier FROM rp, s""",
        RP_DOUBLES + " vs_avg vs_avg_pct z_score",
    )
    def _(t, metric=_metric):
        return G.compare_regions(regional(t), metric)


@query(
    "region_comparison_stats",
    f"""WITH {REGIONAL}
SELECT AVG(missing_rate) AS average, STDDEV_SAMP(missing_rate) AS std, MIN(missing_rate) AS min, MAX(missing_rate) AS max,
  (SELECT region FROM rp ORDER BY missing_rate, region LIMIT 1) AS best_region,
  (SELECT region FROM rp ORDER BY missing_rate DESC, region LIMIT 1) AS worst_region FROM rp""",
    "average std min max",
)
def _(t):
    return G.region_comparison_stats(regional(t))


@query(
    "regional_drivers",
    f"""WITH g AS (SELECT region, driver_id, COUNT(*) AS orders_in_region, CAST(SUM(items_missing) AS BIGINT) AS items_missing,
  CAST(SUM(items_delivered) AS BIGINT) AS items_delivered FROM ord GROUP BY region, driver_id)
SELECT g.*, items_missing + items_delivered AS total_items, {sql_rate('items_missing', 'items_delivered')} AS missing_rate,
  driver_name, age, trips FROM g LEFT JOIN drv USING (driver_id)""",
    "missing_rate",
)
def _(t):
    return G.regional_drivers(t.orders, t.drivers)


@query(
    "regional_hotspots",
    f"WITH {REGIONAL} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, region, CAST({c} AS DOUBLE) AS value FROM rp "
        f"WHERE {c} >= (SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) FROM rp)"
        for k, c in (
            ("high_missing_rate", "missing_rate"),
            ("high_volume_missing", "items_missing"),
            ("low_driver_coverage", "orders_per_driver"),
        )
    ),
    "value",
)
def _(t):
    return G.regional_hotspots(regional(t))


@query(
    "regional_monthly",
    f"""SELECT region, CAST(EXTRACT(MONTH FROM order_date) AS INTEGER) AS month, COUNT(*) AS orders,
  CAST(SUM(items_missing) AS BIGINT) AS items_missing, CAST(SUM(items_delivered) AS BIGINT) AS items_delivered,
  CAST(SUM(items_missing + items_delivered) AS BIGINT) AS total_items,
  {sql_rate('SUM(items_missing)', 'SUM(items_delivered)')} AS missing_rate FROM ord GROUP BY 1, 2""",
    "missing_rate",
)
def _(t):
    return G.regional_monthly(t.orders)


@query(
    "regional_extremes",
    f"""WITH {REGIONAL}
SELECT * FROM (SELECT 'best' AS side, region, missing_rate, total_orders FROM rp ORDER BY missing_rate, region LIMIT 3)
UNION ALL
SELECT * FROM (SELECT 'worst' AS side, region, missing_rate, total_orders FROM rp
               ORDER BY missing_rate DESC, region LIMIT 3)""",
    "missing_rate",
)
def _(t):
    return G.regional_extremes(regional(t))


@query(
    "regional_statistics",
    f"""WITH {REGIONAL}
SELECT COUNT(*) AS total_regions, AVG(missing_rate) AS avg_missing_rate, STDDEV_SAMP(missing_rate) AS std_missing_rate,
  CAST(SUM(total_orders) AS BIGINT) AS total_orders, CAST(SUM(items_missing) AS BIGINT) AS total_missing_items FROM rp""",
    "avg_missing_rate std_missing_rate",
)
def _(t):
    return G.regional_statistics(regional(t))


@query(
    "region_fraud_metrics",
    f"""WITH {ORDER_VALUE},
a AS (SELECT region, COUNT(*) AS orders_count, COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing,
  CAST(SUM(items_delivered) AS BIGINT) AS total_items_delivered, CAST(SUM(items_missing) AS BIGINT) AS total_items_missing,
  {MONEY} AS total_order_value, COUNT(DISTINCT driver_id) AS unique_drivers,
  COUNT(DISTINCT customer_id) AS unique_customers FROM ord GROUP BY region),
v AS (SELECT region, SUM(v) AS total_missing_value FROM ord JOIN ov USING (order_id) GROUP BY region)
SELECT reg.region_id, reg.region_name, COALESCE(orders_count, 0) AS orders_count,
  COALESCE(orders_with_missing, 0) AS orders_with_missing, total_items_delivered, total_items_missing, total_order_value,
  COALESCE(unique_drivers, 0) AS unique_drivers, COALESCE(unique_customers, 0) AS unique_customers,
  COALESCE(total_missing_value, 0.0) AS total_missing_value,
  ROUND(orders_with_missing / CAST(orders_count AS DOUBLE) * 100.0, 2) AS missing_order_rate_pct,
  ROUND(total_items_missing / CAST(total_items_delivered AS DOUBLE) * 100.0, 2) AS missing_item_rate_pct,
  ROUND(COALESCE(total_missing_value, 0.0) / total_order_value * 100.0, 2) AS missing_value_rate_pct,
  ROUND(orders_count / CAST(unique_drivers AS DOUBLE), 2) AS orders_per_driver
FROM reg LEFT JOIN a ON a.region = reg.region_name LEFT JOIN v ON v.region = reg.region_name""",
    "total_order_value total_missing_value missing_order_rate_pct missing_item_rate_pct missing_value_rate_pct "
    "orders_per_driver",
)
def _(t):
    return G.region_fraud_metrics(t.regions, t.orders, t.missing_items, t.products)


@query(
    "regional_stats",
    f"""SELECT region, COUNT(*) AS total_orders, CAST(SUM(items_missing) AS BIGINT) AS total_items_missing,
  CAST(SUM(items_delivered) AS BIGINT) AS total_items_delivered, {MONEY} AS total_revenue,
  ROUND({MONEY} / COUNT(*), 2) AS avg_order_amount,
  ROUND({sql_rate('SUM(items_missing)', 'SUM(items_delivered)')}, 2) AS missing_rate_pct FROM ord GROUP BY region""",
    "total_revenue avg_order_amount missing_rate_pct",
)
def _(t):
    return G.regional_stats(t.orders)


@query("regional_summary", f"WITH {GEO} SELECT * FROM rs", RS_DOUBLES)
def _(t):
    return G.regional_summary(t.orders)


@query("geo_dataset", f"WITH {GEO} SELECT * FROM geo", GEO_DOUBLES)
def _(t):
    return geo(t)


@query(
    "regional_product_scope",
    f"""WITH po AS (SELECT order_id, COUNT(*) AS k FROM mis JOIN prd USING (product_id) WHERE category = 'PROMO' GROUP BY order_id),
g AS (SELECT region, COUNT(*) AS total_orders, {MONEY} AS total_revenue, CAST(SUM(k) AS BIGINT) AS items_missing,
  COUNT(*) AS orders_with_missing, CAST(SUM(items_delivered) AS BIGINT) AS d FROM ord JOIN po USING (order_id) GROUP BY region),
h AS (SELECT *, {sql_rate('items_missing', 'd')} AS missing_rate FROM g)
SELECT region, total_orders, total_revenue, items_missing, orders_with_missing, missing_rate,
  CAST(orders_with_missing AS DOUBLE) / total_orders * 100.0 AS pct_orders_with_missing,
  total_revenue / SUM(total_revenue) OVER () * 100.0 AS revenue_share,
  CAST(DENSE_RANK() OVER (ORDER BY missing_rate DESC) AS INTEGER) AS risk_rank FROM h""",
    "total_revenue missing_rate pct_orders_with_missing revenue_share",
)
def _(t):
    return G.regional_product_scope(t.orders, t.missing_items, t.products, "PROMO")


@query(
    "geo_kpis",
    f"""WITH {GEO}
SELECT COUNT(*) AS total_regions, AVG(missing_rate) AS avg_missing_rate,
  (SELECT region FROM geo ORDER BY missing_rate DESC, region LIMIT 1) AS worst_region,
  (SELECT region FROM geo ORDER BY missing_rate, region LIMIT 1) AS best_region,
  MAX(missing_rate) - MIN(missing_rate) AS spread, SUM(estimated_loss_usd) AS total_loss FROM geo""",
    "avg_missing_rate spread total_loss",
)
def _(t):
    return G.geo_kpis(geo(t))


@query(
    "regional_levels",
    f"""WITH {REGIONAL}, m AS (SELECT AVG(missing_rate) AS m FROM rp)
SELECT region, missing_rate, CASE WHEN missing_rate > m * 1.5 THEN 'Critical' WHEN missing_rate > m * 1.2 THEN 'High'
  WHEN missing_rate > m THEN 'Medium' ELSE 'Low' END AS risk_level
FROM rp, m ORDER BY missing_rate DESC, region LIMIT 5""",
    "missing_rate",
)
def _(t):
    return G.regional_levels(regional(t))
