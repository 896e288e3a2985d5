"""Overview queries A-1 to A-10."""

from deliveryrisk.functions.scalar import bucketize
from deliveryrisk.config import CUSTOMER_AGE_EDGES, CUSTOMER_AGE_LABELS, DRIVER_AGE_EDGES, DRIVER_AGE_LABELS
from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drivers as D
from deliveryrisk.operators import overview as A
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import CUSTOMER_AGE, CUSTOMER_SUMMARY, DRIVER_AGE, DRIVER_RISK, DRIVER_SUMMARY, SUMS

TOTALS = f"""tot0 AS (SELECT {SUMS} FROM ord),
tot AS (SELECT *, {sql_rate('total_items_missing', 'total_items_delivered')} AS overall_missing_rate,
  CAST(orders_with_missing AS DOUBLE) / total_orders * 100.0 AS pct_orders_with_missing FROM tot0)"""
T_DOUBLES = "total_revenue avg_order_value overall_missing_rate pct_orders_with_missing"
STATS = f"""{TOTALS},
st AS (SELECT tot.*, (SELECT COUNT(*) FROM drv) AS total_drivers, (SELECT COUNT(DISTINCT driver_id) FROM ord)
  AS active_drivers, (SELECT COUNT(*) FROM cus) AS total_customers, (SELECT COUNT(DISTINCT customer_id) FROM ord)
  AS active_customers, (SELECT COUNT(DISTINCT region) FROM ord) AS total_regions,
  (SELECT MIN(order_date) FROM ord) AS date_range_start, (SELECT MAX(order_date) FROM ord) AS date_range_end FROM tot)"""
OVERVIEW = f"""{STATS},
ovw AS (SELECT st.*, (SELECT QUANTILE_CONT(order_amount, 0.5) FROM ord) AS median_order_value,
  (SELECT MIN(order_amount) FROM ord) AS min_order_value, (SELECT MAX(order_amount) FROM ord) AS max_order_value,
  total_items_delivered + total_items_missing AS total_items_ordered,
  CAST(total_items_missing * 15.0 AS DOUBLE) AS estimated_loss FROM st)"""


def overview(t):
    return A.overview_metrics(t.orders, t.drivers, t.customers)


@query("order_aggregations", f"WITH {TOTALS} SELECT * FROM tot", T_DOUBLES)
def _(t):
    return A.order_aggregations(t.orders)


@query("overall_statistics", f"WITH {STATS} SELECT * FROM st", T_DOUBLES)
def _(t):
    return A.overall_statistics(t.orders, t.drivers, t.customers)


@query(
    "overview_metrics",
    f"WITH {OVERVIEW} SELECT * FROM ovw",
    T_DOUBLES + " median_order_value min_order_value max_order_value estimated_loss",
)
def _(t):
    return overview(t)


@query(
    "fraud_summary",
    """WITH s AS (SELECT COUNT(*) AS total_orders, COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing,
  CAST(SUM(items_delivered) AS BIGINT) AS total_items_delivered, CAST(SUM(items_missing) AS BIGINT) AS total_items_missing,
  SUM(order_amount) AS total_order_value,
  (SELECT SUM(price) FROM mis JOIN prd USING (product_id)) AS total_missing_value FROM ord)
SELECT s.*, ROUND(orders_with_missing / CAST(total_orders AS DOUBLE) * 100.0, 2) AS overall_missing_order_rate_pct,
  ROUND(total_items_missing / CAST(total_items_delivered AS DOUBLE) * 100.0, 2) AS overall_missing_item_rate_pct,
  ROUND(total_missing_value / total_order_value * 100.0, 2) AS overall_missing_value_rate_pct,
  (SELECT COUNT(*) FROM drv) AS total_drivers, (SELECT COUNT(*) FROM cus) AS total_customers,
  (SELECT COUNT(*) FROM prd) AS total_products, (SELECT COUNT(*) FROM reg) AS total_regions FROM s""",
    "total_order_value total_missing_value overall_missing_order_rate_pct overall_missing_item_rate_pct "
    "overall_missing_value_rate_pct",
)
def _(t):
    return A.fraud_summary(t.orders, t.missing_items, t.products, t.drivers, t.customers, t.regions)


def _describe(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS nulls,
  CAST(SUM({c}) AS DOUBLE) AS total, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
  CAST(MAX({c}) AS DOUBLE) AS max, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS q1,
  QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS median, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {table}"""
        for c in columns
    )


DESC = "total mean std min max q1 median q3"


@query("describe_orders", _describe("ord", ["order_amount", "items_delivered", "items_missing"]), DESC)
def _(t):
    return A.describe_orders(t.orders)


@query("describe_drivers", _describe("drv", ["age", "trips"]), DESC)
def _(t):
    return A.describe_columns(t.drivers, ["age", "trips"])


@query("describe_customers", _describe("cus", ["customer_age"]), DESC)
def _(t):
    return A.describe_columns(t.customers, ["customer_age"])


@query("describe_products", _describe("prd", ["price"]), DESC)
def _(t):
    return A.describe_columns(t.products, ["price"])


@query("describe_order_regions", "SELECT region, COUNT(*) AS n FROM ord GROUP BY region")
def _(t):
    return A.value_counts(t.orders, "region")


@query("describe_driver_ages", f"SELECT {DRIVER_AGE} AS age_group, COUNT(*) AS n FROM drv GROUP BY 1")
def _(t):
    return A.value_counts(
        t.drivers.select(bucketize("age", DRIVER_AGE_EDGES, DRIVER_AGE_LABELS).alias("age_group")), "age_group"
    )


@query("describe_customer_ages", f"SELECT {CUSTOMER_AGE} AS age_group, COUNT(*) AS n FROM cus GROUP BY 1")
def _(t):
    return A.value_counts(
        t.customers.select(bucketize("customer_age", CUSTOMER_AGE_EDGES, CUSTOMER_AGE_LABELS).alias("age_group")),
        "age_group",
    )


@query(
    "describe_price_by_category",
    """SELECT category, AVG(price) AS mean, MIN(price) AS min, MAX(price) AS max, QUANTILE_CONT(price, 0.5) AS median
FROM prd GROUP BY category""",
    "mean min max median",
)
def _(t):
    return A.price_by_category(t.products)


@query(
    "percentile_table",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS INTEGER) AS percentile, QUANTILE_CONT(order_amount, {p / 100}) AS value FROM ord"
        for p in A.PERCENTILES
    ),
    "value",
)
def _(t):
    return A.percentile_table(t.orders)


@query(
    "fraud_loss_metrics",
    f"""WITH {TOTALS}
SELECT tot.*, (SELECT AVG(price) FROM prd) AS avg_product_price,
  total_items_missing * (SELECT AVG(price) FROM prd) AS estimated_loss FROM tot""",
    T_DOUBLES + " avg_product_price estimated_loss",
)
def _(t):
    return A.fraud_loss_metrics(t.orders, t.products)


@query(
    "business_impact",
    f"""WITH {OVERVIEW}
SELECT 6500000000 * 0.53 AS national_context, estimated_loss * 12.0 AS projected_annual_loss,
  estimated_loss * 12.0 * 0.25 AS potential_savings, 25.0 AS target_reduction_pct FROM ovw""",
    "national_context projected_annual_loss potential_savings target_reduction_pct",
)
def _(t):
    return A.business_impact(overview(t))


@query(
    "monitoring_kpis",
    f"""WITH {OVERVIEW}, {DRIVER_SUMMARY}, {CUSTOMER_SUMMARY}
SELECT estimated_loss AS fraud_exposure, overall_missing_rate AS missing_rate,
  (SELECT COUNT(*) FROM ds WHERE risk_category = 'Critical') + (SELECT COUNT(*) FROM cs WHERE risk_category = 'Critical')
    AS high_risk_entities, estimated_loss / 12.0 * 0.4 * 0.7 AS monthly_savings FROM ovw""",
    "fraud_exposure missing_rate monthly_savings",
)
def _(t):
    return A.monitoring_kpis(
        overview(t), D.driver_summary(t.drivers, t.orders), C.customer_summary(t.customers, t.orders)
    )


for _name, _band in (("savings_without_critical", "Critical"), ("savings_without_high", "High")):

    @query(
        _name,
        f"""WITH {DRIVER_RISK},
a AS (SELECT CAST(SUM(items_missing) AS BIGINT) AS m, CAST(SUM(items_delivered) AS BIGINT) AS d FROM ord),
b AS (SELECT CAST(SUM(items_missing) AS BIGINT) AS m, CAST(SUM(items_delivered) AS BIGINT) AS d FROM ord WHERE driver_id NOT IN
  (SELECT driver_id FROM dr WHERE risk_category = '{_band}' AND total_orders > 0))
SELECT a.m AS total_missing, a.m + a.d AS total_items, {sql_rate('a.m', 'a.d')} AS missing_rate,
  {sql_rate('b.m', 'b.d')} AS optimized_rate,
  GREATEST({sql_rate('a.m', 'a.d')} - {sql_rate('b.m', 'b.d')}, 0.0) / 100.0 * (a.m + a.d) * 15.0 AS savings_proxy FROM a, b""",
        "missing_rate optimized_rate savings_proxy",
    )
    def _(t, band=_band):
        return A.savings_without_critical(t.orders, D.driver_snapshot(t.drivers, t.orders), band)
