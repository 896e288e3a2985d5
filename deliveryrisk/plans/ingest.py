"""Ingestion and quality queries I-1 to I-20 and DQ-1 to DQ-11.

Dirty raw text is derived from the given tables by rules on the key, so the
cleaned result can be checked against the tables themselves.
"""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import ensure_checkpoint_dir, materialize
from deliveryrisk.operators import contracts as X
from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drivers as D
from deliveryrisk.operators import overview as A
from deliveryrisk.operators import quality as Q
from deliveryrisk.operators import indicators as R
from deliveryrisk.operators import regions as G
from deliveryrisk.operators import temporal as TM
from deliveryrisk.plans.registry import query, sql_rate
from deliveryrisk.plans.sqlparts import CUSTOMER_SUMMARY, DRIVER_SUMMARY, MONEY
from deliveryrisk.sources import ingest as I

ORDER_RATE = sql_rate("SUM(items_missing)", "SUM(items_delivered)")


def padded(c):
    return F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" "))


def raw_orders(t):
    key = F.col("order_id")
    return t.orders.select(
        F.date_format("order_date", "yyyy-MM-dd").alias(" Date "),
        F.when(key % 97 == 0, "abc")
        .when(key % 101 == 0, " ")
        .otherwise(F.concat(F.lit("$"), F.format_number("order_amount", 2)))
        .alias("order_amount"),
        F.concat(F.lit(" "), F.col("region")).alias("region"),
        F.col("items_delivered").cast("string").alias("items_delivered"),
        F.when(key % 89 == 0, "x").otherwise(F.col("items_missing").cast("string")).alias("Items_Missing"),
        F.when(key % 83 == 0, "25:00:00")
        .otherwise(F.format_string("%02d:30:00", "delivery_hour"))
        .alias("delivery_hour"),
        padded("driver_id").alias("driver_id"),
        padded("customer_id").alias("customer_id"),
        padded("order_id").alias("order_id"),
    )


def raw_drivers(t):
    key = F.col("driver_id")
    return t.drivers.select(
        padded("driver_id").alias("driver_id"),
        padded("driver_name").alias("driver_name"),
        F.when(key % 7 == 0, "n/a").otherwise(F.col("age").cast("string")).alias("age"),
        F.when(key % 11 == 0, "?").otherwise(F.col("trips").cast("string")).alias("Trips"),
    )


def raw_customers(t):
    return t.customers.select(
        padded("customer_id").alias("customer_id"),
        padded("customer_name").alias("customer_name"),
        F.when(F.col("customer_id") % 13 == 0, "").otherwise(F.col("customer_age").cast("string")).alias("customer_age"),
    )


def raw_products(t):
    return t.products.select(
        padded("product_id").alias("produc_id"),
        padded("product_name").alias("product_name"),
        padded("category").alias("category"),
        F.concat(F.lit("$"), F.format_number("price", 2)).alias("price"),
    )


def scratch(t) -> str:
    """A new folder beside the checkpoints."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query(
    "read_raw",
    """SELECT '  ' || CAST(driver_id AS VARCHAR) || ' ' AS driver_id, '  ' || driver_name || ' ' AS driver_name,
  CASE WHEN driver_id % 7 = 0 THEN 'n/a' ELSE CAST(age AS VARCHAR) END AS age,
  CASE WHEN driver_id % 11 = 0 THEN '?' ELSE CAST(trips AS VARCHAR) END AS "Trips" FROM drv""",
)
def _(t):
    path = scratch(t)
    raw_drivers(t).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return I.read_raw(t.spark, path, "drivers")


def raw_missing_items(t):
    return I.pivot_missing_items(t.positioned_items)


RAW_TABLES = {
    "orders": raw_orders,
    "customers": raw_customers,
    "drivers": raw_drivers,
    "products": raw_products,
    "missing_items": raw_missing_items,
}


@query(
    "read_raw_all",
    """SELECT 'orders' AS table_name, COUNT(*) AS row_count, COUNT(*) * 9 AS filled_cells FROM ord
UNION ALL SELECT 'customers', COUNT(*), COUNT(*) * 3 - COUNT(CASE WHEN customer_id % 13 = 0 THEN 1 END) FROM cus
UNION ALL SELECT 'drivers', COUNT(*), COUNT(*) * 4 FROM drv
UNION ALL SELECT 'products', COUNT(*), COUNT(*) * 4 FROM prd
UNION ALL SELECT 'missing_items', COUNT(*), CAST(SUM(1 + LEAST(n, 3)) AS BIGINT)
  FROM (SELECT order_id, COUNT(*) AS n FROM mis GROUP BY order_id)""",
)
def _(t):
    folder, parts = scratch(t), []
    for name, build in RAW_TABLES.items():
        raw = build(t)
        raw = raw.select(*[F.col(f"`{c}`").cast("string").alias(c.strip().lower()) for c in raw.columns])
        raw.select(*I.RAW_COLUMNS[name]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(f"{folder}/{name}")
        back = I.read_raw(t.spark, f"{folder}/{name}", name)
        filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in back.columns), F.lit(0))
        parts.append(
            back.agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.coalesce(F.sum(filled), F.lit(0)).alias("filled_cells"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    "parse_currency",
    """SELECT order_id, CASE WHEN order_id % 97 = 0 OR order_id % 101 = 0 THEN NULL ELSE order_amount END AS amount FROM ord""",
    "amount",
)
def _(t):
    return raw_orders(t).select(
        F.trim("order_id").cast("long").alias("order_id"), I.parse_currency("order_amount").alias("amount")
    )


@query(
    "clean_orders",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, order_date,
  CASE WHEN order_id % 97 = 0 OR order_id % 101 = 0 THEN NULL ELSE order_amount END AS order_amount, region,
  CAST(items_delivered AS INTEGER) AS items_delivered,
  CAST(CASE WHEN order_id % 89 = 0 THEN 0 ELSE items_missing END AS INTEGER) AS items_missing,
  CASE WHEN order_id % 83 = 0 THEN NULL ELSE delivery_hour END AS delivery_hour,
  CAST(driver_id AS VARCHAR) AS driver_id, CAST(customer_id AS VARCHAR) AS customer_id FROM ord""",
    "order_amount",
)
def _(t):
    return I.clean_orders(raw_orders(t))


@query(
    "clean_customers",
    """SELECT CAST(customer_id AS VARCHAR) AS customer_id, customer_name,
  CASE WHEN customer_id % 13 = 0 THEN NULL ELSE customer_age END AS customer_age FROM cus""",
)
def _(t):
    return I.clean_customers(raw_customers(t))


@query(
    "clean_drivers",
    """SELECT CAST(driver_id AS VARCHAR) AS driver_id, driver_name, CASE WHEN driver_id % 7 = 0 THEN NULL ELSE age END AS age,
  CASE WHEN driver_id % 11 = 0 THEN 0 ELSE trips END AS trips FROM drv""",
)
def _(t):
    return I.clean_drivers(raw_drivers(t))


@query("clean_products", "SELECT CAST(product_id AS VARCHAR) AS product_id, product_name, category, price FROM prd", "price")
def _(t):
    return I.clean_products(raw_products(t))


WIDE = """wide AS (SELECT order_id, MAX(CASE WHEN item_position = 1 THEN product_id END) AS product_id_1,
  MAX(CASE WHEN item_position = 2 THEN product_id END) AS product_id_2,
  MAX(CASE WHEN item_position = 3 THEN product_id END) AS product_id_3 FROM mis GROUP BY order_id)"""


def wide(t):
    return I.pivot_missing_items(t.positioned_items)


@query("pivot_missing_items", f"WITH {WIDE} SELECT * FROM wide")
def _(t):
    return wide(t)


@query(
    "clean_missing_items",
    f"""WITH {WIDE} SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(product_id_1 AS VARCHAR) AS product_id_1,
  CAST(product_id_2 AS VARCHAR) AS product_id_2, CAST(product_id_3 AS VARCHAR) AS product_id_3 FROM wide""",
)
def _(t):
    return I.clean_missing_items(wide(t).select(*[padded(c).alias(c) for c in ["order_id", *I.ITEM_COLUMNS]]))


@query("unpivot_missing_items", "SELECT order_id, item_position, product_id FROM mis WHERE item_position <= 3")
def _(t):
    return I.unpivot_missing_items(wide(t))


@query(
    "missing_items_enriched",
    """SELECT m.missing_item_id, m.order_id, m.product_id, m.item_position, product_name, category, price AS product_price
FROM mis m LEFT JOIN prd USING (product_id)""",
    "product_price",
)
def _(t):
    return I.missing_items_enriched(t.positioned_items, t.products)


@query(
    "dedup_keep_first",
    """SELECT order_id, product_id, supplier_id, line_number FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id,
  l_suppkey AS supplier_id, l_linenumber AS line_number, ROW_NUMBER() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(t):
    lines = t.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").alias("line_number"),
    )
    return I.dedup_keep_first(lines, "order_id", [-F.col("line_number"), "product_id", "supplier_id"])


@query(
    "lookup_ids",
    """SELECT order_id, region, region_id FROM ord JOIN reg ON region = region_name WHERE region_id <> 4""",
)
def _(t):
    known, _unknown = I.lookup_ids(
        t.orders.select("order_id", "region"), t.regions.where("region_id <> 4"), "region", "region_name", "region_id"
    )
    return known


@query(
    "lookup_ids_unknown",
    "SELECT region, COUNT(*) AS row_count FROM ord WHERE region IN (SELECT region_name FROM reg WHERE region_id = 4) GROUP BY 1",
)
def _(t):
    _known, unknown = I.lookup_ids(
        t.orders.select("order_id", "region"), t.regions.where("region_id <> 4"), "region", "region_name", "region_id"
    )
    return unknown


@query(
    "semi_join_valid",
    "SELECT order_id, product_id FROM mis WHERE order_id % 3 <> 0 AND product_id % 5 <> 0",
)
def _(t):
    return I.semi_join_valid(
        t.missing_items,
        {"order_id": t.orders.where("order_id % 3 <> 0"), "product_id": t.products.where("product_id % 5 <> 0")},
    )


def _upsert(amount):
    return f"SELECT * REPLACE ({amount} AS order_amount) FROM ord"


for _mode, _amount in (
    ("update", "CASE WHEN order_id % 3 <> 1 THEN order_amount + 1 ELSE order_amount END"),
    ("nothing", "CASE WHEN order_id % 3 = 2 THEN order_amount + 1 ELSE order_amount END"),
):

    @query(f"upsert_orders_{_mode}", _upsert(_amount), "order_amount")
    def _(t, mode=_mode):
        current = t.orders.where("order_id % 3 <> 2")
        changes = t.orders.where("order_id % 3 <> 1").withColumn("order_amount", F.col("order_amount") + 1)
        return I.upsert_orders(current, changes, mode)


@query(
    "load_all",
    """SELECT 'drivers' AS table_name, COUNT(*) AS row_count FROM drv UNION ALL SELECT 'customers', COUNT(*) FROM cus
UNION ALL SELECT 'products', COUNT(*) FROM prd UNION ALL SELECT 'orders', COUNT(*) FROM ord
UNION ALL SELECT 'regions', COUNT(*) FROM reg UNION ALL SELECT 'missing_items', COUNT(*) FROM mis""",
)
def _(t):
    return I.load_all(all_tables(t), scratch(t))


def all_tables(t):
    return {
        "missing_items": t.missing_items,
        "orders": t.orders,
        "products": t.products,
        "customers": t.customers,
        "drivers": t.drivers,
        "regions": t.regions,
    }


@query(
    "load_log",
    """SELECT 'drivers' AS table_name, COUNT(*) AS row_count, 'SUCCESS' AS status FROM drv
UNION ALL SELECT 'customers', COUNT(*), 'SUCCESS' FROM cus UNION ALL SELECT 'products', COUNT(*), 'SUCCESS' FROM prd
UNION ALL SELECT 'orders', COUNT(*), 'SUCCESS' FROM ord UNION ALL SELECT 'regions', COUNT(*), 'SUCCESS' FROM reg
UNION ALL SELECT 'missing_items', COUNT(*), 'SUCCESS' FROM mis""",
)
def _(t):
    path = scratch(t)
    I.load_with_log(all_tables(t), f"{path}/data", f"{path}/log")
    return t.spark.read.schema(I.LOG_SCHEMA).parquet(f"{path}/log").select("table_name", "row_count", "status")


@query(
    "table_profile",
    """SELECT 'orders' AS table_name, TRUE AS found, CAST(6 AS INTEGER) AS column_count, COUNT(*) AS row_count FROM orders
UNION ALL SELECT 'part', TRUE, 6, COUNT(*) FROM part UNION ALL SELECT 'absent', FALSE, 0, NULL""",
)
def _(t):
    return I.table_profile(t.spark, {n: f"{t.path}/{n}.parquet" for n in ("orders", "part", "absent")})


@query(
    "summary_stats",
    f"""SELECT COUNT(*) AS total_orders, CAST(SUM(items_missing) AS BIGINT) AS sum_items_missing, {MONEY} AS total_order_value,
  MIN(order_date) AS min_date, MAX(order_date) AS max_date, (SELECT COUNT(*) FROM drv) AS total_drivers,
  (SELECT COUNT(*) FROM cus) AS total_customers, (SELECT COUNT(*) FROM prd) AS total_products,
  (SELECT COUNT(*) FROM mis) AS total_missing_items FROM ord""",
    "total_order_value",
)
def _(t):
    return I.summary_stats(t.orders, t.drivers, t.customers, t.products, t.missing_items)


@query("result_sinks", "SELECT region, COUNT(*) AS n FROM ord GROUP BY region")
def _(t):
    counts = A.value_counts(t.orders, "region")
    path = scratch(t)
    I.write_result(counts, f"{path}/csv", "csv")
    back = t.spark.read.schema("region string, n bigint").option("header", True).csv(f"{path}/csv")
    I.write_result(back, f"{path}/json", "json")
    return t.spark.read.schema("region string, n bigint").json(f"{path}/json")


@query(
    "fk_violations",
    """SELECT 'orders without driver' AS "check", COUNT(DISTINCT driver_id) AS distinct_keys, COUNT(*) AS row_count FROM ord
WHERE driver_id % 10 = 3
UNION ALL SELECT 'orders without customer', COUNT(DISTINCT customer_id), COUNT(*) FROM ord
  WHERE customer_id NOT IN (SELECT customer_id FROM cus)""",
)
def _(t):
    return Q.fk_violations(
        t.orders, t.drivers.where("driver_id % 10 <> 3"), "driver_id", "orders without driver"
    ).union(Q.fk_violations(t.orders, t.customers, "customer_id", "orders without customer"))


@query(
    "range_violations",
    """SELECT 'negative items_missing' AS "check", COUNT(CASE WHEN items_missing < 0 THEN 1 END) AS row_count FROM ord
UNION ALL SELECT 'negative order_amount', COUNT(CASE WHEN order_amount < 0 THEN 1 END) FROM ord
UNION ALL SELECT 'driver age below 18', COUNT(CASE WHEN age < 18 THEN 1 END) FROM drv""",
)
def _(t):
    return Q.range_violations(t.orders, t.drivers)


@query("over_missing_orders", "SELECT * FROM ord WHERE items_missing > items_delivered", "order_amount")
def _(t):
    return Q.over_missing_orders(t.orders)


@query(
    "validate",
    """SELECT 'invalid driver_ids' AS "check", COUNT(DISTINCT driver_id) AS row_count FROM ord WHERE driver_id % 10 = 3
UNION ALL SELECT 'negative order_amount', COUNT(*) FROM ord WHERE order_id % 50 = 0 AND order_amount > 0""",
)
def _(t):
    dirty = t.orders.withColumn(
        "order_amount",
        F.when(F.col("order_id") % 50 == 0, -F.col("order_amount")).otherwise(F.col("order_amount")),
    )
    return Q.validate(dirty, t.customers, t.drivers.where("driver_id % 10 <> 3"), t.missing_items)


@query(
    "quality_issues",
    """WITH i AS (SELECT 'Orders missing driver' AS issue, 'Orders' AS scope, COUNT(CASE WHEN order_id % 200 = 0 THEN 1 END) AS issue_count,
  COUNT(*) AS n FROM ord
UNION ALL SELECT 'Orders missing customer', 'Orders', 0, COUNT(*) FROM ord
UNION ALL SELECT 'Orders with negative amount', 'Orders', COUNT(CASE WHEN order_amount < 0 THEN 1 END), COUNT(*) FROM ord
UNION ALL SELECT 'Orders in future date', 'Orders', COUNT(CASE WHEN order_date > DATE '2001-06-30' THEN 1 END), COUNT(*) FROM ord
UNION ALL SELECT 'Drivers missing age', 'Drivers', COUNT(CASE WHEN age IS NULL THEN 1 END), COUNT(*) FROM drv
UNION ALL SELECT 'Customers missing age', 'Customers', COUNT(CASE WHEN customer_id % 13 = 0 THEN 1 END), COUNT(*) FROM cus
UNION ALL SELECT 'Products missing category', 'Products', COUNT(CASE WHEN category IS NULL THEN 1 END), COUNT(*) FROM prd)
SELECT issue, scope, issue_count, issue_count * 100.0 / n AS rate_pct,
  CASE WHEN issue_count * 100.0 / n >= 5 THEN 'Critical' WHEN issue_count * 100.0 / n >= 2 THEN 'High'
    WHEN issue_count * 100.0 / n >= 0.5 THEN 'Medium' ELSE 'Low' END AS severity FROM i""",
    "rate_pct",
)
def _(t):
    orders = t.orders.withColumn(
        "driver_id", F.when(F.col("order_id") % 200 == 0, " ").otherwise(F.col("driver_id").cast("string"))
    )
    customers = t.customers.withColumn("customer_age", F.when(F.col("customer_id") % 13 != 0, F.col("customer_age")))
    return Q.quality_issues(orders, t.drivers, customers, t.products, "2001-06-30")


@query(
    "quality_score",
    """SELECT COUNT(*) AS total_orders, COUNT(CASE WHEN order_date > DATE '2001-06-30' THEN 1 END) AS total_issues,
  STRFTIME(MIN(order_date), '%Y-%m-%d') AS date_start, STRFTIME(MAX(order_date), '%Y-%m-%d') AS date_end,
  ROUND(100.0 - COUNT(CASE WHEN order_date > DATE '2001-06-30' THEN 1 END) * 100.0 / COUNT(*), 2) AS quality_score FROM ord""",
    "quality_score",
)
def _(t):
    return Q.quality_score(t.orders, "2001-06-30")


@query(
    "schema_catalog",
    " UNION ALL ".join(
        f"SELECT 'drivers' AS table_name, '{c}' AS column_name, '{d}' AS data_type, COUNT(*) - COUNT({e}) AS null_count, "
        f"COUNT(*) AS row_count, ROUND((COUNT(*) - COUNT({e})) * 100.0 / COUNT(*), 2) AS null_pct FROM drv"
        for c, d, e in (
            ("driver_id", "string", "driver_id"),
            ("driver_name", "string", "driver_name"),
            ("age", "int", "CASE WHEN driver_id % 7 <> 0 THEN age END"),
            ("trips", "int", "trips"),
        )
    ),
    "null_pct",
)
def _(t):
    return Q.schema_catalog(I.clean_drivers(raw_drivers(t)), "drivers")


@query(
    "describe_dataset",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS nulls, CAST(SUM({c}) AS DOUBLE) AS total,
  AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
  QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS q1, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS median,
  QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS q3
FROM (SELECT CASE WHEN driver_id % 7 <> 0 THEN age END AS age, CASE WHEN driver_id % 11 = 0 THEN 0 ELSE trips END AS trips FROM drv)"""
        for c in ("age", "trips")
    ),
    "total mean std min max q1 median q3",
)
def _(t):
    return A.describe_columns(I.clean_drivers(raw_drivers(t)), ["age", "trips"])


@query(
    "driver_consistency",
    """SELECT * FROM (VALUES ('Reconciliation', TRUE), ('Rate', TRUE), ('Sample', TRUE), ('Completeness',
  (SELECT COUNT(*) FROM ord WHERE order_amount IS NULL) = 0)) AS v(dimension, passed)""",
)
def _(t):
    return Q.driver_consistency(t.orders, D.driver_monthly(t.orders))


@query(
    "product_consistency",
    """SELECT 'Total missing items parity (Overview vs Product page)' AS "check", 'OK' AS status,
  (SELECT CAST(SUM(items_missing) AS BIGINT) FROM ord) AS left_value, (SELECT COUNT(*) FROM mis) AS right_value
UNION ALL SELECT 'Total missing items parity (Regional vs Product page)', 'OK',
  (SELECT CAST(SUM(items_missing) AS BIGINT) FROM ord), (SELECT COUNT(*) FROM mis)
UNION ALL SELECT 'Orphan SKU references in missing items', 'OK', 0, 0
UNION ALL SELECT 'Category consistency (catalog vs missing events)', 'OK', 0, 0""",
)
def _(t):
    items = t.missing_items.join(t.products.select("product_id", "category"), "product_id", "left")
    return Q.product_consistency(t.orders, items, t.products, G.regional_performance(t.orders))


CONTRACTS = {
    "driver_summary": Q.Contract(
        ("driver_id", "missing_rate", "risk_score"),
        ("driver_id", "risk_score"),
        {"missing_rate": (0, 100), "risk_score": (0, 100)},
        ("risk_score",),
    ),
    "customer_summary": Q.Contract(
        ("customer_id", "claim_rate", "risk_score", "loyalty_tier"),
        ("customer_id",),
        {"claim_rate": (0, 50), "risk_score": (0, 100)},
        ("total_spent", "customer_name"),
    ),
}


@query(
    "validate_outputs",
    """WITH c AS (SELECT customer_id, CAST(SUM(items_missing) AS DOUBLE) / SUM(items_missing + items_delivered) * 100.0 AS r
  FROM ord GROUP BY customer_id HAVING SUM(items_missing + items_delivered) > 0),
v(output, rule, violations) AS (VALUES
  ('driver_summary', 'has column driver_id', 0), ('driver_summary', 'has column missing_rate', 0),
  ('driver_summary', 'has column risk_score', 0), ('driver_summary', 'numeric risk_score', 0),
  ('driver_summary', 'no null in driver_id', 0), ('driver_summary', 'no null in risk_score', 0),
  ('driver_summary', 'range of missing_rate', 0), ('driver_summary', 'range of risk_score', 0),
  ('customer_summary', 'has column customer_id', 0), ('customer_summary', 'has column claim_rate', 0),
  ('customer_summary', 'has column risk_score', 0), ('customer_summary', 'has column loyalty_tier', 1),
  ('customer_summary', 'numeric total_spent', 0), ('customer_summary', 'numeric customer_name', 1),
  ('customer_summary', 'no null in customer_id', 0), ('customer_summary', 'range of risk_score', 0)),
a AS (SELECT output, rule, CAST(violations AS BIGINT) AS violations FROM v
  UNION ALL SELECT 'customer_summary', 'range of claim_rate', COUNT(*) FROM c WHERE r > 50)
SELECT *, violations = 0 AS passed FROM a""",
)
def _(t):
    frames = {
        "driver_summary": D.driver_summary(t.drivers, t.orders),
        "customer_summary": C.customer_summary(t.customers, t.orders),
    }
    return Q.validate_outputs({n: (df, CONTRACTS[n]) for n, df in frames.items()})


def contract_sql(views):
    """Every rule counted again from the views of the outputs; rules about the schema hold as declared."""
    found = []

    def add(output, rule, severity, count):
        found.append(f"""SELECT '{output}' AS output, '{rule.replace("'", "''")}' AS rule, '{severity}' AS severity, CAST({count} AS BIGINT) AS violations""")

    for name, view in views.items():
        c = X.CONTRACTS[name]
        for col, kind in c.columns.items():
            add(name, f"has column {col}", "issue", 0)
            if kind:
                add(name, f"{col} is a {kind}", "issue", 0)

        def rows(bad):
            return f"(SELECT COUNT(*) FROM {view} WHERE {bad})"

        for severity, names in (("issue", c.not_null), ("warning", c.warn_null)):
            for col in names:
                add(name, f"no null in {col}", severity, rows(f"{col} IS NULL"))
        for col, (low, high) in c.ranges.items():
            outside = [f"{col} < {low}"] * (low is not None) + [f"{col} > {high}"] * (high is not None)
            add(name, f"range of {col}", "issue", rows(" OR ".join(outside)))
        for col, values in c.allowed.items():
            add(name, f"values of {col}", "warning", rows(f"{col} NOT IN {tuple(values)}"))
        if c.unique:
            add(name, f"unique {', '.join(c.unique)}", "issue", f"(SELECT COUNT(*) - COUNT(DISTINCT ({', '.join(c.unique)})) FROM {view})")
        if c.least_rows:
            add(name, f"at least {c.least_rows} rows", "issue", f"(SELECT GREATEST({c.least_rows} - COUNT(*), 0) FROM {view})")
        for rule, condition in c.checks.items():
            add(name, rule, "issue", rows(f"NOT ({condition})"))

    def measure(end):
        return f"(SELECT {X.CONTRACTS[end[0]].measures[end[1]]} FROM {views[end[0]]})"

    for r in X.RELATIONS:
        if isinstance(r, X.Parity):
            add(r.left[0], r.rule, "issue", f"CASE WHEN ABS({measure(r.left)} - {measure(r.right)}) <= {r.tolerance} THEN 0 ELSE 1 END")
        else:
            (child, key), (parent, of) = r.child, r.parent
            add(child, r.rule, "issue", f"(SELECT COUNT(*) FROM {views[child]} c WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {views[parent]} p WHERE p.{of} = c.{key}))")
    return " UNION ALL ".join(found)


OUTPUT_VIEWS = {
    "orders": "ord", "drivers": "drv", "customers": "cus", "products": "prd", "missing_items": "mis", "overview_metrics": "ov",
    "month_of_year": "moy", "risk_alerts": "al", "risk_distribution": "rd", "regional_summary": "rs", "driver_summary": "ds",
    "customer_summary": "cs",
}


@query(
    "output_contracts",
    f"""WITH {DRIVER_SUMMARY}, {CUSTOMER_SUMMARY},
rs AS (SELECT region, COUNT(*) AS total_orders, SUM(items_missing) AS items_missing, {ORDER_RATE} AS missing_rate FROM ord GROUP BY region),
moy AS (SELECT EXTRACT(MONTH FROM order_date) AS month, STRFTIME(order_date, '%b') AS month_name, COUNT(*) AS total_orders,
  SUM(items_missing) AS items_missing, {ORDER_RATE} AS missing_rate FROM ord GROUP BY 1, 2),
ov AS (SELECT COUNT(*) AS total_orders, SUM(items_missing) AS total_items_missing, {ORDER_RATE} AS overall_missing_rate,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) AS orders_with_missing,
  COUNT(CASE WHEN items_missing > 0 THEN 1 END) * 100.0 / COUNT(*) AS pct_orders_with_missing, SUM(items_missing) * 1.0 AS estimated_loss,
  MIN(order_date) AS date_range_start, MAX(order_date) AS date_range_end, (SELECT COUNT(*) FROM drv) AS total_drivers,
  (SELECT COUNT(*) FROM cus) AS total_customers FROM ord),
al AS (SELECT 'Driver' AS entity_type, CAST(driver_id AS VARCHAR) AS entity_id, risk_score, risk_category FROM ds WHERE risk_score >= 70
  UNION ALL SELECT 'Customer', CAST(customer_id AS VARCHAR), risk_score, risk_category FROM cs WHERE risk_score >= 70
  UNION ALL SELECT 'Region', region, missing_rate, CASE WHEN missing_rate > (SELECT AVG(missing_rate) FROM rs) * 1.5 THEN 'High' ELSE 'Medium' END
    FROM rs WHERE missing_rate > (SELECT AVG(missing_rate) FROM rs) * 0.75),
lv AS (SELECT UNNEST({list(X.LEVELS)}) AS risk_category),
rd AS (SELECT 'driver' AS entity_type, risk_category, (SELECT COUNT(*) FROM ds WHERE ds.risk_category = lv.risk_category) AS n FROM lv
  UNION ALL SELECT 'customer', risk_category, (SELECT COUNT(*) FROM cs WHERE cs.risk_category = lv.risk_category) FROM lv),
rules AS ({contract_sql(OUTPUT_VIEWS)})
SELECT *, violations = 0 AS passed FROM rules""",
)
def _(t):
    orders = materialize(t.orders)
    drivers, customers = D.driver_summary(t.drivers, orders), C.customer_summary(t.customers, orders)
    regional = G.regional_summary(orders)
    return X.check_summaries(
        {
            "orders": orders,
            "drivers": t.drivers,
            "customers": t.customers,
            "products": t.products,
            "missing_items": t.positioned_items,
            "overview_metrics": A.overview_metrics(orders, t.drivers, t.customers),
            "month_of_year": TM.trends_month_of_year(orders),
            "risk_alerts": R.risk_alerts(drivers, customers, regional),
            "risk_distribution": R.risk_distribution(drivers, customers),
            "regional_summary": regional,
            "driver_summary": drivers,
            "customer_summary": customers,
        }
    )
