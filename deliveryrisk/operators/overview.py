"""Global key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import ITEM_VALUE_USD
from deliveryrisk.functions.ranking import quantiles
from deliveryrisk.functions.scalar import (
    Scalars,
    missing_rate,
    money_avg,
    money_sum,
    percent_of,
    rate_pct,
)
from deliveryrisk.operators.drivers import has_missing


def rows() -> Column:
    return F.count(F.lit(1))


def count_of(df: DataFrame):
    """Row count as a scalar subquery."""
    return df.agg(rows()).scalar()


def base_totals(orders: DataFrame, *more: Column) -> DataFrame:
    """Totals and rates of all orders, with other aggregates of the same pass."""
    return orders.agg(
        *more,
        rows().alias("total_orders"),
        money_sum("order_amount").alias("total_revenue"),
        money_avg("order_amount").alias("avg_order_value"),
        F.sum("items_delivered").alias("total_items_delivered"),
        F.sum("items_missing").alias("total_items_missing"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
    ).withColumns(
        {
            "overall_missing_rate": missing_rate("total_items_missing", "total_items_delivered"),
            "pct_orders_with_missing": percent_of("orders_with_missing", "total_orders"),
        }
    )


def order_aggregations(orders: DataFrame) -> DataFrame:
    """A-3."""
    return base_totals(orders)


def activity() -> list[Column]:
    """Entities with orders and the dates they span."""
    return [
        F.count_distinct("driver_id").alias("active_drivers"),
        F.count_distinct("customer_id").alias("active_customers"),
        F.count_distinct("region").alias("total_regions"),
        F.min("order_date").alias("date_range_start"),
        F.max("order_date").alias("date_range_end"),
    ]


def overall_statistics(orders: DataFrame, drivers: DataFrame, customers: DataFrame, *more: Column) -> DataFrame:
    """A-2: totals with known and active entities; one pass over the orders."""
    return base_totals(orders, *activity(), *more).withColumns(
        {"total_drivers": count_of(drivers), "total_customers": count_of(customers)}
    )


def overview_metrics(orders: DataFrame, drivers: DataFrame, customers: DataFrame) -> DataFrame:
    """A-1: overall statistics with order value spread and estimated loss."""
    spread = (F.min("order_amount").alias("min_order_value"), F.max("order_amount").alias("max_order_value"))
    q = Scalars(quantiles(orders, {"median": ("order_amount", 0.5)}), "_median")
    out = q.attach(overall_statistics(orders, drivers, customers, *spread)).withColumns(
        {
            "median_order_value": q.median,
            "total_items_ordered": F.col("total_items_delivered") + F.col("total_items_missing"),
            "estimated_loss": F.col("total_items_missing") * ITEM_VALUE_USD,
        }
    )
    return q.detach(out)


def fraud_summary(
    orders: DataFrame,
    missing_items: DataFrame,
    products: DataFrame,
    drivers: DataFrame,
    customers: DataFrame,
    regions: DataFrame,
) -> DataFrame:
    """A-4: view of totals, overall rates and entity counts."""
    events = missing_items.groupBy("product_id").agg(rows().alias("n"))
    value = events.join(products.select("product_id", "price"), "product_id").agg(F.sum(F.col("n") * F.col("price")))
    return (
        orders.agg(
            rows().alias("total_orders"),
            F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
            F.sum("items_delivered").alias("total_items_delivered"),
            F.sum("items_missing").alias("total_items_missing"),
            money_sum("order_amount").alias("total_order_value"),
        )
        .withColumn("total_missing_value", F.coalesce(value.scalar(), F.lit(0.0)))
        .withColumns(
            {
                "overall_missing_order_rate_pct": rate_pct("orders_with_missing", "total_orders"),
                "overall_missing_item_rate_pct": rate_pct("total_items_missing", "total_items_delivered"),
                "overall_missing_value_rate_pct": rate_pct("total_missing_value", "total_order_value"),
                "total_drivers": count_of(drivers),
                "total_customers": count_of(customers),
                "total_products": count_of(products),
                "total_regions": count_of(regions),
            }
        )
    )


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, total, mean, median, deviation and range of one column."""
    q = Scalars(quantiles(df, {"median": (column, 0.5)}))
    c = F.col(column).cast("double")
    stats = df.agg(
        F.count(column).alias("n"),
        F.sum(c).alias("total"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    return q.detach(q.attach(stats).withColumns({"median": q.median, "column_name": F.lit(column)}))


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-5, DQ-8: one row of statistics per numeric column, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])
    tall = df.select(F.explode(pairs).alias("e")).select(F.col("e.m").alias("column_name"), F.col("e.v").alias("v"))
    stats = tall.groupBy("column_name").agg(
        F.count("v").alias("n"),
        F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"),
        F.sum("v").alias("total"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    parts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = quantiles(df, {f"{i}_{name}": (c, p) for i, c in enumerate(columns) for name, p in parts.items()})
    found = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"{i}_{name}").alias(name) for name in parts])
            for i, c in enumerate(columns)
        ]
    )
    return stats.join(q.select(F.explode(found).alias("e")).select("e.*"), "column_name", "left")


def describe_orders(orders: DataFrame) -> DataFrame:
    """A-5: spread of amounts and items."""
    return describe_columns(orders, ["order_amount", "items_delivered", "items_missing"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(rows().alias("n"))


def price_by_category(products: DataFrame) -> DataFrame:
    """A-5: price statistics per category."""
    stats = products.groupBy("category").agg(
        F.avg("price").alias("mean"), F.min("price").alias("min"), F.max("price").alias("max")
    )
    return stats.join(quantiles(products, {"median": ("price", 0.5)}, ["category"]), "category")


# Percentiles of the order amount table.
PERCENTILES = [10, 25, 50, 75, 90, 95, 99]


def percentile_table(orders: DataFrame, column: str = "order_amount", points: list[int] = PERCENTILES) -> DataFrame:
    """A-6: long table of percentiles."""
    q = quantiles(orders, {f"p{p}": (column, p / 100) for p in points})
    pairs = F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("value")) for p in points])
    return q.select(F.explode(pairs).alias("e")).select("e.percentile", "e.value")


def fraud_loss_metrics(orders: DataFrame, products: DataFrame) -> DataFrame:
    """A-7: loss as missing items times the mean catalogue price."""
    price = products.agg(F.avg("price")).scalar()
    return (
        base_totals(orders)
        .withColumn("avg_product_price", price)
        .withColumn("estimated_loss", F.col("total_items_missing") * F.col("avg_product_price"))
    )


# Fixed value: national e-commerce loss used as context (53 % of 6.5 billion).
NATIONAL_ECOMMERCE_LOSS = 6_500_000_000 * 0.53


def business_impact(overview: DataFrame, reduction: float = 0.25) -> DataFrame:
    """A-8: annualised loss and possible savings."""
    annual = F.col("estimated_loss") * 12.0
    return overview.select(
        F.lit(NATIONAL_ECOMMERCE_LOSS).alias("national_context"),
        annual.alias("projected_annual_loss"),
        (annual * reduction).alias("potential_savings"),
        F.lit(reduction * 100.0).alias("target_reduction_pct"),
    )


def monitoring_kpis(overview: DataFrame, driver_summary: DataFrame, customer_summary: DataFrame) -> DataFrame:
    """A-9: exposure, rate, critical entities and monthly savings."""
    critical = F.col("risk_category") == "Critical"
    return overview.select(
        F.col("estimated_loss").alias("fraud_exposure"),
        F.col("overall_missing_rate").alias("missing_rate"),
        (count_of(driver_summary.where(critical)) + count_of(customer_summary.where(critical))).alias(
            "high_risk_entities"
        ),
        (F.col("estimated_loss") / 12.0 * 0.4 * 0.7).alias("monthly_savings"),
    )


def savings_without_critical(orders: DataFrame, snapshot: DataFrame, category: str = "Critical") -> DataFrame:
    """A-10: missing rate with the drivers of one band left out, and the money it saves."""
    out = snapshot.where(F.col("risk_category") == category).select("driver_id")
    kept = Scalars(
        orders.join(out, "driver_id", "left_anti").agg(
            F.coalesce(F.sum("items_missing"), F.lit(0)).alias("m"),
            F.coalesce(F.sum("items_delivered"), F.lit(0)).alias("d"),
        )
    )
    total = orders.agg(F.sum("items_missing").alias("total_missing"), F.sum("items_delivered").alias("_d")).withColumns(
        {"total_items": F.col("total_missing") + F.col("_d"), "missing_rate": missing_rate("total_missing", "_d")}
    )
    optimized = kept.attach(total).withColumn("optimized_rate", missing_rate(kept.m, kept.d))
    gap = F.greatest(F.col("missing_rate") - F.col("optimized_rate"), F.lit(0.0))
    return kept.detach(
        optimized.withColumn("savings_proxy", gap / 100.0 * F.col("total_items") * ITEM_VALUE_USD)
    ).drop("_d")
