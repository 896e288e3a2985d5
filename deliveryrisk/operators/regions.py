"""Regional performance; every frame here has at most one row per region or region and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from deliveryrisk.config import DEFAULT_COORDINATES, ITEM_VALUE_USD, REGION_COORDINATES, THRESHOLDS
from deliveryrisk.functions.scalar import (
    Scalars,
    lookup,
    missing_rate,
    money_avg,
    money_sum,
    percent_of,
    rate_pct,
    ratio_or_null,
)
from deliveryrisk.operators.drivers import has_missing, missing_value_by
from deliveryrisk.operators.scope import scope_items


def all_regions() -> WindowSpec:
    """One partition over a handful of region rows."""
    return Window.partitionBy()


def regional_performance(orders: DataFrame) -> DataFrame:
    """G-1; orders without a region belong to none."""
    return (
        orders.where(F.col("region").isNotNull())
        .groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            money_sum("order_amount").alias("total_revenue"),
            money_avg("order_amount").alias("avg_order_value"),
            F.sum("items_delivered").alias("items_delivered"),
            F.sum("items_missing").alias("items_missing"),
            F.count_distinct("driver_id").alias("unique_drivers"),
            F.count_distinct("customer_id").alias("unique_customers"),
            F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
        )
        .withColumns(
            {
                "total_items": F.col("items_delivered") + F.col("items_missing"),
                "missing_rate": missing_rate("items_missing", "items_delivered"),
                "pct_orders_with_missing": F.col("orders_with_missing") / F.col("total_orders") * 100.0,
                "orders_per_driver": F.col("total_orders") / F.col("unique_drivers"),
                "revenue_per_customer": F.col("total_revenue") / F.col("unique_customers"),
            }
        )
    )


def compare_regions(regional: DataFrame, metric: str = "missing_rate") -> DataFrame:
    """G-2: distance of each region from the mean of a metric."""
    s = Scalars(regional, mean=F.avg(metric), std=F.stddev_samp(metric))
    diff = F.col(metric) - s.mean
    z = F.when(s.std > 0, diff / s.std).otherwise(F.lit(0.0))
    return s.detach(
        s.attach(regional).withColumns(
            {
                "vs_avg": diff,
                "vs_avg_pct": diff / F.nullif(s.mean, F.lit(0.0)) * 100.0,
                "z_score": z,
                "is_above_avg": F.col(metric) > s.mean,
                "is_outlier": F.abs(z) > 2,
            }
        )
    )


def region_comparison_stats(regional: DataFrame, metric: str = "missing_rate") -> DataFrame:
    """G-2: spread, best and worst region; ties to the first name."""
    m = F.col(metric)
    return regional.agg(
        F.avg(m).alias("average"),
        F.stddev_samp(m).alias("std"),
        F.min(m).alias("min"),
        F.max(m).alias("max"),
        F.min_by("region", F.struct(m, F.col("region"))).alias("best_region"),
        F.min_by("region", F.struct(-m, F.col("region"))).alias("worst_region"),
    )


def regional_drivers(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    """G-3: driver by region."""
    return (
        orders.where(F.col("region").isNotNull() & F.col("driver_id").isNotNull())
        .groupBy("region", "driver_id")
        .agg(
            F.count(F.lit(1)).alias("orders_in_region"),
            F.sum("items_missing").alias("items_missing"),
            F.sum("items_delivered").alias("items_delivered"),
        )
        .withColumns(
            {
                "total_items": F.col("items_delivered") + F.col("items_missing"),
                "missing_rate": missing_rate("items_missing", "items_delivered"),
            }
        )
        .join(drivers, "driver_id", "left")
    )


def regional_hotspots(regional: DataFrame, percentile: float = THRESHOLDS.geographic_rank) -> DataFrame:
    """G-4: regions at or above a percentile of rate, volume or orders per driver."""
    metrics = {
        "high_missing_rate": "missing_rate",
        "high_volume_missing": "items_missing",
        "low_driver_coverage": "orders_per_driver",
    }
    s = Scalars(regional, **{k: F.percentile(c, percentile / 100) for k, c in metrics.items()})
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c) >= getattr(s, k), F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value"))
                )
                for k, c in metrics.items()
            ]
        )
    )
    return s.attach(regional).select("region", F.explode(hits).alias("h")).select("h.kind", "region", "h.value")


def regional_monthly(orders: DataFrame) -> DataFrame:
    """G-5: region by month of the year."""
    return (
        orders.where(F.col("region").isNotNull())
        .groupBy("region", F.month("order_date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("items_missing").alias("items_missing"),
            F.sum("items_delivered").alias("items_delivered"),
        )
        .withColumns(
            {
                "total_items": F.col("items_delivered") + F.col("items_missing"),
                "missing_rate": missing_rate("items_missing", "items_delivered"),
            }
        )
    )


def regional_extremes(regional: DataFrame, n: int = 3) -> DataFrame:
    """G-6: the n regions with the lowest and highest rate."""
    cols = ["region", "missing_rate", "total_orders"]
    best = regional.orderBy("missing_rate", "region").limit(n).select(F.lit("best").alias("side"), *cols)
    worst = regional.orderBy(F.desc("missing_rate"), "region").limit(n).select(F.lit("worst").alias("side"), *cols)
    return best.unionByName(worst)


def regional_statistics(regional: DataFrame) -> DataFrame:
    """G-6: statistics over the regions."""
    return regional.agg(
        F.count(F.lit(1)).alias("total_regions"),
        F.avg("missing_rate").alias("avg_missing_rate"),
        F.stddev_samp("missing_rate").alias("std_missing_rate"),
        F.sum("total_orders").alias("total_orders"),
        F.sum("items_missing").alias("total_missing_items"),
    )


def region_fraud_metrics(
    regions: DataFrame, orders: DataFrame, missing_items: DataFrame, products: DataFrame
) -> DataFrame:
    """G-7: view with missing value and orders per driver."""
    stats = (
        orders.groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
            F.sum("items_delivered").alias("total_items_delivered"),
            F.sum("items_missing").alias("total_items_missing"),
            money_sum("order_amount").alias("total_order_value"),
            F.count_distinct("driver_id").alias("unique_drivers"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
        .withColumnRenamed("region", "region_name")
    )
    value = missing_value_by(orders, missing_items, products, "region").withColumnRenamed("region", "region_name")
    zero = ["orders_count", "orders_with_missing", "unique_drivers", "unique_customers", "total_missing_value"]
    return (
        regions.join(stats, "region_name", "left")
        .join(value, "region_name", "left")
        .fillna(0, zero)
        .withColumns(
            {
                "missing_order_rate_pct": rate_pct("orders_with_missing", "orders_count"),
                "missing_item_rate_pct": rate_pct("total_items_missing", "total_items_delivered"),
                "missing_value_rate_pct": rate_pct("total_missing_value", "total_order_value"),
                "orders_per_driver": F.round(ratio_or_null("orders_count", "unique_drivers"), 2),
            }
        )
    )


def regional_stats(orders: DataFrame) -> DataFrame:
    """G-8: older view."""
    return orders.groupBy("region").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("items_missing").alias("total_items_missing"),
        F.sum("items_delivered").alias("total_items_delivered"),
        money_sum("order_amount").alias("total_revenue"),
        F.round(money_avg("order_amount"), 2).alias("avg_order_amount"),
        F.round(missing_rate(F.sum("items_missing"), F.sum("items_delivered")), 2).alias("missing_rate_pct"),
    )


def regional_summary(orders: DataFrame) -> DataFrame:
    """G-9: revenue share and risk rank; tied regions share their mean rank, cut to a whole number."""
    rate = F.desc("missing_rate")
    ties = F.count(F.lit(1)).over(Window.partitionBy("missing_rate"))
    rank = F.rank().over(all_regions().orderBy(rate)) + (ties - 1) / F.lit(2.0)
    return (
        regional_performance(orders)
        .drop("revenue_per_customer")
        .withColumns(
            {
                "orders_per_customer": F.col("total_orders") / F.col("unique_customers"),
                "revenue_share": F.col("total_revenue") / F.sum("total_revenue").over(all_regions()) * 100.0,
                "risk_rank": rank.cast("int"),
            }
        )
    )


def geo_dataset(summary: DataFrame) -> DataFrame:
    """G-10: tier by rank, loss, gap to the mean rate and coordinates."""
    rank = F.col("risk_rank")
    tier = F.when(rank <= 1, "Critical").when(rank <= 2, "High").when(rank <= 4, "Medium").otherwise("Low")
    lat = {k: v[0] for k, v in REGION_COORDINATES.items()}
    lon = {k: v[1] for k, v in REGION_COORDINATES.items()}
    return summary.withColumns(
        {
            "risk_tier": tier,
            "estimated_loss_usd": F.col("items_missing") * ITEM_VALUE_USD,
            "missing_rate_gap": F.col("missing_rate") - F.avg("missing_rate").over(all_regions()),
            "lat": lookup("region", lat, DEFAULT_COORDINATES[0]),
            "lon": lookup("region", lon, DEFAULT_COORDINATES[1]),
        }
    )


def regional_product_scope(
    orders: DataFrame, missing_items: DataFrame, products: DataFrame, category: str = "", product_id=None
) -> DataFrame:
    """G-11: regions seen through the orders that miss an item of the scope.

    Items are counted per order first, so each order meets the scope once.
    """
    per_order = (
        scope_items(missing_items, products, category, product_id)
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("scoped_missing"))
    )
    regional = (
        orders.join(per_order, "order_id")
        .groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            money_sum("order_amount").alias("total_revenue"),
            F.sum("scoped_missing").alias("items_missing"),
            F.count(F.lit(1)).alias("orders_with_missing"),
            F.sum("items_delivered").alias("_delivered"),
        )
    )
    return (
        regional.withColumn("missing_rate", missing_rate("items_missing", "_delivered"))
        .withColumns(
            {
                "pct_orders_with_missing": percent_of("orders_with_missing", "total_orders"),
                "revenue_share": percent_of("total_revenue", F.sum("total_revenue").over(all_regions())),
                "risk_rank": F.dense_rank().over(all_regions().orderBy(F.desc("missing_rate"))),
            }
        )
        .drop("_delivered")
    )


def geo_kpis(geo: DataFrame) -> DataFrame:
    """G-12."""
    rate = F.col("missing_rate")
    return geo.agg(
        F.count(F.lit(1)).alias("total_regions"),
        F.avg(rate).alias("avg_missing_rate"),
        F.min_by("region", F.struct(-rate, F.col("region"))).alias("worst_region"),
        F.min_by("region", F.struct(rate, F.col("region"))).alias("best_region"),
        (F.max(rate) - F.min(rate)).alias("spread"),
        F.sum("estimated_loss_usd").alias("total_loss"),
    )


def regional_levels(regional: DataFrame, n: int = 5) -> DataFrame:
    """G-13: the n worst regions with a level by multiples of the mean rate."""
    s = Scalars(regional, mean=F.avg("missing_rate"))
    rate = F.col("missing_rate")
    level = (
        F.when(rate > s.mean * 1.5, "Critical")
        .when(rate > s.mean * 1.2, "High")
        .when(rate > s.mean, "Medium")
        .otherwise("Low")
    )
    top = regional.orderBy(F.desc("missing_rate"), "region").limit(n)
    return s.attach(top).select("region", "missing_rate", level.alias("risk_level"))
