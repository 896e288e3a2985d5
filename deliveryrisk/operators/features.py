"""Row-level order features and denormalised views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.functions.ranking import quantiles
from deliveryrisk.functions.scalar import (
    Scalars,
    bucketize,
    delivery_period,
    missing_rate,
    rate_pct,
    ratio_or_null,
    round_half_up,
)


def order_features(orders: DataFrame) -> DataFrame:
    """F-1: totals, rate, value flag above the third quartile, period, calendar and size."""
    s = Scalars(quantiles(orders, {"p75": ("order_amount", 0.75)}))
    total = F.col("items_delivered") + F.col("items_missing")
    return s.detach(
        s.attach(orders).withColumns(
            {
                "total_items": total,
                "missing_rate": missing_rate("items_missing", "items_delivered"),
                "is_high_value": F.col("order_amount") > s.p75,
                "delivery_period": delivery_period("delivery_hour", "cut"),
                "day_of_week": F.date_format("order_date", "EEEE"),
                "is_weekend": F.weekday("order_date") >= 5,
                "month": F.month("order_date"),
                "week_of_year": F.weekofyear("order_date"),
                "order_size": bucketize(total, [-1, 5, 10, None], ["Small", "Medium", "Large"]),
                "has_missing": F.col("items_missing") > 0,
            }
        )
    )


def temporal_features(orders: DataFrame, month_start: int = 7, month_end: int = 24) -> DataFrame:
    """F-2: calendar columns of an order."""
    day = F.dayofmonth("order_date")
    return orders.withColumns(
        {
            "hour": F.col("delivery_hour"),
            "period": delivery_period("delivery_hour", "cut"),
            "day_of_week": F.date_format("order_date", "EEEE"),
            "day_of_week_num": F.weekday("order_date"),
            "is_weekend": F.weekday("order_date") >= 5,
            "week_of_year": F.weekofyear("order_date"),
            "month": F.month("order_date"),
            "month_name": F.date_format("order_date", "MMMM"),
            "day_of_month": day,
            "is_month_start": day <= month_start,
            "is_month_end": day >= month_end,
            "quarter": F.quarter("order_date"),
        }
    )


def orders_enriched(orders: DataFrame) -> DataFrame:
    """F-3: the base of the summaries; an unknown hour counts as 0."""
    return orders.withColumns(
        {
            "total_items": F.col("items_delivered") + F.col("items_missing"),
            "missing_rate": missing_rate("items_missing", "items_delivered"),
            "has_missing": F.col("items_missing") > 0,
            "month": F.month("order_date"),
            "month_name": F.date_format("order_date", "MMMM"),
            "day_of_week": F.date_format("order_date", "EEEE"),
            "day_of_week_num": F.weekday("order_date"),
            "delivery_hour": F.coalesce("delivery_hour", F.lit(0)),
        }
    )


def orders_full(orders: DataFrame, drivers: DataFrame, customers: DataFrame) -> DataFrame:
    """F-4: orders with driver, customer and derived rates."""
    return (
        orders.where(F.col("region").isNotNull())
        .join(drivers.withColumnsRenamed({"age": "driver_age", "trips": "driver_total_trips"}), "driver_id")
        .join(customers, "customer_id")
        .withColumnRenamed("region", "region_name")
        .withColumns(
            {
                "order_year": F.year("order_date"),
                "order_month": F.month("order_date"),
                "day_of_week": F.dayofweek("order_date") - 1,
                "day_name": F.date_format("order_date", "EEEE"),
                "delivery_period": delivery_period("delivery_hour"),
                "has_missing_items": F.col("items_missing") > 0,
                "missing_rate_pct": rate_pct("items_missing", "items_delivered"),
                "avg_item_value": round_half_up(ratio_or_null("order_amount", "items_delivered"), 2),
            }
        )
    )


def missing_items_full(
    positioned: DataFrame, products: DataFrame, orders: DataFrame, drivers: DataFrame, customers: DataFrame
) -> DataFrame:
    """F-5: missing items with product, order, driver and customer."""
    return (
        positioned.join(
            products.withColumnsRenamed({"category": "product_category", "price": "product_price"}), "product_id"
        )
        .join(
            orders.where(F.col("region").isNotNull()).select(
                "order_id",
                "order_date",
                "order_amount",
                F.col("region").alias("region_name"),
                "driver_id",
                "customer_id",
            ),
            "order_id",
        )
        .join(drivers.select("driver_id", "driver_name"), "driver_id")
        .join(customers.select("customer_id", "customer_name"), "customer_id")
    )
