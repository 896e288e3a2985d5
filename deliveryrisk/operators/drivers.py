"""Per-driver features, scores and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import (
    DRIVER_AGE_EDGES,
    DRIVER_AGE_LABELS,
    EXPERIENCE_EDGES,
    EXPERIENCE_LABELS,
    ITEM_VALUE_USD,
    THRESHOLDS,
)
from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.ranking import quantiles
from deliveryrisk.functions.scalar import (
    Scalars,
    bucketize,
    max_scale,
    min_max,
    missing_rate,
    money_avg,
    money_sum,
    percent_of,
    rate_pct,
    ratio_or_null,
    risk_band,
    round_half_up,
)


def has_missing() -> Column:
    return F.col("items_missing") > 0


def order_stats(orders: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums and rates of orders by any keys; the base of most entity operators."""
    return (
        orders.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("items_delivered").alias("total_items_delivered"),
            F.sum("items_missing").alias("total_items_missing"),
            money_sum("order_amount").alias("total_revenue"),
            money_avg("order_amount").alias("avg_order_value"),
            F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
        )
        .withColumn("missing_rate", missing_rate("total_items_missing", "total_items_delivered"))
        .withColumn("pct_orders_with_missing", F.col("orders_with_missing") / F.col("total_orders") * 100.0)
    )


def driver_features(drivers: DataFrame, orders: DataFrame) -> DataFrame:
    """D-1: history of every driver, zeros for drivers without orders, age and experience bands."""
    joined = drivers.join(order_stats(orders, "driver_id"), "driver_id", "left").fillna(
        0,
        [
            "total_orders",
            "total_items_delivered",
            "total_items_missing",
            "total_revenue",
            "avg_order_value",
            "missing_rate",
            "orders_with_missing",
            "pct_orders_with_missing",
        ],
    )
    return joined.withColumns(
        {
            "age_group": bucketize("age", DRIVER_AGE_EDGES, DRIVER_AGE_LABELS),
            "experience_level": bucketize("trips", EXPERIENCE_EDGES, EXPERIENCE_LABELS),
        }
    )


def weighted_risk(df: DataFrame, parts: dict[str, tuple[str, float]], on_flat: float = 0.5) -> DataFrame:
    """Weighted sum of min-max scaled columns; ``parts`` maps output name to (column, weight)."""
    df = materialize(df)
    bounds = {}
    for c, _ in parts.values():
        bounds[f"{c}_lo"], bounds[f"{c}_hi"] = F.min(c), F.max(c)
    s = Scalars(df, **bounds)
    scaled = s.attach(df).withColumns(
        {out: min_max(c, getattr(s, f"{c}_lo"), getattr(s, f"{c}_hi"), on_flat) for out, (c, _) in parts.items()}
    )
    total = sum((F.col(out) * w for out, (_, w) in parts.items()), F.lit(0.0))
    return s.detach(scaled).withColumn("risk_score", total * 100.0)


def driver_risk_scores(features: DataFrame) -> DataFrame:
    """D-2: 40/35/25 weighting of rate, share of orders and volume."""
    return weighted_risk(
        features,
        {
            "missing_rate_score": ("missing_rate", 0.40),
            "pct_orders_score": ("pct_orders_with_missing", 0.35),
            "volume_score": ("total_items_missing", 0.25),
        },
    ).withColumn("risk_category", risk_band("risk_score"))


def suspicious_entities(features: DataFrame, rate_limit: float, min_orders: int) -> DataFrame:
    """Enough orders and a rate at the limit or more than two deviations above the mean."""
    features = materialize(features)
    s = Scalars(features, mean=F.avg("missing_rate"), std=F.stddev_samp("missing_rate"))
    rate = F.col("missing_rate")
    enough = s.attach(features.where(F.col("total_orders") >= min_orders))
    return s.detach(enough.where((rate >= rate_limit) | (rate > s.mean + 2 * s.std)))


def suspicious_drivers(
    features: DataFrame, rate_limit: float = THRESHOLDS.driver_rate, min_orders: int = 5
) -> DataFrame:
    """D-3."""
    return suspicious_entities(features, rate_limit, min_orders)


def compare_drivers(features: DataFrame) -> DataFrame:
    """D-4: distance of each driver from the fleet."""
    features = materialize(features)
    s = Scalars(features, mean=F.avg("missing_rate"), std=F.stddev_samp("missing_rate"))
    rate = F.col("missing_rate")
    return s.detach(
        s.attach(features).withColumns(
            {
                "vs_avg": rate - s.mean,
                "is_above_avg": rate > s.mean,
                "is_outlier": F.coalesce(rate > s.mean + 2 * s.std, F.lit(False)),
            }
        )
    )


def driver_comparison_stats(features: DataFrame) -> DataFrame:
    """D-4: the fleet statistics behind the comparison."""
    rate = "missing_rate"
    features = materialize(features)
    q = Scalars(quantiles(features, {"q1": (rate, 0.25), "med": (rate, 0.5), "q3": (rate, 0.75)}), "_q")
    s = Scalars(features, mean=F.avg(rate))
    stats = s.attach(features).agg(
        F.avg(rate).alias("avg_missing_rate"),
        F.stddev_samp(rate).alias("std_missing_rate"),
        F.count(F.lit(1)).alias("total_drivers"),
        F.count(F.when(F.col(rate) > s.mean, 1)).alias("drivers_above_avg"),
    )
    return q.detach(
        q.attach(stats).withColumns({"median_missing_rate": q.med, "q1_missing_rate": q.q1, "q3_missing_rate": q.q3})
    )


def missing_value_by(orders: DataFrame, missing_items: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """Catalogue value of missing items per order attribute.

    Items are valued and folded to one row per order first, so the join with
    orders is one-to-one whatever the key's skew.
    """
    per_order = (
        missing_items.join(products.select("product_id", "price"), "product_id")
        .groupBy("order_id")
        .agg(F.sum("price").alias("order_missing_value"))
    )
    return (
        orders.select("order_id", key)
        .join(per_order, "order_id")
        .groupBy(key)
        .agg(F.sum("order_missing_value").alias("total_missing_value"))
    )


def fraud_score_columns(df: DataFrame) -> DataFrame:
    """The two-decimal rates and the 40/30/30 score of the SQL views."""
    return df.withColumns(
        {
            "missing_order_rate_pct": rate_pct("orders_with_missing", "orders_count"),
            "missing_item_rate_pct": rate_pct("total_items_missing", "total_items_delivered"),
            "missing_value_rate_pct": rate_pct("total_missing_value", "total_order_value"),
            "fraud_risk_score": F.round(
                ratio_or_null("orders_with_missing", "orders_count") * 40.0
                + ratio_or_null("total_items_missing", "total_items_delivered") * 30.0
                + ratio_or_null("total_missing_value", "total_order_value") * 30.0,
                2,
            ),
        }
    )


def fraud_metrics_base(entity: DataFrame, orders: DataFrame, key: str, extra: tuple = ()) -> DataFrame:
    """Order sums for every row of a dimension; NULL sums where there are no orders."""
    stats = orders.groupBy(key).agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
        F.sum("items_delivered").alias("total_items_delivered"),
        F.sum("items_missing").alias("total_items_missing"),
        money_sum("order_amount").alias("total_order_value"),
        money_avg("order_amount").alias("avg_order_value"),
        *extra,
    )
    return entity.join(stats, key, "left").fillna(0, ["orders_count", "orders_with_missing"])


def driver_fraud_metrics(
    drivers: DataFrame, orders: DataFrame, missing_items: DataFrame, products: DataFrame
) -> DataFrame:
    """D-5: view with missing value by product price."""
    base = fraud_metrics_base(drivers.withColumnsRenamed({"age": "driver_age", "trips": "total_trips"}), orders, "driver_id")
    value = missing_value_by(orders, missing_items, products, "driver_id")
    scored = fraud_score_columns(base.join(value, "driver_id", "left").fillna(0.0, ["total_missing_value"]))
    return scored.withColumns(
        {"total_order_value": round_half_up("total_order_value", 2), "avg_order_value": round_half_up("avg_order_value", 2)}
    )


def driver_daily_performance(drivers: DataFrame, orders: DataFrame) -> DataFrame:
    """D-6: the orders are folded per driver and day before names are attached."""
    daily = orders.groupBy("driver_id", "order_date").agg(
        F.count(F.lit(1)).alias("daily_orders"),
        F.sum("items_delivered").alias("daily_items_delivered"),
        F.sum("items_missing").alias("daily_items_missing"),
        money_sum("order_amount").alias("daily_order_value"),
    )
    return daily.join(drivers.select("driver_id", "driver_name"), "driver_id").withColumn(
        "daily_missing_rate_pct", rate_pct("daily_items_missing", "daily_items_delivered")
    )


def driver_fraud_stats(drivers: DataFrame, orders: DataFrame) -> DataFrame:
    """D-7: older view with the rate on total items."""
    stats = orders.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("items_missing").alias("total_items_missing"),
        F.sum("items_delivered").alias("total_items_delivered"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
    )
    return (
        drivers.join(stats, "driver_id", "left")
        .fillna(0, ["total_orders", "orders_with_missing"])
        .withColumn(
            "missing_rate_pct",
            F.round(F.coalesce(missing_rate("total_items_missing", "total_items_delivered"), F.lit(0.0)), 2),
        )
    )


def high_risk_entities_view(metrics: DataFrame, id_cols: list[str], min_orders: int) -> DataFrame:
    """D-8, C-7: entities above mean + 1 deviation of the item rate, with z-score and level."""
    base = materialize(
        metrics.where(F.col("orders_count") >= min_orders).select(
            *id_cols, "orders_count", "total_items_missing", "missing_item_rate_pct", "fraud_risk_score"
        )
    )
    rate = F.col("missing_item_rate_pct")
    s = Scalars(base, mean=F.avg(rate), std=F.stddev_samp(rate))
    flagged = s.attach(base).where(rate > s.mean + s.std).withColumns(
        {
            "population_mean_rate": s.mean,
            "population_stddev_rate": s.std,
            "z_score": F.round(ratio_or_null(rate - s.mean, s.std), 2),
            "risk_level": F.when(rate > s.mean + 2 * s.std, "HIGH")
            .when(rate > s.mean + s.std, "MEDIUM")
            .otherwise("LOW"),
        }
    )
    return s.detach(flagged)


def driver_summary(drivers: DataFrame, orders: DataFrame) -> DataFrame:
    """D-9: summary with the 50/50 max-scaled score."""
    stats = orders.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("orders_completed"),
        money_sum("order_amount").alias("total_revenue"),
        F.sum("items_delivered").alias("items_delivered"),
        F.sum("items_missing").alias("items_missing"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
    ).withColumns(
        {
            "total_items": F.col("items_delivered") + F.col("items_missing"),
            "missing_rate": missing_rate("items_missing", "items_delivered"),
            "pct_orders_with_missing": F.col("orders_with_missing") / F.col("orders_completed") * 100.0,
            "avg_order_value": F.col("total_revenue") / F.col("orders_completed"),
        }
    )
    joined = drivers.join(stats, "driver_id", "left").fillna(0)
    return half_half_score(joined, "missing_rate", "pct_orders_with_missing")


def half_half_score(df: DataFrame, rate: str, share: str) -> DataFrame:
    """Two columns scaled by their maximum, 50 points each; 0 for all if either maximum is 0."""
    df = materialize(df)
    s = Scalars(df, rate=F.max(rate), share=F.max(share))
    score = F.when(
        (s.rate > 0) & (s.share > 0), max_scale(rate, s.rate, 50.0) + max_scale(share, s.share, 50.0)
    ).otherwise(F.lit(0.0))
    return s.detach(s.attach(df).withColumn("risk_score", score).withColumn("risk_category", risk_band("risk_score")))


def driver_monthly(orders: DataFrame) -> DataFrame:
    """D-10: driver by month of the year."""
    return (
        orders.groupBy(
            "driver_id",
            F.month("order_date").alias("month"),
            F.date_format("order_date", "MMMM").alias("month_name"),
        )
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("items_delivered").alias("items_delivered"),
            F.sum("items_missing").alias("items_missing"),
            money_sum("order_amount").alias("revenue"),
        )
        .withColumns(
            {
                "total_items": F.col("items_delivered") + F.col("items_missing"),
                "missing_rate": missing_rate("items_missing", "items_delivered"),
            }
        )
    )


def driver_primary_region(orders: DataFrame) -> DataFrame:
    """D-11: most frequent region of a driver, ties to the first name."""
    counted = orders.where(F.col("region").isNotNull()).groupBy("driver_id", "region").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("driver_id").agg(
        F.min_by("region", F.struct(-F.col("n"), F.col("region"))).alias("primary_region")
    )


def driver_snapshot(drivers: DataFrame, orders: DataFrame) -> DataFrame:
    """Active drivers with scores, primary region and a money proxy."""
    return (
        driver_risk_scores(driver_features(drivers, orders))
        .join(driver_primary_region(orders), "driver_id", "left")
        .withColumn("missing_value", F.col("total_items_missing") * ITEM_VALUE_USD)
        .where(F.col("total_orders") > 0)
    )


RADAR_METRICS = [
    "missing_rate",
    "pct_orders_with_missing",
    "total_items_missing",
    "avg_order_value",
    "total_orders",
]


def driver_profile_radar(features: DataFrame) -> DataFrame:
    """D-12: five metrics of each driver on a 0-100 scale beside the fleet mean."""
    features = materialize(features)
    aggs = {}
    for m in RADAR_METRICS:
        aggs |= {f"{m}_lo": F.min(m), f"{m}_hi": F.max(m), f"{m}_mean": F.avg(m)}
    out = []
    for m in RADAR_METRICS:
        lo, hi = F.col(f"_s.{m}_lo"), F.col(f"_s.{m}_hi")
        out.append(min_max(m, lo, hi, 0, 100.0).alias(f"{m}_norm"))
        out.append(min_max(f"_s.{m}_mean", lo, hi, 0, 100.0).alias(f"{m}_fleet"))
    return Scalars(features, **aggs).attach(features).select("driver_id", *out)


def driver_segments(snapshot: DataFrame, by: str) -> DataFrame:
    """D-13: drivers, missing value, mean rate and share of the total per band."""
    total = Scalars(snapshot, value=F.sum("missing_value"))
    return total.detach(
        total.attach(
            snapshot.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("drivers"),
            F.sum("missing_value").alias("missing_value"),
            F.avg("missing_rate").alias("missing_rate"),
        )).withColumn("missing_share", percent_of("missing_value", total.value))
    )
