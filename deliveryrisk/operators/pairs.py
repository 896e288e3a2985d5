"""Driver-customer pairs: interactions and signs of collusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import THRESHOLDS
from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.ranking import running_counts
from deliveryrisk.functions.scalar import Scalars, missing_rate, money_sum, rate_pct
from deliveryrisk.operators.drivers import has_missing


def with_both(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("driver_id").isNotNull() & F.col("customer_id").isNotNull())


def pair_interactions(orders: DataFrame) -> DataFrame:
    """X-1: orders, items and rate of each pair; orders without driver or customer belong to none.

    Rows that stand for several orders say so in a column ``interactions``.
    """
    n = F.sum("interactions") if "interactions" in orders.columns else F.count(F.lit(1))
    return (
        with_both(orders)
        .groupBy("driver_id", "customer_id")
        .agg(
            n.alias("interactions"),
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


def suspicious_pairs(pairs: DataFrame, drivers: DataFrame, customers: DataFrame) -> DataFrame:
    """X-2: more interactions than the mean and 1.5 times the mean rate, with names."""
    pairs = materialize(pairs)
    s = Scalars(pairs, n=F.avg("interactions"), rate=F.avg("missing_rate"))
    found = s.detach(
        s.attach(pairs).where((F.col("interactions") > s.n) & (F.col("missing_rate") > s.rate * 1.5))
    )
    return found.join(drivers.select("driver_id", "driver_name"), "driver_id", "left").join(
        customers.select("customer_id", "customer_name"), "customer_id", "left"
    )


def driver_customer_pairs(
    orders: DataFrame, drivers: DataFrame, customers: DataFrame, min_orders: int = 2
) -> DataFrame:
    """X-3: view of pairs that share at least ``min_orders`` orders; filtered before names are joined."""
    grouped = (
        with_both(orders)
        .groupBy("driver_id", "customer_id")
        .agg(
            F.count(F.lit(1)).alias("shared_orders"),
            F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
            F.sum("items_missing").alias("total_items_missing"),
            money_sum("order_amount").alias("total_order_value"),
        )
        .where(F.col("shared_orders") >= min_orders)
        .withColumn("missing_order_rate_pct", rate_pct("orders_with_missing", "shared_orders"))
    )
    return grouped.join(drivers.select("driver_id", "driver_name"), "driver_id").join(
        customers.select("customer_id", "customer_name"), "customer_id"
    )


def collusion_indicators(
    pairs: DataFrame, min_interactions: int = 3, rate_limit: float = THRESHOLDS.fraud_rate
) -> DataFrame:
    """X-4: pairs with enough orders and a high rate; the score is the rate, at most 100."""
    return (
        pairs.where((F.col("interactions") >= min_interactions) & (F.col("missing_rate") >= rate_limit))
        .withColumn("entity_id", F.concat_ws("_", "driver_id", "customer_id"))
        .withColumn("score", F.least("missing_rate", F.lit(100.0)))
        .select("entity_id", "driver_id", "customer_id", "interactions", "items_missing", "missing_rate", "score")
    )


def top_by_interactions(pairs: DataFrame, key: str, n: int) -> DataFrame:
    totals = pairs.groupBy(key).agg(F.sum("interactions").alias("_total"))
    return totals.orderBy(F.desc("_total"), key).limit(n).select(key)


def pair_heatmap(pairs: DataFrame, n: int = 15) -> DataFrame:
    """X-5: rates of the n busiest drivers with the n busiest customers, long form."""
    pairs = materialize(pairs)
    return (
        pairs.join(F.broadcast(top_by_interactions(pairs, "driver_id", n)), "driver_id", "left_semi")
        .join(F.broadcast(top_by_interactions(pairs, "customer_id", n)), "customer_id", "left_semi")
        .select("driver_id", "customer_id", "interactions", "missing_rate")
    )


def interaction_distribution(pairs: DataFrame) -> DataFrame:
    """X-6: pairs per interaction count, their share, and how many pairs have at least that many."""
    return running_counts(materialize(pairs), "interactions").select(
        "interactions",
        F.col("n").alias("pairs"),
        (F.col("n") / F.col("total") * 100.0).alias("pct_of_pairs"),
        (F.col("total") - F.col("below")).alias("pairs_at_least"),
    )
