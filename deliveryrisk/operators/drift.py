"""Change between an earlier and a later part of the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.ranking import running_counts
from deliveryrisk.functions.scalar import Scalars, missing_rate
from deliveryrisk.operators.stats import ks_two_sample

DRIFT_FEATURES = ["order_amount", "items_missing", "missing_rate"]
READ = ["order_id", "order_date", "order_amount", "items_missing", "items_delivered"]


def time_halves(orders: DataFrame) -> DataFrame:
    """M-1: mark the later half of the orders by (date, id); the first half is rounded down.

    The middle date comes from counts per date; only the orders of that one
    date are ranked by id.
    """
    orders = materialize(orders.withColumn("missing_rate", missing_rate("items_missing", "items_delivered")))
    half = F.floor(F.col("total") / 2)
    middle = Scalars(
        running_counts(orders, "order_date")
        .where((F.col("below") <= half) & (half < F.col("below") + F.col("n")))
        .select("order_date", (half - F.col("below")).alias("rest")),
        "_middle",
    )
    same_day = middle.attach(orders).where(F.col("order_date") == middle.order_date)
    first = Scalars(
        running_counts(same_day.select("order_id", middle.rest.alias("rest")), "order_id", tail=["rest"])
        .where(F.col("below") == F.col("rest"))
        .select("order_id"),
        "_first",
    )
    late = (F.col("order_date") > middle.order_date) | (
        (F.col("order_date") == middle.order_date) & (F.col("order_id") >= first.order_id)
    )
    marked = first.attach(middle.attach(orders)).withColumn("is_current", late)
    return first.detach(middle.detach(marked))


def months_split(orders: DataFrame, first_current_month) -> DataFrame:
    """M-1: mark the orders from a month on as current."""
    return orders.withColumns(
        {
            "missing_rate": missing_rate("items_missing", "items_delivered"),
            "is_current": F.col("order_date") >= F.lit(first_current_month).cast("date"),
        }
    )


def drift_table(split: DataFrame, features: list[str] = DRIFT_FEATURES) -> DataFrame:
    """M-1: two-sample KS, means, shift and status of every feature."""
    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in features])
    tall = split.select("is_current", F.explode(pairs).alias("e")).select(
        F.col("e.f").alias("feature"), F.col("e.v").alias("value"), "is_current"
    )
    means = tall.groupBy("feature").agg(
        F.avg(F.when(~F.col("is_current"), F.col("value"))).alias("ref_mean"),
        F.avg(F.when(F.col("is_current"), F.col("value"))).alias("curr_mean"),
    )
    p = F.col("p_value")
    return (
        ks_two_sample(tall, "value", "is_current", ["feature"])
        .join(means, "feature")
        .withColumns(
            {
                "shift_pct": F.when(
                    F.col("ref_mean") != 0, (F.col("curr_mean") - F.col("ref_mean")) / F.col("ref_mean") * 100.0
                ).otherwise(F.lit(0.0)),
                "is_drifting": p < 0.05,
                "status": F.when(p < 0.01, "Critical")
                .when(p < 0.05, "High")
                .when(p < 0.1, "Medium")
                .otherwise("Low"),
            }
        )
    )


def drift_by_halves(orders: DataFrame) -> DataFrame:
    return drift_table(time_halves(orders.select(*READ)))


def half_performance(orders: DataFrame) -> DataFrame:
    """M-1: share of orders with missing items before and after, stable within two points."""
    hit = (F.col("items_missing") > 0).cast("double") * 100.0
    ref, cur = F.col("reference_anomaly_rate"), F.col("current_anomaly_rate")
    return (
        time_halves(orders.select(*READ))
        .agg(
            F.avg(F.when(~F.col("is_current"), hit)).alias("reference_anomaly_rate"),
            F.avg(F.when(F.col("is_current"), hit)).alias("current_anomaly_rate"),
        )
        .withColumns(
            {
                "rate_change_pct": F.when(ref > 0, (cur - ref) / F.nullif(ref, F.lit(0.0)) * 100.0).otherwise(
                    F.lit(0.0)
                ),
                "status": F.when(F.abs(cur - ref) < 2, "Stable").otherwise("Degrading"),
            }
        )
    )
