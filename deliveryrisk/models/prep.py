"""Model input: the joined order data set and its standardisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.functions.ranking import quantiles
from deliveryrisk.operators.customers import customer_features
from deliveryrisk.operators.drivers import driver_features
from deliveryrisk.operators.features import order_features, temporal_features

# Columns the order models are trained on, and those that are monitored.
ORDER_MODEL_COLUMNS = [
    "order_amount",
    "items_delivered",
    "items_missing",
    "total_items",
    "missing_rate",
    "is_high_value",
    "is_weekend",
    "driver_age",
    "trips",
    "driver_missing_rate",
    "driver_total_orders",
    "customer_age",
    "customer_missing_rate",
    "customer_total_orders",
]
MONITORED_COLUMNS = [c for c in ORDER_MODEL_COLUMNS if c not in ("is_high_value", "is_weekend")]


def fraud_dataset(orders: DataFrame, drivers: DataFrame, customers: DataFrame) -> DataFrame:
    """M-0: order and calendar features with the history of driver and customer, and the target."""
    d = driver_features(drivers, orders).select(
        "driver_id",
        F.col("age").alias("driver_age"),
        "trips",
        F.col("missing_rate").alias("driver_missing_rate"),
        F.col("total_orders").alias("driver_total_orders"),
        F.col("pct_orders_with_missing").alias("driver_pct_orders_with_missing"),
        "experience_level",
    )
    c = customer_features(customers, orders).select(
        "customer_id",
        "customer_age",
        F.col("total_orders").alias("customer_total_orders"),
        F.col("missing_rate").alias("customer_missing_rate"),
        F.col("pct_orders_with_missing").alias("customer_pct_orders_with_missing"),
        "customer_segment",
    )
    return (
        temporal_features(order_features(orders))
        .join(d, "driver_id", "left")
        .join(c, "customer_id", "left")
        .withColumn("is_fraud_candidate", F.col("has_missing").cast("int"))
    )


@dataclass(frozen=True)
class Scaler:
    """Median imputation and standardisation with the population deviation."""

    columns: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        med = quantiles(numbers, {f"m{i}": (c, 0.5) for i, c in enumerate(columns)}).first()
        medians = [float(med[f"m{i}"] or 0.0) for i in range(len(columns))]
        filled = numbers.fillna(dict(zip(columns, medians)))
        stats = filled.agg(
            *[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        means = [float(stats[f"a{i}"]) for i in range(len(columns))]
        scales = [float(stats[f"s{i}"]) or 1.0 for i in range(len(columns))]
        return cls(tuple(columns), tuple(medians), tuple(means), tuple(scales))

    def standardized(self, column: str) -> Column:
        i = self.columns.index(column)
        return (F.coalesce(F.col(column).cast("double"), F.lit(self.medians[i])) - self.means[i]) / self.scales[i]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add the standardised columns as one array."""
        return df.withColumn(out, F.array(*[self.standardized(c) for c in self.columns]))
