"""Rule-based indicators, alerts, scores and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import RISK_LABELS, THRESHOLDS
from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.ranking import quantiles
from deliveryrisk.functions.scalar import Scalars, min_max, missing_rate, risk_band
from deliveryrisk.operators.drivers import has_missing
from deliveryrisk.operators.pairs import collusion_indicators, pair_interactions


FOLDED = ["total_orders", "items_missing", "items_delivered", "total_spent", "orders_with_missing"]


def fold_orders(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sums of the orders of each combination of keys."""
    return orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("items_missing").alias("items_missing"),
        F.sum("items_delivered").alias("items_delivered"),
        F.sum("order_amount").alias("total_spent"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
    )


def entity_stats(orders: DataFrame, key: str) -> DataFrame:
    """Counts and rates of the entities that have orders; orders without the key belong to none.

    Takes orders or their ``fold_orders`` by more keys.
    """
    known = orders.where(F.col(key).isNotNull())
    folded = set(FOLDED) <= set(orders.columns)
    sums = known.groupBy(key).agg(*[F.sum(c).alias(c) for c in FOLDED]) if folded else fold_orders(known, [key])
    return sums.withColumns(
        {
            "missing_rate": missing_rate("items_missing", "items_delivered"),
            "pct_orders_with_missing": F.col("orders_with_missing") / F.col("total_orders") * 100.0,
        }
    )


def _indicators(df: DataFrame, entity: str, key: str, name: str, rules: dict[str, tuple[Column, int, Column]]):
    """Sum the points of the rules that hold; details hold the value behind each one."""
    score = sum((F.when(cond, pts).otherwise(0) for cond, pts, _ in rules.values()), F.lit(0))
    facts = F.array(
        *[
            F.when(cond, F.struct(F.lit(rule).alias("key"), value.cast("double").alias("value")))
            for rule, (cond, _, value) in rules.items()
        ]
    )
    return (
        df.withColumn("score", F.least(score, F.lit(100)).cast("double"))
        .where(F.col("score") > 0)
        .select(
            F.lit(entity).alias("entity_type"),
            F.col(key).cast("string").alias("entity_id"),
            F.lit(name).alias("indicator_name"),
            "score",
            F.map_from_entries(F.array_compact(facts)).alias("details"),
        )
    )


def driver_indicators(orders: DataFrame, k: float = THRESHOLDS.anomaly_std) -> DataFrame:
    """R-1: 40 points for rate, 35 for share of orders, 25 for volume above the 95th percentile."""
    stats = materialize(entity_stats(orders, "driver_id"))
    s = Scalars(
        stats,
        rate=F.avg("missing_rate") + k * F.stddev_samp("missing_rate"),
        share=F.avg("pct_orders_with_missing") + k * F.stddev_samp("pct_orders_with_missing"),
    )
    q = Scalars(quantiles(stats, {"p95": ("items_missing", 0.95)}), "_q")
    rate, share, volume = F.col("missing_rate"), F.col("pct_orders_with_missing"), F.col("items_missing")
    return _indicators(
        q.attach(s.attach(stats)),
        "driver",
        "driver_id",
        "suspicious_driver_pattern",
        {
            "missing_rate_anomaly": (rate > s.rate, 40, rate),
            "pct_orders_anomaly": (share > s.share, 35, share),
            "volume_anomaly": (volume > q.p95, 25, volume),
        },
    )


def customer_indicators(orders: DataFrame, k: float = 2.0) -> DataFrame:
    """R-2: 35 points for rate, 40 for always claiming, 25 for high spend with a high rate."""
    stats = materialize(entity_stats(orders, "customer_id"))
    s = Scalars(stats, mean=F.avg("missing_rate"), std=F.stddev_samp("missing_rate"))
    q = Scalars(quantiles(stats, {"p75": ("total_spent", 0.75)}), "_q")
    rate = F.col("missing_rate")
    return _indicators(
        q.attach(s.attach(stats.where(F.col("total_orders") >= 2))),
        "customer",
        "customer_id",
        "suspicious_customer_pattern",
        {
            "missing_rate_anomaly": (rate > s.mean + k * s.std, 35, rate),
            "consistent_reporting": (
                (F.col("pct_orders_with_missing") == 100) & (F.col("total_orders") >= 3),
                40,
                F.col("total_orders"),
            ),
            "high_value_pattern": (
                (F.col("total_spent") > q.p75) & (rate > s.mean * 1.5),
                25,
                F.col("total_spent"),
            ),
        },
    )


def region_indicators(orders: DataFrame, k: float = 2.0) -> DataFrame:
    """R-3: regions above mean + k deviations; the score is the rate."""
    stats = entity_stats(orders, "region")
    s = Scalars(stats, mean=F.avg("missing_rate"), std=F.stddev_samp("missing_rate"))
    limit = s.mean + k * s.std
    details = F.create_map(
        F.lit("missing_rate"),
        F.col("missing_rate"),
        F.lit("threshold"),
        limit,
        F.lit("items_missing"),
        F.col("items_missing").cast("double"),
    )
    return (
        s.attach(stats)
        .where(F.col("missing_rate") > limit)
        .select(
            F.lit("region").alias("entity_type"),
            F.col("region").alias("entity_id"),
            F.lit("high_risk_region").alias("indicator_name"),
            F.least("missing_rate", F.lit(100.0)).alias("score"),
            details.alias("details"),
        )
    )


def pair_indicators(collusion: DataFrame) -> DataFrame:
    """X-4 in the common shape of the indicators."""
    details = F.create_map(
        F.lit("interactions"),
        F.col("interactions").cast("double"),
        F.lit("missing_rate"),
        F.col("missing_rate"),
        F.lit("items_missing"),
        F.col("items_missing").cast("double"),
    )
    return collusion.select(
        F.lit("pair").alias("entity_type"),
        "entity_id",
        F.lit("potential_collusion").alias("indicator_name"),
        "score",
        details.alias("details"),
    )


def all_indicators(orders: DataFrame, k: float = THRESHOLDS.anomaly_std) -> DataFrame:
    """R-4: indicators of all four detectors, from orders folded once by driver, customer and region."""
    folded = materialize(fold_orders(orders, ["driver_id", "customer_id", "region"]))
    pairs = pair_interactions(folded.withColumnRenamed("total_orders", "interactions"))
    parts = {
        "driver_patterns": driver_indicators(folded, k),
        "customer_patterns": customer_indicators(folded, k),
        "collusion_patterns": pair_indicators(collusion_indicators(pairs)),
        "regional_patterns": region_indicators(folded, k),
    }
    return reduce(
        DataFrame.unionByName, [df.withColumn("pattern_type", F.lit(name)) for name, df in parts.items()]
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def fraud_report(indicators: DataFrame) -> DataFrame:
    """R-5: every indicator with its risk level."""
    return indicators.withColumn("risk_level", risk_level(F.col("score")))


def fraud_report_counts(report: DataFrame) -> DataFrame:
    """R-5: indicators by type and level with subtotals and the total."""
    return report.rollup("pattern_type", "risk_level").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("indicators")
    )


# Advice texts of the alerts.
ALERT_ADVICE = {
    "Driver": "Review delivery patterns and consider audit",
    "Customer": "Verify claims and consider enhanced verification",
    "Region": "Investigate regional patterns and driver assignments",
}


def risk_alerts(
    drivers: DataFrame,
    customers: DataFrame,
    regional: DataFrame,
    threshold: float = THRESHOLDS.alert,
    geographic_rank: float = THRESHOLDS.geographic_rank,
) -> DataFrame:
    """R-6: drivers and customers at the threshold, regions above a share of the mean rate."""

    def rows(df, kind, key, name, score, band, first, second):
        return df.select(
            F.lit(kind).alias("entity_type"),
            F.col(key).cast("string").alias("entity_id"),
            F.col(name).alias("entity_name"),
            score.alias("risk_score"),
            band.alias("risk_category"),
            F.format_string(f"{first[0]}: %.2f%%", F.bround(first[1], 2)).alias("primary_metric"),
            F.format_string(f"{second[0]}: %d", F.col(second[1])).alias("secondary_metric"),
            F.lit(ALERT_ADVICE[kind]).alias("recommendation"),
        )

    high = F.col("risk_score") >= threshold
    mean = Scalars(regional, m=F.avg("missing_rate"))
    rate = F.col("missing_rate")
    hot = mean.attach(regional).where(rate > mean.m * (geographic_rank / 100.0))
    score, band = F.col("risk_score"), F.col("risk_category")
    return (
        rows(
            drivers.where(high),
            "Driver",
            "driver_id",
            "driver_name",
            score,
            band,
            ("Missing rate", rate),
            ("Orders with issues", "orders_with_missing"),
        )
        .union(
            rows(
                customers.where(high),
                "Customer",
                "customer_id",
                "customer_name",
                score,
                band,
                ("Claim rate", F.col("claim_rate")),
                ("Orders with claims", "orders_with_claims"),
            )
        )
        .union(
            rows(
                hot,
                "Region",
                "region",
                "region",
                rate,
                F.when(rate > mean.m * 1.5, "High").otherwise("Medium"),
                ("Missing rate", rate),
                ("Items missing", "items_missing"),
            )
        )
    )


def top_suspicious(drivers: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    """R-8: the n highest scores of drivers and of customers."""

    def top(df, kind, key, name, orders, rate, share):
        return (
            df.orderBy(F.desc("risk_score"), key)
            .limit(n)
            .select(
                F.lit(kind).alias("entity_type"),
                F.col(key).alias("entity_id"),
                F.col(name).alias("entity_name"),
                F.col(orders).alias("orders"),
                F.col(rate).alias("missing_rate"),
                F.col(share).alias("pct_orders"),
                "risk_score",
                "risk_category",
            )
        )

    return top(
        drivers, "Driver", "driver_id", "driver_name", "orders_completed", "missing_rate", "pct_orders_with_missing"
    ).union(
        top(
            customers,
            "Customer",
            "customer_id",
            "customer_name",
            "total_orders",
            "claim_rate",
            "pct_orders_with_claims",
        )
    )


def risk_distribution(drivers: DataFrame, customers: DataFrame) -> DataFrame:
    """R-9: entities per band; every band is present."""
    counts = reduce(
        DataFrame.union,
        [
            df.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("entity_type"), "*")
            for kind, df in (("driver", drivers), ("customer", customers))
        ],
    )
    bands = counts.sparkSession.createDataFrame(
        [(kind, band) for kind in ("driver", "customer") for band in RISK_LABELS],
        "entity_type string, risk_category string",
    )
    return bands.join(counts, ["entity_type", "risk_category"], "left").fillna(0, ["n"])


# Text of the dominant detector, in order of precedence on equal counts.
DOMINANT_TEXT = {
    "driver_patterns": "Driver-linked signals dominate",
    "customer_patterns": "Customer-linked signals dominate",
    "collusion_patterns": "Network collusion signals dominate",
    "regional_patterns": "Regional hotspot signals dominate",
}


def behavior_snapshot(indicators: DataFrame) -> DataFrame:
    """R-10: findings per detector and the dominant one."""
    kinds = list(DOMINANT_TEXT)
    counts = indicators.agg(
        *[F.count(F.when(F.col("pattern_type") == k, 1)).alias(k) for k in kinds],
        F.count(F.lit(1)).alias("total_findings"),
    )
    most = F.greatest(*kinds)
    label = F.coalesce(
        *[F.when((F.col(k) == most) & (most > 0), F.lit(DOMINANT_TEXT[k])) for k in kinds],
        F.lit("No dominant entity signal"),
    )
    return counts.withColumn("dominant", label)


def simple_entity_risk(features: DataFrame) -> DataFrame:
    """R-11: rate and share of orders, min-max scaled, half each."""
    features = materialize(features)
    a, b = "missing_rate", "pct_orders_with_missing"
    s = Scalars(features, alo=F.min(a), ahi=F.max(a), blo=F.min(b), bhi=F.max(b))
    scored = s.attach(features).withColumns(
        {
            "missing_rate_score": min_max(a, s.alo, s.ahi, 50.0, 100.0),
            "pct_orders_score": min_max(b, s.blo, s.bhi, 50.0, 100.0),
        }
    )
    return s.detach(scored).withColumn(
        "risk_score", F.col("missing_rate_score") * 0.5 + F.col("pct_orders_score") * 0.5
    ).withColumn("risk_category", risk_band("risk_score"))


def score_entities(features: DataFrame, entity: str, key: str, factors: dict[str, tuple[str, float]]) -> DataFrame:
    """R-12: 0-100 factors with weights, left-closed bands; the factors stay as a struct."""
    features = materialize(features)
    bounds = {}
    for name, (c, _) in factors.items():
        bounds[f"{name}_lo"], bounds[f"{name}_hi"] = F.min(c), F.max(c)
    s = Scalars(features, **bounds)
    scaled = {
        name: min_max(c, getattr(s, f"{name}_lo"), getattr(s, f"{name}_hi"), 50.0, 100.0)
        for name, (c, _) in factors.items()
    }
    packed = s.attach(features).select(
        F.lit(entity).alias("entity_type"),
        F.col(key).cast("string").alias("entity_id"),
        F.struct(*[c.alias(n) for n, c in scaled.items()]).alias("factors"),
    )
    total = sum((F.col(f"factors.{n}") * w for n, (_, w) in factors.items()), F.lit(0.0))
    return packed.withColumn("score", F.least(total, F.lit(100.0))).withColumn(
        "category", risk_band("score", "threshold")
    )


DRIVER_FACTORS = {
    "missing_rate": ("missing_rate", 0.40),
    "pct_orders_with_issues": ("pct_orders_with_missing", 0.35),
    "volume_missing": ("total_items_missing", 0.25),
}
CUSTOMER_FACTORS = {
    "missing_rate": ("missing_rate", 0.40),
    "pct_orders_with_issues": ("pct_orders_with_missing", 0.35),
    "issue_frequency": ("orders_with_missing", 0.25),
}


def score_drivers(features: DataFrame) -> DataFrame:
    return score_entities(features, "driver", "driver_id", DRIVER_FACTORS)


def score_customers(features: DataFrame) -> DataFrame:
    return score_entities(features, "customer", "customer_id", CUSTOMER_FACTORS)


def risk_report(scores: DataFrame) -> DataFrame:
    """R-13: factors as columns."""
    names = scores.schema["factors"].dataType.names
    return scores.select(
        "entity_type",
        "entity_id",
        F.col("score").alias("risk_score"),
        F.col("category").alias("risk_category"),
        *[F.col(f"factors.{n}").alias(f"factor_{n}") for n in names],
    )


def high_risk_scores(scores: DataFrame, threshold: float = THRESHOLDS.high) -> DataFrame:
    """R-13."""
    return scores.where(F.col("score") >= threshold)


def overall_report(
    statistics: DataFrame, report: DataFrame, extremes: DataFrame, temporal: DataFrame, n: int = 20
) -> DataFrame:
    """R-7: one JSON document; every list in it is a top-n or one row per region.

    Holds the number of indicators by level and the first ``n`` high-risk
    indicators of all types, highest score first.
    """
    level = F.col("risk_level")
    counts = report.agg(
        F.count(F.lit(1)).alias("total_indicators"),
        *[F.count(F.when(level == x, 1)).alias(f"{x}_risk_count") for x in ("high", "medium", "low")],
    )
    top = (
        report.where(level == "high")
        .orderBy(F.desc("score"), "pattern_type", "entity_id")
        .limit(n)
        .select("pattern_type", "entity_type", "entity_id", "indicator_name", "score")
    )

    def one(df):
        return df.select(F.struct("*")).scalar()

    def many(df):
        return df.agg(F.collect_list(F.struct("*"))).scalar()

    doc = statistics.select(
        F.struct("*").alias("overall"),
        one(counts).alias("fraud"),
        many(extremes).alias("regions"),
        one(temporal).alias("temporal"),
        many(top).alias("high_risk_entities"),
    )
    return doc.select(F.to_json(F.struct("*")).alias("report"))
