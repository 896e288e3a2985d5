"""Per-customer features, risk, behaviour and case handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import (
    CUSTOMER_AGE_EDGES,
    CUSTOMER_AGE_LABELS,
    ITEM_VALUE_USD,
    QUARTILE_SEGMENTS,
    RISK_LABELS,
    SLA_BY_RISK,
    SPEND_EDGES,
    SPEND_LABELS,
)
from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.ranking import quantile, quantiles
from deliveryrisk.functions.scalar import (
    Scalars,
    bucketize,
    clip,
    lookup,
    min_max,
    missing_rate,
    money_sum,
    percent_of,
    risk_band,
    round_half_up,
)
from deliveryrisk.operators.drivers import (
    has_missing,
    fraud_metrics_base,
    fraud_score_columns,
    half_half_score,
    order_stats,
    suspicious_entities,
    weighted_risk,
)

FILLED = [
    "total_orders",
    "total_spent",
    "avg_order_value",
    "total_items_delivered",
    "total_items_missing",
    "total_items_ordered",
    "missing_rate",
    "orders_with_missing",
    "pct_orders_with_missing",
]


def customer_features(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """C-1: history of every customer with age band and quartile spend segment."""
    stats = (
        order_stats(orders, "customer_id")
        .withColumnRenamed("total_revenue", "total_spent")
        .withColumn("total_items_ordered", F.col("total_items_delivered") + F.col("total_items_missing"))
    )
    joined = materialize(
        customers.join(stats, "customer_id", "left")
        .fillna(0, FILLED)
        .withColumn("age_group", bucketize("customer_age", CUSTOMER_AGE_EDGES, CUSTOMER_AGE_LABELS))
    )
    spent = "total_spent"
    s = Scalars(quantiles(joined, {"q1": (spent, 0.25), "q2": (spent, 0.5), "q3": (spent, 0.75)}))
    segment = bucketize(spent, [-1, s.q1, s.q2, s.q3, None], QUARTILE_SEGMENTS)
    return s.detach(s.attach(joined).withColumn("customer_segment", segment))


def customer_risk_scores(features: DataFrame) -> DataFrame:
    """C-2: 40/35/25 weighting of rate, share of orders and frequency."""
    return weighted_risk(
        features,
        {
            "missing_rate_score": ("missing_rate", 0.40),
            "pct_orders_score": ("pct_orders_with_missing", 0.35),
            "frequency_score": ("orders_with_missing", 0.25),
        },
    ).withColumn("risk_category", risk_band("risk_score"))


def suspicious_customers(features: DataFrame, rate_limit: float = 30.0, min_orders: int = 3) -> DataFrame:
    """C-3."""
    return suspicious_entities(features, rate_limit, min_orders)


def customer_patterns(features: DataFrame) -> DataFrame:
    """C-4: portfolio counts."""
    features = materialize(features)
    median = quantile(features, "missing_rate", 0.5)
    issue = F.col("orders_with_missing") > 0
    return features.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count(F.when(issue, 1)).alias("customers_with_issues"),
        (F.avg(issue.cast("double")) * 100.0).alias("pct_customers_with_issues"),
        F.avg("missing_rate").alias("avg_missing_rate"),
        F.count(F.when(F.col("orders_with_missing") > 1, 1)).alias("repeat_offenders"),
    ).withColumn("median_missing_rate", median)


def customer_patterns_by(features: DataFrame, by: str) -> DataFrame:
    """C-4, C-17: rate, spend and issue totals by age band or spend segment."""
    return features.groupBy(by).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("missing_rate").alias("avg_missing_rate"),
        F.sum("total_spent").alias("total_spent"),
        F.sum("orders_with_missing").alias("total_issues"),
        F.sum("total_items_missing").alias("total_missing"),
    )


def customer_fraud_metrics(
    customers: DataFrame, orders: DataFrame, missing_items: DataFrame, products: DataFrame
) -> DataFrame:
    """C-5: view with missing value, distinct missing products and first and last order."""
    base = fraud_metrics_base(
        customers,
        orders,
        "customer_id",
        (F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date")),
    )
    # Fold to one row per customer and product first: a hot customer then
    # costs at most one row per product.
    per_product = (
        missing_items.groupBy("order_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(orders.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id", "product_id")
        .agg(F.sum("n").alias("n"))
        .join(products.select("product_id", "price"), "product_id")
    )
    value = per_product.groupBy("customer_id").agg(
        F.sum(F.col("n") * F.col("price")).alias("total_missing_value"),
        F.count(F.lit(1)).alias("unique_missing_products"),
    )
    joined = base.join(value, "customer_id", "left").fillna(0, ["total_missing_value", "unique_missing_products"])
    return fraud_score_columns(joined).withColumns(
        {"total_order_value": round_half_up("total_order_value", 2), "avg_order_value": round_half_up("avg_order_value", 2)}
    )


def customer_fraud_stats(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """C-6: older view with the rate on total items."""
    stats = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("items_missing").alias("total_items_missing"),
        money_sum("order_amount").alias("total_spent"),
        F.sum("items_delivered").alias("_delivered"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
    )
    rate = F.round(F.coalesce(missing_rate("total_items_missing", "_delivered"), F.lit(0.0)), 2)
    return (
        customers.join(stats, "customer_id", "left")
        .fillna(0, ["total_orders", "orders_with_missing"])
        .withColumn("missing_rate_pct", rate)
        .drop("_delivered")
    )


def customer_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """C-8: claim rates, 50/50 score and fixed spend segment."""
    stats = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum("order_amount").alias("total_spent"),
        F.sum("items_delivered").alias("items_received"),
        F.sum("items_missing").alias("items_reported_missing"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_claims"),
    ).withColumns(
        {
            "total_items": F.col("items_received") + F.col("items_reported_missing"),
            "claim_rate": missing_rate("items_reported_missing", "items_received"),
            "pct_orders_with_claims": F.col("orders_with_claims") / F.col("total_orders") * 100.0,
            "avg_order_value": F.col("total_spent") / F.col("total_orders"),
        }
    )
    joined = customers.join(stats, "customer_id", "left").fillna(0)
    return half_half_score(joined, "claim_rate", "pct_orders_with_claims").withColumn(
        "spending_segment", bucketize("total_spent", SPEND_EDGES, SPEND_LABELS)
    )


def customer_activity(orders: DataFrame) -> DataFrame:
    """C-9: first and last order, active days, distinct drivers and regions."""
    return (
        orders.groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
            F.count_distinct("driver_id").alias("unique_drivers"),
            F.count_distinct("region").alias("unique_regions"),
        )
        .withColumn("active_days", F.datediff("last_order_date", "first_order_date") + 1)
    )


# Behaviour signatures in rank order.
SIGNATURES = ["Always Claiming", "High-Value Opportunist", "Chronic Reporter", "Emerging Risk", "Baseline Pattern"]


def behavior_signature(summary: DataFrame) -> DataFrame:
    """C-10: first matching behaviour; limits are a quantile or a floor, whichever is larger."""
    summary = materialize(summary)
    q = Scalars(
        quantiles(
            summary,
            {
                "rate": ("claim_rate", 0.85),
                "share": ("pct_orders_with_claims", 0.80),
                "value": ("avg_order_value", 0.75),
                "claims": ("orders_with_claims", 0.80),
            },
        )
    )
    rate, share = F.col("claim_rate"), F.col("pct_orders_with_claims")
    claims, n = F.col("orders_with_claims"), F.col("total_orders")
    rules: list[tuple[Column, str]] = [
        ((share >= 80) & (n >= 3), SIGNATURES[0]),
        (
            (rate >= F.greatest(F.lit(8.0), q.rate))
            & (share >= F.greatest(F.lit(35.0), q.share))
            & (F.col("avg_order_value") >= F.greatest(F.lit(120.0), q.value))
            & (claims >= 2),
            SIGNATURES[1],
        ),
        ((claims >= F.greatest(F.lit(2), q.claims.cast("int"))) & (n >= 4), SIGNATURES[2]),
        ((F.col("risk_score") >= 60) & (n < 4), SIGNATURES[3]),
    ]
    label = F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules], F.lit(SIGNATURES[4]))
    rank = F.array_position(F.array(*[F.lit(s) for s in SIGNATURES]), F.col("behavior_signature")).cast("int")
    return q.detach(q.attach(summary).withColumn("behavior_signature", label).withColumn("signature_rank", rank))


def case_priority(summary: DataFrame) -> DataFrame:
    """C-11: 50/20/15/15 weighting of risk, claim share, spend and claim count."""
    summary = materialize(summary)
    s = Scalars(
        summary,
        spend_lo=F.min("total_spent"),
        spend_hi=F.max("total_spent"),
        claim_lo=F.min("orders_with_claims"),
        claim_hi=F.max("orders_with_claims"),
    )
    spend = min_max("total_spent", s.spend_lo, s.spend_hi, 0.0, 100.0)
    claims = min_max("orders_with_claims", s.claim_lo, s.claim_hi, 0.0, 100.0)
    score = F.col("risk_score") * 0.50 + F.col("pct_orders_with_claims") * 0.20 + spend * 0.15 + claims * 0.15
    return s.detach(s.attach(summary).withColumn("priority_score", clip(score, 0, 100))).withColumn(
        "priority_tier",
        bucketize("priority_score", [-1, 35, 60, 80, 100], ["Monitor", "Review", "Fast Track", "Immediate"]),
    )


def customer_workspace(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Summary, activity, behaviour and priority of every customer."""
    judged = case_priority(behavior_signature(customer_summary(customers, orders)))
    return judged.join(customer_activity(orders), "customer_id", "left").fillna(
        0, ["active_days", "unique_drivers", "unique_regions"]
    )


def case_queue(prioritized: DataFrame, top_n: int = 12) -> DataFrame:
    """C-12: the first cases by priority, risk, claim count and claim rate, with time targets."""
    order = [F.desc(c) for c in ("priority_score", "risk_score", "orders_with_claims", "claim_rate")]
    return (
        prioritized.orderBy(*order, "customer_id")
        .limit(top_n)
        .withColumn("sla", lookup("risk_category", SLA_BY_RISK, "72h"))
    )


def segment_matrix(summary: DataFrame) -> DataFrame:
    """C-13: customers by spend segment and risk band, zero filled."""
    return (
        summary.groupBy("spending_segment")
        .pivot("risk_category", RISK_LABELS)
        .agg(F.count(F.lit(1)))
        .fillna(0)
    )


def customer_monthly(orders: DataFrame) -> DataFrame:
    """C-14: monthly orders and claims of every customer."""
    return (
        orders.groupBy("customer_id", F.trunc("order_date", "month").alias("month_date"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count(F.when(has_missing(), 1)).alias("claim_orders"),
            F.sum("items_missing").alias("items_missing"),
            F.sum(F.col("items_delivered") + F.col("items_missing")).alias("total_items"),
            money_sum("order_amount").alias("revenue"),
        )
        .withColumns(
            {
                "claim_rate": percent_of("items_missing", "total_items"),
                "claim_order_rate": percent_of("claim_orders", "orders"),
            }
        )
    )


def driver_links(orders: DataFrame, driver_summary: DataFrame, customer_summary: DataFrame) -> DataFrame:
    """C-15: drivers linked to each customer, their risk gap and link status."""
    known_keys = F.col("customer_id").isNotNull() & F.col("driver_id").isNotNull()
    links = orders.where(known_keys).groupBy("customer_id", "driver_id").agg(
        F.count(F.lit(1)).alias("interactions"),
        F.sum("items_missing").alias("items_missing"),
        F.sum(F.col("items_delivered") + F.col("items_missing")).alias("total_items"),
        F.max("order_date").alias("last_order"),
    )
    known = driver_summary.select(
        "driver_id",
        "driver_name",
        F.col("risk_category").alias("driver_risk_category"),
        F.col("risk_score").alias("driver_risk_score"),
        F.col("missing_rate").alias("driver_missing_rate"),
    )
    score = customer_summary.select("customer_id", F.col("risk_score").alias("_customer_score"))
    joined = (
        links.withColumn("pair_missing_rate", percent_of("items_missing", "total_items"))
        .join(known, "driver_id", "left")
        .join(score, "customer_id", "left")
        .withColumns(
            {
                "driver_name": F.coalesce("driver_name", F.col("driver_id").cast("string")),
                "driver_risk_category": F.coalesce("driver_risk_category", F.lit("Low")),
                "driver_risk_score": F.coalesce("driver_risk_score", F.lit(0.0)),
            }
        )
    )
    n, rate = F.col("interactions"), F.col("pair_missing_rate")
    high = (n >= 3) & (rate >= 20.0) & F.col("driver_risk_category").isin("High", "Critical")
    watch = (n >= 2) & (rate >= 10.0)
    return joined.withColumns(
        {
            "risk_gap": F.round(F.col("driver_risk_score") - F.coalesce("_customer_score", F.lit(0.0)), 2),
            "link_status": F.when(high, "High Link Risk").when(watch, "Watch Link").otherwise("Low Link Risk"),
            "sla_hours": F.when(high, "24h").when(watch, "48h").otherwise("72h"),
            "period_label": F.date_format("last_order", "yyyy-MM"),
        }
    ).drop("_customer_score")


# Texts of the recommended actions.
PRIMARY_ACTIONS = {
    "Immediate": "Manual claim validation + proof-of-delivery required.",
    "Fast Track": "Apply selective friction: one-time PIN on high-value orders.",
    "Review": "Monitor next 3 orders and trigger alert if another claim appears.",
}
PRIMARY_DEFAULT = "Standard monitoring only."
LINK_ACTION = "Audit repeated customer-driver pairs with high missing rates."
SIGNATURE_ACTIONS = {
    "High-Value Opportunist": "Prioritize basket-level review on premium products.",
    "Chronic Reporter": "Run behavioral interview workflow before refunds.",
}
SECONDARY_DEFAULT = "No collusion signal; keep baseline control policy."


def case_actions(prioritized: DataFrame, links: DataFrame) -> DataFrame:
    """C-16: action texts from tier, risky links and behaviour."""
    risky = (
        links.where(F.col("link_status") == "High Link Risk").select("customer_id").distinct().withColumn("_hot", F.lit(True))
    )
    return (
        prioritized.join(risky, "customer_id", "left")
        .select(
            "customer_id",
            "priority_tier",
            "behavior_signature",
            lookup("priority_tier", PRIMARY_ACTIONS, PRIMARY_DEFAULT).alias("primary_action"),
            F.when(F.col("_hot"), LINK_ACTION)
            .otherwise(lookup("behavior_signature", SIGNATURE_ACTIONS, SECONDARY_DEFAULT))
            .alias("secondary_action"),
        )
    )


def customer_kpis(prioritized: DataFrame) -> DataFrame:
    """C-18: head-line numbers of a customer scope."""
    prioritized = materialize(prioritized)
    p75 = quantile(prioritized, "avg_order_value", 0.75)
    return prioritized.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count(F.when(F.col("risk_category") == "Critical", 1)).alias("critical_count"),
        F.count(F.when(F.col("orders_with_claims") >= 3, 1)).alias("repeat_count"),
        F.coalesce(F.avg("claim_rate"), F.lit(0.0)).alias("avg_claim_rate"),
        F.coalesce(F.sum("items_reported_missing") * ITEM_VALUE_USD, F.lit(0.0)).alias("exposure_usd"),
    ).withColumn("p75_order_value", p75)
