"""Ensembles, order scoring, consensus, monitoring and retraining decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.scalar import Scalars, min_max, missing_rate, risk_band, safe_corr
from deliveryrisk.models.iforest import IsolationForest
from deliveryrisk.models.kmeans import FraudKMeans
from deliveryrisk.operators.stats import ks_two_sample


def ensemble_outlier(scored: dict[str, DataFrame], min_votes: int | None = None) -> DataFrame:
    """M-5: mean of the min-max scaled scores and a vote; by default every model must agree.

    Each input has id, score (lower is more anomalous) and prediction.
    """
    need = min_votes if min_votes is not None else len(scored)
    joined = None
    for name, df in scored.items():
        part = materialize(df.select("id", F.col("score").alias(f"{name}_score"), F.col("prediction").alias(name)))
        joined = part if joined is None else joined.join(part, "id")
    joined = materialize(joined)
    bounds = {}
    for name in scored:
        bounds[f"{name}_lo"], bounds[f"{name}_hi"] = F.min(f"{name}_score"), F.max(f"{name}_score")
    s = Scalars(joined, **bounds)
    scaled = [
        min_max(f"{n}_score", getattr(s, f"{n}_lo"), getattr(s, f"{n}_hi"), 0.5) for n in scored
    ]
    votes = sum((F.when(F.col(n) == -1, 1).otherwise(0) for n in scored), F.lit(0))
    return s.detach(
        s.attach(joined).withColumns(
            {
                "score": sum(scaled, F.lit(0.0)) / float(len(scaled)),
                "prediction": F.when(votes >= need, -1).otherwise(1),
            }
        )
    )


# Weights of the order score.
ORDER_WEIGHTS = {"missing_rate": 0.25, "anomaly_score": 0.25, "cluster_distance": 0.15}


def score_orders(orders: DataFrame, ensemble: DataFrame, clustered: DataFrame, legacy_scale: bool = False) -> DataFrame:
    """M-10: rate, anomaly and cluster distance as 0-100 factors, divided by the weights used.

    ``legacy_scale`` multiplies the result by 100 once more before the cap.
    """
    joined = materialize(
        orders.select("order_id", missing_rate("items_missing", "items_delivered").alias("_rate"))
        .join(ensemble.select(F.col("id").alias("order_id"), (1.0 - F.col("score")).alias("_anomaly")), "order_id")
        .join(clustered.select("order_id", F.col("cluster_distance").alias("_distance")), "order_id")
    )
    source = {"missing_rate": "_rate", "anomaly_score": "_anomaly", "cluster_distance": "_distance"}
    bounds = {}
    for name, c in source.items():
        bounds[f"{name}_lo"], bounds[f"{name}_hi"] = F.min(c), F.max(c)
    s = Scalars(joined, **bounds)
    factors = {
        n: min_max(c, getattr(s, f"{n}_lo"), getattr(s, f"{n}_hi"), 50.0, 100.0) for n, c in source.items()
    }
    total = sum((F.col(n) * w for n, w in ORDER_WEIGHTS.items()), F.lit(0.0)) / sum(ORDER_WEIGHTS.values())
    score = F.least(total * (100.0 if legacy_scale else 1.0), F.lit(100.0))
    return (
        s.attach(joined)
        .select("order_id", *[c.alias(n) for n, c in factors.items()])
        .withColumn("risk_score", score)
        .withColumn("risk_category", risk_band("risk_score", "threshold"))
    )


def vote(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M-11: sum of the labels below 0 means anomaly."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    return joined.withColumn("prediction", F.when(total < 0, -1).otherwise(1))


def predict_with_details(ensemble: DataFrame, clustered: DataFrame, id_column: str) -> DataFrame:
    """M-11: anomaly flag and score, cluster, distance and band of every row."""
    return (
        ensemble.select(
            F.col("id").alias(id_column),
            (F.col("prediction") == -1).alias("is_anomaly"),
            ((1.0 - F.col("score")) * 100.0).alias("anomaly_score"),
        )
        .join(clustered.select(id_column, "cluster", "cluster_distance"), id_column)
        .withColumn("risk_category", risk_band("anomaly_score"))
    )


def consensus(flags: DataFrame, methods: Sequence[str], min_votes: int = 2) -> DataFrame:
    """M-12: votes per row over boolean method columns."""
    votes = sum((F.col(m).cast("int") for m in methods), F.lit(0))
    return flags.withColumn("anomaly_votes", votes).withColumn("is_consensus", F.col("anomaly_votes") >= min_votes)


def consensus_summary(votes: DataFrame) -> DataFrame:
    """M-12: rows per vote count."""
    return votes.groupBy("anomaly_votes").agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg("missing_rate").alias("avg_missing_rate"),
        (F.avg(F.col("has_missing").cast("double")) * 100.0).alias("pct_with_missing"),
        F.avg("order_amount").alias("avg_order_amount"),
    )


def method_comparison(flags: DataFrame, methods: Sequence[str]) -> DataFrame:
    """M-12: what each method flags, in one pass."""
    tall = flags.select(
        "missing_rate",
        "has_missing",
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("hit")) for m in methods])).alias("e"),
    )
    hit = F.col("e.hit")
    return tall.groupBy(F.col("e.method").alias("method")).agg(
        F.count(F.when(hit, 1)).alias("anomalies"),
        (F.avg(hit.cast("double")) * 100.0).alias("anomaly_rate_pct"),
        F.avg(F.when(hit, F.col("missing_rate"))).alias("avg_missing_rate"),
        (F.avg(F.when(hit, F.col("has_missing").cast("double"))) * 100.0).alias("pct_with_missing"),
    )


def feature_importance(flags: DataFrame, columns: Sequence[str], targets: Sequence[str], kmeans: FraudKMeans) -> DataFrame:
    """M-13: mean absolute correlation with the flags and scaled variance of the cluster centres."""
    import numpy as np

    stats = flags.agg(
        *[safe_corr(c, F.col(t).cast("double")).alias(f"{c}|{t}") for c in columns for t in targets]
    )
    spread = np.var(np.array(kmeans.model.clusterCenters()), axis=0)
    span = (spread.max() - spread.min()) or 1.0
    scaled = (spread - spread.min()) / span * 100.0
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(float(scaled[i])).alias("cluster_importance"),
            (
                sum((F.abs(F.coalesce(F.col(f"`{c}|{t}`"), F.lit(0.0))) for t in targets), F.lit(0.0))
                / float(len(targets))
                * 100.0
            ).alias("correlation_importance"),
        )
        for i, c in enumerate(columns)
    ]
    return (
        stats.select(F.explode(F.array(*cells)).alias("e"))
        .select("e.*")
        .withColumn("combined_score", (F.col("cluster_importance") + F.col("correlation_importance")) / 2.0)
    )


def monthly_model_metrics(scored: DataFrame) -> DataFrame:
    """M-14: needs order_date, prediction, score and missing_rate."""
    return scored.groupBy(F.trunc("order_date", "month").alias("month")).agg(
        (F.avg((F.col("prediction") == -1).cast("double")) * 100.0).alias("anomaly_rate"),
        F.avg("score").alias("avg_score"),
        F.stddev_samp("score").alias("score_std"),
        F.avg("missing_rate").alias("avg_missing_rate"),
        F.count(F.lit(1)).alias("order_count"),
    )


def prediction_correlation(monthly: DataFrame) -> DataFrame:
    """M-14: how the monthly anomaly rate follows the true missing rate."""
    return monthly.agg(safe_corr("anomaly_rate", "avg_missing_rate").alias("correlation"))


# Limits of the retraining triggers.
RATE_CHANGE_LIMIT, KS_LIMIT, CORRELATION_LIMIT = 0.20, 0.15, 0.5


def retraining_triggers(drift: DataFrame, monthly: DataFrame) -> DataFrame:
    """M-15: three rules with their value, limit and whether they fire."""
    latest = F.max_by("anomaly_rate", "month")
    mean = F.avg("anomaly_rate")
    change = monthly.agg((F.abs(latest - mean) / F.nullif(mean, F.lit(0.0))).alias("v"))
    drifted = drift.agg(F.count(F.when(F.col("ks_stat") > KS_LIMIT, 1)).cast("double").alias("v"))
    corr = prediction_correlation(monthly).select(F.col("correlation").alias("v"))
    v = F.col("v")
    parts = [
        change.select(F.lit("anomaly_rate_change").alias("trigger"), v.alias("value"), F.lit(RATE_CHANGE_LIMIT).alias("limit"), (v > RATE_CHANGE_LIMIT).alias("fired")),
        drifted.select(F.lit("drifted_features"), v, F.lit(0.0), v > 0),
        corr.select(F.lit("prediction_correlation"), v, F.lit(CORRELATION_LIMIT), v < CORRELATION_LIMIT),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def champion_challenger(
    champion: IsolationForest, challenger: IsolationForest, current: DataFrame, id_column: str
) -> DataFrame:
    """M-17: both models on the same rows: rate, mean and deviation of the margin, KS between the scores."""
    parts = []
    for name, model in (("Champion", champion), ("Challenger", challenger)):
        parts.append(
            model.predict(current, id_column).select(
                F.lit(name).alias("model"), (F.col("score") - model.offset).alias("margin"), "prediction"
            )
        )
    both = materialize(parts[0].union(parts[1]))
    gap = ks_two_sample(both.withColumn("is_second", F.col("model") == "Challenger"), "margin", "is_second")
    s = Scalars(gap.select("ks_stat", "p_value"))
    return s.detach(
        s.attach(
            both.groupBy("model").agg(
                (F.avg((F.col("prediction") == -1).cast("double")) * 100.0).alias("anomaly_rate"),
                F.avg("margin").alias("avg_score"),
                F.stddev_pop("margin").alias("score_std"),
            )
        ).withColumns({"ks_stat": s.ks_stat, "p_value": s.p_value})
    )


def model_health(monthly: DataFrame, drift: DataFrame, training: DataFrame) -> DataFrame:
    """M-18: correlation, feature stability and rate stability against their thresholds."""
    v = F.col("value")
    corr = prediction_correlation(monthly).select(
        F.lit("Prediction Correlation").alias("metric"), (F.col("correlation") * 100.0).alias("value"), F.lit(70.0).alias("threshold")
    )
    stable = drift.agg(
        ((1.0 - F.avg(F.col("status").isin("Critical", "High").cast("double"))) * 100.0).alias("value")
    ).select(F.lit("Feature Stability"), "value", F.lit(80.0))
    steady = training.agg(
        (100.0 - F.stddev_samp("anomaly_rate") / F.nullif(F.avg("anomaly_rate"), F.lit(0.0)) * 100.0).alias("value")
    ).select(F.lit("Rate Stability"), "value", F.lit(85.0))
    status = F.when(v >= F.col("threshold"), "Low").when(v >= F.col("threshold") * 0.8, "Medium").otherwise("High")
    return corr.union(stable).union(steady).withColumn("status", status)
