"""Correlations, outliers and hypothesis tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import EXPERIENCE_EDGES, EXPERIENCE_LABELS
from deliveryrisk.functions.ranking import quantiles, running_sums
from deliveryrisk.functions.scalar import Scalars, bucketize, delivery_period, missing_rate, safe_corr
from deliveryrisk.functions.tails import ks_p, normal_p, student_p


def rows() -> Column:
    return F.count(F.lit(1))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ST-1: Pearson matrix in long form, all pairs in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    stats = df.agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{a}|{b}`").alias("r")))
    return stats.select(F.explode(F.array(*cells)).alias("e")).select("e.x", "e.y", "e.r")


def safe_correlation(df: DataFrame, x: str, y: str, min_points: int = 8) -> DataFrame:
    """ST-2: correlation with a status when the sample is too small or flat."""
    clean = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    stats = clean.agg(
        rows().alias("sample_size"),
        (F.min("x") != F.max("x")).alias("_vx"),
        (F.min("y") != F.max("y")).alias("_vy"),
        safe_corr("x", "y").alias("_r"),
    )
    status = (
        F.when(F.col("sample_size") < min_points, "insufficient_sample")
        .when(~(F.col("_vx") & F.col("_vy")), "insufficient_variance")
        .otherwise("ok")
    )
    return stats.select("sample_size", status.alias("status"), F.when(status == "ok", F.col("_r")).alias("value"))


def correlation_strength(r):
    """ST-3."""
    a = F.abs(r)
    return (
        F.when(a >= 0.7, "Strong").when(a >= 0.4, "Moderate").when(a >= 0.2, "Weak").otherwise("Very weak")
    )


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """ST-4: rows outside the quartile fences or beyond an absolute z-score."""
    c = F.col(column)
    if method == "iqr":
        s = Scalars(quantiles(df, {"q1": (column, 0.25), "q3": (column, 0.75)}))
        span = s.q3 - s.q1
        keep = (c < s.q1 - threshold * span) | (c > s.q3 + threshold * span)
    elif method == "zscore":
        s = Scalars(df, mean=F.avg(column), std=F.stddev_samp(column))
        keep = F.abs((c - s.mean) / F.nullif(s.std, F.lit(0.0))) > threshold
    else:
        raise ValueError(f"unknown method {method}")
    return s.detach(s.attach(df).where(keep))


def h1_pearson(driver_summary: DataFrame) -> DataFrame:
    """ST-5: experience against missing rate over active drivers."""
    valid = driver_summary.where(F.col("trips").isNotNull() & (F.col("orders_completed") > 0)).withColumn(
        "_level", bucketize("trips", EXPERIENCE_EDGES, EXPERIENCE_LABELS)
    )
    rate = F.col("missing_rate")
    stats = valid.agg(
        rows().alias("n"),
        safe_corr("trips", rate).alias("_r"),
        F.avg(F.when(F.col("_level") == "Novice", rate)).alias("novice_rate"),
        F.avg(F.when(F.col("_level") == "Expert", rate)).alias("expert_rate"),
    )
    usable = (F.col("n") >= 3) & F.col("_r").isNotNull()
    r = F.when(usable, F.col("_r")).otherwise(F.lit(0.0))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return (
        stats.withColumn("r", r)
        .withColumn("p_value", F.when(usable, student_p(t, (F.col("n") - 2).cast("double"))).otherwise(F.lit(1.0)))
        .withColumn("status", F.when(F.col("p_value") < 0.05, "Validated").otherwise("Investigating"))
        .drop("_r")
    )


def h2_hotspots(regional: DataFrame, k: float = 2.0) -> DataFrame:
    """ST-6: number of regions above mean + k deviations."""
    s = Scalars(regional, mean=F.avg("missing_rate"), std=F.stddev_samp("missing_rate"))
    limit = s.mean + k * s.std
    return (
        s.attach(regional)
        .agg(F.count(F.when(F.col("missing_rate") > limit, 1)).alias("hotspots"), F.max(limit).alias("threshold"))
        .withColumn("status", F.when(F.col("hotspots") > 0, "Validated").otherwise("Rejected"))
    )


def with_order_rate(orders: DataFrame) -> DataFrame:
    return orders.withColumn("order_missing_rate", missing_rate("items_missing", "items_delivered"))


def h3_welch_t(orders: DataFrame) -> DataFrame:
    """ST-7: night against the rest of the day with unequal variances."""
    night = F.coalesce(delivery_period("delivery_hour", "cut") == "Night", F.lit(False))
    rate = F.col("order_missing_rate")
    stats = with_order_rate(orders).agg(
        *[
            f(F.when(cond, rate)).alias(f"{name}_{side}")
            for side, cond in (("night", night), ("rest", ~night))
            for name, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))
        ]
    )
    a, b = F.col("var_night") / F.col("n_night"), F.col("var_rest") / F.col("n_rest")
    usable = (F.col("n_night") > 2) & (F.col("n_rest") > 2) & (a + b > 0)
    freedom = (a + b) * (a + b) / (a * a / (F.col("n_night") - 1) + b * b / (F.col("n_rest") - 1))
    return (
        stats.withColumns(
            {
                "mean_gap": F.col("mean_night") - F.col("mean_rest"),
                "t": F.when(usable, (F.col("mean_night") - F.col("mean_rest")) / F.sqrt(a + b)),
                "df": F.when(usable, freedom),
            }
        )
        .withColumn("p_value", F.coalesce(student_p("t", "df"), F.lit(1.0)))
        .select("mean_night", "mean_rest", "n_night", "n_rest", "mean_gap", "t", "df", "p_value")
    )


def mann_whitney(df: DataFrame, value: str, is_first) -> DataFrame:
    """Rank sum test from counts per distinct value; ties share their mean rank.

    With two values or fewer on a side the statistic is 0 and the p-value 1.
    """
    flagged = df.withColumn("_first", is_first)
    rc = running_sums(flagged, value, {"n": rows(), "k": F.count(F.when(F.col("_first"), 1))})
    n = F.col("n").cast("double")
    rank = F.col("n_below") + (n + 1) / 2.0
    stats = rc.agg(
        F.sum(rank * F.col("k")).alias("_r1"),
        F.max("k_total").cast("double").alias("n1"),
        (F.max("n_total") - F.max("k_total")).cast("double").alias("n2"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    total = F.col("n1") + F.col("n2")
    u = F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    mean = F.col("n1") * F.col("n2") / 2.0
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (total + 1 - F.col("_ties") / (total * (total - 1))))
    z = (F.greatest(u, F.col("n1") * F.col("n2") - u) - mean - 0.5) / F.nullif(sd, F.lit(0.0))
    enough = (F.col("n1") > 2) & (F.col("n2") > 2)
    return (
        stats.withColumns({"u": F.when(enough, u).otherwise(0.0), "z": F.when(enough, z)})
        .withColumn("p_value", F.coalesce(normal_p(F.greatest("z", F.lit(0.0))), F.lit(1.0)))
        .drop("_r1", "_ties")
    )


def h4_mann_whitney(orders: DataFrame) -> DataFrame:
    """ST-8: orders from the third amount quartile up against the rest."""
    s = Scalars(quantiles(orders, {"p75": ("order_amount", 0.75)}))
    return mann_whitney(s.attach(with_order_rate(orders)), "order_missing_rate", F.col("order_amount") >= s.p75)


def ks_two_sample(df: DataFrame, value: str, is_second: str, by: Sequence[str] = ()) -> DataFrame:
    """ST-9: largest gap between two empirical distributions.

    Cumulative counts come from distinct values in range blocks, so no task
    sorts the whole sample.
    """
    second = F.col(is_second)
    sums = running_sums(
        df, value, {"a": F.count(F.when(~second, 1)), "b": F.count(F.when(second, 1))}, by
    )
    gap = F.abs(
        (F.col("a_below") + F.col("a")) / F.col("a_total") - (F.col("b_below") + F.col("b")) / F.col("b_total")
    )
    grouped = sums.groupBy(*by) if by else sums.groupBy()
    return grouped.agg(
        F.max(gap).alias("ks_stat"), F.max("a_total").alias("n_ref"), F.max("b_total").alias("n_curr")
    ).withColumn("p_value", ks_p("ks_stat", F.col("n_ref").cast("double"), F.col("n_curr").cast("double")))


def top_correlates(df: DataFrame, target: str, columns: Sequence[str], n: int = 5) -> DataFrame:
    """ST-11: columns with the highest correlation with a target."""
    stats = df.agg(*[safe_corr(c, target).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])
    return (
        stats.select(F.explode(pairs).alias("e"))
        .select("e.feature", "e.correlation")
        .orderBy(F.desc("correlation"), "feature")
        .limit(n)
    )


REGRESSION_FEATURES = ["trips", "age", "total_orders", "avg_order_value", "pct_orders_with_missing"]


def least_squares(df: DataFrame, x: Sequence[str], y: str, is_test: Column) -> dict[str, float]:
    """Coefficients fitted on one part of the rows, R² and RMSE on the other, from one aggregate.

    Counts, means and covariances of both parts are enough: the squared errors of
    the test rows follow from them. A column without variance gets 0.
    """
    names = [*x, y]
    parts = {"fit": ~is_test, "test": is_test}
    stats = df.agg(
        *[F.count(F.when(part, 1)).alias(f"{p}_n") for p, part in parts.items()],
        *[F.avg(F.when(part, F.col(c))).alias(f"{p}_{i}") for p, part in parts.items() for i, c in enumerate(names)],
        *[
            F.covar_pop(F.when(part, F.col(a)), F.when(part, F.col(b))).alias(f"{p}_{i}_{j}")
            for p, part in parts.items()
            for i, a in enumerate(names)
            for j, b in enumerate(names[i:], i)
        ],
    ).first()

    def moments(p: str) -> tuple[np.ndarray, np.ndarray]:
        mean = np.array([stats[f"{p}_{i}"] or 0.0 for i in range(len(names))])
        pairs = [[stats[f"{p}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))]
        return mean, np.array(pairs)

    mean, cov = moments("fit")
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    # in units of the deviations, so that the cutoff for collinear columns is the same for all
    unit = cov / scale[:, None] / scale[None, :]
    slopes = np.linalg.lstsq(unit[:-1, :-1], unit[:-1, -1], rcond=1e-10)[0] * scale[-1] / scale[:-1]
    intercept = mean[-1] - slopes @ mean[:-1]
    out = dict(zip(x, slopes.tolist(), strict=True)) | {"intercept": float(intercept)}
    if stats["test_n"]:
        mean, cov = moments("test")
        weights = np.append(-slopes, 1.0)
        error = weights @ cov @ weights + (weights @ mean - intercept) ** 2
        out |= {"r2": float(1.0 - error / cov[-1, -1]) if cov[-1, -1] else 0.0, "rmse": float(np.sqrt(max(error, 0.0)))}
    return out


def held_back(id_column: str) -> Column:
    """A quarter of the rows, by the first digit of the id's digest."""
    return F.substring(F.md5(F.col(id_column).cast("string").cast("binary")), 1, 1).isin("0", "4", "8", "c")


def linear_regression(features: DataFrame, id_column: str = "driver_id") -> DataFrame:
    """ST-10: missing rate on five driver features; a digest of the id holds a quarter back for testing."""
    data = features.select(
        id_column,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*REGRESSION_FEATURES, "missing_rate"]],
    )
    found = least_squares(data, REGRESSION_FEATURES, "missing_rate", held_back(id_column))
    return features.sparkSession.createDataFrame(list(found.items()), "term string, value double")
