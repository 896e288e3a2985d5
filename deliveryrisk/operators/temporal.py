"""Calendar, weekday and hour patterns.

Orders are folded to one row per period first; the windows below then run over
a calendar (months, weekdays, hours), whose size does not grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from deliveryrisk.config import THRESHOLDS
from deliveryrisk.functions.scalar import (
    Scalars,
    bucketize,
    delivery_period,
    missing_rate,
    money_avg,
    money_sum,
    percent_of,
    rate_pct,
)
from deliveryrisk.operators.drivers import has_missing


def calendar() -> WindowSpec:
    """One partition over period rows."""
    return Window.partitionBy()


def totals_by(orders: DataFrame, **keys) -> DataFrame:
    """Counts, revenue, items and rate by named period expressions."""
    return (
        orders.groupBy(*[c.alias(n) for n, c in keys.items()])
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            money_sum("order_amount").alias("total_revenue"),
            money_avg("order_amount").alias("avg_order_value"),
            F.sum("items_delivered").alias("items_delivered"),
            F.sum("items_missing").alias("items_missing"),
            F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
        )
        .withColumns(
            {
                "total_items": F.col("items_delivered") + F.col("items_missing"),
                "missing_rate": missing_rate("items_missing", "items_delivered"),
            }
        )
    )



def month_start() -> Column:
    return F.trunc("order_date", "month")

# Interval steps of the period kinds.
STEPS = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months"}


def spine(df: DataFrame, column: str, step: str, out: str) -> DataFrame:
    """All period starts between the smallest and largest value of a date column."""
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(
        F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(out)
    )


def aggregate_by_period(orders: DataFrame, period: str = "month") -> DataFrame:
    """T-1: zero-filled buckets labelled by their last day."""
    start = F.col("order_date") if period == "day" else F.trunc("order_date", period)
    buckets = totals_by(orders, start=start).drop("avg_order_value", "orders_with_missing")
    full = spine(buckets, "start", STEPS[period], "start").join(buckets, "start", "left")
    end = {
        "day": F.col("start"),
        "week": F.date_add("start", 6),
        "month": F.last_day("start"),
        "quarter": F.last_day(F.add_months("start", 2)),
    }[period]
    return full.withColumn("period", end).drop("start").fillna(0)


def monthly_trends(orders: DataFrame) -> DataFrame:
    """T-2: calendar months with changes from month to month."""
    base = (
        orders.groupBy(month_start().alias("month"))
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
            }
        )
    )
    by_month = calendar().orderBy("month")

    def change(c):
        before = F.lag(c).over(by_month)
        return (F.col(c) - before) / F.nullif(before.cast("double"), F.lit(0.0)) * 100.0

    return base.withColumns(
        {
            "orders_mom": change("total_orders"),
            "revenue_mom": change("total_revenue"),
            "missing_rate_change": F.col("missing_rate") - F.lag("missing_rate").over(by_month),
        }
    )


def monthly_rates(orders: DataFrame) -> DataFrame:
    """Month and missing rate only, for trend and anomaly operators."""
    return totals_by(orders, month=month_start())


def weekly_patterns(orders: DataFrame) -> DataFrame:
    """T-3: weeks labelled by their Monday."""
    return totals_by(orders, week=F.trunc("order_date", "week")).drop("avg_order_value", "orders_with_missing")


def day_of_week_patterns(orders: DataFrame) -> DataFrame:
    """T-4."""
    return (
        totals_by(orders, day_num=F.weekday("order_date"), day_of_week=F.date_format("order_date", "EEEE"))
        .drop("orders_with_missing")
        .withColumn("is_weekend", F.col("day_num") >= 5)
    )


# Period labels of the hourly table.
HOUR_LABELS = ["Night (0-6)", "Morning (6-12)", "Afternoon (12-18)", "Evening (18-24)"]


def hourly_patterns(orders: DataFrame) -> DataFrame:
    """T-5: orders without a readable hour are left out."""
    return (
        totals_by(orders.where(F.col("delivery_hour").isNotNull()), hour=F.col("delivery_hour"))
        .drop("total_revenue", "orders_with_missing")
        .withColumn("period", bucketize("hour", [-1, 6, 12, 18, 24], HOUR_LABELS))
    )


def monthly_fraud_trends(orders: DataFrame, missing_items: DataFrame, products: DataFrame) -> DataFrame:
    """T-6: view with missing value and change of missing items."""
    stats = orders.groupBy(month_start().alias("month_start")).agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
        F.sum("items_delivered").alias("total_items_delivered"),
        F.sum("items_missing").alias("total_items_missing"),
        money_sum("order_amount").alias("total_order_value"),
    )
    per_order = (
        missing_items.join(products.select("product_id", "price"), "product_id")
        .groupBy("order_id")
        .agg(F.sum("price").alias("v"))
    )
    value = (
        orders.select("order_id", month_start().alias("month_start"))
        .join(per_order, "order_id")
        .groupBy("month_start")
        .agg(F.sum("v").alias("total_missing_value"))
    )
    before = F.lag("total_items_missing").over(calendar().orderBy("month_start"))
    return (
        stats.join(value, "month_start", "left")
        .fillna(0.0, ["total_missing_value"])
        .withColumns(
            {
                "month_name": F.date_format("month_start", "MMMM yyyy"),
                "missing_order_rate_pct": rate_pct("orders_with_missing", "orders_count"),
                "missing_item_rate_pct": rate_pct("total_items_missing", "total_items_delivered"),
                "prev_month_missing": before,
                "mom_missing_change": F.col("total_items_missing") - before,
            }
        )
    )


def view_by(orders: DataFrame, **keys) -> DataFrame:
    return (
        orders.groupBy(*[c.alias(n) for n, c in keys.items()])
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.count(F.when(has_missing(), 1)).alias("orders_with_missing"),
            F.sum("items_delivered").alias("total_items_delivered"),
            F.sum("items_missing").alias("total_items_missing"),
            money_sum("order_amount").alias("total_order_value"),
        )
        .withColumn("missing_item_rate_pct", rate_pct("total_items_missing", "total_items_delivered"))
    )


def hourly_fraud_patterns(orders: DataFrame) -> DataFrame:
    """T-7: view by hour with the hours named in the period label."""
    hours = {
        "Morning": "Morning (6-11)",
        "Afternoon": "Afternoon (12-17)",
        "Evening": "Evening (18-21)",
        "Night": "Night (22-5)",
    }
    label = F.coalesce(*[F.when(delivery_period("delivery_hour") == k, F.lit(v)) for k, v in hours.items()])
    return view_by(orders, delivery_hour_int=F.col("delivery_hour"), delivery_period=label)


def day_of_week_fraud_patterns(orders: DataFrame) -> DataFrame:
    """T-8: view by weekday, Sunday = 0."""
    return view_by(
        orders, day_of_week=F.dayofweek("order_date") - 1, day_name=F.date_format("order_date", "EEEE")
    )


def legacy_trends(orders: DataFrame, by: str) -> DataFrame:
    """T-9: older monthly and hourly views."""
    key = month_start().alias("month") if by == "month" else F.col("delivery_hour").alias("hour_of_day")
    rows = orders if by == "month" else orders.where(F.col("delivery_hour").isNotNull())
    aggs = [F.count(F.lit(1)).alias("total_orders"), F.sum("items_missing").alias("total_items_missing")]
    if by == "month":
        aggs.append(money_sum("order_amount").alias("total_revenue"))
    rate = F.round(missing_rate(F.sum("items_missing"), F.sum("items_delivered")), 2).alias("missing_rate_pct")
    return rows.groupBy(key).agg(*aggs, rate)


def trends_month_of_year(enriched: DataFrame) -> DataFrame:
    """T-10: month of the year."""
    return (
        totals_by(enriched, month=F.month("order_date"), month_name=F.date_format("order_date", "MMM"))
        .withColumn("pct_orders_with_missing", percent_of("orders_with_missing", "total_orders"))
        .drop("avg_order_value", "total_items")
    )


def trends_weekday(enriched: DataFrame) -> DataFrame:
    """T-10: weekday."""
    return totals_by(
        enriched, day_num=F.weekday("order_date"), day_of_week=F.date_format("order_date", "EEEE")
    ).drop("avg_order_value", "total_items", "orders_with_missing")


def trends_hour(enriched: DataFrame) -> DataFrame:
    """T-10: hour with its clock period."""
    return (
        totals_by(enriched, hour=F.coalesce("delivery_hour", F.lit(0)))
        .withColumn("period", delivery_period("hour"))
        .drop("avg_order_value", "total_items", "total_revenue", "orders_with_missing")
    )


def above_sigma(df: DataFrame, segment: str, label, k: float, zero_if_flat: bool = False) -> DataFrame:
    """Periods whose rate exceeds mean + k deviations; nothing when the deviation is unknown."""
    s = Scalars(df, mean=F.avg("missing_rate"), std=F.stddev_samp("missing_rate"))
    spread = F.coalesce(s.std, F.lit(0.0)) if zero_if_flat else s.std
    limit = s.mean + k * spread
    return (
        s.attach(df)
        .where(F.col("missing_rate") > limit)
        .select(
            F.lit(segment).alias("segment"),
            label.alias("period"),
            "missing_rate",
            limit.alias("threshold"),
            F.when(s.std > 0, (F.col("missing_rate") - s.mean) / s.std).otherwise(F.lit(0.0)).alias("deviation"),
        )
    )


def temporal_anomalies(orders: DataFrame, k: float = THRESHOLDS.anomaly_std) -> DataFrame:
    """T-11: months, weekdays and hours above mean + k deviations."""
    parts = [
        above_sigma(monthly_rates(orders), "monthly", F.date_format("month", "yyyy-MM"), k),
        above_sigma(day_of_week_patterns(orders), "daily", F.col("day_of_week"), k),
        above_sigma(hourly_patterns(orders), "hourly", F.format_string("%02d:00", "hour"), k),
    ]
    return reduce(DataFrame.unionByName, parts)


def trend_direction(monthly: DataFrame) -> DataFrame:
    """T-12: slope over the month index, first against last quarter, peak and lowest month."""
    rate = F.col("missing_rate")
    order = calendar().orderBy("month")
    ranked = monthly.select(
        "month",
        "missing_rate",
        (F.row_number().over(order) - 1).alias("i"),
        F.count(F.lit(1)).over(calendar()).alias("n"),
    )
    edge = F.when(F.col("n") >= 3, 3).otherwise(1)
    stats = ranked.agg(
        F.coalesce(F.regr_slope(rate, F.col("i").cast("double")), F.lit(0.0)).alias("slope"),
        F.avg(F.when(F.col("i") < edge, rate)).alias("first_period_avg"),
        F.avg(F.when(F.col("i") >= F.col("n") - edge, rate)).alias("last_period_avg"),
        F.min_by("month", F.struct(-rate, F.col("month"))).alias("peak_month"),
        F.max(rate).alias("peak_rate"),
        F.min_by("month", F.struct(rate, F.col("month"))).alias("lowest_month"),
        F.min(rate).alias("lowest_rate"),
    )
    first = F.col("first_period_avg")
    return stats.withColumns(
        {
            "direction": F.when(F.col("slope") > 0.1, "increasing")
            .when(F.col("slope") < -0.1, "decreasing")
            .otherwise("stable"),
            "change_pct": F.when(
                first > 0, (F.col("last_period_avg") - first) / F.nullif(first, F.lit(0.0)) * 100.0
            ).otherwise(F.lit(0.0)),
        }
    )


def temporal_summary(orders: DataFrame, k: float = THRESHOLDS.anomaly_std) -> DataFrame:
    """T-13: range, trend, anomaly count, best and worst day and hour, weekend against weekday."""
    monthly = monthly_rates(orders)
    rate = F.col("missing_rate")
    days = Scalars(
        day_of_week_patterns(orders).agg(
            F.min_by("day_of_week", F.struct(-rate, F.col("day_num"))).alias("worst_day"),
            F.min_by("day_of_week", F.struct(rate, F.col("day_num"))).alias("best_day"),
            F.avg(F.when(F.col("is_weekend"), rate)).alias("weekend_rate"),
            F.avg(F.when(~F.col("is_weekend"), rate)).alias("weekday_rate"),
        ),
        "_days",
    )
    hours = Scalars(
        hourly_patterns(orders).agg(
            F.min_by("hour", F.struct(-rate, F.col("hour"))).alias("worst_hour"),
            F.min_by("hour", F.struct(rate, F.col("hour"))).alias("best_hour"),
        ),
        "_hours",
    )
    dates = Scalars(
        orders.agg(
            F.min("order_date").alias("date_start"),
            F.max("order_date").alias("date_end"),
            F.count_distinct(month_start()).alias("total_months"),
        ),
        "_dates",
    )
    anomalies = temporal_anomalies(orders, k).agg(F.count(F.lit(1))).scalar()
    out = trend_direction(monthly)
    for s in (days, hours, dates):
        out = s.attach(out)
    out = out.withColumns(
        {
            "date_start": dates.date_start,
            "date_end": dates.date_end,
            "total_months": dates.total_months,
            "anomalies_total": anomalies,
            "worst_day": days.worst_day,
            "best_day": days.best_day,
            "worst_hour": hours.worst_hour,
            "best_hour": hours.best_hour,
            "weekend_rate": days.weekend_rate,
            "weekday_rate": days.weekday_rate,
        }
    )
    for s in (days, hours, dates):
        out = s.detach(out)
    return out


def trend_delta(monthly: DataFrame) -> DataFrame:
    """T-14: last month of the year against the one before, mean and peak."""
    rate = F.col("missing_rate")
    last = F.row_number().over(calendar().orderBy(F.desc("month")))
    stats = monthly.withColumn("_r", last).agg(
        F.max(F.when(F.col("_r") == 1, rate)).alias("current_rate"),
        F.max(F.when(F.col("_r") == 2, rate)).alias("previous_rate"),
        F.avg(rate).alias("avg_rate"),
        F.min_by("month_name", F.struct(-rate, F.col("month"))).alias("peak_month"),
        F.max(rate).alias("peak_rate"),
    )
    delta = F.coalesce(F.col("current_rate") - F.col("previous_rate"), F.lit(0.0))
    before = F.col("previous_rate")
    return stats.withColumns(
        {
            "delta_pp": delta,
            "delta_pct": F.when(before > 0, delta / F.nullif(before, F.lit(0.0)) * 100.0).otherwise(F.lit(0.0)),
            "direction": F.when(delta > 0.5, "up").when(delta < -0.5, "down").otherwise("stable"),
        }
    )


def hourly_baseline(orders: DataFrame) -> DataFrame:
    """T-15: hours with the mean line, the upper limit and an anomaly flag."""
    hourly = totals_by(orders, hour=F.coalesce("delivery_hour", F.lit(0))).select(
        "hour", F.col("total_orders").alias("orders"), "items_missing", "total_items", "missing_rate"
    )
    mean = F.avg("missing_rate").over(calendar())
    limit = mean + 2 * F.stddev_samp("missing_rate").over(calendar())
    return hourly.withColumns({"baseline": mean, "upper_threshold": limit}).withColumn(
        "is_anomaly", F.coalesce(F.col("missing_rate") > F.col("upper_threshold"), F.lit(False))
    )


def hourly_watchtower(baseline: DataFrame, recent: int = 6) -> DataFrame:
    """T-15: threat level from the last hours against the daily mean."""
    rate = F.col("missing_rate")
    latest = F.row_number().over(calendar().orderBy(F.desc("hour")))
    stats = baseline.withColumn("_r", latest).agg(
        F.avg(F.when(F.col("_r") <= recent, rate)).alias("current_rate"),
        F.avg(rate).alias("baseline_rate"),
        F.stddev_samp(rate).alias("_std"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("active_anomalies"),
        F.sum("orders").alias("total_orders"),
        (100.0 - F.avg(rate)).alias("clean_rate"),
    )
    sigma = F.when(F.col("_std") > 0, (F.col("current_rate") - F.col("baseline_rate")) / F.col("_std")).otherwise(
        F.lit(0.0)
    )
    level = (
        F.when(F.col("sigma_deviation") >= 2.0, "CRITICAL")
        .when(F.col("sigma_deviation") >= 1.0, "ELEVATED")
        .when(F.col("sigma_deviation") >= 0.5, "MODERATE")
        .otherwise("NORMAL")
    )
    return stats.withColumn("sigma_deviation", sigma).withColumn("threat_level", level).drop("_std")


def scoped_anomalies(scoped_orders: DataFrame, k: float = 2.0) -> DataFrame:
    """T-16: anomalies of an item scope by weekday, hour and month of the year."""
    parts = [
        above_sigma(trends_weekday(scoped_orders), "daily", F.col("day_of_week"), k, True),
        above_sigma(trends_hour(scoped_orders), "hourly", F.format_string("%02d:00", "hour"), k, True),
        above_sigma(trends_month_of_year(scoped_orders), "monthly", F.col("month_name"), k, True),
    ]
    return reduce(DataFrame.unionByName, parts)


def scoped_trend(scoped_orders: DataFrame) -> DataFrame:
    """T-16: first against second half of the months, worst weekday and hour."""
    rate = F.col("missing_rate")
    months = trends_month_of_year(scoped_orders).select(
        rate,
        F.row_number().over(calendar().orderBy("month")).alias("_r"),
        F.count(F.lit(1)).over(calendar()).alias("_n"),
    )
    half = F.greatest(F.floor(F.col("_n") / 2), F.lit(1))
    stats = months.agg(
        F.avg(F.when(F.col("_r") <= half, rate)).alias("first_rate"),
        F.avg(F.when(F.col("_r") > F.col("_n") - half, rate)).alias("last_rate"),
    )
    day = trends_weekday(scoped_orders).agg(F.min_by("day_of_week", F.struct(-rate, F.col("day_num")))).scalar()
    hour = trends_hour(scoped_orders).agg(F.min_by("hour", F.struct(-rate, F.col("hour")))).scalar()
    change = F.when(
        F.col("first_rate") > 0,
        (F.col("last_rate") - F.col("first_rate")) / F.nullif(F.col("first_rate"), F.lit(0.0)) * 100.0,
    ).otherwise(F.lit(0.0))
    return stats.withColumn("change_pct", change).withColumns(
        {
            "direction": F.when(F.col("change_pct") > 0.5, "increasing")
            .when(F.col("change_pct") < -0.5, "decreasing")
            .otherwise("stable"),
            "worst_day": day,
            "worst_hour": hour,
        }
    )


def flatten_anomalies(anomalies: DataFrame) -> DataFrame:
    """T-17: one table with the gap over the threshold."""
    return anomalies.select(
        F.initcap("segment").alias("segment"),
        "period",
        F.round("missing_rate", 2).alias("missing_rate_pct"),
        F.round("threshold", 2).alias("threshold_pct"),
        F.round(F.col("missing_rate") - F.col("threshold"), 2).alias("gap_pp"),
    )


def period_stats(orders: DataFrame) -> DataFrame:
    """T-18: totals by clock period."""
    return totals_by(orders, period=delivery_period("delivery_hour")).drop("total_items")
