"""Products: missing item facts, losses, exposure, forecasts and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliveryrisk.config import (
    DEFAULT_MARGIN,
    MARGIN_BY_CATEGORY,
    PRICE_BAND_EDGES,
    PRICE_BAND_LABELS,
    PRICE_EDGES,
    PRICE_LABELS,
    RISK_LABELS,
    SLA_BY_PRIORITY,
    THRESHOLDS,
)
from deliveryrisk.functions.dealing import dealt
from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.ranking import average_rank, quantiles, running_counts
from deliveryrisk.functions.scalar import (
    Scalars,
    bucketize,
    clip,
    delivery_period,
    lookup,
    min_max,
    missing_rate,
    money_sum,
    pct_change_safe,
    percent_of,
    price_segment,
)
from deliveryrisk.operators.temporal import spine


def rows() -> Column:
    return F.count(F.lit(1))


def missing_facts(missing_items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """P-1: missing items with their order and product; the item's own name, category and price win."""
    own = [c for c in ("product_name", "category", "product_price") if c in missing_items.columns]
    catalogue = products.select("product_id", "product_name", "category", "price")
    joined = missing_items.withColumnsRenamed({c: f"_own_{c}" for c in own}).join(orders, "order_id", "left").join(
        catalogue, "product_id", "left"
    )
    for c in own:
        target = "price" if c == "product_price" else c
        joined = joined.withColumn(target, F.coalesce(F.col(f"_own_{c}"), F.col(target))).drop(f"_own_{c}")
    return joined


def events_by_product(missing_items: DataFrame) -> DataFrame:
    """Missing events and distinct orders per product, counted without a distinct over raw rows of one key."""
    return (
        missing_items.groupBy("product_id", "order_id")
        .agg(rows().alias("_n"))
        .groupBy("product_id")
        .agg(F.sum("_n").alias("times_reported_missing"), rows().alias("orders_affected"))
    )


def product_features(products: DataFrame, missing_items: DataFrame, edges=PRICE_EDGES) -> DataFrame:
    """P-2: reports per product, price band and the total of its category."""
    counts = missing_items.groupBy("product_id").agg(rows().alias("times_reported_missing"))
    featured = products.join(counts, "product_id", "left").fillna(0, ["times_reported_missing"])
    totals = featured.groupBy("category").agg(F.sum("times_reported_missing").alias("category_total_missing"))
    return featured.join(totals, "category", "left").withColumn("price_category", bucketize("price", edges, PRICE_LABELS))


def product_summary(products: DataFrame, missing_items: DataFrame) -> DataFrame:
    """P-3."""
    return (
        products.join(events_by_product(missing_items), "product_id", "left")
        .fillna(0, ["times_reported_missing", "orders_affected"])
        .withColumn("estimated_loss", F.col("times_reported_missing") * F.col("price"))
    )


def product_fraud_metrics(products: DataFrame, missing_items: DataFrame) -> DataFrame:
    """P-4: view with the rank inside the category (equal counts share the smallest rank).

    Ranks come from counts of distinct values, so a category that holds most
    products is not sorted in one task.
    """
    base = materialize(
        products.withColumnRenamed("category", "category_name")
        .join(events_by_product(missing_items), "product_id", "left")
        .fillna(0, ["times_reported_missing", "orders_affected"])
        .withColumnRenamed("times_reported_missing", "times_missing")
    )
    ranks = running_counts(base, "times_missing", ["category_name"]).select(
        "category_name",
        "times_missing",
        (F.col("total") - F.col("below") - F.col("n") + 1).cast("int").alias("rank_in_category"),
    )
    return base.join(ranks, ["category_name", "times_missing"], "left").withColumn(
        "total_missing_value", F.round(F.col("times_missing") * F.col("price"), 2)
    )


def category_fraud_metrics(products: DataFrame, missing_items: DataFrame) -> DataFrame:
    """P-5: view that, as published, adds the price of never-missing products once."""
    per_product = products.join(
        missing_items.groupBy("product_id").agg(rows().alias("n")), "product_id", "left"
    ).fillna(0, ["n"])
    lines = F.greatest("n", F.lit(1))
    orders = (
        missing_items.join(products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.count_distinct("order_id").alias("orders_affected"))
    )
    return (
        per_product.groupBy("category")
        .agg(
            rows().alias("products_in_category"),
            F.sum("n").alias("total_items_missing"),
            F.sum(F.col("price") * lines).alias("_value"),
            F.sum(lines).alias("_lines"),
        )
        .join(orders, "category", "left")
        .fillna(0, ["orders_affected"])
        .select(
            F.col("category").alias("category_name"),
            "products_in_category",
            "total_items_missing",
            "orders_affected",
            F.round("_value", 2).alias("total_missing_value"),
            F.round(F.col("_value") / F.col("_lines"), 2).alias("avg_missing_item_price"),
        )
    )


def missing_by_product(products: DataFrame, missing_items: DataFrame) -> DataFrame:
    """P-6: products with events and the value lost."""
    counts = missing_items.groupBy("product_id").agg(rows().alias("times_missing"))
    return counts.join(products, "product_id").withColumn("value_lost", F.col("times_missing") * F.col("price"))


def product_risk_60_40(by_product: DataFrame) -> DataFrame:
    """P-7: 60 % frequency and 40 % price, left-closed bands at 30, 50 and 70."""
    by_product = materialize(by_product)
    s = Scalars(by_product, times=F.max("times_missing"), price=F.max("price"))
    scored = s.attach(by_product).withColumns(
        {
            "frequency_score": F.col("times_missing") / s.times * 100.0,
            "value_score": F.col("price") / s.price * 100.0,
        }
    )
    score = F.col("risk_score")
    return s.detach(scored).withColumn(
        "risk_score", F.col("frequency_score") * 0.6 + F.col("value_score") * 0.4
    ).withColumn(
        "risk_category",
        F.when(score >= 70, "Critical").when(score >= 50, "High").when(score >= 30, "Medium").otherwise("Low"),
    )


def category_distribution(products: DataFrame) -> DataFrame:
    """P-8."""
    total = Scalars(products, n=rows())
    stats = products.groupBy("category").agg(
        rows().alias("product_count"),
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("price").alias("total_value"),
    )
    return total.detach(
        total.attach(stats).withColumn("pct_of_catalog", F.col("product_count") / total.n * 100.0)
    )


def missing_by_category(products: DataFrame, missing_items: DataFrame) -> DataFrame:
    """P-9: events, value and share of the catalogue; counts real events only."""
    by_product = missing_by_product(products, missing_items)
    catalogue = products.groupBy("category").agg(rows().alias("product_count"))
    return (
        by_product.groupBy("category")
        .agg(
            F.sum("times_missing").alias("items_missing"),
            F.sum("value_lost").alias("total_value_lost"),
            rows().alias("unique_products_missing"),
        )
        .join(catalogue, "category", "left")
        .withColumns(
            {
                "pct_products_missing": F.col("unique_products_missing") / F.col("product_count") * 100.0,
                "avg_value_per_missing": F.col("total_value_lost") / F.col("items_missing"),
            }
        )
    )


def missing_by_price_segment(products: DataFrame, missing_items: DataFrame, edges=(20, 50, 100)) -> DataFrame:
    """P-10."""
    by_product = missing_by_product(products, missing_items).withColumn("price_segment", price_segment("price", edges))
    by_product = materialize(by_product)
    total = Scalars(by_product, n=F.sum("times_missing"))
    grouped = by_product.groupBy("price_segment").agg(
        F.sum("times_missing").alias("items_missing"), F.sum("value_lost").alias("total_value_lost")
    )
    return total.detach(
        total.attach(grouped).withColumn("pct_of_missing", F.col("items_missing") / total.n * 100.0)
    )


def driver_product(facts: DataFrame, drivers: DataFrame, n: int = 20) -> DataFrame:
    """P-11: driver-product combinations with the most events."""
    grouped = facts.groupBy("driver_id", "product_id", "product_name", "category").agg(
        rows().alias("times_missing"), F.sum("price").alias("value_lost")
    )
    top = grouped.orderBy(F.desc("times_missing"), "driver_id", "product_id").limit(n)
    return top.join(drivers.select("driver_id", "driver_name"), "driver_id", "left")


def high_value_driver_losses(facts: DataFrame, drivers: DataFrame, min_price: float = 100.0) -> DataFrame:
    """P-12."""
    grouped = (
        facts.where(F.col("price") >= min_price)
        .groupBy("driver_id")
        .agg(rows().alias("high_value_items_missing"), F.sum("price").alias("high_value_lost"))
    )
    return grouped.join(drivers.select("driver_id", "driver_name"), "driver_id", "left")


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with the most rows, ties to the smallest key."""
    return df.groupBy(key).agg(rows().alias("_n")).orderBy(F.desc("_n"), key).limit(n).select(key)


def driver_category_matrix(facts: DataFrame, drivers_n: int = 5, categories_n: int = 5) -> DataFrame:
    """P-13: events of the top drivers in the top categories, long form with zeros."""
    counts = facts.groupBy("driver_id", "category").agg(rows().alias("n"))
    top_d, top_c = top_keys(facts, "driver_id", drivers_n), top_keys(facts, "category", categories_n)
    names = top_c.agg(F.collect_list("category")).scalar()
    grid = top_d.withColumn("category", names).withColumn("category", F.explode("category"))
    return grid.join(counts, ["driver_id", "category"], "left").select(
        "driver_id", "category", F.coalesce("n", F.lit(0)).alias("items_missing")
    )


def crosstab(facts: DataFrame, *keys) -> DataFrame:
    """P-14, P-16: events and value by any keys, long form."""
    return facts.groupBy(*keys).agg(rows().alias("items_missing"), F.sum("price").alias("value_lost"))


def region_category_matrix(facts: DataFrame, categories: list[str]) -> DataFrame:
    """P-14: one column per category; the list fixes the schema."""
    return facts.groupBy("region").pivot("category", categories).agg(rows()).fillna(0)


def top_products_per_region(facts: DataFrame, n: int = 3) -> DataFrame:
    """P-15: the rank limit is pushed below the shuffle, so at most n rows per task and region move."""
    counts = facts.groupBy("region", "product_name").agg(rows().alias("times_missing"))
    w = Window.partitionBy("region").orderBy(F.desc("times_missing"), "product_name")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def high_value_by_period(facts: DataFrame, min_price: float = 100.0) -> DataFrame:
    """P-16: events at or above a price by clock period."""
    return (
        facts.where(F.col("price") >= min_price)
        .groupBy(delivery_period("delivery_hour").alias("period"))
        .agg(rows().alias("high_value_missing"), F.sum("price").alias("value_lost"))
    )


def _flag_with_fallback(flag, mean_rate: str, p: float):
    """A flag over a small frame; if it marks nothing, mark the rows at or above a quantile."""
    everything = Window.partitionBy()
    return F.when(F.max(flag.cast("int")).over(everything) == 1, flag).otherwise(
        F.col(mean_rate) >= F.percentile(mean_rate, p).over(everything)
    )


def _small_signal(orders: DataFrame, key: str, name: str, flag_name: str, p: float) -> DataFrame:
    """Mean order rate, event percentile and anomaly flag per weekday, hour or region."""
    everything = Window.partitionBy()
    rate = f"{name}_missing_rate"
    stats = orders.groupBy(key).agg(
        F.avg("order_missing_rate").alias(rate),
        F.sum("_events").alias("_n"),
        missing_rate(F.sum("items_missing"), F.sum("items_delivered")).alias("_rate"),
    )
    limit = F.avg("_rate").over(everything) + 2 * F.stddev_samp("_rate").over(everything)
    flag = F.coalesce(F.col("_rate") > limit, F.lit(False))
    seen = F.col("_n") > 0
    below = F.sum("_n").over(everything.orderBy(rate).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("_n").over(Window.partitionBy(rate))
    values = F.size(F.collect_set(F.when(seen, F.col(rate))).over(everything))
    pct = (below - ties + (ties + 1) / 2.0) / F.sum("_n").over(everything) * 100.0
    return stats.select(
        key,
        rate,
        _flag_with_fallback(flag, rate, p).alias(flag_name),
        F.when(values <= 1, F.lit(50.0)).otherwise(pct).alias(f"{name}_signal"),
    )


def order_exposure(orders: DataFrame, missing_items: DataFrame) -> DataFrame:
    """P-17: pattern exposure points of every order.

    Weekday, hour, region and driver-customer pair are attributes of the order,
    so the points are worked out per order and reach the items by one join.
    Percentiles are over missing events; each order weighs in with its events.
    """
    return _exposed_orders(orders, missing_items)[0]


def _exposed_orders(orders: DataFrame, missing_items: DataFrame) -> tuple[DataFrame, int]:
    """Orders with their points, and how many there are. They meet their pairs in tasks of bounded size."""
    events = missing_items.groupBy("order_id").agg(rows().alias("_events"))
    base = materialize(
        orders.join(events, "order_id", "left")
        .fillna(0, ["_events"])
        .withColumns(
            {
                "order_missing_rate": missing_rate("items_missing", "items_delivered"),
                "day_of_week": F.date_format("order_date", "EEEE"),
                "region": F.coalesce("region", F.lit("Unknown")),
            }
        )
    )
    day = _small_signal(base, "day_of_week", "day", "is_anomaly_day", 0.80)
    hour = _small_signal(base, "delivery_hour", "hour", "is_anomaly_hour", 0.85)
    region = _small_signal(base, "region", "region", "is_high_risk_region", 0.85)

    n = base.count()
    by_pair = dealt(base, "driver_id", "customer_id", rows=n)
    pairs = materialize(
        by_pair.groupBy("driver_id", "customer_id").agg(
            rows().alias("interactions"),
            F.avg("order_missing_rate").alias("pair_missing_rate"),
            F.sum("_events").alias("_n"),
            missing_rate(F.sum("items_missing"), F.sum("items_delivered")).alias("_rate"),
        )
    )
    known = (F.col("interactions") >= 3) & (F.col("_rate") >= THRESHOLDS.fraud_rate)
    found = Scalars(pairs, "_known", n=F.count(F.when(known, 1)))
    cutoff = Scalars(quantiles(pairs, {"q": ("pair_missing_rate", 0.95)}), "_cut")
    ranks = running_counts(pairs.where(F.col("_n") > 0), "pair_missing_rate", weight="_n").select(
        "pair_missing_rate",
        F.when(F.col("distinct") <= 1, F.lit(50.0))
        .otherwise(average_rank() / F.col("total") * 100.0)
        .alias("pair_signal"),
    )
    fallback = (
        (F.col("interactions") >= 2) & (F.col("pair_missing_rate") >= cutoff.q) & (F.col("pair_missing_rate") > 0)
    )
    flagged = cutoff.attach(found.attach(pairs)).withColumn(
        "is_collusion_pair", F.when(found.n > 0, known).otherwise(fallback)
    )
    pair = flagged.join(ranks, "pair_missing_rate", "left").select(
        "driver_id", "customer_id", "pair_missing_rate", "pair_signal", "is_collusion_pair"
    )
    # Weekday and hour tables are at most 7 and 24 rows; regions are a fixed dimension.
    joined = (
        by_pair.join(F.broadcast(day), "day_of_week", "left")
        .join(F.broadcast(hour), "delivery_hour", "left")
        .join(F.broadcast(region), "region", "left")
        .join(dealt(pair, "driver_id", "customer_id", rows=n), ["driver_id", "customer_id"], "left")
    )
    points = (
        F.col("day_signal") * 0.30
        + F.col("hour_signal") * 0.20
        + F.col("region_signal") * 0.25
        + F.col("pair_signal") * 0.25
        + F.col("is_anomaly_day").cast("int") * 8
        + F.col("is_anomaly_hour").cast("int") * 7
        + F.col("is_high_risk_region").cast("int") * 7
        + F.col("is_collusion_pair").cast("int") * 10
    )
    return joined.withColumn("pattern_exposure_points", clip(points, 0, 100)).drop("_events"), n


def pattern_exposure(missing_items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """P-17: facts with signals, flags and points; items meet orders in tasks of bounded size."""
    exposed, n = _exposed_orders(orders, missing_items)
    n += missing_items.count()
    items, exposed = (dealt(df, "order_id", rows=n) for df in (missing_items, exposed))
    return missing_facts(items, exposed, products).fillna(0.0, ["price"])


def exposure_by_product(exposed: DataFrame) -> DataFrame:
    """Events, losses, rates, and numbers of different orders, customers and regions of each product.

    Several distinct counts in one aggregation would hold every row once for
    each of them in a task's memory, with all other sums. So the rows are written
    once, narrow, and each count folds its own pairs, in tasks of bounded size.
    """
    flags = {
        "is_anomaly_day": "anomaly_day_rate",
        "is_anomaly_hour": "anomaly_hour_rate",
        "is_high_risk_region": "high_risk_region_rate",
        "is_collusion_pair": "collusion_pair_rate",
    }
    distinct = {"order_id": "orders_affected", "customer_id": "unique_customers", "region": "unique_regions"}
    narrow = materialize(exposed.select("product_id", *distinct, "price", *flags, "pattern_exposure_points"))
    n = narrow.count()
    out = dealt(narrow, "product_id", "order_id", rows=n).groupBy("product_id").agg(
        rows().alias("times_reported_missing"),
        money_sum("price").alias("estimated_loss"),
        *[F.avg(F.col(c).cast("double")).alias(name) for c, name in flags.items()],
        F.avg("pattern_exposure_points").alias("pattern_exposure_index"),
    )
    known = None
    for c, name in distinct.items():
        pairs = dealt(narrow.select("product_id", c), "product_id", c, rows=n).distinct()
        one = pairs.select("product_id", *[(F.col(c).isNotNull() if x == name else F.lit(False)).alias(x) for x in distinct.values()])
        known = one if known is None else known.unionByName(one)
    counts = known.groupBy("product_id").agg(*[F.count_if(name).alias(name) for name in distinct.values()])
    out = out.join(counts, "product_id")
    order = ["product_id", "times_reported_missing", "orders_affected", "estimated_loss", "unique_customers", "unique_regions"]
    return out.select(*order, *flags.values(), "pattern_exposure_index")


def product_scope(products: DataFrame, exposed: DataFrame, edges=PRICE_BAND_EDGES) -> DataFrame:
    """P-18: losses, costs, 40/30/20/10 score, tiers and ranks of every product."""
    agg = exposure_by_product(exposed)
    loss, times = F.col("estimated_loss"), F.col("times_reported_missing")
    scoped = materialize(
        products.withColumn("price", F.coalesce("price", F.lit(0.0)))
        .join(agg, "product_id", "left")
        .fillna(0, [c for c in agg.columns if c != "product_id"])
        .withColumns(
            {
                "avg_unit_price": F.when(times > 0, loss / times).otherwise(F.col("price")),
                "price_band": bucketize("price", edges, PRICE_BAND_LABELS),
                "margin_rate": lookup("category", MARGIN_BY_CATEGORY, DEFAULT_MARGIN),
            }
        )
        .withColumns({"margin_loss": loss * F.col("margin_rate"), "replacement_cost": loss * 1.10})
    )
    turnover = running_counts(scoped, "orders_affected", ["category"]).select(
        "category", "orders_affected", (average_rank() / F.col("total") * 100.0).alias("stock_turnover_proxy")
    )
    s = Scalars(
        scoped,
        times=F.greatest(F.max(times).cast("double"), F.lit(1.0)),
        loss=F.greatest(F.max(loss), F.lit(1.0)),
        margin=F.greatest(F.max("margin_rate"), F.lit(0.01)),
        pattern=F.greatest(F.max("pattern_exposure_index"), F.lit(1.0)),
        total=F.sum(loss),
    )
    scored = s.attach(scoped.join(turnover, ["category", "orders_affected"], "left")).withColumns(
        {
            "frequency_score": clip(times / s.times * 100.0, 0, 100),
            "value_score": clip(loss / s.loss * 100.0, 0, 100),
            "margin_score": clip(F.col("margin_rate") / s.margin * 100.0, 0, 100),
            "pattern_score": clip(F.col("pattern_exposure_index") / s.pattern * 100.0, 0, 100),
            "loss_pct_of_total": percent_of(loss, s.total),
        }
    )
    score = (
        F.col("frequency_score") * 0.40
        + F.col("value_score") * 0.30
        + F.col("margin_score") * 0.20
        + F.col("pattern_score") * 0.10
    )
    tiered = (
        s.detach(scored)
        .withColumn("risk_score", F.round(clip(score, 0, 100), 8))
        .withColumn("risk_tier", bucketize("risk_score", [-0.1, 30, 55, 75, 100], RISK_LABELS))
        .withColumn(
            "prevention_cost", F.when(F.col("risk_tier").isin("High", "Critical"), loss * 0.42).otherwise(loss * 0.30)
        )
        .withColumns(
            {
                "prevention_roi": percent_of(F.col("replacement_cost") - F.col("prevention_cost"), "prevention_cost"),
                "opportunity_cost": loss * 1.25,
            }
        )
    )
    return materialize(tiered)


def with_risk_rank(scope: DataFrame) -> DataFrame:
    """P-18: dense rank of the products by score, highest first."""
    ranks = running_counts(scope, "risk_score").select(
        "risk_score", (F.col("distinct") - F.col("dense") + 1).cast("int").alias("risk_rank")
    )
    return scope.join(ranks, "risk_score", "left")


def category_scope(scope: DataFrame, facts: DataFrame) -> DataFrame:
    """P-19: category totals with each order's revenue counted once per category."""
    stats = scope.groupBy("category").agg(
        rows().alias("sku_count"),
        F.count(F.when(F.col("risk_tier").isin("High", "Critical"), 1)).alias("high_risk_skus"),
        F.sum("times_reported_missing").alias("times_reported_missing"),
        F.sum("estimated_loss").alias("estimated_loss"),
        F.sum("margin_loss").alias("margin_loss"),
        F.sum("replacement_cost").alias("replacement_cost"),
        F.sum("prevention_cost").alias("prevention_cost"),
        F.avg("risk_score").alias("avg_risk_score"),
    )
    amounts = materialize(facts.select("order_id", "category", "order_amount"))
    revenue = (
        dealt(amounts, "order_id", "category")
        .distinct()
        .groupBy("category")
        .agg(money_sum("order_amount").alias("revenue_proxy"))
    )
    return (
        stats.join(revenue, "category", "left")
        .fillna(0.0, ["revenue_proxy"])
        .withColumns(
            {
                "loss_pct_revenue": percent_of("estimated_loss", "revenue_proxy"),
                "prevention_roi": percent_of(F.col("replacement_cost") - F.col("prevention_cost"), "prevention_cost"),
            }
        )
    )


def monthly_category_loss(facts: DataFrame) -> DataFrame:
    """P-20."""
    return (
        facts.where(F.col("order_date").isNotNull())
        .groupBy(F.trunc("order_date", "month").alias("month_start"), "category")
        .agg(F.sum("price").alias("estimated_loss"), rows().alias("missing_events"))
        .withColumn("month_label", F.date_format("month_start", "MMM yyyy"))
    )


def scoped_revenue(facts: DataFrame) -> DataFrame:
    """P-21: order amounts of the scope, every order once."""
    per_order = facts.groupBy("order_id").agg(F.max("order_amount").alias("order_amount"))
    return per_order.agg(F.coalesce(money_sum("order_amount"), F.lit(0.0)).alias("scoped_revenue"))


def daily_loss(facts: DataFrame) -> DataFrame:
    """Loss per calendar day, zero filled, with a day index from 0."""
    daily = (
        facts.where(F.col("order_date").isNotNull()).groupBy("order_date").agg(F.sum("price").alias("loss"))
    )
    full = spine(daily, "order_date", "1 day", "order_date").join(daily, "order_date", "left").fillna(0.0, ["loss"])
    first = F.min("order_date").over(Window.partitionBy())
    return full.withColumn("day_index", F.datediff("order_date", first))


HORIZONS = [30, 60, 90]


def loss_forecast(daily: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """P-22: linear trend summed over future days, never negative; mean times days if short or flat."""
    x = F.col("day_index").cast("double")
    fit = daily.agg(
        rows().alias("n"),
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop("loss"), F.lit(0.0)).alias("std"),
        (F.max("loss") - F.min("loss")).alias("span"),
        F.regr_slope(F.col("loss"), x).alias("slope"),
        F.regr_intercept(F.col("loss"), x).alias("intercept"),
    )
    ahead = fit.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    flat = (F.col("n") < 7) | (F.col("span") <= 1e-8)
    days = F.sequence(F.col("n"), F.col("n") + F.col("horizon_days") - 1)
    future = ahead.withColumn("_x", F.explode(days)).withColumn(
        "_y",
        F.when(flat, F.col("mean")).otherwise(
            F.greatest(F.col("slope") * F.col("_x") + F.col("intercept"), F.lit(0.0))
        ),
    )
    out = future.groupBy("horizon_days", "std").agg(F.sum("_y").alias("projected_loss"))
    margin = F.col("std") * F.sqrt("horizon_days")
    return out.select(
        "horizon_days",
        "projected_loss",
        F.greatest(F.col("projected_loss") - margin, F.lit(0.0)).alias("projected_loss_low"),
        (F.col("projected_loss") + margin).alias("projected_loss_high"),
    )


def cumulative_history(daily: DataFrame, days: int = 60) -> DataFrame:
    """P-23: running loss of the last days beside the mean-based target."""
    calendar = Window.partitionBy()
    mean = F.avg("loss").over(calendar)
    recent = daily.withColumns(
        {"_mean": mean, "_back": F.row_number().over(calendar.orderBy(F.desc("order_date")))}
    ).where(F.col("_back") <= days)
    run = calendar.orderBy("order_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return recent.select(
        "order_date",
        "loss",
        F.sum("loss").over(run).alias("cumulative_loss"),
        (F.col("_mean") * F.row_number().over(calendar.orderBy("order_date"))).alias("baseline_target"),
    )


def behavior_shift(facts: DataFrame, recent: int = 3) -> DataFrame:
    """P-24: last active months of a product against the earlier ones; needs one month more than recent.

    The window holds one row per active month of a product, bounded by the calendar.
    """
    monthly = facts.where(F.col("order_date").isNotNull()).groupBy(
        "product_id", "product_name", F.trunc("order_date", "month").alias("month_start")
    ).agg(F.sum("price").alias("monthly_loss"))
    back = F.row_number().over(Window.partitionBy("product_id", "product_name").orderBy(F.desc("month_start")))
    return (
        monthly.withColumn("_r", back)
        .groupBy("product_id", "product_name")
        .agg(
            rows().alias("_n"),
            F.avg(F.when(F.col("_r") > recent, F.col("monthly_loss"))).alias("baseline_loss"),
            F.avg(F.when(F.col("_r") <= recent, F.col("monthly_loss"))).alias("recent_loss"),
        )
        .where(F.col("_n") > recent)
        .drop("_n")
        .withColumn("change_pct", pct_change_safe("recent_loss", "baseline_loss"))
    )


def baseline_delta(monthly: DataFrame) -> DataFrame:
    """P-25: the same on the monthly totals; below four months the last month against the mean."""
    totals = monthly.groupBy("month_start").agg(F.sum("estimated_loss").alias("v"))
    calendar = Window.partitionBy()
    ranked = totals.withColumns(
        {"_r": F.row_number().over(calendar.orderBy(F.desc("month_start"))), "_n": rows().over(calendar)}
    )
    short = F.col("_n") < 4
    v = F.col("v")
    return ranked.agg(
        F.coalesce(F.avg(F.when(short | (F.col("_r") > 3), v)), F.lit(0.0)).alias("baseline_loss"),
        F.coalesce(F.avg(F.when(F.col("_r") <= F.when(short, 1).otherwise(3), v)), F.lit(0.0)).alias("recent_loss"),
    ).withColumn("delta_pct", pct_change_safe("recent_loss", "baseline_loss"))


def sku_triage_queue(scope: DataFrame, facts: DataFrame, reference_date: str) -> DataFrame:
    """P-26: recency, loss percentile, 60/25/15 priority, tier, time target and top decile."""
    last = facts.groupBy("product_id").agg(F.max("order_date").alias("last_event_date"))
    ranks = running_counts(scope, "estimated_loss").select(
        "estimated_loss", (average_rank() / F.col("total") * 100.0).alias("loss_percentile")
    )
    top = Scalars(quantiles(scope, {"p90": ("estimated_loss", 0.90)}))
    days = F.datediff(F.lit(reference_date).cast("date"), F.col("last_event_date"))
    queue = (
        scope.join(last, "product_id", "left")
        .join(ranks, "estimated_loss", "left")
        .withColumn("recency_days", F.greatest(F.coalesce(days, F.lit(999)), F.lit(0)))
        .withColumn("recency_score", clip(100.0 - F.col("recency_days") * 3.33, 0, 100))
        .withColumn(
            "priority_score",
            clip(
                F.col("risk_score") * 0.60 + F.col("loss_percentile") * 0.25 + F.col("recency_score") * 0.15, 0, 100
            ),
        )
    )
    p = F.col("priority_score")
    tier = F.when(p >= 80, "Immediate").when(p >= 60, "Fast Track").when(p >= 40, "Review").otherwise("Monitor")
    return top.detach(
        top.attach(queue.withColumn("priority_tier", tier)).withColumns(
            {
                "sla_target": lookup("priority_tier", SLA_BY_PRIORITY, "48h"),
                "top_decile_flag": (F.col("estimated_loss") >= top.p90) & (F.col("estimated_loss") > 0),
                "last_event_label": F.coalesce(F.date_format("last_event_date", "yyyy-MM-dd"), F.lit("No events")),
            }
        )
    ).select(
        "product_id",
        "product_name",
        "category",
        "risk_tier",
        "risk_score",
        "estimated_loss",
        "times_reported_missing",
        "last_event_date",
        "recency_days",
        "recency_score",
        "loss_percentile",
        "priority_score",
        "priority_tier",
        "sla_target",
        "top_decile_flag",
        "last_event_label",
    )


def margin_loss_frame(scope: DataFrame) -> DataFrame:
    """P-27: products with a loss, margin in percent and a 10-34 point size."""
    lossy = scope.where(F.col("estimated_loss") > 0)
    s = Scalars(lossy, lo=F.min("times_reported_missing"), hi=F.max("times_reported_missing"))
    size = F.when(s.hi > s.lo, 10.0 + min_max("times_reported_missing", s.lo, s.hi, 0.0, 24.0)).otherwise(F.lit(16.0))
    return s.attach(lossy).select(
        "product_id",
        "product_name",
        "category",
        "estimated_loss",
        "times_reported_missing",
        "risk_score",
        (F.col("margin_rate") * 100.0).alias("margin_pct"),
        size.alias("bubble_size"),
    )


def category_accuracy_proxy(categories: DataFrame, performance: DataFrame, drift: DataFrame) -> DataFrame:
    """P-28: model confidence per category from the anomaly rate change, loss z-score and drift."""
    perf = Scalars(performance.select("rate_change_pct"), "_perf")
    drifting = Scalars(drift, "_drift", n=F.count(F.when(F.col("is_drifting"), 1)))
    spread = Scalars(categories, "_loss", mean=F.avg("estimated_loss"), std=F.stddev_samp("estimated_loss"))
    base = clip(86.0 - F.abs(perf.rate_change_pct) * 0.1, 72, 94)
    z = F.when(spread.std > 0, (F.col("estimated_loss") - spread.mean) / spread.std).otherwise(F.lit(0.0))
    return spread.attach(drifting.attach(perf.attach(categories))).select(
        "category",
        "estimated_loss",
        clip(base - z * 2.5, 65, 96).alias("model_accuracy_proxy"),
        F.when(drifting.n > 0, "Drift monitoring active").otherwise("Stable").alias("drift_status"),
    )


def segment_risk_matrix(facts: DataFrame, customers: DataFrame) -> DataFrame:
    """P-29: events by spend segment and customer risk; events are folded per customer before the join."""
    events = facts.groupBy("customer_id").agg(rows().alias("n"))
    return (
        events.join(customers.select("customer_id", "spending_segment", "risk_category"), "customer_id")
        .groupBy("spending_segment")
        .pivot("risk_category", RISK_LABELS)
        .agg(F.sum("n"))
        .fillna(0)
    )


def customer_exposure(facts: DataFrame, customers: DataFrame, scope: DataFrame, n: int = 12) -> DataFrame:
    """P-29: share of events of High and Critical customers for the riskiest products, by name."""
    high = F.col("risk_tier").isin("High", "Critical")
    s = Scalars(scope, "_any", high=F.count(F.when(high, 1)))
    q = Scalars(quantiles(scope, {"p80": ("risk_score", 0.80)}), "_q")
    risky = (
        q.attach(s.attach(scope))
        .where(F.when(s.high > 0, high).otherwise(F.col("risk_score") >= q.p80))
        .select("product_id")
    )
    per_customer = (
        facts.join(risky, "product_id", "left_semi")
        .groupBy("product_name", "customer_id")
        .agg(rows().alias("n"), F.sum("price").alias("v"))
        .join(customers.select("customer_id", "risk_category"), "customer_id", "left")
    )
    critical = F.col("risk_category").isin("High", "Critical")
    return (
        per_customer.groupBy("product_name")
        .agg(
            (F.sum(F.when(critical, F.col("n")).otherwise(0)) / F.sum("n") * 100.0).alias("critical_customer_share"),
            rows().alias("unique_customers"),
            F.sum("v").alias("estimated_loss"),
        )
        .orderBy(F.desc("critical_customer_share"), "product_name")
        .limit(n)
    )


def top_products(scope: DataFrame, n: int) -> DataFrame:
    """The n products with the largest loss; n is small, so the keys may be broadcast."""
    order = [F.desc("estimated_loss"), F.desc("times_reported_missing"), F.asc("product_id")]
    return scope.orderBy(*order).limit(n).select("product_id")


def product_region_loss(facts: DataFrame, scope: DataFrame, n: int = 5) -> DataFrame:
    """P-30."""
    return (
        facts.join(F.broadcast(top_products(scope, n)), "product_id", "left_semi")
        .groupBy("region", "product_id", "product_name")
        .agg(F.sum("price").alias("estimated_loss"), rows().alias("missing_events"))
    )


def category_roi(categories: DataFrame) -> DataFrame:
    """P-31."""
    saving = F.col("replacement_cost") - F.col("prevention_cost")
    return categories.select(
        "category",
        "replacement_cost",
        "prevention_cost",
        "prevention_roi",
        saving.alias("potential_savings_usd"),
        percent_of(saving, "replacement_cost").alias("potential_savings_pct"),
        (F.col("replacement_cost") >= F.col("prevention_cost") * 1.5).alias("opportunity_flag"),
    )


def insights(scope: DataFrame, categories: DataFrame, delta: DataFrame, temporal: DataFrame) -> DataFrame:
    """P-32: facts behind the insight texts, one row each."""
    total = Scalars(scope, "_t", loss=F.sum("estimated_loss"))
    order = [F.desc("estimated_loss"), F.desc("times_reported_missing"), F.asc("product_id")]
    lead = total.attach(categories.orderBy(F.desc("estimated_loss"), "category").limit(1)).select(
        F.lit("top_category").alias("insight"),
        F.col("category").alias("subject"),
        percent_of("estimated_loss", total.loss).alias("value"),
    )
    product = scope.orderBy(*order).limit(1).select(
        F.lit("top_product"), F.col("product_name"), F.col("risk_score")
    )
    anomalies = temporal.where(F.col("anomalies_total") > 0).select(
        F.lit("temporal_anomalies"), F.col("worst_day"), F.col("anomalies_total").cast("double")
    )
    change = delta.select(F.lit("baseline_delta"), F.lit("loss"), F.col("delta_pct"))
    return lead.union(product).union(anomalies).union(change)


def recommendations(scope: DataFrame, categories: DataFrame, forecast: DataFrame) -> DataFrame:
    """P-32: three actions by money saved."""
    high = scope.where(F.col("risk_tier").isin("High", "Critical")).agg(
        F.coalesce(F.sum("estimated_loss"), F.lit(0.0)).alias("v")
    )
    a = high.select(
        F.lit("Strengthen delivery proof for top 10 highest-risk SKUs").alias("action"),
        (F.col("v") * 0.28).alias("impact_usd"),
        F.lit("Medium").alias("effort"),
    )
    b = categories.orderBy(F.desc("estimated_loss"), "category").limit(1).select(
        F.concat(F.lit("Review operational process for "), "category", F.lit(" category")),
        F.col("estimated_loss") * 0.22,
        F.lit("Low"),
    )
    c = forecast.where(F.col("horizon_days") == 90).select(
        F.lit("Activate enhanced surveillance for regional clusters + high-risk customers"),
        F.col("projected_loss") * 0.16,
        F.lit("High"),
    )
    return a.union(b).union(c).orderBy(F.desc("impact_usd"), "action").limit(3)


# Weekday columns in calendar order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def product_weekday_heatmap(facts: DataFrame, scope: DataFrame, n: int = 12) -> DataFrame:
    """P-33."""
    return (
        facts.join(F.broadcast(top_products(scope, n)), "product_id", "left_semi")
        .withColumn("day_of_week", F.date_format("order_date", "EEEE"))
        .groupBy("product_name")
        .pivot("day_of_week", WEEKDAYS)
        .agg(rows())
        .fillna(0)
    )


def product_kpis(scope: DataFrame, facts: DataFrame, forecast: DataFrame, risk_limit: float = 60.0) -> DataFrame:
    """P-34."""
    f90 = forecast.where(F.col("horizon_days") == 90).agg(F.max("projected_loss")).scalar()
    seen = scope.where(F.col("times_reported_missing") > 0)
    med = Scalars(quantiles(seen, {"price": ("price", 0.5), "freq": ("times_reported_missing", 0.5)}))
    stats = scope.agg(
        F.sum("times_reported_missing").alias("total_units_missing"),
        F.sum("estimated_loss").alias("total_estimated_loss"),
        F.count(F.when(F.col("risk_score") >= risk_limit, 1)).alias("high_risk_skus"),
        F.sum("margin_loss").alias("margin_at_risk"),
        F.sum("opportunity_cost").alias("opportunity_cost"),
    )
    return med.detach(
        med.attach(stats).withColumns(
            {
                "forecast_90": F.coalesce(f90, F.lit(0.0)),
                "scoped_revenue": scoped_revenue(facts).scalar(),
                "median_price": med.price,
                "median_frequency": med.freq,
            }
        )
    ).withColumn("loss_pct_revenue", percent_of("total_estimated_loss", "scoped_revenue"))


def loss_hierarchy(scope: DataFrame) -> DataFrame:
    """P-35: loss totals by category, price band and product name with all subtotals."""
    return (
        scope.where(F.col("estimated_loss") > 0)
        .rollup("category", "price_band", "product_name")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("estimated_loss").alias("estimated_loss"),
            F.avg("risk_score").alias("avg_risk_score"),
        )
    )
