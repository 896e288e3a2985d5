"""Filters and generic grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import THRESHOLDS
from deliveryrisk.functions.ranking import quantiles
from deliveryrisk.functions.scalar import Scalars


def text_match(query: str, columns: Sequence[str]):
    needle = query.strip().lower()
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def apply_filters(
    df: DataFrame,
    date_range: tuple | None = None,
    regions: Sequence[str] = (),
    text: str = "",
    text_columns: Sequence[str] = (),
    date_column: str = "order_date",
    region_column: str = "region",
) -> DataFrame:
    """SC-1: inclusive dates, region list and case-insensitive search; empty settings do not filter."""
    if date_range and date_column in df.columns:
        start, end = date_range
        df = df.where(F.col(date_column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if regions and region_column in df.columns:
        df = df.where(F.col(region_column).isin(list(regions)))
    if text.strip() and text_columns:
        df = df.where(text_match(text, text_columns))
    return df


def filter_customers(
    customers: DataFrame,
    risks: Sequence[str] = (),
    segment: str = "All",
    min_priority: float = 0.0,
    min_orders: float = 0.0,
    repeat_only: bool = False,
    text: str = "",
) -> DataFrame:
    """SC-2."""
    df = customers
    if risks:
        df = df.where(F.col("risk_category").isin(list(risks)))
    if segment != "All":
        df = df.where(F.col("spending_segment") == segment)
    df = df.where((F.col("priority_score") >= float(min_priority)) & (F.col("total_orders") >= min_orders))
    if repeat_only:
        df = df.where(F.col("orders_with_claims") >= 2)
    if text.strip():
        df = df.where(text_match(text, ["customer_name", "customer_id"]))
    return df


# Sort modes of the region table and whether they ascend.
REGION_SORTS = {
    "Risk Rank": ("risk_rank", True),
    "Missing Rate (Highest)": ("missing_rate", False),
    "Gap vs Avg (Highest)": ("missing_rate_gap", False),
    "Orders with Missing (Highest)": ("pct_orders_with_missing", False),
    "Orders Volume (Highest)": ("total_orders", False),
    "Revenue Share (Highest)": ("revenue_share", False),
    "Estimated Loss (Highest)": ("estimated_loss_usd", False),
}


def filter_sort_regions(geo: DataFrame, text: str = "", tiers: Sequence[str] = (), sort_mode: str = "Risk Rank") -> DataFrame:
    """SC-3: region table filtered and sorted, ties by name."""
    df = geo
    if text.strip():
        df = df.where(text_match(text, ["region"]))
    if tiers:
        df = df.where(F.col("risk_tier").isin(list(tiers)))
    column, ascending = REGION_SORTS.get(sort_mode, ("risk_rank", True))
    return df.orderBy(F.asc(column) if ascending else F.desc(column), "region")


def scope_items(missing_items: DataFrame, products: DataFrame, category: str = "", product_id=None) -> DataFrame:
    scoped = missing_items
    if product_id is not None:
        scoped = scoped.where(F.col("product_id") == product_id)
    if category:
        wanted = products.where(F.col("category") == category).select("product_id")
        scoped = scoped.join(wanted, "product_id", "left_semi")
    return scoped


def scope_orders_by_product(
    orders: DataFrame, missing_items: DataFrame, products: DataFrame, category: str = "", product_id=None
) -> DataFrame:
    """SC-4: orders with at least one missing item in the scope."""
    items = scope_items(missing_items, products, category, product_id).select("order_id")
    return orders.join(items, "order_id", "left_semi")


AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
}


def summary_table(
    df: DataFrame, by: str, aggs: Mapping[str, Sequence[str]], sort_by: str | None = None, ascending: bool = False
) -> DataFrame:
    """SC-5: generic group-by with names column_function."""
    out = df.groupBy(by).agg(*[AGGREGATES[fn](c).alias(f"{c}_{fn}") for c, fns in aggs.items() for fn in fns])
    return out.orderBy(F.asc(sort_by) if ascending else F.desc(sort_by), by) if sort_by else out


def scope_facts(facts: DataFrame, categories: Sequence[str] = (), start=None, end=None) -> DataFrame:
    """SC-6: category list and inclusive dates."""
    df = facts.where(F.col("category").isin(list(categories))) if categories else facts
    return df.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))) if start else df


def high_risk_orders(
    featured: DataFrame, rate_limit: float = THRESHOLDS.order_rate, value_limit: float | None = None
) -> DataFrame:
    """SC-7: a high rate, or missing items on an order of at least median value."""
    rate = F.col("missing_rate") >= rate_limit
    if value_limit is not None:
        return featured.where(rate | (F.col("has_missing") & (F.col("order_amount") >= value_limit)))
    s = Scalars(quantiles(featured, {"median": ("order_amount", 0.5)}))
    return s.detach(
        s.attach(featured).where(rate | (F.col("has_missing") & (F.col("order_amount") >= s.median)))
    )
