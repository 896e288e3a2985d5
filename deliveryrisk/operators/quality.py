"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deliveryrisk.functions.scalar import Scalars, missing_rate, percent_of


def rows() -> Column:
    return F.count(F.lit(1))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def fk_violations(child: DataFrame, parent: DataFrame, key: str, check: str) -> DataFrame:
    """DQ-1: child rows and distinct keys without a parent."""
    orphans = child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
    return (
        orphans.groupBy(key)
        .agg(rows().alias("_n"))
        .agg(rows().alias("distinct_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"))
        .select(F.lit(check).alias("check"), "distinct_keys", "row_count")
    )


def range_violations(orders: DataFrame, drivers: DataFrame) -> DataFrame:
    """DQ-2: negative items or amounts, drivers under 18."""

    def count(df, check, cond):
        return df.agg(F.count(F.when(cond, 1)).alias("row_count")).select(F.lit(check).alias("check"), "row_count")

    return union_all(
        [
            count(orders, "negative items_missing", F.col("items_missing") < 0),
            count(orders, "negative order_amount", F.col("order_amount") < 0),
            count(drivers, "driver age below 18", F.col("age") < 18),
        ]
    )


def over_missing_orders(orders: DataFrame) -> DataFrame:
    """DQ-3: orders with more missing than delivered items."""
    return orders.where(F.col("items_missing") > F.col("items_delivered"))


def validate(orders, customers, drivers, missing_items) -> DataFrame:
    """DQ-4: one row per failed check; no row means the data are fine."""
    references = union_all(
        [
            fk_violations(orders, drivers, "driver_id", "invalid driver_ids"),
            fk_violations(orders, customers, "customer_id", "invalid customer_ids"),
            fk_violations(missing_items, orders, "order_id", "invalid order_ids"),
        ]
    ).select("check", F.col("distinct_keys").alias("row_count"))
    return references.union(range_violations(orders, drivers)).where(F.col("row_count") > 0)


def blank(df: DataFrame, c: str) -> Column:
    """Missing value; for text also a blank one."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return F.coalesce(F.trim(c) == "", F.lit(True))
    return F.col(c).isNull()


def severity(rate: Column) -> Column:
    return F.when(rate >= 5.0, "Critical").when(rate >= 2.0, "High").when(rate >= 0.5, "Medium").otherwise("Low")


def quality_issues(
    orders: DataFrame, drivers: DataFrame, customers: DataFrame, products: DataFrame, today: str
) -> DataFrame:
    """DQ-5: seven checks with count, rate and severity, one pass per table."""

    def checks(df, scope, conditions):
        counted = df.agg(
            rows().alias("total"), *[F.count(F.when(c, 1)).alias(f"c{i}") for i, c in enumerate(conditions.values())]
        )
        entries = F.array(
            *[
                F.struct(F.lit(issue).alias("issue"), F.col(f"c{i}").alias("count"))
                for i, issue in enumerate(conditions)
            ]
        )
        return counted.select("total", F.explode(entries).alias("e")).select(
            "e.issue", F.lit(scope).alias("scope"), F.col("e.count").alias("issue_count"), "total"
        )

    parts = [
        checks(
            orders,
            "Orders",
            {
                "Orders missing driver": blank(orders, "driver_id"),
                "Orders missing customer": blank(orders, "customer_id"),
                "Orders with negative amount": F.col("order_amount") < 0,
                "Orders in future date": F.col("order_date") > F.lit(today).cast("date"),
            },
        ),
        checks(drivers, "Drivers", {"Drivers missing age": blank(drivers, "age")}),
        checks(customers, "Customers", {"Customers missing age": blank(customers, "customer_age")}),
        checks(products, "Products", {"Products missing category": blank(products, "category")}),
    ]
    rate = percent_of("issue_count", "total")
    return union_all(parts).select(
        "issue", "scope", "issue_count", F.round(rate, 4).alias("rate_pct"), severity(rate).alias("severity")
    )


def quality_score(orders: DataFrame, today: str) -> DataFrame:
    """DQ-6: 100 minus the issues per hundred orders, at least 0; 100 without orders."""
    bad = (
        blank(orders, "driver_id").cast("int")
        + blank(orders, "customer_id").cast("int")
        + F.coalesce((F.col("order_amount") < 0).cast("int"), F.lit(0))
        + F.coalesce((F.col("order_date") > F.lit(today).cast("date")).cast("int"), F.lit(0))
    )
    return orders.agg(
        rows().alias("total_orders"),
        F.coalesce(F.sum(bad), F.lit(0)).alias("total_issues"),
        F.coalesce(F.date_format(F.min("order_date"), "yyyy-MM-dd"), F.lit("N/A")).alias("date_start"),
        F.coalesce(F.date_format(F.max("order_date"), "yyyy-MM-dd"), F.lit("N/A")).alias("date_end"),
    ).withColumn(
        "quality_score",
        F.round(
            F.greatest(F.lit(0.0), 100.0 - F.col("total_issues") / F.greatest("total_orders", F.lit(1)) * 100.0), 2
        ),
    )


def schema_catalog(df: DataFrame, table: str) -> DataFrame:
    """DQ-7: type, nulls and null share of every column in one pass."""
    counted = df.agg(
        rows().alias("_rows"), *[F.count(F.when(F.col(f.name).isNull(), 1)).alias(f.name) for f in df.schema.fields]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f.name).alias("null_count"),
            )
            for f in df.schema.fields
        ]
    )
    return counted.select("_rows", F.explode(entries).alias("e")).select(
        F.lit(table).alias("table_name"),
        "e.*",
        F.col("_rows").alias("row_count"),
        F.round(percent_of("e.null_count", "_rows"), 2).alias("null_pct"),
    )


def driver_consistency(orders: DataFrame, monthly: DataFrame) -> DataFrame:
    """DQ-9: monthly totals reconcile with the key figures, volume is present, no critical nulls."""
    k = Scalars(
        orders,
        "_kpi",
        missing=F.sum("items_missing"),
        delivered=F.sum("items_delivered"),
        nulls=F.count(
            F.when(F.col("driver_id").isNull() | F.col("order_amount").isNull() | F.col("items_missing").isNull(), 1)
        ),
    )
    m = monthly.agg(F.sum("items_missing").alias("m"), F.sum("items_delivered").alias("d"))
    kpi_rate, month_rate = missing_rate(k.missing, k.delivered), missing_rate("m", "d")
    entries = [
        ("Reconciliation", F.col("m") == k.missing),
        ("Rate", F.abs(month_rate - kpi_rate) <= 0.01),
        ("Sample", k.missing + k.delivered > 0),
        ("Completeness", k.nulls == 0),
    ]
    packed = F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("passed")) for n, c in entries])
    return k.attach(m).select(F.explode(packed).alias("e")).select("e.*")


def product_consistency(orders: DataFrame, missing_items: DataFrame, products: DataFrame, regional: DataFrame) -> DataFrame:
    """DQ-10: three totals of missing items agree; no orphan products or categories."""
    totals = Scalars(orders, "_orders", v=F.coalesce(F.sum("items_missing"), F.lit(0)))
    regions = Scalars(regional, "_regions", v=F.coalesce(F.sum("items_missing"), F.lit(0)))
    known = missing_items.join(products.select("product_id"), "product_id", "left_semi")
    events = Scalars(known, "_events", v=rows())
    orphans = missing_items.select("product_id").join(products.select("product_id"), "product_id", "left_anti")
    lost = Scalars(orphans.distinct(), "_lost", v=rows())
    one = totals.attach(regions.attach(events.attach(lost.attach(orders.sparkSession.range(1)))))
    parity = lambda a, b: F.when(a == b, "OK").otherwise("Mismatch")
    entries = [
        ("Total missing items parity (Overview vs Product page)", parity(totals.v, events.v), totals.v, events.v),
        ("Total missing items parity (Regional vs Product page)", parity(regions.v, events.v), regions.v, events.v),
        (
            "Orphan SKU references in missing items",
            F.when(lost.v == 0, "OK").otherwise("Gap"),
            lost.v,
            F.lit(0).cast("long"),
        ),
    ]
    if "category" in missing_items.columns:
        only = missing_items.where("category IS NOT NULL").join(products.select("category"), "category", "left_anti")
        extra = Scalars(only.select("category").distinct(), "_extra", v=rows())
        one = extra.attach(one)
        entries.append(
            (
                "Category consistency (catalog vs missing events)",
                F.when(extra.v == 0, "OK").otherwise("Gap"),
                extra.v,
                F.lit(0).cast("long"),
            )
        )
    packed = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"), s.alias("status"), a.cast("long").alias("left_value"), b.alias("right_value")
            )
            for n, s, a, b in entries
        ]
    )
    return one.select(F.explode(packed).alias("e")).select("e.*")


@dataclass(frozen=True)
class Contract:
    """What an output must hold: its columns, columns without NULL, and allowed ranges."""

    required: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()


def validate_outputs(outputs: Mapping[str, tuple[DataFrame, Contract]]) -> DataFrame:
    """DQ-11: one row per output and rule with the number of violations."""
    results = []
    for name, (df, c) in outputs.items():
        rules: dict[str, Column | int] = {}
        for col in c.required:
            rules[f"has column {col}"] = 0 if col in df.columns else 1
        for col in c.numeric:
            ok = col in df.columns and isinstance(df.schema[col].dataType, T.NumericType)
            rules[f"numeric {col}"] = 0 if ok else 1
        for col in c.not_null:
            if col in df.columns:
                rules[f"no null in {col}"] = F.count(F.when(F.col(col).isNull(), 1))
        for col, (lo, hi) in c.ranges.items():
            if col in df.columns:
                bad = F.lit(False)
                if lo is not None:
                    bad = bad | (F.col(col) < lo)
                if hi is not None:
                    bad = bad | (F.col(col) > hi)
                rules[f"range of {col}"] = F.count(F.when(bad, 1))
        counted = df.agg(
            *[
                (v if isinstance(v, Column) else F.max(F.lit(v)).cast("long")).alias(f"r{i}")
                for i, v in enumerate(rules.values())
            ]
        )
        entries = F.array(
            *[
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.coalesce(f"r{i}", F.lit(v if isinstance(v, int) else 0).cast("long")).alias("violations"),
                )
                for i, (rule, v) in enumerate(rules.items())
            ]
        )
        results.append(
            counted.select(F.explode(entries).alias("e")).select(
                F.lit(name).alias("output"), "e.rule", "e.violations", (F.col("e.violations") == 0).alias("passed")
            )
        )
    return union_all(results)
