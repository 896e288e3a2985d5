"""Contracts of outputs: declared rules, all rules of an output in one aggregate.

A contract lists what one output must hold. Relations compare outputs: parity of
a measure of two of them, and containment of the keys of one in another. Each
output is read once for its own rules and measures; a containment reads the two
key columns. One row of results comes back for an output, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "whole": T.IntegralType,
    "number": T.NumericType,
    "text": T.StringType,
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "flag": T.BooleanType,
}


@dataclass(frozen=True)
class Contract:
    """What an output must hold.

    ``columns`` maps required columns to a kind (a key of KINDS, or None for
    any), ``not_null`` and ``warn_null`` name columns without NULL, ``ranges``
    gives closed limits (None: open), ``allowed`` the values of a column,
    ``unique`` a key, ``least_rows`` how many rows there are at least, ``checks``
    conditions that every row meets (NULL counts as met). ``measures`` are
    aggregates for parities.
    """

    columns: Mapping[str, str | None]
    not_null: Sequence[str] = ()
    warn_null: Sequence[str] = ()
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    allowed: Mapping[str, Sequence] = field(default_factory=dict)
    unique: Sequence[str] = ()
    least_rows: int = 0
    checks: Mapping[str, str] = field(default_factory=dict)
    measures: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Parity:
    """A measure of one output equals one of another, up to a tolerance."""

    left: tuple[str, str]
    right: tuple[str, str]
    tolerance: float = 0.0

    @property
    def rule(self) -> str:
        return f"{self.left[1]} equals {self.right[0]}.{self.right[1]}"


@dataclass(frozen=True)
class Contained:
    """Every key of one output occurs in another; NULL keys are left to ``not_null``."""

    child: tuple[str, str]
    parent: tuple[str, str]

    @property
    def rule(self) -> str:
        return f"{self.child[1]} is in {self.parent[0]}.{self.parent[1]}"


def violations(df: DataFrame, c: Contract) -> dict[str, tuple[str, Column | int]]:
    """Rule: (severity, count of violations); rules about absent columns only say that these are absent."""
    rules: dict[str, tuple[str, Column | int]] = {}
    has = set(df.columns)

    def count(bad: Column) -> Column:
        return F.count(F.when(bad, 1))

    for name, kind in c.columns.items():
        rules[f"has column {name}"] = ("issue", int(name not in has))
        if kind is not None and name in has:
            rules[f"{name} is a {kind}"] = ("issue", int(not isinstance(df.schema[name].dataType, KINDS[kind])))
    for severity, names in (("issue", c.not_null), ("warning", c.warn_null)):
        for name in names:
            if name in has:
                rules[f"no null in {name}"] = (severity, count(F.col(name).isNull()))
    for name, (low, high) in c.ranges.items():
        if name in has:
            outside = F.lit(False)
            if low is not None:
                outside = outside | (F.col(name) < F.lit(low))
            if high is not None:
                outside = outside | (F.col(name) > F.lit(high))
            rules[f"range of {name}"] = ("issue", count(outside))
    for name, values in c.allowed.items():
        if name in has:
            rules[f"values of {name}"] = ("warning", count(~F.col(name).isin(*values)))
    if c.unique and has.issuperset(c.unique):
        key = F.struct(*c.unique)
        rules[f"unique {', '.join(c.unique)}"] = ("issue", F.count(F.lit(1)) - F.count_distinct(key))
    if c.least_rows:
        rules[f"at least {c.least_rows} rows"] = ("issue", F.greatest(F.lit(c.least_rows) - F.count(F.lit(1)), F.lit(0)))
    for name, condition in c.checks.items():
        rules[name] = ("issue", count(~F.expr(condition)))
    return rules


def check_outputs(
    outputs: Mapping[str, tuple[DataFrame, Contract]], relations: Sequence[Parity | Contained] = ()
) -> DataFrame:
    """DQ-11: output, rule, severity, violations, passed, for all rules of all outputs and between them."""
    some = next(iter(outputs.values()))[0].sparkSession
    results: list[tuple] = []
    measured: dict[tuple[str, str], float | None] = {}
    for name, (df, contract) in outputs.items():
        rules = violations(df, contract)
        counted = {rule: v for rule, (_, v) in rules.items() if isinstance(v, Column)}
        aggregates = [v.cast("long").alias(f"r{i}") for i, v in enumerate(counted.values())]
        aggregates += [F.expr(m).cast("double").alias(f"m{i}") for i, m in enumerate(contract.measures.values())]
        row = df.agg(*aggregates).first() if aggregates else None
        found = {rule: row[f"r{i}"] for i, rule in enumerate(counted)}
        results += [(name, rule, level, int(found.get(rule, v) if rule in found else v)) for rule, (level, v) in rules.items()]
        measured |= {(name, m): row[f"m{i}"] for i, m in enumerate(contract.measures)}
    for r in relations:
        if isinstance(r, Parity):
            a, b = measured[r.left], measured[r.right]
            equal = a is b is None or (a is not None and b is not None and abs(a - b) <= r.tolerance)
            results.append((r.left[0], r.rule, "issue", int(not equal)))
        else:
            (child, key), (parent, of) = r.child, r.parent
            keys = outputs[child][0].select(F.col(key).alias("k")).where(F.col("k").isNotNull())
            known = outputs[parent][0].select(F.col(of).alias("k"))
            results.append((child, r.rule, "issue", keys.join(known, "k", "left_anti").count()))
    rows = [(*r, r[3] == 0) for r in results]
    return some.createDataFrame(rows, "output string, rule string, severity string, violations bigint, passed boolean")


LEVELS = ("Low", "Medium", "High", "Critical")
SHARE = (0.0, 100.0)

# What the summaries and the tables behind them must hold.
CONTRACTS = {
    "orders": Contract(
        {"order_id": None, "order_date": "date", "order_amount": "number", "region": "text", "items_delivered": "whole",
         "items_missing": "whole", "delivery_hour": "whole", "driver_id": None, "customer_id": None},
        not_null=("order_id", "order_date"), warn_null=("items_delivered", "items_missing", "order_amount"),
        ranges={"delivery_hour": (0, 23), "items_missing": (0, None), "items_delivered": (0, None), "order_amount": (0, None)},
        unique=("order_id",), least_rows=1,
        measures={"orders": "count(*)", "missing": "sum(items_missing)", "with_missing": "count(case when items_missing > 0 then 1 end)"},
    ),
    "drivers": Contract({"driver_id": None, "driver_name": "text", "age": "whole", "trips": "whole"}, ("driver_id",), unique=("driver_id",), measures={"drivers": "count(*)"}),
    "customers": Contract({"customer_id": None, "customer_name": "text", "customer_age": "whole"}, ("customer_id",), unique=("customer_id",), measures={"customers": "count(*)"}),
    "products": Contract({"product_id": None, "product_name": "text", "category": "text", "price": "number"}, ("product_id",), ranges={"price": (0, None)}, unique=("product_id",)),
    "missing_items": Contract(
        {"missing_item_id": None, "order_id": None, "product_id": None, "item_position": "whole"},
        ("order_id", "product_id"), ranges={"item_position": (1, None)}, measures={"items": "count(*)"},
    ),
    "overview_metrics": Contract(
        {"total_orders": "whole", "overall_missing_rate": "number", "orders_with_missing": "whole",
         "pct_orders_with_missing": "number", "estimated_loss": "number", "date_range_start": "date", "date_range_end": "date"},
        ("total_orders", "overall_missing_rate", "orders_with_missing", "pct_orders_with_missing", "estimated_loss",
         "date_range_start", "date_range_end"),
        ranges={"overall_missing_rate": SHARE, "pct_orders_with_missing": SHARE, "estimated_loss": (0, None)}, least_rows=1,
        checks={"dates in order": "date_range_start <= date_range_end", "flagged orders are orders": "orders_with_missing <= total_orders"},
        measures={"orders": "sum(total_orders)", "missing": "sum(total_items_missing)", "with_missing": "sum(orders_with_missing)",
                  "drivers": "sum(total_drivers)", "customers": "sum(total_customers)"},
    ),
    "month_of_year": Contract(
        {"month": "whole", "month_name": "text", "missing_rate": "number", "total_orders": "whole", "items_missing": "whole"},
        ("missing_rate", "month_name", "total_orders", "items_missing"), ranges={"month": (1, 12), "missing_rate": SHARE},
        unique=("month",), least_rows=1, measures={"orders": "sum(total_orders)", "missing": "sum(items_missing)"},
    ),
    "risk_alerts": Contract(
        {"entity_type": "text", "entity_id": None, "entity_name": "text", "risk_score": "number", "risk_category": "text"},
        ("entity_id",), ranges={"risk_score": SHARE},
        allowed={"risk_category": LEVELS, "entity_type": ("Driver", "Customer", "Region")},
        checks={"entities reach the threshold": "entity_type = 'Region' OR risk_score >= 70"},
    ),
    "risk_distribution": Contract(
        {"entity_type": "text", "risk_category": "text", "n": "whole"}, ("entity_type", "risk_category", "n"),
        ranges={"n": (0, None)}, allowed={"risk_category": LEVELS}, unique=("entity_type", "risk_category"), least_rows=2 * len(LEVELS),
        measures={"drivers": "sum(case when entity_type = 'driver' then n else 0 end)",
                  "customers": "sum(case when entity_type = 'customer' then n else 0 end)"},
    ),
    "regional_summary": Contract(
        {"region": "text", "missing_rate": "number", "total_orders": "whole", "items_missing": "whole"},
        ("missing_rate", "total_orders", "items_missing"), ranges={"missing_rate": SHARE}, unique=("region",),
        measures={"orders": "sum(total_orders)", "missing": "sum(items_missing)"},
    ),
    "driver_summary": Contract(
        {"driver_id": None, "driver_name": "text", "orders_completed": "whole", "missing_rate": "number", "risk_score": "number", "risk_category": "text"},
        ("driver_id", "risk_score"), ranges={"missing_rate": SHARE, "risk_score": SHARE}, allowed={"risk_category": LEVELS}, unique=("driver_id",),
        measures={"orders": "sum(orders_completed)", "missing": "sum(items_missing)", "drivers": "count(risk_category)"},
    ),
    "customer_summary": Contract(
        {"customer_id": None, "customer_name": "text", "total_orders": "whole", "claim_rate": "number", "risk_score": "number", "risk_category": "text"},
        ("customer_id", "risk_score"), ranges={"claim_rate": (0.0, 50.0), "risk_score": SHARE}, allowed={"risk_category": LEVELS}, unique=("customer_id",),
        measures={"orders": "sum(total_orders)", "customers": "count(risk_category)"},
    ),
}

# Sums that must agree, and keys that must be known.
RELATIONS = (
    Parity(("overview_metrics", "orders"), ("orders", "orders")),
    Parity(("overview_metrics", "missing"), ("orders", "missing")),
    Parity(("overview_metrics", "with_missing"), ("orders", "with_missing")),
    Parity(("overview_metrics", "drivers"), ("drivers", "drivers")),
    Parity(("overview_metrics", "customers"), ("customers", "customers")),
    Parity(("month_of_year", "orders"), ("orders", "orders")),
    Parity(("month_of_year", "missing"), ("orders", "missing")),
    Parity(("regional_summary", "orders"), ("orders", "orders")),
    Parity(("regional_summary", "missing"), ("orders", "missing")),
    Parity(("driver_summary", "orders"), ("orders", "orders")),
    Parity(("driver_summary", "missing"), ("orders", "missing")),
    Parity(("customer_summary", "orders"), ("orders", "orders")),
    Parity(("risk_distribution", "drivers"), ("driver_summary", "drivers")),
    Parity(("risk_distribution", "customers"), ("customer_summary", "customers")),
    Parity(("missing_items", "items"), ("orders", "missing")),
    Contained(("orders", "driver_id"), ("drivers", "driver_id")),
    Contained(("orders", "customer_id"), ("customers", "customer_id")),
    Contained(("missing_items", "order_id"), ("orders", "order_id")),
    Contained(("missing_items", "product_id"), ("products", "product_id")),
)


def check_summaries(frames: Mapping[str, Callable[[], DataFrame] | DataFrame]) -> DataFrame:
    """DQ-11: the contracts above for the frames given; relations of absent frames are left out."""
    ready = {name: (f() if callable(f) else f, CONTRACTS[name]) for name, f in frames.items()}
    ends = {r: (r.left[0], r.right[0]) if isinstance(r, Parity) else (r.child[0], r.parent[0]) for r in RELATIONS}
    return check_outputs(ready, [r for r, (a, b) in ends.items() if a in ready and b in ready])
