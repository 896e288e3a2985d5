"""Column expressions: rates, bands, periods and normalisers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliveryrisk.config import RISK_EDGES, RISK_LABELS, THRESHOLDS, Thresholds

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_rate(missing: ColumnLike, delivered: ColumnLike) -> Column:
    """Missing share of all items in percent; 0 when there are no items."""
    m, total = col(missing), col(missing) + col(delivered)
    return F.when(total > 0, m / total * 100.0).otherwise(F.lit(0.0))


def percent_of(part: ColumnLike, whole: ColumnLike) -> Column:
    """part / whole in percent; 0 when the whole is not positive or unknown."""
    p, w = F.coalesce(col(part), F.lit(0)), F.coalesce(col(whole), F.lit(0))
    return F.when(w > 0, p / w * 100.0).otherwise(F.lit(0.0))


def ratio_or_null(part: ColumnLike, whole: ColumnLike) -> Column:
    """SQL style ratio: NULL when the whole is 0."""
    return col(part).cast("double") / F.nullif(col(whole).cast("double"), F.lit(0.0))


def rate_pct(part: ColumnLike, whole: ColumnLike) -> Column:
    """SQL view style percentage with two decimals, NULL when the whole is 0."""
    return F.round(ratio_or_null(part, whole) * 100.0, 2)


def round_half_up(c: ColumnLike, digits: int) -> Column:
    """Decimal rounding: digits beyond the eighth are floating point noise."""
    return F.round(col(c).cast("decimal(38,8)"), digits).cast("double")


def safe_ratio(part: ColumnLike, whole: ColumnLike) -> Column:
    return F.when(col(whole) == 0, F.lit(0.0)).otherwise(ratio_or_null(part, whole))


def pct_change_safe(current: ColumnLike, baseline: ColumnLike) -> Column:
    """Change in percent of the baseline; 0 when the baseline is 0."""
    c, b = col(current), col(baseline)
    return F.when(b == 0, F.lit(0.0)).otherwise((c - b) / F.nullif(b, F.lit(0.0)) * 100.0)


def clip(c: ColumnLike, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(low))), F.lit(float(high)))


def min_max(c: ColumnLike, low: Column, high: Column, on_flat: float, scale: float = 1.0) -> Column:
    """(c - low) / (high - low) times scale, or on_flat when the span is 0."""
    span = high - low
    return F.when(span == 0, F.lit(float(on_flat))).otherwise(
        (col(c) - low) / F.nullif(span.cast("double"), F.lit(0.0)) * scale
    )


def max_scale(c: ColumnLike, top: Column, scale: float = 100.0) -> Column:
    return F.when(top > 0, col(c) / F.nullif(top.cast("double"), F.lit(0.0)) * scale).otherwise(F.lit(0.0))


def bucketize(c: ColumnLike, edges: Sequence, labels: Sequence[str], right: bool = True) -> Column:
    """Label the interval a value falls in.

    ``edges`` has one element more than ``labels``; None is an open end, a
    Column is allowed. ``right`` closes intervals on the right. Values outside
    all intervals, and NULL, give NULL.
    """
    value = col(c)
    low = edges[0]
    out = None
    for label, high in zip(labels, edges[1:]):
        if high is None:
            inside = value.isNotNull()
        else:
            inside = value <= high if right else value < high
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    if low is None:
        return out
    above = value > low if right else value >= low
    return F.when(above, out)


def band_rank(label: ColumnLike, labels: Sequence[str]) -> Column:
    """Position of an ordered label, from 1."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), col(label)), F.lit(0)).cast("int")


def risk_band(score: ColumnLike, mode: str = "cut", t: Thresholds = THRESHOLDS) -> Column:
    """``cut``: right-closed bands of 0-100. ``threshold``: left-closed by configured limits."""
    if mode == "cut":
        return bucketize(score, RISK_EDGES, RISK_LABELS)
    s = col(score)
    return (
        F.when(s >= t.critical, "Critical").when(s >= t.high, "High").when(s >= t.medium, "Medium").otherwise("Low")
    )


def risk_predicates(score: ColumnLike, t: Thresholds = THRESHOLDS) -> dict[str, Column]:
    s = col(score)
    return {
        "is_critical": s >= t.critical,
        "is_high": s >= t.high,
        "is_medium": s >= t.medium,
        "is_alert": s >= t.alert,
        "is_valid_score": s.isNotNull() & s.between(0, 100),
    }


def delivery_period(hour: ColumnLike, mode: str = "clock") -> Column:
    """``clock``: 6-11, 12-17, 18-21, rest Night. ``cut``: right-closed at 6, 12, 18, 24."""
    h = col(hour)
    if mode == "cut":
        return bucketize(h, [-1, 6, 12, 18, 24], ["Night", "Morning", "Afternoon", "Evening"])
    return (
        F.when(h.between(6, 11), "Morning")
        .when(h.between(12, 17), "Afternoon")
        .when(h.between(18, 21), "Evening")
        .otherwise("Night")
    )


def price_segment(price: ColumnLike, edges: Sequence[int] = (20, 50, 100)) -> Column:
    """Left-closed price segments named after their edges."""
    p = col(price)
    a, b, c = edges
    return (
        F.when(p < a, f"Budget (<${a})")
        .when(p < b, f"Mid-Range (${a}-${b})")
        .when(p < c, f"Premium (${b}-${c})")
        .otherwise(f"High-Value (${c}+)")
    )


def lookup(key: ColumnLike, table: Mapping[str, float], default) -> Column:
    """Constant dictionary lookup with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(key)), F.lit(default))


def money_sum(c: ColumnLike) -> Column:
    """Exact sum of amounts with two decimals, added up as whole cents."""
    return F.sum(F.rint(col(c) * 100).cast("bigint")) / 100.0


def money_avg(c: ColumnLike) -> Column:
    return F.sum(F.rint(col(c) * 100).cast("bigint")) / 100.0 / F.count(col(c))


def safe_corr(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation over rows where both are known; NULL when either does not vary."""
    known = col(x).isNotNull() & col(y).isNotNull()
    a = F.when(known, col(x).cast("double"))
    b = F.when(known, col(y).cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


class Scalars:
    """One-row statistics usable as constants in another frame.

    All statistics come from one aggregation (or a one-row frame), planned as
    one scalar subquery: Spark runs it once and puts the values into the rows of
    the frame it is attached to. No join is needed and nothing is collected.
    """

    def __init__(self, source: DataFrame, _name: str = "_s", **aggregates: Column):
        if aggregates:
            packed = source.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s"))
        else:
            packed = source.select(F.struct("*").alias("s"))
        self._row = packed.scalar()
        self._column = _name

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self._column, self._row)

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(self._column)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return F.col(f"{self._column}.{name}")
