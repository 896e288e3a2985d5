"""Ranks, quantiles and positions that never put one group into one task.

Ranks: rows are reduced to distinct values with counts (a partial aggregation, so
a hot value costs one row per task), and those are sent to ranges of the whole
order (Spark's range partitioning) and written once with the number of their
range. Sums run inside each range and are moved by the totals of the ranges
before it; only the totals, one for each range and group, meet in one window
partition. There are as many ranges as shuffle partitions at most; the plan does
not grow with them.

Quantiles: a mergeable sketch of one pass gives a bracket around each quantile,
a second pass counts the rows below the bracket and groups the few values inside
it. Nothing of the size of the column is ordered or written, and the result is
exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import materialize

# The sketch errs by one of so many rows at most.
ACCURACY = 10_000
# Half the width of a bracket, as a share of the rows; ten times that error.
MARGIN = 10 / ACCURACY
# Brackets are narrowed until they hold no more rows than this, about.
FEW = 1 << 20


def running_sums(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
    tail: Sequence[str] = (),
) -> DataFrame:
    """Sums per distinct value with, for each measure m, ``m_below`` (sum of smaller values) and ``m_total``.

    The order is ``lead`` columns, then ``value``, then ``tail`` columns, inside
    each ``by`` group. NULL values are left out. ``dense`` is the dense rank and
    ``distinct`` the number of distinct values of the group.
    """
    keys = [*by, *lead, value, *tail]
    rows = df.where(F.col(value).isNotNull())
    sums = rows.groupBy(*keys).agg(*[c.alias(m) for m, c in measures.items()])
    ranged = materialize(sums.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    block = [*by, "_range"]
    inside = Window.partitionBy(*block).orderBy(*lead, value, *tail)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns(
        {f"{m}_below": F.sum(m).over(upto) - F.col(m) for m in measures} | {"dense": F.row_number().over(inside)}
    )
    group = Window.partitionBy(*by)
    blocks = ranged.groupBy(*block).agg(
        *[F.sum(m).alias(f"_{m}_block") for m in measures], F.count(F.lit(1)).alias("_values")
    )
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # null keys form a group like any other
    offsets = blocks.select(
        *[F.col(c).alias(f"{c}_of") for c in block],
        *[F.coalesce(F.sum(f"_{m}_block").over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(f"_{m}_block").over(group).alias(f"{m}_total") for m in measures],
        F.coalesce(F.sum("_values").over(earlier), F.lit(0)).alias("_value_offset"),
        F.sum("_values").over(group).alias("distinct"),
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in block])
    return local.join(offsets, same).select(
        *keys,
        *measures,
        *[(F.col(f"{m}_below") + F.col(f"_{m}_offset")).alias(f"{m}_below") for m in measures],
        *[f"{m}_total" for m in measures],
        (F.col("dense") + F.col("_value_offset")).alias("dense"),
        "distinct",
    )


def running_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    lead: Sequence[str] = (),
    tail: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Distinct values with ``n`` rows, ``below`` rows ordered before, and ``total`` rows of the group.

    ``weight`` names a column saying how many rows a row stands for.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return running_sums(df, value, {"n": n}, by, lead, tail).withColumnsRenamed({"n_below": "below", "n_total": "total"})


def average_rank(below: Column | str = "below", n: Column | str = "n") -> Column:
    """1-based rank in which ties share their mean position."""
    b = F.col(below) if isinstance(below, str) else below
    c = F.col(n) if isinstance(n, str) else n
    return b + (c + 1) / F.lit(2.0)


def with_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Join ``avg_rank``, ``dense_rank`` (ascending) and ``pct_rank`` of a value back to its rows."""
    ranks = running_counts(df, value, by).select(
        *by,
        value,
        average_rank().alias("avg_rank"),
        F.col("dense").cast("int").alias("dense_rank"),
        (F.col("distinct") - F.col("dense") + 1).cast("int").alias("dense_rank_desc"),
        (average_rank() / F.col("total")).alias("pct_rank"),
    )
    return df.join(ranks, [*by, value], "left")


def brackets(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> tuple[dict[str, int], dict[str, tuple]]:
    """Rows of each column, and for each quantile two values between which it lies.

    The sketch's rank error is far below the margin, so the ranks of both bounds
    enclose the quantile's. Small columns are bracketed by their range. Where a
    bracket still holds very many rows, the sketch is taken again inside it.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))

    def sketch(value: Column, at: float) -> Column:
        ends = [max(0.0, at - MARGIN), min(1.0, at + MARGIN)]
        return F.percentile_approx(value, ends, ACCURACY)

    first = df.agg(
        *[F.struct(F.count(c), F.min(c), F.max(c)).alias(f"c{i}") for i, c in enumerate(columns)],
        *[sketch(F.col(c), p).alias(f"q{i}") for i, (c, p) in enumerate(wanted.values())],
    ).first()
    facts = {c: tuple(first[f"c{i}"]) for i, c in enumerate(columns)}
    rows = {c: n for c, (n, _, _) in facts.items()}
    found: dict[str, tuple] = {}
    inside: dict[str, float] = {}
    for i, (name, (c, _)) in enumerate(wanted.items()):
        large = rows[c] > 4 * ACCURACY
        found[name] = tuple(first[f"q{i}"]) if large else facts[c][1:]
        inside[name] = rows[c] * 3 * MARGIN if large else rows[c]
    while wide := [m for m in wanted if inside[m] > FEW and found[m][0] < found[m][1]]:
        held = {m: F.col(wanted[m][0]).between(*map(F.lit, found[m])) for m in wide}
        counts = df.agg(
            *[F.count(F.when(F.col(wanted[m][0]) < F.lit(found[m][0]), 1)).alias(f"b{i}") for i, m in enumerate(wide)],
            *[F.count(F.when(held[m], 1)).alias(f"i{i}") for i, m in enumerate(wide)],
        ).first()
        place = {}
        for i, m in enumerate(wide):
            c, p = wanted[m]
            place[m] = (p * (rows[c] - 1) - counts[f"b{i}"]) / max(1, counts[f"i{i}"])
            inside[m] = counts[f"i{i}"] * 3 * MARGIN
        again = df.agg(
            *[sketch(F.when(held[m], F.col(wanted[m][0])), min(1.0, max(0.0, place[m]))).alias(f"q{i}") for i, m in enumerate(wide)]
        ).first()
        found |= {m: tuple(again[f"q{i}"]) for i, m in enumerate(wide)}
    return rows, found


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: ``{name: (column, probability)}``.

    Without groups by brackets, for several columns in the same two passes; of
    groups by ranks.
    """
    if by:
        return group_quantiles(df, wanted, by)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(c for c, _ in wanted.values())])
    rows, found = brackets(numbers, wanted)
    held = []
    for i, (name, (c, _)) in enumerate(wanted.items()):
        low, high = (F.lit(x).cast("double") for x in found[name])
        # rows below the bracket count together, as NULL
        value = F.when(F.col(c) >= low, F.col(c))
        held.append(F.when(F.col(c) <= high, F.struct(F.lit(i).alias("i"), value.alias("v"))))
    tall = numbers.select(F.explode(F.filter(F.array(*held), lambda e: e.isNotNull())).alias("e"))
    counts = tall.groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("below", F.sum("n").over(upto) - F.col("n")).where(F.col("v").isNotNull())
    picks, out = [], []
    for i, (name, (c, p)) in enumerate(wanted.items()):
        pos = p * (rows[c] - 1)
        for side, at in (("lo", math.floor(pos)), ("hi", math.ceil(pos))):
            hit = (F.col("i") == i) & (F.col("below") <= at) & (F.lit(at) < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col("v"))).alias(f"_{i}_{side}"))
        low, high = F.col(f"_{i}_lo"), F.col(f"_{i}_hi")
        exact = low + (high - low) * (pos - math.floor(pos))
        if rows[c]:
            exact = F.coalesce(exact, F.raise_error(F.lit(f"quantile {name} is outside its bracket")))
        out.append(exact.cast("double").alias(name))
    return placed.agg(*picks).select(*out)


def group_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str]) -> DataFrame:
    """Exact quantiles of every group."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    if len(columns) == 1:
        rc = running_counts(df, columns[0], by).withColumnRenamed(columns[0], "_value").withColumn(
            "_metric", F.lit(columns[0])
        )
    else:
        tall = df.select(
            *by,
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])
            ).alias("_e"),
        ).select(*by, F.col("_e.m").alias("_metric"), F.col("_e.v").alias("_value"))
        rc = running_counts(tall, "_value", [*by, "_metric"])
    picks = []
    for name, (c, p) in wanted.items():
        pos = F.when(F.col("_metric") == c, F.lit(float(p)) * (F.col("total") - 1))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col("_value"))).cast("double").alias(f"_{name}_{side}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    found = rc.groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
            for n in wanted
        ],
    )


def quantile(df: DataFrame, value: str, p: float) -> Column:
    """One exact quantile as a scalar subquery."""
    return quantiles(df, {"q": (value, p)}).scalar()


def ordered_positions(
    df: DataFrame, by: Sequence[str], value: str, lead: Sequence[str], tail: Sequence[str], out: str
) -> DataFrame:
    """Number the rows of each group from 1 in the order lead, value, tail; safe for a hot group."""
    rc = running_counts(df, value, by, lead, tail)
    first = F.col("below") + 1
    numbered = rc.select(*by, *lead, value, *tail, F.explode(F.sequence(first, F.col("below") + F.col("n"))).alias(out))
    return numbered.withColumn(out, F.col(out).cast("int"))


# Groups with more rows than this are numbered by ranges, not by one task.
HEAVY_GROUP = 1 << 20
COUNTED_BUCKETS = 1 << 14


def heavy_groups(df: DataFrame, by: Sequence[str], most: int) -> DataFrame | None:
    """The groups of more than ``most`` rows, or None.

    Rows are first counted by hash, which shuffles next to nothing; only groups
    that share a bucket of so many rows are counted themselves.
    """
    bucket = F.pmod(F.xxhash64(*by), F.lit(COUNTED_BUCKETS))
    full = materialize(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))
    if full.isEmpty():
        return None
    # at most COUNTED_BUCKETS rows
    suspects = df.withColumn("_bucket", bucket).join(F.broadcast(full.select("_bucket")), "_bucket")
    heavy = materialize(suspects.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*by))
    return None if heavy.isEmpty() else heavy


def line_positions(
    df: DataFrame, by: Sequence[str], lead: Sequence[str], value: str, tail: Sequence[str], out: str, most: int | None = None
) -> DataFrame:
    """Number the rows of each group from 1 in the order lead, value, tail.

    One shuffle by group with a sort inside it numbers all groups of usual size;
    a group of more than ``most`` rows is split into ranges instead.
    """
    heavy = heavy_groups(df, by, most or HEAVY_GROUP)
    keys = [*by, *lead, value, *tail]
    order = Window.partitionBy(*by).orderBy(*lead, value, *tail)

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.select(*keys).withColumn(out, F.row_number().over(order))

    if heavy is None:
        return numbered(df)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by])
    marked = heavy.select(*[F.col(c).alias(f"{c}_of") for c in by])
    light = numbered(df.join(marked, same, "left_anti"))
    return light.unionByName(ordered_positions(df.join(marked, same, "left_semi"), by, value, lead, tail, out))
