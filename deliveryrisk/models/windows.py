"""Isolation forests for many training windows at once."""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deliveryrisk.functions.materialize import materialize
from deliveryrisk.functions.ranking import quantiles
from deliveryrisk.models.forest import Forest
from deliveryrisk.models.iforest import TREE_SCHEMA, average_path, grow, path_lengths

# Windows whose forests are held by a task at the same time.
TOGETHER = 12
# Buckets of scores that a task counts for each window, and scores that are told apart in the end.
BUCKETS = 4096
FEW_SCORES = 1 << 16
# Rows that tell beforehand where a window's cutoff is, about, and deviations of their ranks that it may be off.
FIRST_ROWS = 1 << 18
DEVIATIONS = 6.0
SAMPLE_PASSES = 4


@dataclass(frozen=True)
class Span:
    """A training window: rows up to and including a month, with the scaling of these rows."""

    number: int
    month: datetime.date
    n: int
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.medians, x) - self.means) / self.scales


def spans(rows: DataFrame, columns: Sequence[str], min_rows: int) -> list[Span]:
    """One span per month with more than ``min_rows`` rows up to it.

    Sums per month are added up over the calendar, so rows are read once.
    Missing values take the median of all rows.
    """
    med = quantiles(rows, {f"m{i}": (c, 0.5) for i, c in enumerate(columns)}).first()
    medians = np.array([float(med[f"m{i}"] or 0.0) for i in range(len(columns))])
    values = {c: F.coalesce(F.col(c), F.lit(float(m))) for c, m in zip(columns, medians)}
    by_month = rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(values.values())],
        *[F.sum(v * v).alias(f"q{i}") for i, v in enumerate(values.values())],
    )
    upto = Window.orderBy("month")  # one row per month
    names = ["n", *[f"{k}{i}" for k in "sq" for i in range(len(columns))]]
    found = by_month.select("month", *[F.sum(c).over(upto).alias(c) for c in names]).orderBy("month").collect()
    out = []
    for r in found:
        if r["n"] > min_rows:
            mean = np.array([r[f"s{i}"] for i in range(len(columns))]) / r["n"]
            spread = np.array([r[f"q{i}"] for i in range(len(columns))]) / r["n"] - mean**2
            scale = np.sqrt(np.maximum(spread, 0.0))
            scale[scale < 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
            out.append(Span(len(out), r["month"], r["n"], medians, mean, scale))
    return out


def draw(tree: Column, seed: int) -> Column:
    """A number from 0 to 1 that a row draws for a tree."""
    return F.pmod(F.xxhash64("id", tree, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def share_of(span: Span, sample_size: int) -> float:
    """Rows of a window with draws below are those that may grow a tree."""
    return min(1.0, 1.3 * min(sample_size, span.n) / span.n)


def drawn_rows(rows: DataFrame, every: Sequence[Span], n_trees: int, sample_size: int, seed: int) -> DataFrame:
    """tree, draw, id, month and x of the rows that may grow a tree in some window; rows draw once for all windows."""
    first: dict[datetime.date, float] = {}
    least = 0.0
    for s in reversed(every):
        least = max(least, share_of(s, sample_size))
        first[s.month] = least
    listed = rows.sparkSession.createDataFrame([(m, w) for m, w in first.items()], "until date, share double")
    table = listed.agg(F.array_sort(F.collect_list(F.struct("until", "share")))).scalar()
    # a subquery cannot stand inside the filter; rows before the first window belong to it
    known = rows.withColumn("spans", table)
    mine = F.filter("spans", lambda s: s["until"] >= F.col("month"))
    known = known.withColumn("most", F.get(mine, F.lit(0))["share"]).drop("spans")
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t, seed) < F.col("most"))
    return known.withColumn("tree", F.explode(trees)).select("tree", draw(F.col("tree"), seed).alias("draw"), "id", "month", "x")


def forest_rates(
    rows: DataFrame, drawn: DataFrame, some: Sequence[Span], sample_size: int, contamination: float, seed: int
) -> dict[int, float]:
    """Share of rows below the forest's cutoff, for each of some spans.

    ``rows`` has month and the array x, ``drawn`` the rows that drew for a tree;
    the ``sample_size`` rows of a window with the smallest draws grow it.
    """
    size = {s.number: min(sample_size, s.n) for s in some}
    spans_of = [(s.number, s.month, share_of(s, sample_size)) for s in some]
    listed = rows.sparkSession.createDataFrame(spans_of, "w int, until date, share double")
    inside = (F.col("until") >= F.col("month")) & (F.col("draw") < F.col("share"))
    sample = drawn.join(F.broadcast(listed), inside).select("tree", "draw", "id", "x", "w")
    by_number = {s.number: s for s in some}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        w, tree = int(pdf["w"].iloc[0]), int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["draw", "id"]).head(size[w])
        limit = max(1, math.ceil(math.log2(max(size[w], 2))))
        x = by_number[w].scaled(np.stack(pdf["x"].to_numpy()).astype(float))
        return pd.DataFrame([{"w": w, "tree": tree, **grow(x, np.random.default_rng(seed + tree), limit)}])

    # put in order here: a sort by ranges would grow every tree twice
    grown = sample.groupBy("w", "tree").applyInPandas(build, f"w int, {TREE_SCHEMA}").collect()
    forests: dict[int, list[tuple]] = {s.number: [] for s in some}
    for r in sorted(grown, key=lambda r: (r["w"], r["tree"])):
        forests[r["w"]].append(
            (
                np.array(r["feature"], dtype=np.int64),
                np.array(r["threshold"]),
                np.array(r["left"], dtype=np.int64),
                np.array(r["right"], dtype=np.int64),
                np.array(r["depth"]),
            )
        )
    width = len(some[0].medians)
    sent = rows.sparkSession.sparkContext.broadcast({w: Forest.of(trees, width) for w, trees in forests.items()})
    months = {s.number: s.month for s in some}

    def scores(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Scores of a batch in every window that has some of its rows."""
        x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, width))
        for w, forest in sent.value.items():
            part = x[(pdf["month"] <= months[w]).to_numpy()]
            if len(part):
                lengths = forest.path_lengths(by_number[w].scaled(part), path_lengths)
                yield w, -np.power(2.0, -lengths / (average_path(size[w]) or 1.0))

    at = {s.number: contamination * (s.n - 1) for s in some}
    return low_shares(rows.select("month", "x"), scores, at, {s.number: s.n for s in some})


def counted(
    rows: DataFrame, scores: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]], held: dict[int, tuple[float, float]]
) -> DataFrame:
    """Scores of each window counted inside the tasks: by buckets between the window's limits.

    ``held`` gives the limits; bucket -1 lies below. Every task returns at most
    BUCKETS + 1 rows for a window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {w: np.zeros(BUCKETS + 2, dtype=np.int64) for w in held}
        for pdf in batches:
            for w, s in scores(pdf):
                if w in held:
                    total[w] += np.bincount(bucket_of(s, *held[w]) + 1, minlength=BUCKETS + 2)
        for w, n in total.items():
            used = np.flatnonzero(n[:-1])
            yield pd.DataFrame({"w": w, "bucket": used - 1, "n": n[used]})

    return rows.mapInPandas(run, "w int, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))


def bucket_of(s: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bucket of each score between the limits, -1 below and BUCKETS above."""
    at = np.floor((s - low) / (high - low) * BUCKETS)
    at = np.where(s == high, BUCKETS - 1, at)
    return np.clip(at, -1, BUCKETS).astype(np.int64)


def distinct_scores(
    rows: DataFrame, scores: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]], held: dict[int, tuple[float, float]]
) -> DataFrame:
    """Different scores between the limits of each window, with their counts, and the count below as NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, s in scores(pdf):
                if w not in held:
                    continue
                low, high = held[w]
                found, n = np.unique(s[(s >= low) & (s <= high)], return_counts=True)
                below = int((s < low).sum())
                yield pd.DataFrame({"w": w, "score": [*found.tolist(), None], "n": [*n.tolist(), below]})

    return rows.mapInPandas(run, "w int, score double, n long").groupBy("w", "score").agg(F.sum("n").alias("n"))


def first_limits(
    rows: DataFrame, scores: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]], at: dict[int, float], sizes: dict[int, int]
) -> dict[int, tuple[float, float]]:
    """Limits that most likely hold the score at each position, from about ``FIRST_ROWS`` rows of the largest window."""
    share = FIRST_ROWS / max(sizes[w] for w in at)
    some = rows.sample(share, seed=1) if share < 0.5 else rows
    limits = dict.fromkeys(at, (-1.0, 0.0))
    open_, drawn = dict(limits), {}
    for _ in range(SAMPLE_PASSES):
        counts: dict[int, list] = {w: [] for w in open_}
        for r in counted(some, scores, open_).orderBy("w", "bucket").collect():
            counts[r["w"]].append((r["bucket"], r["n"]))
        narrower = {}
        for w, (low, high) in open_.items():
            if not counts[w]:
                continue
            bucket, n = (np.array(c) for c in zip(*counts[w], strict=True))
            upto = np.cumsum(n)
            m = drawn.setdefault(w, int(upto[-1]))
            part = at[w] / max(1, sizes[w] - 1)
            room = DEVIATIONS * math.sqrt(m * part * (1 - part)) + 1
            first, last = np.searchsorted(upto, (part * m - room, part * m + room), side="right")
            width = (high - low) / BUCKETS
            # the first rows lie below or in the first bucket: as they were
            below = bucket[first] if part * m - room > 0 else -1
            above = bucket[last] if last < len(bucket) else BUCKETS
            limits[w] = (low + below * width if below >= 0 else low, low + (above + 1) * width if above < BUCKETS - 1 else high)
            held = upto[min(last, len(upto) - 1)] - (upto[first - 1] if first else 0)
            if held > 4 * room and held * sizes[w] > FEW_SCORES * m and limits[w] != (low, high) and width > 1e-12:
                narrower[w] = limits[w]
        open_ = narrower
        if not open_:
            break
    return limits


def counted_limits(
    rows: DataFrame, scores: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]], at: dict[int, float], sizes: dict[int, int]
) -> dict[int, tuple[float, float]]:
    """Limits of the bucket that holds the score at each position, refined until few scores share it."""
    limits = dict.fromkeys(at, (-1.0, 0.0))
    open_ = {w: limits[w] for w in at if sizes[w] > FEW_SCORES}
    while open_:
        counts: dict[int, list] = {w: [] for w in open_}
        for r in counted(rows, scores, open_).orderBy("w", "bucket").collect():
            counts[r["w"]].append((r["bucket"], r["n"]))
        narrower = {}
        for w, (low, high) in open_.items():
            width, seen, ends = (high - low) / BUCKETS, 0, []
            for bucket, n in counts[w]:
                # the buckets of the two ranks around the position
                for rank in (math.floor(at[w]), math.ceil(at[w])):
                    if seen <= rank < seen + n:
                        ends.append((bucket, n))
                seen += n
            first, last = ends[0][0], ends[-1][0]
            limits[w] = (low + first * width, low + (last + 1) * width if last < BUCKETS - 1 else high)
            if sum(n for _, n in set(ends)) > FEW_SCORES and limits[w][0] < limits[w][1] < 0 and width > 1e-15:
                narrower[w] = limits[w]
        if narrower == open_:
            break
        open_ = narrower
    return limits


def told_apart(
    rows: DataFrame, scores: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]], limits: dict[int, tuple[float, float]]
) -> DataFrame:
    """Stored w, score, n and below (rows with smaller scores) of the different scores between the limits."""
    # room for rounding at the limits
    held = {w: (low - 1e-12, high + 1e-12) for w, (low, high) in limits.items()}
    upto = Window.partitionBy("w").orderBy(F.asc_nulls_first("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return materialize(
        distinct_scores(rows, scores, held).withColumn("below", F.sum("n").over(upto) - F.col("n")).where(F.col("score").isNotNull())
    )


def low_shares(
    rows: DataFrame,
    scores: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]],
    at: dict[int, float],
    sizes: dict[int, int],
) -> dict[int, float]:
    """Share of each window's scores below its score at position ``at`` (linear between two ranks).

    Some rows tell first between which scores the position lies; one pass over all
    rows then counts those below and tells those between apart. Where the position
    turns out to lie elsewhere, buckets counted over all rows bracket it. Nothing is
    stored for a row or a window.
    """
    limits = dict.fromkeys(at, (-1.0, 0.0))
    large = [w for w in at if sizes[w] > FEW_SCORES]
    if large:
        limits |= first_limits(rows, scores, {w: at[w] for w in large}, sizes)
    values = told_apart(rows, scores, limits)
    ends = values.groupBy("w").agg(F.min("below").alias("first"), F.max(F.col("below") + F.col("n")).alias("last")).collect()
    inside = {r["w"] for r in ends if r["first"] <= math.floor(at[r["w"]]) and math.ceil(at[r["w"]]) < r["last"]}
    missed = {w: at[w] for w in at if w not in inside}
    if missed:
        again = told_apart(rows, scores, counted_limits(rows, scores, missed, sizes))
        values = values.where(~F.col("w").isin(list(missed))).unionByName(again)
    places = rows.sparkSession.createDataFrame(
        [(w, math.floor(p), math.ceil(p), p - math.floor(p), sizes[w]) for w, p in at.items()],
        "w int, lo long, hi long, part double, size long",
    )
    known = values.join(F.broadcast(places), "w")

    def value(rank: str) -> Column:
        return F.max(F.when((F.col("below") <= F.col(rank)) & (F.col(rank) < F.col("below") + F.col("n")), F.col("score")))

    cut = known.groupBy("w").agg((value("lo") + (value("hi") - value("lo")) * F.max("part")).alias("cut"))
    # rows below the cut: those below the first score that is not
    below = known.join(F.broadcast(cut), "w").groupBy("w").agg(
        F.coalesce(F.min(F.when(F.col("score") >= F.col("cut"), F.col("below"))), F.max("size")).alias("below"),
        F.max("size").alias("size"),
    )
    return {r["w"]: r["below"] / r["size"] for r in below.collect()}


def expanding_window_training(
    df: DataFrame,
    columns: Sequence[str],
    id_column: str,
    min_rows: int = 100,
    n_trees: int = 100,
    sample_size: int = 256,
    contamination: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """M-16: refit on all rows up to each month; windows that are too small are left out."""
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    rows = materialize(
        df.where(F.col("order_date").isNotNull()).select(
            F.col(id_column).alias("id"), F.trunc("order_date", "month").alias("month"), *numbers
        )
    )
    every = spans(rows, columns, min_rows)
    packed = rows.select("id", "month", F.array(*columns).alias("x"))
    drawn = materialize(drawn_rows(packed, every, n_trees, sample_size, seed)) if every else None
    rates: dict[int, float] = {}
    for lo in range(0, len(every), TOGETHER):
        rates |= forest_rates(packed, drawn, every[lo : lo + TOGETHER], sample_size, contamination, seed)
    out = [(f"{s.month:%Y-%m}", float(rates[s.number]) * 100.0, s.n) for s in every]
    return df.sparkSession.createDataFrame(out, "training_month string, anomaly_rate double, n_samples bigint")
