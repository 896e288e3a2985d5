"""Range-based ranks against brute force, with a hot value and a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deliveryrisk.functions import ranking as R


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n)),
            "v": np.where(rng.random(n) < 0.35, 1.5, np.round(rng.normal(0, 50, n), 1)),
            "t": rng.integers(0, 4, n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(params=[1, 40])
def ranges(spark, request):
    """One range, and many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranks_and_quantiles(skewed, ranges):
    pdf, df = skewed
    got = R.with_ranks(df, "v", ["g"]).toPandas().drop_duplicates(["g", "v"]).set_index(["g", "v"]).sort_index()
    want = pdf.assign(
        avg=pdf.groupby("g")["v"].rank(), dense=pdf.groupby("g")["v"].rank("dense"), pct=pdf.groupby("g")["v"].rank(pct=True)
    ).drop_duplicates(["g", "v"]).set_index(["g", "v"]).sort_index()
    assert np.allclose(got["avg_rank"], want["avg"])
    assert np.array_equal(got["dense_rank"], want["dense"])
    assert np.allclose(got["pct_rank"], want["pct"])
    q = R.quantiles(df, {"a": ("v", 0.25), "b": ("v", 0.9), "c": ("t", 0.5)}).first()
    assert (q["a"], q["b"], q["c"]) == pytest.approx(
        (pdf["v"].quantile(0.25), pdf["v"].quantile(0.9), pdf["t"].quantile(0.5))
    )
    by = R.quantiles(df, {"m": ("v", 0.5)}, ["g"]).toPandas().set_index("g")["m"].sort_index()
    assert np.allclose(by, pdf.groupby("g")["v"].median().sort_index())


def test_positions_of_a_hot_group(skewed, ranges):
    pdf, df = skewed
    got = R.ordered_positions(df, ["g"], "v", ["t"], [], "pos").toPandas()
    assert len(got) == len(pdf)
    for g, part in got.groupby("g"):
        part = part.sort_values("pos")
        assert part["pos"].tolist() == list(range(1, len(part) + 1))
        assert list(zip(part["t"], part["v"])) == sorted(zip(part["t"], part["v"]))


def test_empty_input(spark):
    empty = spark.createDataFrame([], "v double")
    assert R.quantiles(empty, {"m": ("v", 0.5)}).first()["m"] is None


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [1 << 20, 500])
def test_quantiles_by_brackets(spark, monkeypatch, few):
    """Sketch, narrowing and a hot value; the bracket holds a small part of the column."""
    monkeypatch.setattr(R, "ACCURACY", 1000)
    monkeypatch.setattr(R, "MARGIN", 10 / 1000)
    monkeypatch.setattr(R, "FEW", few)
    rng = np.random.default_rng(7)
    n = 30_000
    pdf = pd.DataFrame({"a": rng.exponential(10, n), "b": np.where(rng.random(n) < 0.4, 2.5, rng.normal(0, 9, n)), "c": np.full(n, 4.0)})
    pdf.loc[rng.random(n) < 0.1, "a"] = None
    df = spark.createDataFrame(pdf).selectExpr("nullif(a, double('nan')) a", "b", "c").repartition(7)
    wanted = {f"{c}{p}": (c, p) for c in "abc" for p in (0.0, 0.01, 0.25, 0.5, 0.777, 0.95, 1.0)}
    out = R.quantiles(df, wanted)
    got = out.first()
    for name, (c, p) in wanted.items():
        assert got[name] == pytest.approx(pdf[c].dropna().quantile(p), abs=1e-12), name
    rows, found = R.brackets(df, {"m": ("a", 0.5)})
    low, high = found["m"]
    assert rows["a"] == pdf["a"].count()
    assert 0 < ((pdf["a"] >= low) & (pdf["a"] <= high)).sum() < 0.1 * n
    assert "Window" in plan(out) and "Relation" not in plan(out)


def test_rank_plan_does_not_grow(skewed, spark):
    pdf, df = skewed
    sizes = []
    for parts in (10, 500):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes.append(len(plan(R.running_counts(df, "v", ["g"])).splitlines()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[0] == sizes[1]


def test_order_of_several_keys(spark, ranges):
    rows = [(g, d, v, 1) for g in (None, "a", "b") for d in range(3) for v in range(20)] * 2
    df = spark.createDataFrame(rows, "g string, d int, v int, w int")
    got = R.running_sums(df, "v", {"n": F.sum("w")}, ["g"], ["d"]).orderBy("g", "d", "v").collect()
    for g in (None, "a", "b"):
        mine = [r for r in got if r["g"] == g]
        assert [r["n_below"] for r in mine] == list(range(0, 120, 2)) and {r["n_total"] for r in mine} == {120}
        assert [r["dense"] for r in mine] == list(range(1, 61)) and {r["distinct"] for r in mine} == {60}
