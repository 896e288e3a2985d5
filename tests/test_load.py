"""Loads as a whole, positions in orders, regression, contracts, clusters and window scores."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deliveryrisk.functions import ranking as R
from deliveryrisk.models import kmeans as K
from deliveryrisk.models import windows as W
from deliveryrisk.operators import contracts as X
from deliveryrisk.operators import stats as S
from deliveryrisk.sources import ingest as I


def rows_of(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).collect())


@pytest.fixture
def tables(spark):
    return {
        "orders": spark.createDataFrame([(1, 5.0), (2, 6.0)], "order_id int, amount double"),
        "drivers": spark.createDataFrame([(7, "x")], "driver_id int, name string"),
        "extra": spark.createDataFrame([], "a int"),
    }


def test_load_replaces_or_adds(spark, tables, tmp_path):
    out = str(tmp_path / "db")
    assert [tuple(r) for r in I.load_all(tables, out).collect()] == [("drivers", 1), ("orders", 2), ("extra", 0)]
    assert [tuple(r) for r in I.load_all(tables, out, truncate=False).collect()] == [("drivers", 1), ("orders", 2), ("extra", 0)]
    assert rows_of(spark, f"{out}/orders") == [(1, 5.0), (1, 5.0), (2, 6.0), (2, 6.0)]
    I.load_all({"orders": tables["orders"].limit(1)}, out)
    assert rows_of(spark, f"{out}/orders") == [(1, 5.0)] and len(rows_of(spark, f"{out}/drivers")) == 2
    assert sorted(os.listdir(out)) == ["drivers", "extra", "orders"]


def test_failing_child_leaves_the_old_load(spark, tables, tmp_path):
    out, log = str(tmp_path / "db"), str(tmp_path / "log")
    I.load_with_log(tables, out, log)
    bad = tables["orders"].withColumn("amount", F.raise_error(F.lit("broken row")).cast("double"))
    more = {"orders": bad, "drivers": spark.createDataFrame([(8, "y"), (9, "z")], "driver_id int, name string")}
    with pytest.raises(I.LoadError, match="broken row"):
        I.load_with_log(more, out, log)
    assert rows_of(spark, f"{out}/drivers") == [(7, "x")] and len(rows_of(spark, f"{out}/orders")) == 2
    assert sorted(os.listdir(out)) == ["drivers", "extra", "orders"]
    logged = spark.read.parquet(log).orderBy("started_at").collect()
    assert [(r["table_name"], r["status"], r["row_count"]) for r in logged] == [
        ("drivers", "SUCCESS", 1), ("orders", "SUCCESS", 2), ("extra", "SUCCESS", 0), ("orders", "FAILED", None),
    ]
    assert "broken row" in logged[-1]["error"]


def test_failed_commit_is_undone(spark, tables, tmp_path, monkeypatch):
    out = str(tmp_path / "db")
    I.load_all(tables, out)
    move = I.Folders.move

    def fails(self, source, target):
        if target.endswith("/orders") and "/new/" in source:
            raise OSError("no space")
        move(self, source, target)

    monkeypatch.setattr(I.Folders, "move", fails)
    with pytest.raises(I.LoadError, match="no space"):
        I.load_all({n: df.limit(0) for n, df in tables.items()}, out)
    assert rows_of(spark, f"{out}/drivers") == [(7, "x")] and len(rows_of(spark, f"{out}/orders")) == 2


@pytest.mark.parametrize("most", [None, 3])
def test_positions_with_a_heavy_order(spark, most):
    rng = np.random.default_rng(0)
    rows = [(o, int(rng.integers(1, 4)), int(rng.integers(0, 9)), 1) for o in [1] * 40 + [2] * 3 + [3] * 5 + [None] * 4]
    df = spark.createDataFrame(rows, "o int, line int, product int, supplier int")
    out = R.line_positions(df, ["o"], ["line"], "product", ["supplier"], "pos", most)
    got = [tuple(r) for r in out.select("o", "line", "product", "pos").collect()]
    want = []
    for o in {r[0] for r in rows}:
        mine = sorted(r[1:3] for r in rows if r[0] == o)
        want += [(o, *r, i) for i, r in enumerate(mine, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    if most is None:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Window") == 1


def test_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal([1e4, 3, 0], [2e3, 1, 5], (400, 3))
    y = 2.5 * x[:, 0] - 40 * x[:, 1] + 7 + rng.normal(0, 3, 400)
    test = rng.random(400) < 0.25
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "twice": 2 * x[:, 1], "flat": 4.0, "y": y, "t": test})
    df = spark.createDataFrame(pdf)
    a = np.column_stack([x, np.ones(400)])
    want = np.linalg.lstsq(a[~test], y[~test], rcond=None)[0]
    got = S.least_squares(df, ["a", "b", "c"], "y", F.col("t"))
    assert [got[c] for c in ("a", "b", "c", "intercept")] == pytest.approx(want, rel=1e-6)
    error = y[test] - a[test] @ want
    assert got["rmse"] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-6)
    assert got["r2"] == pytest.approx(1 - (error**2).mean() / y[test].var(), rel=1e-9)
    same = S.least_squares(df, ["a", "b", "c", "twice", "flat"], "y", F.col("t"))
    assert same["flat"] == 0 and same["rmse"] == pytest.approx(got["rmse"], rel=1e-6)
    assert "r2" not in S.least_squares(df, ["a"], "y", F.lit(False))


GOOD = [(1, "a", 5.0, "Low"), (2, "b", 9.0, "High")]
SCHEMA = "k int, name string, v double, level string"
CONTRACT = X.Contract(
    {"k": "whole", "name": "text", "v": "number", "level": None}, ("k",), ("name",), {"v": (0, 10)}, {"level": X.LEVELS}, ("k",), 2,
    {"level fits": "level <> 'Low' OR v < 6"}, {"total": "sum(v)"},
)


@pytest.mark.parametrize(
    "rows, schema, broken",
    [
        (GOOD, SCHEMA, {}),
        ([*GOOD, (None, "c", 1.0, "Low")], SCHEMA, {"no null in k": 1, "total equals p.total": 1}),
        ([*GOOD, (3, None, 0.0, "Low")], SCHEMA, {"no null in name": 1, "k is in p.k": 1}),
        ([(1, "a", -5.0, "Low"), (2, "b", 19.0, "High")], SCHEMA, {"range of v": 2}),
        ([*GOOD, (2, "c", 0.0, "Huge")], SCHEMA, {"values of level": 1, "unique k": 1}),
        (GOOD[:1], SCHEMA, {"at least 2 rows": 1, "total equals p.total": 1}),
        ([(1, "a", 7.0, "Low"), (2, "b", 7.0, "High")], SCHEMA, {"level fits": 1}),
        ([("1", "a", 5.0, "Low"), ("2", "b", 9.0, "High")], SCHEMA.replace("k int", "k string"), {"k is a whole": 1}),
        ([r[:3] for r in GOOD], SCHEMA.replace(", level string", ""), {"has column level": 1, "level fits": None}),
    ],
)
def test_contracts(spark, rows, schema, broken):
    parent = spark.createDataFrame([(1, 6.0), (2, 8.0)], "k int, v double")
    contract = CONTRACT if "level" in schema else X.Contract(**{**CONTRACT.__dict__, "checks": {}})
    outputs = {
        "c": (spark.createDataFrame(rows, schema), contract),
        "p": (parent, X.Contract({"k": "whole"}, measures={"total": "sum(v)"})),
    }
    relations = [X.Parity(("c", "total"), ("p", "total"), 1e-9), X.Contained(("c", "k"), ("p", "k"))]
    got = {r["rule"]: r["violations"] for r in X.check_outputs(outputs, relations).where("NOT passed").collect()}
    assert got == {r: n for r, n in broken.items() if n}


def test_driver_clusters(spark):
    rng = np.random.default_rng(1)
    centers = np.array([[5, 10, 50, 20, 4, 80], [40, 60, 90, 21, 30, 20], [80, 95, 55, 19, 70, 5]], dtype=float)
    group = np.repeat([2, 0, 1], [20, 30, 10])
    x = centers[group] + rng.normal(0, 0.5, (60, 6))
    pdf = pd.DataFrame(x, columns=K.DRIVER_FEATURES).assign(driver_id=range(60), total_items_missing=lambda d: d["total_items_missing"].round().astype(int))
    found = K.cluster_drivers(spark.createDataFrame(pdf), n_init=2)
    stats = found.stats.orderBy("cluster").collect()
    assert [r["drivers"] for r in stats] == [30, 10, 20]
    assert [r["total_items_missing"] for r in stats] == [int(pdf["total_items_missing"][group == g].sum()) for g in range(3)]
    labels = {r["driver_id"]: r["cluster"] for r in found.rows.collect()}
    assert [labels[i] for i in range(60)] == group.tolist()
    share = {r["feature"]: r["importance_score"] for r in found.importance.collect()}
    z = (x - x.mean(0)) / x.std(0)
    spread = np.array([z[group == g].mean(0) for g in range(3)]).var(axis=0)
    want = (spread - spread.min()) / (spread.max() - spread.min()) * 100
    assert [share[c] for c in K.DRIVER_FEATURES] == pytest.approx(want, abs=0.5) and found.silhouette > 0.9
    assert K.cluster_drivers(spark.createDataFrame(pdf.head(5)), n_init=1) is None


@pytest.mark.parametrize("few, buckets", [(1 << 16, 4096), (20, 8)])
def test_window_shares(spark, monkeypatch, few, buckets):
    """Shares below a quantile from bucket counts, with ties and a score that most rows have."""
    monkeypatch.setattr(W, "FEW_SCORES", few)
    monkeypatch.setattr(W, "BUCKETS", buckets)
    rng = np.random.default_rng(4)
    values = {0: -rng.random(500), 1: np.round(-rng.random(700), 2), 2: np.where(rng.random(900) < 0.6, -0.5, -rng.random(900)), 3: np.full(40, -0.25)}
    df = spark.createDataFrame([(w, float(s)) for w, v in values.items() for s in v], "w int, s double").repartition(5)

    def scores(pdf):
        for w, part in pdf.groupby("w"):
            yield int(w), part["s"].to_numpy()

    for p in (0.0, 0.1, 0.37, 0.5):
        got = W.low_shares(df, scores, {w: p * (len(v) - 1) for w, v in values.items()}, {w: len(v) for w, v in values.items()})
        for w, v in values.items():
            assert got[w] == pytest.approx((v < np.quantile(v, p)).mean(), abs=1e-12), (w, p)
