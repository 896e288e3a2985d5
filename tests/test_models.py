"""Model operators against brute force on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deliveryrisk.models import kmeans as K
from deliveryrisk.models import neighbors as N
from deliveryrisk.models.dbscan import DBSCAN, cluster_info
from deliveryrisk.models.iforest import IsolationForest
from deliveryrisk.models.lof import LocalOutlierFactor
from deliveryrisk.models.monitor import champion_challenger
from deliveryrisk.models.prep import Scaler

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = np.vstack(
        [
            rng.normal(0, 1, (400, 3)),
            rng.normal(7, 0.5, (300, 3)),
            np.tile([[2.0, 2.0, 2.0]], (200, 1)),
            rng.uniform(-12, 12, (15, 3)),
        ]
    )
    pdf = pd.DataFrame(x, columns=COLUMNS)
    pdf["id"] = np.arange(len(x))
    df = spark.createDataFrame(pdf)
    z = (x - x.mean(0)) / x.std(0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    return df, Scaler.fit(df, COLUMNS), d


@pytest.fixture(autouse=True)
def many_leaves(monkeypatch):
    monkeypatch.setattr(N.Partitions.build.__func__, "__defaults__", (40,))


def test_scaler(cloud, spark):
    df, scaler, _ = cloud
    stats = scaler.transform(df).select(F.avg(F.col("features")[0]), F.stddev_pop(F.col("features")[0])).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    holes = spark.createDataFrame([(1.0,), (None,), (3.0,), (8.0,)], "a double")
    s = Scaler.fit(holes, ["a"])
    assert s.medians == (3.0,) and s.means[0] == pytest.approx(3.75)


def test_lof_is_exact_with_copies(cloud):
    df, scaler, d = cloud
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :20]
    dist = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(dist[:, -1][near], dist).mean(1) + 1e-10)
    lof = lrd[near].mean(1) / lrd
    got = LocalOutlierFactor(COLUMNS).fit_predict(df, "id", scaler).toPandas().sort_values("id")
    assert np.allclose(-got["score"].to_numpy(), lof, rtol=1e-6)
    assert (got["prediction"] == -1).mean() == pytest.approx(0.1, abs=0.02)


def test_dbscan_is_exact(cloud):
    df, scaler, d = cloud
    close = d <= 0.3
    core = close.sum(1) >= 10
    label = np.full(len(d), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], stack = i, [i]
            while stack:
                for v in np.flatnonzero(close[stack.pop()] & core & (label < 0)):
                    label[v] = i
                    stack.append(v)
    for i in np.flatnonzero(~core):
        label[i] = label[close[i] & core].min() if (close[i] & core).any() else -1
    out = DBSCAN(COLUMNS, 0.3, 10).fit_predict(df, "id", scaler)
    got = out.toPandas().sort_values("id")
    assert np.array_equal(got["cluster"].to_numpy(), label)
    info = cluster_info(out).first()
    assert info["n_noise"] == (label == -1).sum()
    assert info["n_clusters"] == len(set(label[label >= 0]))


def test_isolation_forest(cloud, spark, tmp_path):
    df, scaler, _ = cloud
    model = IsolationForest.fit(df, COLUMNS, "id", n_trees=60, scaler=scaler)
    out = model.risk_scores(df, "id").toPandas().sort_values("id")
    assert out["risk_score"].min() == 0 and out["risk_score"].max() == 100
    assert (out["prediction"] == -1).mean() <= 0.11
    assert out.nlargest(10, "risk_score")["id"].ge(900).mean() >= 0.8
    again = IsolationForest.fit(df, COLUMNS, "id", n_trees=60, scaler=scaler)
    assert np.array_equal(again.predict(df, "id").toPandas().sort_values("id")["score"], out["score"])
    model.save(spark, str(tmp_path / "m"))
    loaded = IsolationForest.load(spark, str(tmp_path / "m")).predict(df, "id").toPandas().sort_values("id")
    assert np.array_equal(loaded["score"], out["score"]) and loaded["prediction"].tolist() == out["prediction"].tolist()
    same = champion_challenger(model, model, df, "id").collect()
    assert {r["ks_stat"] for r in same} == {0.0}


def test_kmeans(cloud):
    df, scaler, _ = cloud
    model = K.FraudKMeans.fit(df, COLUMNS, 3, 2, scaler=scaler)
    out = model.transform(df)
    assert out.where("cluster_distance < 0").count() == 0
    assert -1 <= model.silhouette(df) <= 1
    stats = K.cluster_statistics(out, COLUMNS, "a").collect()
    assert sum(r["share"] for r in stats) == pytest.approx(100) and sum(r["is_high_risk"] for r in stats) == 1


def test_kmeans_starts_are_spark_ones_in_few_jobs(cloud, spark):
    """All starts of all k end where Spark's own end, and share their passes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df, scaler, _ = cloud
    rows = scaler.transform(df).withColumn("vector", array_to_vector("features"))
    starts = [(k, 42 + i) for k in (2, 4) for i in range(3)]
    group = "starts together"
    spark.sparkContext.setJobGroup(group, group)
    got = K.fit_starts(rows, starts)
    together = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("own", "own")
    for (k, seed), m in zip(starts, got, strict=True):
        own = KMeans(k=k, seed=seed, featuresCol="vector", maxIter=300).fit(rows)
        assert np.allclose(m.clusterCenters(), own.clusterCenters())
        assert m.trainingCost == pytest.approx(own.summary.trainingCost)
    one_by_one = len(spark.sparkContext.statusTracker().getJobIdsForGroup("own"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert together < one_by_one


def test_first_start_wins_equal_costs():
    a, b, c = (K.Centers(np.zeros((1, 1)), cost) for cost in (5.0, 3.0 * (1 + 1e-15), 3.0))
    assert K.cheapest([a, b, c]) is b and K.cheapest([c, a, b]) is c


def test_within_decides_as_distances_do():
    from deliveryrisk.models.dbscan import within
    from deliveryrisk.models.metric_tree import distances

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 14)) * 40
    y = np.vstack([x[:50], x[:50] + rng.normal(size=(50, 14)) * 0.2, np.round(x[:50]), x[:50]])
    # exactly at the radius, and beside it by one last place
    y[150:, 0] += 0.5
    y[150::2, 0] = np.nextafter(y[150::2, 0], np.inf)
    assert np.array_equal(within(x, y, 0.5), distances(x, y) <= 0.5)
    assert within(x, y, 0.5).sum() > 50 and within(x[:0], y, 0.5).shape == (0, 200)
    bad = np.vstack([x[:3], np.full((1, 14), np.inf), np.full((1, 14), np.nan)])
    assert np.array_equal(within(bad, x, 0.5), distances(bad, x) <= 0.5)


def test_dbscan_keeps_text_keys(spark):
    rows = [(f"k{i}", float(i % 2) * 10, 0.0, 0.0) for i in range(30)] + [("far", 99.0, 99.0, 99.0)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    got = {r["id"]: (r["role"], r["cluster"]) for r in DBSCAN(COLUMNS, 0.3, 5).fit_predict(df, "id").collect()}
    assert got["far"] == ("noise", "-1") and got["k3"] == ("core", "k1") and got["k4"] == ("core", "k0")


def test_path_lengths_follow_each_row():
    """Every row ends in the leaf that a walk of its own reaches."""
    from deliveryrisk.models.iforest import grow, path_lengths

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    x[::7, 1] = np.nan
    grown = [grow(np.nan_to_num(x[i * 50 : i * 50 + 50]), rng, 6) for i in range(4)] + [grow(np.ones((5, 3)), rng, 6)]
    trees = [tuple(np.array(t[c]) for c in ("feature", "threshold", "left", "right", "depth")) for t in grown]

    def walk(row, tree):
        feature, threshold, left, right, depth = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] <= threshold[at] else right[at]
        return depth[at]

    want = [np.mean([walk(row, t) for t in trees]) for row in x]
    assert path_lengths(x, trees) == pytest.approx(want)
    assert len(path_lengths(x[:0], trees)) == 0


def test_forest_sees_all_ids(spark):
    """The rows of a tree are drawn over the whole range of ids."""
    df = spark.range(20_000).select("id", (F.col("id") * 1.0).alias("a"))
    model = IsolationForest.fit(df, ["a"], "id", n_trees=20, scaler=Scaler(("a",), (0.0,), (0.0,), (1.0,)))
    cuts = np.concatenate([t[1][t[0] >= 0] for t in model.trees])
    assert 0.1 < (cuts > 16_000).mean() < 0.3


def test_months_are_refit(spark):
    from deliveryrisk.models.windows import expanding_window_training

    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(900), "a": rng.normal(size=900), "b": rng.normal(size=900)})
    pdf["order_date"] = pd.to_datetime("2024-01-15") + pd.to_timedelta(30 * (pdf["id"] // 90), unit="D")
    df = spark.createDataFrame(pdf).withColumn("order_date", F.to_date("order_date"))
    got = expanding_window_training(df, ["a", "b"], "id", n_trees=10).orderBy("training_month").collect()
    assert [r["n_samples"] for r in got] == [90 * k for k in range(2, 11)]
    assert all(8.0 <= r["anomaly_rate"] <= 12.0 for r in got)


def test_packed_forest_adds_the_same_path_lengths():
    """The compiled walk gives the sums of the descent in numpy, to the last bit; also for missing values and bare roots."""
    from deliveryrisk.models import forest as FO
    from deliveryrisk.models.iforest import grow, path_lengths

    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    x[::9, 2] = np.nan
    grown = [grow(np.nan_to_num(x[i * 40 : i * 40 + 40]), rng, 6) for i in range(12)]
    grown[3:3] = [grow(np.ones((5, 3)), rng, 6)]
    trees = [tuple(np.array(t[c]) for c in ("feature", "threshold", "left", "right", "depth")) for t in grown]
    on_cut = trees[0][1][trees[0][0] >= 0]
    x[: len(on_cut), trees[0][0][trees[0][0] >= 0][0]] = on_cut
    packed = FO.Forest.of(trees, 3)
    assert (packed.model is None) == (FO.onnxruntime is None)
    assert packed.path_lengths(x, path_lengths) == pytest.approx(path_lengths(x, trees), rel=1e-14)
    assert len(packed.path_lengths(x[:0], path_lengths)) == 0
    bare = FO.Forest.of(trees[3:4], 3)
    assert np.array_equal(bare.path_lengths(x, path_lengths), path_lengths(x, trees[3:4]))


@pytest.mark.parametrize("off", [0.0, 40.0])
def test_all_rows_are_scored_once_for_a_cutoff(spark, monkeypatch, off):
    """Large windows: a few rows tell where to look, one pass over all rows decides; a wrong guess costs passes, not results."""
    from deliveryrisk.models import windows as W

    monkeypatch.setattr(W, "FEW_SCORES", 100)
    monkeypatch.setattr(W, "FIRST_ROWS", 4000)
    monkeypatch.setattr(W, "DEVIATIONS", 6.0 - off)
    scored = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(6)
    values = {0: -rng.random(30_000), 1: np.round(-rng.random(20_000), 3)}
    df = spark.createDataFrame([(w, float(s)) for w, v in values.items() for s in v], "w int, s double").repartition(4)

    def scores(pdf):
        scored.add(len(pdf))
        for w, part in pdf.groupby("w"):
            yield int(w), part["s"].to_numpy()

    got = W.low_shares(df, scores, {w: 0.1 * (len(v) - 1) for w, v in values.items()}, {w: len(v) for w, v in values.items()})
    for w, v in values.items():
        assert got[w] == pytest.approx((v < np.quantile(v, 0.1)).mean(), abs=1e-12)
    assert off or scored.value < 1.7 * 50_000
