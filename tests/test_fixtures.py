"""Hand-checked edge cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from deliveryrisk.functions import scalar as S
from deliveryrisk.functions import tails
from deliveryrisk.models.monitor import consensus, ensemble_outlier
from deliveryrisk.operators import customers as C
from deliveryrisk.operators import drivers as D
from deliveryrisk.operators import products as P
from deliveryrisk.operators import quality as Q
from deliveryrisk.operators import regions as G
from deliveryrisk.operators import stats as ST
from deliveryrisk.operators import temporal as T
from deliveryrisk.sources import ingest as I

ORDER = (
    "order_id bigint, order_date date, order_amount double, region string, items_delivered bigint, "
    "items_missing bigint, delivery_hour int, driver_id bigint, customer_id bigint"
)


def day(text):
    return dt.date.fromisoformat(text)


def orders(spark, rows):
    return spark.createDataFrame(rows, ORDER)


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one_column(spark, vals, kind="double"):
    return spark.createDataFrame([(v,) for v in vals], f"x {kind}")


def test_band_edges(spark):
    df = one_column(spark, [0.0, 25.0, 50.0, 75.0, 100.0])
    rows = values(df, S.risk_band("x"), S.risk_band("x", "threshold"))
    assert [r[0] for r in rows] == ["Low", "Low", "Medium", "High", "Critical"]
    assert [r[1] for r in rows] == ["Low", "Medium", "High", "Critical", "Critical"]


def test_period_edges(spark):
    df = one_column(spark, [0, 5, 6, 11, 12, 17, 18, 21, 22, 23], "int")
    clock = "".join(r[0][0] for r in values(df, S.delivery_period("x")))
    cut = "".join(r[0][0] for r in values(df, S.delivery_period("x", "cut")))
    assert clock == "NNMMAAEENN"
    assert cut == "NNNMMAAEEE"


def test_bucketize_open_and_outside(spark):
    df = one_column(spark, [-5.0, -1.0, 0.0, 10.0, 1e9, None])
    got = [r[0] for r in values(df, S.bucketize("x", [-1, 10, None], ["a", "b"]))]
    assert got == [None, None, "a", "a", "b", None]


def test_zero_items_has_rate_zero_and_null_view_rate(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "m int, d int")
    rows = values(df, S.missing_rate("m", "d"), S.rate_pct("m", "d"))
    assert rows == [(0.0, None), (25.0, 33.33)]


def test_entities_without_orders(spark):
    drivers = spark.createDataFrame([(1, "a", 20, 10), (2, "b", 101, 200)], "driver_id bigint, driver_name string, age int, trips int")
    o = orders(spark, [(1, day("2024-01-01"), 10.0, "R", 3, 1, 5, 1, 1)])
    rows = {r["driver_id"]: r for r in D.driver_features(drivers, o).collect()}
    assert rows[2]["total_orders"] == 0 and rows[2]["missing_rate"] == 0.0
    assert rows[2]["age_group"] is None and rows[2]["experience_level"] == "Expert"
    assert rows[1]["missing_rate"] == 25.0
    products = spark.createDataFrame([(1, "p", "c", 5.0)], "product_id bigint, product_name string, category string, price double")
    items = spark.createDataFrame([(1, 1)], "order_id bigint, product_id bigint")
    view = {r["driver_id"]: r for r in D.driver_fraud_metrics(drivers, o, items, products).collect()}
    assert view[2]["fraud_risk_score"] is None and view[2]["orders_count"] == 0
    assert view[1]["total_missing_value"] == 5.0


def test_flat_metric(spark):
    df = one_column(spark, [7.0, 7.0])
    for flat in (0.5, 50.0, 0.0):
        assert values(df, S.min_max("x", F.lit(7.0), F.lit(7.0), flat)) == [(flat,), (flat,)]
    features = spark.createDataFrame(
        [(1, 10.0, 10.0, 5), (2, 10.0, 10.0, 5)],
        "driver_id bigint, missing_rate double, pct_orders_with_missing double, total_items_missing bigint",
    )
    assert [r["risk_score"] for r in D.driver_risk_scores(features).collect()] == [50.0, 50.0]


def test_single_group_flags_nothing(spark):
    features = spark.createDataFrame([(1, 10, 5.0)], "driver_id bigint, total_orders bigint, missing_rate double")
    assert D.suspicious_drivers(features).count() == 0


def test_average_rank_ties(spark):
    o = orders(
        spark,
        [
            (i, day("2024-01-01"), 1.0, r, d, m, 1, 1, 1)
            for i, (r, d, m) in enumerate([("A", 7, 3), ("B", 8, 2), ("C", 8, 2), ("D", 9, 1)])
        ],
    )
    ranks = {r["region"]: r["risk_rank"] for r in G.regional_summary(o).collect()}
    assert ranks == {"A": 1, "B": 2, "C": 2, "D": 4}


def test_anomaly_six(spark):
    hours, delivered, missing = [9, 13, 18, 10, 15, 20], [10, 9, 8, 9, 10, 7], [0, 1, 0, 2, 1, 3]
    dates = ["2024-01-02", "2024-01-09", "2024-01-16", "2024-02-06", "2024-02-13", "2024-02-20"]
    o = orders(
        spark,
        [(i, day(d), 1.0, "R", n, m, h, 1, 1) for i, (d, h, n, m) in enumerate(zip(dates, hours, delivered, missing))],
    )
    rates = dict(values(T.monthly_rates(o), F.date_format("month", "MM"), F.round("missing_rate", 3)))
    assert rates == {"01": 3.571, "02": 18.75}
    assert T.temporal_anomalies(o).count() == 0


def test_quality_nominal(spark):
    o = spark.createDataFrame(
        [
            (1, day("2024-01-01"), 5.0, " ", "c1"),
            (2, day("2024-01-02"), -5.0, "d1", None),
            (3, day("2260-01-01"), 5.0, "d1", "c1"),
        ],
        "order_id bigint, order_date date, order_amount double, driver_id string, customer_id string",
    )
    d = spark.createDataFrame([("d1", 30), ("d2", None)], "driver_id string, age int")
    c = spark.createDataFrame([("c1", "30"), ("c2", "")], "customer_id string, customer_age string")
    p = spark.createDataFrame([("p1", "x"), ("p2", None)], "product_id string, category string")
    issues = Q.quality_issues(o, d, c, p, "2025-01-01").collect()
    assert len(issues) == 7 and all(r["issue_count"] == 1 for r in issues)
    assert Q.quality_score(o, "2025-01-01").first()["quality_score"] == 0.0
    empty = Q.quality_score(o.limit(0), "2025-01-01").first()
    assert (empty["quality_score"], empty["date_start"]) == (100.0, "N/A")
    assert all(r["rate_pct"] == 0.0 for r in Q.quality_issues(o.limit(0), d.limit(0), c.limit(0), p.limit(0), "2025-01-01").collect())


def test_gap_days_and_short_forecast(spark):
    facts = spark.createDataFrame(
        [(day("2024-01-01"), 6.0), (day("2024-01-04"), 2.0)], "order_date date, price double"
    )
    daily = P.daily_loss(facts)
    assert [r["loss"] for r in daily.orderBy("order_date").collect()] == [6.0, 0.0, 0.0, 2.0]
    forecast = {r["horizon_days"]: r["projected_loss"] for r in P.loss_forecast(daily).collect()}
    assert forecast == {30: 60.0, 60: 120.0, 90: 180.0}


def test_category_view_counts_unsold_price_once(spark):
    products = spark.createDataFrame(
        [(1, "a", "c", 10.0), (2, "b", "c", 5.0)], "product_id bigint, product_name string, category string, price double"
    )
    items = spark.createDataFrame([(1, 1), (2, 1)], "order_id bigint, product_id bigint")
    assert P.category_fraud_metrics(products, items).first()["total_missing_value"] == 25.0
    assert P.missing_by_category(products, items).first()["total_value_lost"] == 20.0


def test_equal_quartiles_take_first_segment(spark):
    customers = spark.createDataFrame([(i, "n", 30) for i in range(4)], "customer_id bigint, customer_name string, customer_age int")
    o = orders(spark, [(i, day("2024-01-01"), 10.0, "R", 1, 0, 1, 1, i) for i in range(4)])
    assert {r["customer_segment"] for r in C.customer_features(customers, o).collect()} == {"Low Value"}


def test_ensemble_votes(spark):
    a = spark.createDataFrame([(1, -0.9, -1), (2, -0.8, -1), (3, -0.1, 1)], "id bigint, score double, prediction int")
    b = spark.createDataFrame([(1, -2.0, -1), (2, -1.0, 1), (3, -1.0, 1)], "id bigint, score double, prediction int")
    got = dict(values(ensemble_outlier({"a": a, "b": b}), "id", "prediction"))
    assert got == {1: -1, 2: 1, 3: 1}
    assert dict(values(ensemble_outlier({"a": a, "b": b}, min_votes=1), "id", "prediction"))[2] == -1
    flags = spark.createDataFrame([(True, True, False), (True, False, False)], "a boolean, b boolean, c boolean")
    assert values(consensus(flags, ["a", "b", "c"]), "anomaly_votes", "is_consensus") == [(2, True), (1, False)]


def test_ks_and_mann_whitney_tiny(spark):
    ks = spark.createDataFrame([(v, False) for v in (1.0, 2.0, 3.0)] + [(v, True) for v in (2.0, 3.0, 4.0)], "v double, s boolean")
    assert ST.ks_two_sample(ks, "v", "s").first()["ks_stat"] == pytest.approx(1 / 3)
    mw = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, False)], "v double, s boolean")
    row = ST.mann_whitney(mw, "v", F.col("s")).first()
    assert row["u"] == 0.0 and 0 <= row["p_value"] <= 1


def test_tail_probabilities():
    assert tails.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.student_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.kolmogorov(1.3581 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-4)
    assert tails.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)


def test_safe_correlation_status(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)], "x double, y double")
    assert ST.safe_correlation(df, "x", "y").first()["status"] == "insufficient_variance"
    assert ST.safe_correlation(df.limit(3), "x", "y").first()["status"] == "insufficient_sample"
    assert ST.safe_correlation(df, "x", "x").first()["value"] == pytest.approx(1.0)


def test_dirty_currency_hours_and_counts(spark):
    raw = spark.createDataFrame(
        [
            ("2024-01-05", " o1 ", "$1,234.50", " R ", "3", "1", "09:15:00", " d ", " c "),
            ("2024-01-05", "o2", " 12.5 ", "R", "x", None, "25:00:00", "d", "c"),
            ("bad", "o3", "abc", "R", "2.0", "x", None, "d", "c"),
            ("2024-01-05", "o4", "", "R", "1", "0", "00:00:00", "d", "c"),
        ],
        ", ".join(f"`{c}` string" for c in I.RAW_COLUMNS["orders"]),
    )
    rows = {r["order_id"]: r for r in I.clean_orders(raw).collect()}
    assert rows["o1"]["order_amount"] == 1234.5 and rows["o1"]["delivery_hour"] == 9 and rows["o1"]["region"] == "R"
    assert rows["o2"]["order_amount"] == 12.5 and rows["o2"]["delivery_hour"] is None
    assert (rows["o2"]["items_delivered"], rows["o2"]["items_missing"]) == (0, 0)
    assert rows["o3"]["order_amount"] is None and rows["o3"]["order_date"] is None
    assert rows["o3"]["items_delivered"] == 2 and rows["o4"]["order_amount"] is None


def test_unpivot_drops_blank_positions(spark):
    wide = spark.createDataFrame(
        [("o1", "p1", " ", "p3"), ("o2", "p1", None, None), ("o1", "p1", None, None)],
        "order_id string, product_id_1 string, product_id_2 string, product_id_3 string",
    )
    got = sorted(values(I.unpivot_missing_items(wide), "order_id", "item_position", "product_id"))
    assert got == [("o1", 1, "p1"), ("o1", 3, "p3"), ("o2", 1, "p1")]


def test_upsert_modes_and_versions(spark):
    schema = "order_id bigint, order_amount double, version bigint"
    old = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0)], schema)
    new = spark.createDataFrame([(2, 20.0, 1), (2, 21.0, 2), (3, 30.0, 1)], schema)
    update = dict(values(I.upsert_orders(old, new, "update", "version"), "order_id", "order_amount"))
    keep = dict(values(I.upsert_orders(old, new, "nothing", "version"), "order_id", "order_amount"))
    assert update == {1: 1.0, 2: 21.0, 3: 30.0}
    assert keep == {1: 1.0, 2: 2.0, 3: 30.0}
    with pytest.raises(ValueError):
        I.upsert_orders(old, new, "merge")


def test_lookup_reports_unknown_names(spark):
    df = spark.createDataFrame([(1, "A"), (2, "Z"), (3, "Z")], "id bigint, region string")
    dim = spark.createDataFrame([(7, "A")], "region_id int, region_name string")
    known, unknown = I.lookup_ids(df, dim, "region", "region_name", "region_id")
    assert values(known, "id", "region_id") == [(1, 7)]
    assert values(unknown, "region", "row_count") == [("Z", 2)]


def test_require_columns(spark):
    with pytest.raises(ValueError):
        I.require_columns(one_column(spark, [1.0]), ["x", "y"])


def test_failed_load_is_logged(spark, tmp_path):
    good = one_column(spark, [1.0, 2.0])
    bad = good.select(F.raise_error(F.lit("broken")).cast("double").alias("x"))
    with pytest.raises(Exception):
        I.load_with_log({"good": good, "bad": bad}, str(tmp_path / "out"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    # a load is visible as a whole or not at all
    assert sorted(values(log, "table_name", "status")) == [("bad", "FAILED")]
    assert not (tmp_path / "out" / "good").exists()


def test_orders_without_keys_belong_to_nobody(spark):
    """Drivers at 10, 10 and 20 percent; orders without driver, customer or region at 100."""
    from deliveryrisk.operators import indicators as N
    from deliveryrisk.operators import pairs as P
    from deliveryrisk.operators import regions as G

    rows = [(i, "2024-01-05", 10.0, "west", 9, 1, 8, "a", "x") for i in range(5)]
    rows += [(10 + i, "2024-01-05", 10.0, "west", 9, 1, 8, "b", "y") for i in range(5)]
    rows += [(20 + i, "2024-02-05", 10.0, "east", 8, 2, 9, "c", "z") for i in range(5)]
    rows += [(30 + i, "2024-02-05", 10.0, None, 0, 10, 9, None, None) for i in range(5)]
    df = spark.createDataFrame(
        rows,
        "order_id long, order_date string, order_amount double, region string, items_delivered long, "
        "items_missing long, delivery_hour int, driver_id string, customer_id string",
    ).withColumn("order_date", F.to_date("order_date"))
    stats = {r["driver_id"]: r["missing_rate"] for r in N.entity_stats(df, "driver_id").collect()}
    assert stats == {"a": 10.0, "b": 10.0, "c": 20.0}
    found = N.all_indicators(df, 1.0).collect()
    assert {(r["entity_type"], r["entity_id"]) for r in found} == {("driver", "c"), ("customer", "z"), ("customer", "x"), ("customer", "y")}
    assert {(r["driver_id"], r["customer_id"]) for r in P.pair_interactions(df).collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    assert {r["region"] for r in G.regional_performance(df).collect()} == {"west", "east"}
    assert all(r["region"] for r in G.regional_monthly(df).collect())


def test_exposure_by_product_counts_each_column_on_its_own(spark):
    kind = (
        "product_id bigint, order_id bigint, customer_id bigint, region string, price double, is_anomaly_day boolean, "
        "is_anomaly_hour boolean, is_high_risk_region boolean, is_collusion_pair boolean, pattern_exposure_points double"
    )
    rows = [
        (1, 10, 5, "a", 2.5, True, False, True, False, 4.0),
        (1, 10, 5, "a", 2.5, True, False, False, False, 2.0),
        (1, 10, 6, None, 2.5, False, False, False, False, 0.0),
        (1, 11, None, "b", 2.5, False, True, None, False, 2.0),
        (2, None, 5, None, 1.0, False, False, False, True, 1.0),
        (None, 12, 5, "a", 1.0, False, False, False, True, 1.0),
    ]
    got = P.exposure_by_product(spark.createDataFrame(rows, kind)).orderBy("product_id")
    assert values(got, "product_id", "times_reported_missing", "orders_affected", "unique_customers", "unique_regions") == [
        (1, 4, 2, 2, 2),
        (2, 1, 0, 1, 0),
    ]
    assert values(got, "estimated_loss", "high_risk_region_rate", "pattern_exposure_index") == [
        (10.0, pytest.approx(1 / 3), 2.0),
        (1.0, 0.0, 1.0),
    ]
    # no row is held once for each distinct count
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_products_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    from deliveryrisk.functions import dealing

    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    kind = (
        "product_id bigint, order_id bigint, customer_id bigint, region string, price double, is_anomaly_day boolean, "
        "is_anomaly_hour boolean, is_high_risk_region boolean, is_collusion_pair boolean, pattern_exposure_points double"
    )
    rows = [(i % 7, i // 2, i % 30, "ab"[i % 2] if i % 3 else None, 1.0, True, False, True, False, 4.0) for i in range(200)]
    exposed = spark.createDataFrame(rows, kind)
    parts = [r[0] for r in dealing.dealt(exposed, "order_id").groupBy(F.spark_partition_id()).count().collect()]
    assert 10 < len(parts) <= 20
    got = P.exposure_by_product(exposed)
    want = {
        p: tuple(len({r[c] for r in rows if r[0] == p and r[c] is not None}) for c in (1, 2, 3)) for p in range(7)
    }
    assert {r[0]: tuple(r)[1:] for r in got.select("product_id", "orders_affected", "unique_customers", "unique_regions").collect()} == want
    # the sums and each of the three counts work on 20 tasks of ten rows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 4 and all(", 20" in line for line in plan.splitlines() if "RepartitionByExpression" in line)
    facts = spark.createDataFrame([(i, "xy"[i % 2], 2.0) for i in range(50)] * 3, "order_id bigint, category string, order_amount double")
    scope = spark.createDataFrame(
        [(c, "Low", 1, 1.0, 1.0, 1.0, 1.0, 1.0) for c in "xy"],
        "category string, risk_tier string, times_reported_missing bigint, estimated_loss double, margin_loss double, "
        "replacement_cost double, prevention_cost double, risk_score double",
    )
    cats = P.category_scope(scope, facts)
    assert sorted(values(cats, "category", "revenue_proxy")) == [("x", 50.0), ("y", 50.0)]
    assert "RepartitionByExpression" in cats._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_folded_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Lines and orders are dealt by the number of lines, not by a fixed number of partitions; odd keys stay right."""
    from deliveryrisk.functions import dealing
    from deliveryrisk.sources.canonical import SCHEMAS, Tables

    day = dt.datetime(2023, 1, 1)
    lines = [(k, k % 5, k % 3, n, 1.0, 1.0, 0.0, 0.0, "R" if (k + n) % 4 == 0 else "N", "O", day) for k in range(40) for n in range(1, 6)]
    lines += [(None, 1, 2, 1, 1.0, 1.0, 0.0, 0.0, "R", "O", day)] * 30 + lines[:5]
    orders = [(k, (k or 0) % 7, "O", 10.0, day, "1") for k in [*range(42), 3, None]]
    rows = {
        "lineitem": lines,
        "orders": orders,
        "supplier": [(k, f"s{k}", 0, 0.0) for k in range(3)],
        "customer": [(k, f"c{k}", 0, 0.0, "x") for k in range(7)],
        "nation": [(0, "n", 0)],
        "region": [(0, "r")],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    df = Tables(spark, str(tmp_path)).orders
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {math.ceil(len(lines) / 10)}") >= 2 and "RepartitionByExpression" in plan
    want = []
    for k, *_ in orders:
        mine = [r for r in lines if k is not None and r[0] == k]
        first = min(((r[3], r[1], r[2]) for r in mine), default=(0, 0, None if k is None else k % 3))
        gone = sum(r[8] == "R" for r in mine)
        want.append((k, gone, len(mine) - gone, first[2]))
    got = df.select("order_id", "items_missing", "items_delivered", "driver_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exposed_orders_meet_pairs_and_items_in_tasks_of_bounded_size(spark, monkeypatch):
    """Pairs and items are dealt by the number of rows; keys may be null or repeat, and every row comes out once."""
    from deliveryrisk.functions import dealing

    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    day = dt.date(2023, 1, 1)
    rows = [
        (i if i % 50 else None, day + dt.timedelta(i % 9), 10.0, "ab"[i % 2] if i % 3 else None, i % 5, i % 4, i % 24, i % 6 if i % 7 else None, i % 8)
        for i in range(200)
    ]
    rows += rows[1:4]
    kind = (
        "order_id bigint, order_date date, order_amount double, region string, items_delivered bigint, items_missing bigint, "
        "delivery_hour int, driver_id bigint, customer_id bigint"
    )
    items = [(i if i % 40 else None, i % 5 if i % 11 else None) for i in range(150)]
    orders, missing = spark.createDataFrame(rows, kind), spark.createDataFrame(items, "order_id bigint, product_id bigint")
    products = spark.createDataFrame([(p, f"p{p}", "c", 2.0) for p in range(5)], "product_id bigint, product_name string, category string, price double")
    plan = P.order_exposure(orders, missing)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and all("driver_id" in line and ", 21" in line for line in dealt)
    exposed = P.order_exposure(orders, missing).collect()
    assert sorted((str(r.order_id), str(r.driver_id), r.customer_id) for r in exposed) == sorted((str(r[0]), str(r[7]), r[8]) for r in rows)
    pair_rates = {}
    for r in rows:
        pair_rates.setdefault((r[7], r[8]), []).append(100.0 * r[5] / (r[4] + r[5]) if r[4] + r[5] else 0.0)
    for r in exposed:
        known = pair_rates[r.driver_id, r.customer_id]
        assert r.pair_missing_rate == (None if r.driver_id is None else pytest.approx(sum(known) / len(known)))
    facts = P.pattern_exposure(missing, orders, products)
    lines = [line for line in facts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert sum("[order_id" in line and ", 36" in line for line in lines) == 2
    copies = {i: sum(r[0] == i for r in rows) for i, _ in items if i is not None}
    want = sorted((str(i), str(p)) for i, p in items for _ in range(max(1, copies.get(i, 0))))
    assert sorted((str(r.order_id), str(r.product_id)) for r in facts.collect()) == want
