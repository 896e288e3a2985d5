"""Every query against its SQL; a cross-section by default, all with FULL_ORACLE=1."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

PATH = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
CORE = [
    "driver_features",
    "driver_risk_scores",
    "driver_fraud_metrics",
    "high_risk_drivers",
    "customer_workspace",
    "driver_links",
    "suspicious_pairs",
    "order_features",
    "overview_metrics",
    "percentile_table",
    "regional_summary",
    "regional_hotspots",
    "monthly_trends",
    "aggregate_by_week",
    "temporal_summary",
    "product_scope",
    "loss_forecast",
    "sku_triage_queue",
    "all_indicators",
    "h4_mann_whitney",
    "drift_by_halves",
    "clean_orders",
    "missing_items_full",
    "upsert_orders_update",
    "quality_issues",
    "stream_hourly_watchtower",
    "stream_upsert_orders",
]
ORACLES = entry.oracle_sql()
NAMES = list(ORACLES) if os.environ.get("FULL_ORACLE") else CORE


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in glob.glob(f"{PATH}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, PATH)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    rel = db.sql(ORACLES[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = ordered(tuple(r[i] for i in at) for r in rel.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_every_query_is_callable():
    assert len(entry.queries()) >= 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
