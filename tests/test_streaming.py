"""Streams drained from files, with late and repeated rows."""

import datetime as dt
import os

from deliveryrisk.streaming import jobs

SCHEMA = "event_id bigint, ts timestamp, event_type string"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def write(spark, rows, folder, schema=SCHEMA):
    """Add one file that is newer than the files already there."""
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    number = sum(f.startswith("part-") for f in before)
    for f in set(os.listdir(folder)) - before:
        if f.startswith("part-"):
            os.utime(os.path.join(folder, f), (1_700_000_000 + 100 * number,) * 2)


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, [(i, at(h, 5), "error" if h == 1 else "view") for i, h in enumerate([0, 1, 1, 2, 3, 8])], folder)
    write(spark, [(99, at(8, 10), "view")], folder)
    write(spark, [(100, at(1, 30), "view"), (101, at(8, 30), "view"), (102, at(12), "view")], folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    jobs.drain(jobs.hourly_watchtower_stream(stream, (10.0, 5.0)), out, str(tmp_path / "state"))
    got = {r["window_start"].hour: (r["events"], r["bad_rate"], r["is_anomaly"]) for r in spark.read.parquet(out).collect()}
    # The row at 1:30 arrives after 8:05, three hours past the watermark of two.
    assert got[1] == (2, 100.0, True)
    assert got[8] == (3, 0.0, False)
    assert 12 not in got


ORDERS = "order_id bigint, order_amount double, change_id bigint, version bigint"


def changes_from(spark, folder):
    return spark.readStream.schema(f"{ORDERS}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def test_latest_version_wins(spark, tmp_path):
    schema, folder = f"{ORDERS}, ts timestamp", str(tmp_path / "in")
    write(spark, [(1, 1.0, 1, 1, at(0)), (1, 3.0, 2, 3, at(1)), (2, 5.0, 3, 1, at(1))], folder, schema)
    write(spark, [(1, 2.0, 4, 2, at(1)), (2, 6.0, 5, 2, at(2)), (2, 9.0, 3, 9, at(1))], folder, schema)
    latest = jobs.LatestOrders(spark, str(tmp_path / "state"), ORDERS)
    got = {r["order_id"]: r["order_amount"] for r in latest.run(changes_from(spark, folder)).collect()}
    # Version 2 of order 1 is older than the stored version 3; change 3 came before.
    assert got == {1: 3.0, 2: 6.0}
    again = jobs.LatestOrders(spark, str(tmp_path / "state"), ORDERS)
    assert {r["order_id"]: r["order_amount"] for r in again.run(changes_from(spark, folder)).collect()} == got
    # Started again: a new order, and an equal version, which does not replace the first.
    write(spark, [(3, 7.0, 6, 1, at(3)), (2, 8.0, 7, 2, at(3))], folder, schema)
    assert {r["order_id"]: r["order_amount"] for r in again.run(changes_from(spark, folder)).collect()} == got | {3: 7.0}
    assert spark.conf.get(jobs.STATE_SETTING, None) != jobs.ROCKSDB


def test_state_holds_one_row_an_order(spark, tmp_path):
    """Many batches: the state has no history, and a batch does not rewrite orders of others."""
    schema, folder = f"{ORDERS}, ts timestamp", str(tmp_path / "in")
    latest = jobs.LatestOrders(spark, str(tmp_path / "state"), ORDERS)
    for n in range(3):
        write(spark, [(o, float(n), 10 * n + o, n, at(n)) for o in range(5)] + [(100 + n, 1.0, 1000 + n, 0, at(n))], folder, schema)
    rows = latest.run(changes_from(spark, folder)).collect()
    assert sorted((r["order_id"], r["order_amount"]) for r in rows) == [(o, 2.0) for o in range(5)] + [(100, 1.0), (101, 1.0), (102, 1.0)]
