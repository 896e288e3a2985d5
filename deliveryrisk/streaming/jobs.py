"""Two streaming jobs: an hourly watch and the latest version of each order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from deliveryrisk.functions.materialize import ensure_checkpoint_dir


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def window_rates(events: DataFrame, bad_type: str, width: str = "1 hour") -> DataFrame:
    """Share of bad events per window; the same for a batch or a stream."""
    return events.groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col("event_type") == bad_type, 1)).alias("bad_events"),
    ).select(
        F.col("window.start").alias("window_start"),
        "events",
        "bad_events",
        (F.col("bad_events") / F.col("events") * 100.0).alias("bad_rate"),
    )


def rate_baseline(batch: DataFrame, bad_type: str = "error") -> tuple[float, float]:
    """Mean and deviation of the hourly rates of a finished period (one row)."""
    row = window_rates(batch, bad_type).agg(F.avg("bad_rate").alias("m"), F.stddev_samp("bad_rate").alias("s")).first()
    return float(row["m"] or 0.0), float(row["s"] or 0.0)


def hourly_watchtower_stream(
    events: DataFrame, baseline: tuple[float, float], bad_type: str = "error", late: str = "2 hours"
) -> DataFrame:
    """SS-1: rate per hour against the baseline band; rows later than the watermark are dropped."""
    mean, std = baseline
    return window_rates(events.withWatermark("ts", late), bad_type).withColumns(
        {
            "upper_threshold": F.lit(mean + 2 * std),
            "is_anomaly": F.col("bad_rate") > mean + 2 * std,
        }
    )


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over everything available and append the result as parquet."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()


STATE_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeepLatest(StatefulProcessor):
    """Keeps the row with the largest version of each key and passes on every new one.

    Of rows with equal versions the first stays. With ``keep_ms`` a key that has
    not changed for so long is forgotten.
    """

    def __init__(self, schema: StructType, version: str, keep_ms: int | None):
        self.schema, self.at, self.keep_ms = schema, schema.fieldNames().index(version), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", self.schema, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = plain(self.latest.get()[self.at]) if self.latest.exists() else None
        best = None
        for row in rows:
            if newest is None or plain(row[self.at]) > newest:
                best, newest = row, plain(row[self.at])
        if best is not None:
            self.latest.update(tuple(plain(v) for v in best))
            yield best

    def close(self) -> None:
        pass


def plain(value):
    """A struct as a tuple, so that versions of several parts are compared part by part."""
    if isinstance(value, dict):
        return tuple(value.values())
    return tuple(value) if isinstance(value, (tuple, list)) else value


class LatestOrders:
    """SS-2: keep the latest version of each order in keyed state.

    A batch reads and writes the state of its own orders only, whatever came
    before. ``table`` reads the state as it stands, one row an order; no batch is
    kept and none is merged. The state lives below the checkpoint folder of the
    query, in RocksDB, and a query started again there goes on from it.
    """

    def __init__(self, spark: SparkSession, checkpoint: str, schema: str, keep_ms: int | None = None):
        self.spark, self.checkpoint, self.keep_ms = spark, checkpoint, keep_ms
        self.schema = StructType.fromDDL(schema)

    def table(self) -> DataFrame:
        """The latest version of every order that the state holds."""
        state = (
            self.spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "latest").load(self.checkpoint)
        )
        return state.select(*[F.col("value")[c].alias(c) for c in self.schema.fieldNames()])

    def run(self, changes: DataFrame, late: str = "2 hours") -> DataFrame:
        """Drain the stream and return the latest versions; repeated change ids are dropped."""
        rows = changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["change_id"])
        latest = rows.select(*self.schema.fieldNames()).groupBy("order_id").transformWithState(
            statefulProcessor=KeepLatest(self.schema, "version", self.keep_ms),
            outputStructType=self.schema,
            outputMode="Append",
            timeMode="None" if self.keep_ms is None else "ProcessingTime",
        )
        before = self.spark.conf.get(STATE_SETTING, None)
        self.spark.conf.set(STATE_SETTING, ROCKSDB)
        try:
            query = (
                latest.writeStream.format("noop")
                .option("checkpointLocation", self.checkpoint)
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            if before is None:
                self.spark.conf.unset(STATE_SETTING)
            else:
                self.spark.conf.set(STATE_SETTING, before)
        return self.table()
