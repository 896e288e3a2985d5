"""Cut the lineage of a frame that several parts of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; a temporary one only in local mode where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get(CHECKPOINT_SETTING, None)
        if not named and not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the reliable checkpoint folder, once.

    Used for aggregated frames (one row per driver, customer, product, pair or
    order) that feed both scalar statistics and the final rows: the fact tables
    are then read once, and a lost executor costs no recomputation.
    """
    if getattr(df, "_is_materialized", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._is_materialized = True
    return out
