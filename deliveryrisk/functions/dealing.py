"""Deal rows to tasks of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# Rows of a task, about.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows dealt by keys to as many tasks as hold ``TASK_ROWS`` each, about.

    Spark joins the partitions of its own shuffles until there is one for each
    core or they reach 64 MB, so narrow rows meet by the million and what a task
    holds of them grows with the table. A number of partitions that is asked for
    stays. ``df`` is counted if ``rows`` is not given, so it should be cheap to read.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(1, math.ceil(n / TASK_ROWS)), *keys)
