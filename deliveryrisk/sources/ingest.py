"""Reading, cleaning and loading the raw tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Raw CSV columns, all read as text.
RAW_COLUMNS = {
    "orders": [
        "date",
        "order_id",
        "order_amount",
        "region",
        "items_delivered",
        "items_missing",
        "delivery_hour",
        "driver_id",
        "customer_id",
    ],
    "customers": ["customer_id", "customer_name", "customer_age"],
    "drivers": ["driver_id", "driver_name", "age", "Trips"],
    "products": ["produc_id", "product_name", "category", "price"],
    "missing_items": ["order_id", "product_id_1", "product_id_2", "product_id_3"],
}


def read_raw(spark: SparkSession, path: str, table: str) -> DataFrame:
    """I-1: one raw CSV with a header, every column text."""
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS[table])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 16,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """I-2: a database table or subquery, split into range reads when a column is named."""
    props = dict(properties or {})
    if partition_column and bounds:
        return spark.read.jdbc(
            url, table, partition_column, str(bounds[0]), str(bounds[1]), partitions, properties=props
        )
    return spark.read.jdbc(url, table, properties=props)


def parse_currency(c: Column | str) -> Column:
    """I-3: amount from text with $ and thousands separators; NULL when unreadable."""
    text = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(text, "[$,]", "")).try_cast("double")


def whole_number(c: str, default: int | None = None) -> Column:
    n = F.trim(c).try_cast("double").try_cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def lower_names(df: DataFrame) -> DataFrame:
    """Names in lower case without blanks around them."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def trimmed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns if c in df.columns})


def clean_orders(raw: DataFrame) -> DataFrame:
    """I-4: dates, amounts, hours (bad to NULL), item counts (bad to 0), trimmed ids."""
    df = lower_names(raw)
    hour = F.hour(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.trim("delivery_hour")), F.lit("yyyy-MM-dd HH:mm:ss")))
    df = df.withColumns(
        {
            "order_date": F.col("date").try_cast("date"),
            "order_amount": parse_currency("order_amount"),
            "delivery_hour": hour,
            "items_delivered": whole_number("items_delivered", 0),
            "items_missing": whole_number("items_missing", 0),
        }
    ).drop("date")
    return trimmed(df, ["region", "driver_id", "customer_id", "order_id"])


def clean_customers(raw: DataFrame) -> DataFrame:
    """I-5."""
    df = trimmed(lower_names(raw), ["customer_id", "customer_name"])
    return df.withColumn("customer_age", whole_number("customer_age"))


def clean_drivers(raw: DataFrame) -> DataFrame:
    """I-5."""
    df = trimmed(lower_names(raw), ["driver_id", "driver_name"])
    return df.withColumns({"age": whole_number("age"), "trips": whole_number("trips", 0)})


def clean_products(raw: DataFrame) -> DataFrame:
    """I-6: the misspelt id column gets its name."""
    df = lower_names(raw).withColumnRenamed("produc_id", "product_id")
    return trimmed(df, ["product_id", "product_name", "category"]).withColumn("price", parse_currency("price"))


ITEM_COLUMNS = ["product_id_1", "product_id_2", "product_id_3"]


def clean_missing_items(raw: DataFrame) -> DataFrame:
    """I-7: trimmed ids, NULL stays NULL."""
    return trimmed(lower_names(raw), ["order_id", *ITEM_COLUMNS])


def unpivot_missing_items(wide: DataFrame) -> DataFrame:
    """I-8: one row per filled product column; the first of equal (order, position) rows is kept."""
    long = wide.unpivot("order_id", [c for c in ITEM_COLUMNS if c in wide.columns], "_column", "product_id")
    rows = long.where(F.coalesce(F.trim(F.col("product_id").cast("string")) != "", F.lit(False))).select(
        "order_id", "product_id", F.substring("_column", -1, 1).cast("int").alias("item_position")
    )
    return rows.groupBy("order_id", "item_position").agg(F.min("product_id").alias("product_id"))


def pivot_missing_items(long: DataFrame, order_column: str = "item_position") -> DataFrame:
    """I-9: the first three items of an order as columns.

    Spark applies the rank limit below the shuffle too, so each task sends at
    most three items of an order.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("order_id").orderBy(order_column, "product_id")
    ranked = long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3)
    return ranked.groupBy("order_id").agg(
        *[F.max(F.when(F.col("_r") == i, F.col("product_id"))).alias(c) for i, c in enumerate(ITEM_COLUMNS, 1)]
    )


def missing_items_enriched(long: DataFrame, products: DataFrame) -> DataFrame:
    """I-10: items with name, price and category where known."""
    return long.join(products.withColumnRenamed("price", "product_price"), "product_id", "left")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """I-11: fail early when a column is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def dedup_keep_first(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """I-12: the first row of every key in a given order.

    The smallest ordered struct is an aggregate, so rows of a hot key are
    reduced before they are shuffled.
    """
    ranks = [F.col(c) if isinstance(c, str) else c for c in order]
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(ranks)], F.struct(*others).alias("row"))
    return df.groupBy(key).agg(F.min(packed).alias("_first")).select(key, "_first.row.*")


def lookup_ids(df: DataFrame, dimension: DataFrame, name: str, dim_name: str, dim_id: str) -> tuple[DataFrame, DataFrame]:
    """I-13: replace a name by its surrogate id; also return the unknown names with their row counts."""
    dim = dimension.select(F.col(dim_name).alias(name), dim_id)
    known = df.join(dim, name)
    unknown = df.join(dim, name, "left_anti").groupBy(name).agg(F.count(F.lit(1)).alias("row_count"))
    return known, unknown


def semi_join_valid(children: DataFrame, parents: Mapping[str, DataFrame]) -> DataFrame:
    """I-14: children whose keys exist in every parent."""
    out = children
    for key, parent in parents.items():
        out = out.join(parent.select(key), key, "left_semi")
    return out


def upsert_orders(current: DataFrame, changes: DataFrame, mode: str = "update", version: str | None = None) -> DataFrame:
    """I-15: insert new rows; on a known key replace (``update``) or keep the old row (``nothing``).

    Of several changes of one key the one with the largest ``version`` wins.
    """
    if mode not in ("update", "nothing"):
        raise ValueError(f"unknown mode {mode}")
    first, second = (changes, current) if mode == "update" else (current, changes)
    newest = (-F.col(version)).alias("_v") if version else F.lit(0).alias("_v")
    stacked = first.select("*", F.lit(0).alias("_source"), newest).unionByName(
        second.select("*", F.lit(1).alias("_source"), newest if version and version in second.columns else F.lit(0).alias("_v"))
    )
    return dedup_keep_first(stacked, "order_id", ["_source", "_v"]).drop("_source", "_v")


# Parents before children.
LOAD_ORDER = ["regions", "drivers", "customers", "products", "orders", "missing_items"]


class LoadError(RuntimeError):
    """A table could not be written; nothing of the load is visible."""

    def __init__(self, table: str, cause: Exception):
        super().__init__(f"{table}: {cause}")
        self.table = table


class Folders:
    """Renames and deletes below one folder, in whatever store it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def move(self, source: str, target: str) -> None:
        self.system.mkdirs(self.path(target).getParent())
        if not self.system.rename(self.path(source), self.path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def files(self, name: str) -> list[str]:
        return [f.getPath().getName() for f in self.system.listStatus(self.path(name)) if f.getPath().getName().startswith("part-")]

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def in_load_order(tables: Mapping[str, DataFrame]) -> list[str]:
    return [t for t in LOAD_ORDER if t in tables] + [t for t in tables if t not in LOAD_ORDER]


def write_staged(df: DataFrame, path: str) -> int:
    """Write a frame and count its rows on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return int(seen.get.get("n", 0))


def commit(folders: Folders, stage: str, out: str, names: Sequence[str], truncate: bool) -> None:
    """Make staged tables visible; if one cannot be moved, those moved before are put back."""
    undo: list[tuple[str, str]] = []
    try:
        for name in names:
            target = f"{out}/{name}"
            if truncate or not folders.exists(target):
                if folders.exists(target):
                    folders.move(target, f"{stage}/old/{name}")
                    undo.append((f"{stage}/old/{name}", target))
                folders.move(f"{stage}/new/{name}", target)
                undo.append((target, f"{stage}/new/{name}"))
            else:
                for file in folders.files(f"{stage}/new/{name}"):
                    folders.move(f"{stage}/new/{name}/{file}", f"{target}/{file}")
                    undo.append((f"{target}/{file}", f"{stage}/new/{name}/{file}"))
    except Exception as error:
        for source, target in reversed(undo):
            folders.move(source, target)
        raise LoadError(name, error) from error


def staged_load(tables: Mapping[str, DataFrame], out: str, truncate: bool) -> list[tuple]:
    """Write all tables beside the visible ones, parents first, then swap them in.

    Returns (table, started, finished, rows) of each. Every table is read once;
    its rows are counted while they are written. If a table fails, what is
    visible stays as it was.
    """
    spark = next(iter(tables.values())).sparkSession
    folders, stage = Folders(spark, out), f"{out}/_load-{uuid.uuid4().hex}"
    done = []
    try:
        for name in in_load_order(tables):
            started = datetime.now()
            try:
                n = write_staged(tables[name], f"{stage}/new/{name}")
            except Exception as error:
                raise LoadError(name, error) from error
            done.append((name, started, datetime.now(), n))
        commit(folders, stage, out, [d[0] for d in done], truncate)
    finally:
        folders.delete(stage)
    return done


def load_all(tables: Mapping[str, DataFrame], out: str, truncate: bool = True) -> DataFrame:
    """I-16: load the tables as parquet, all or none; rows of this load for each table."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, n) for name, _, _, n in staged_load(tables, out, truncate)]
    return spark.createDataFrame(rows, "table_name string, row_count bigint")


LOG_SCHEMA = "table_name string, started_at timestamp, finished_at timestamp, row_count bigint, status string, error string"


def load_log(spark: SparkSession, path: str, entries: Sequence[tuple]) -> None:
    """I-17: append audit rows."""
    spark.createDataFrame(list(entries), LOG_SCHEMA).write.mode("append").parquet(path)


def load_with_log(tables: Mapping[str, DataFrame], out: str, log_path: str) -> None:
    """I-16, I-17: load all tables or none and log the outcome; of a failed load, the table it failed at."""
    spark, started = next(iter(tables.values())).sparkSession, datetime.now()
    try:
        done = staged_load(tables, out, truncate=True)
    except LoadError as error:
        load_log(spark, log_path, [(error.table, started, datetime.now(), None, "FAILED", str(error)[:4000])])
        raise
    load_log(spark, log_path, [(*d, "SUCCESS", None) for d in done])


def table_profile(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """I-18: existence, columns and rows per source."""
    rows = []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name, path in paths.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(hadoop).exists(p):
            rows.append((name, False, 0, None))
            continue
        df = spark.read.parquet(path)
        rows.append((name, True, len(df.columns), df.count()))
    return spark.createDataFrame(rows, "table_name string, found boolean, column_count int, row_count bigint")


def summary_stats(orders, drivers, customers, products, missing_items) -> DataFrame:
    """I-19: counts, sums and date range over the five tables."""
    from deliveryrisk.functions.scalar import money_sum

    def count(df):
        return df.agg(F.count(F.lit(1))).scalar()

    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("items_missing").alias("sum_items_missing"),
        money_sum("order_amount").alias("total_order_value"),
        F.min("order_date").alias("min_date"),
        F.max("order_date").alias("max_date"),
    ).withColumns(
        {
            "total_drivers": count(drivers),
            "total_customers": count(customers),
            "total_products": count(products),
            "total_missing_items": count(missing_items),
        }
    )


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """I-20: export a result as CSV with header, JSON lines or parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")
