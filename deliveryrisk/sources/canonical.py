"""The five canonical tables, read from TPC-H shaped parquet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliveryrisk.functions.dealing import dealt
from deliveryrisk.functions.ranking import line_positions

# The schemas of the input files, given so that no read has to open a file first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


@dataclass
class Tables:
    """Lazy access to the canonical tables below one directory."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def regions(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))

    @cached_property
    def drivers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("driver_id"),
            F.col("s_name").alias("driver_name"),
            (key % 50 + 18).cast("int").alias("age"),
            (key * 13 % 130).cast("int").alias("trips"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            (key % 63 + 18).cast("int").alias("customer_age"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def missing_items(self) -> DataFrame:
        """One row per missing item, without position."""
        return (
            self.raw("lineitem")
            .where(F.col("l_returnflag") == "R")
            .select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
        )

    @cached_property
    def positioned_items(self) -> DataFrame:
        """Missing items with their position in the order and an id made of both."""
        rows = (
            self.raw("lineitem")
            .where(F.col("l_returnflag") == "R")
            .select(
                F.col("l_orderkey").alias("order_id"),
                "l_linenumber",
                F.col("l_partkey").alias("product_id"),
                "l_suppkey",
            )
        )
        numbered = line_positions(rows, ["order_id"], ["l_linenumber"], "product_id", ["l_suppkey"], "item_position")
        return numbered.select(
            F.concat_ws("-", "order_id", "item_position").alias("missing_item_id"),
            "order_id",
            "product_id",
            "item_position",
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with item counts, driver and region.

        The line items are folded to one row per order before they meet the
        orders; region and nation are fixed dimensions of at most 25 rows. Both
        are dealt to tasks of bounded size: the fold sorts its rows, so a fixed
        number of shuffle partitions would give a task its share of the table.
        Lines without an order meet none.
        """
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        n_lines = lines.count()
        items = (
            dealt(lines.where("l_orderkey IS NOT NULL"), "l_orderkey", rows=n_lines)
            .groupBy("l_orderkey")
            .agg(
                F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("items_missing"),
                F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("items_delivered"),
                F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first_line"),
            )
        )
        n_drivers = self.raw("supplier").agg(F.count(F.lit(1))).scalar()
        place = (
            self.raw("customer")
            .join(F.broadcast(self.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("region"))
        )
        return (
            dealt(self.raw("orders"), "o_orderkey", rows=n_lines)
            .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .join(place, "o_custkey", "left")
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.to_date("o_orderdate").alias("order_date"),
                F.col("o_totalprice").alias("order_amount"),
                "region",
                F.coalesce("items_delivered", F.lit(0)).alias("items_delivered"),
                F.coalesce("items_missing", F.lit(0)).alias("items_missing"),
                ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 24).cast("int").alias("delivery_hour"),
                F.coalesce(F.col("first_line.l_suppkey"), F.col("o_orderkey") % n_drivers).alias("driver_id"),
                F.col("o_custkey").alias("customer_id"),
            )
        )
