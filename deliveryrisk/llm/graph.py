"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliveryrisk.llm.common import stored


def _smallest(links: DataFrame) -> DataFrame:
    """Each node u with the smallest of its v and itself."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from every linked node: columns node, component.

    Each round links a node's larger neighbours, then all its neighbours, to
    its smallest one. A hub with very many links is summed before the shuffle
    for its minimum and meets its links in a join that Spark can split. Rounds
    grow with the logarithm of a component's length; each is written to the
    shared folder, and the last changes nothing.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    edges = stored(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    before = None
    while True:
        facts = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if facts["n"] == 0 or before == (facts["n"], facts["h"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = (facts["n"], facts["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
