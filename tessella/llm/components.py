"""Connected components of a graph given as edges, by alternating large and small stars. Nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import drop_table, table


def _hung(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung from the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _hung(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung from the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _hung(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root): for each node with an edge that isn't the least of its component, that least node. `edges` has u and v of one
    sortable type. Each round's edges are written to the shared folder; it ends when a round changes nothing."""
    now, mark = table(_hung(edges), "edges"), None
    while True:
        count, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == mark or not count:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (count, total)
        before, now = now, table(_small_star(_large_star(now)), "edges")
        drop_table(before)
