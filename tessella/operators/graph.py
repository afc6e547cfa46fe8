"""Co-occurrence, typed weights, neighbourhoods, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C


def co_occurrences(mentions: DataFrame, context: str, entity: str, at: str | None = None) -> DataFrame:
    """(a, b, n, contexts, last): pairs a < b that share a context; every repeat counts. Repeats in a context are counted before pairs are made."""
    m = mentions.groupBy(F.col(context).alias("x"), F.col(entity).alias("e")).agg(F.count(F.lit(1)).alias("n"), *([F.max(at).alias("t")] if at else []))
    l, r = m.alias("l"), m.alias("r")
    both = [F.col("l.e").alias("a"), F.col("r.e").alias("b"), (F.col("l.n") * F.col("r.n")).alias("n"), *([F.greatest("l.t", "r.t").alias("t")] if at else [])]
    pairs = l.join(r, (F.col("l.x") == F.col("r.x")) & (F.col("l.e") < F.col("r.e"))).select(*both)
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"), *([F.max("t").alias("last")] if at else []))


def weighted(pairs: DataFrame, as_of: Column, least: float = 0.05) -> DataFrame:
    """Edges with their weight; those below `least` go."""
    days = F.datediff(as_of, F.to_date("last"))
    return pairs.withColumn("weight", F.round(C.edge_weight(F.col("n"), days), 6)).where(F.col("weight") >= least)


def neighbours_by_context(mentions: DataFrame, context: str, entity: str, of: int, k: int = 10) -> DataFrame:
    """Entities that share contexts with one entity, by number of mentions there."""
    shared = mentions.where(F.col(entity) == of).select(context).distinct()
    return mentions.join(shared, context, "left_semi").where(F.col(entity) != of).groupBy(entity).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), entity).limit(k)


def k_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): what lies within `depth` undirected steps (at most 3) of the nodes of `start`, with the fewest steps."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = front = start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("hops", F.lit(0))
    for hop in range(1, min(depth, 3) + 1):
        near = front.join(both, front.node == both.a).select(F.col("b").alias("node")).distinct()
        front = near.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among `nodes`."""
    n = nodes.select(F.col(nodes.columns[0]).alias("_n"))
    return edges.join(n, edges.a == n["_n"], "left_semi").join(n.withColumnRenamed("_n", "_m"), F.col("b") == F.col("_m"), "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state, old, new, delta): added, removed and changed keys."""
    o, n = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    out = o.join(n, key, "full").withColumn("state", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed"))
    return out.where(F.col("state").isNotNull()).withColumn("delta", F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0)))


def merged_entities(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Upsert of entities (key, mentions, first_seen, last_seen): counts add up, times widen; is_new marks those not stored before."""
    both = stored.withColumn("is_new", F.lit(False)).unionByName(found.withColumn("is_new", F.lit(True)))
    return both.groupBy(key).agg(F.sum("mentions").alias("mentions"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.every("is_new").alias("is_new"))


def merged_edges(edges: DataFrame, src: DataFrame, dst: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """Edges counted by their ends, with the last time; an edge is skipped if an end is no node. Counting comes before the joins."""
    counted = edges.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    return counted.join(src, a, "left_semi").join(dst, b, "left_semi")


def merged_nodes(stored: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (keys, name, first_seen, last_seen, mentions) after found ones are merged in: a new node is created, an old one is seen later, more often, and
    under its latest name. `created` tells them apart."""
    both = stored.withColumn("created", F.lit(False)).unionByName(found.withColumn("created", F.lit(True)))
    return both.groupBy(*keys).agg(
        F.max_by("name", F.struct("last_seen", "name")).alias("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("mentions").alias("mentions"), F.every("created").alias("created")
    )
