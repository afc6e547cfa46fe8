"""Contexts of meetings, projects, weeks and quarters, and changes of stored nodes, files and briefings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import context as X
from tessella.operators import graph as G
from tessella.operators import ingest as I
from tessella.registry import query
from tessella.sources.tables import load


def _between(column, a, b):
    return (F.col(column) >= F.lit(a).cast("timestamp")) & (F.col(column) < F.lit(b).cast("timestamp"))


@query("""WITH e AS (SELECT o_orderkey AS owner, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-02' AND o_orderdate < TIMESTAMP '1998-03-04'),
 p AS (SELECT owner, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS participants FROM e JOIN lineitem ON l_orderkey = owner GROUP BY 1),
 d AS (SELECT owner, list(l_partkey ORDER BY l_quantity DESC, l_partkey)[1:5] AS documents FROM (SELECT owner, l_partkey, max(l_quantity) AS l_quantity FROM e JOIN lineitem ON l_orderkey = owner GROUP BY ALL) GROUP BY 1),
 i AS (SELECT owner, list(o.o_orderkey ORDER BY o.o_orderdate, o.o_orderkey)[1:5] AS open_items FROM e JOIN orders o USING (o_custkey) WHERE o.o_orderstatus = 'O' AND o.o_orderkey <> owner GROUP BY 1)
 SELECT owner, participants, documents, coalesce(open_items, []) AS open_items FROM p JOIN d USING (owner) LEFT JOIN i USING (owner)""")
def meeting_contexts(spark, d):
    """For each order of two days: who takes part (suppliers), its weightiest parts, and what else is open with its customer."""
    o, line = load(spark, d, "orders"), load(spark, d, "lineitem")
    e = o.where(_between("o_orderdate", "1998-03-02", "1998-03-04")).select(F.col("o_orderkey").alias("owner"), "o_custkey")
    lines = line.join(e.select(F.col("owner").alias("l_orderkey")), "l_orderkey", "left_semi").withColumnRenamed("l_orderkey", "owner")
    people = lines.select("owner", F.col("l_suppkey").alias("item"), F.col("l_suppkey").alias("place")).distinct()
    parts = lines.groupBy("owner", F.col("l_partkey").alias("item")).agg((-F.max("l_quantity")).alias("place"))
    waiting = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("item"), F.unix_timestamp("o_orderdate").alias("place"))
    items = e.join(waiting, "o_custkey").where("item != owner").select("owner", "item", "place")
    return X.assembled("owner", {"participants": (people, None), "documents": (parts, 5), "open_items": (items, 5)}, needed=["participants", "documents"])


@query("""WITH s AS (SELECT s_suppkey AS owner FROM supplier WHERE contains(lower(s_name), '0001')), l AS (SELECT * FROM lineitem JOIN s ON l_suppkey = owner),
 d AS (SELECT owner, list(l_orderkey ORDER BY t DESC, l_orderkey)[1:10] AS decisions FROM (SELECT owner, l_orderkey, max(l_shipdate) AS t FROM l WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY 1),
 p AS (SELECT owner, list(o_custkey ORDER BY n DESC, o_custkey)[1:5] AS participants FROM (SELECT owner, o_custkey, count(*) AS n FROM l JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1),
 i AS (SELECT owner, list(l_partkey ORDER BY n DESC, l_partkey)[1:5] AS open_items FROM (SELECT owner, l_partkey, count(*) AS n FROM l WHERE l_linestatus = 'O' GROUP BY ALL) GROUP BY 1)
 SELECT d.owner, decisions, coalesce(participants, []) AS participants, coalesce(open_items, []) AS open_items FROM d LEFT JOIN p USING (owner) LEFT JOIN i USING (owner)""")
def project_contexts(spark, d):
    """For suppliers whose names contain a text: their last decisions, the customers met most, and the parts most often open."""
    chosen = load(spark, d, "supplier").where(F.contains(F.lower("s_name"), F.lit("0001"))).select(F.col("s_suppkey").alias("l_suppkey"))
    l = load(spark, d, "lineitem").join(chosen, "l_suppkey", "left_semi").withColumnRenamed("l_suppkey", "owner")
    decisions = l.where("l_returnflag = 'R'").groupBy("owner", F.col("l_orderkey").alias("item")).agg((-F.unix_timestamp(F.max("l_shipdate"))).alias("place"))
    met = l.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("item")), "l_orderkey").groupBy("owner", "item").agg((-F.count(F.lit(1))).alias("place"))
    waits = l.where("l_linestatus = 'O'").groupBy("owner", F.col("l_partkey").alias("item")).agg((-F.count(F.lit(1))).alias("place"))
    return X.assembled("owner", {"decisions": (decisions, 10), "participants": (met, 5), "open_items": (waits, 5)}, needed=["decisions"])


@query("""WITH w AS (SELECT o_custkey AS owner, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-02' AND o_orderdate < TIMESTAMP '1998-03-09')
 SELECT owner, list(o_orderkey ORDER BY o_orderkey) AS documents, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O'), []) AS decisions,
  (SELECT list(t ORDER BY n DESC, t)[1:3] FROM (SELECT o_orderpriority AS t, count(*) AS n FROM w x WHERE x.owner = w.owner GROUP BY 1)) AS topics FROM w GROUP BY owner""")
def weekly_contexts(spark, d):
    """For each customer of a week: its orders, those that are open, and the commonest priorities."""
    w = load(spark, d, "orders").where(_between("o_orderdate", "1998-03-02", "1998-03-09")).withColumnRenamed("o_custkey", "owner")
    docs = w.select("owner", F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("place"))
    waiting = w.where("o_orderstatus = 'O'").select("owner", F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("place"))
    topics = w.groupBy("owner", F.col("o_orderpriority").alias("item")).agg((-F.count(F.lit(1))).alias("place"))
    return X.assembled("owner", {"documents": (docs, None), "decisions": (waiting, None), "topics": (topics, 3)}, needed=["documents"])


@query("SELECT o_custkey AS owner, list(o_orderstatus || '=' || n ORDER BY o_orderstatus) AS status, sum(n)::BIGINT AS n, sum(changed)::BIGINT AS changed FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS changed FROM orders GROUP BY 1, 2) GROUP BY 1")
def quarterly_contexts(spark, d):
    """Orders of each customer by state, as a review of a quarter shows them, and how many changed since its start."""
    g = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).alias("changed"))
    pairs = F.array_sort(F.collect_list(F.struct("o_orderstatus", "n")))
    return g.groupBy("owner").agg(F.transform(pairs, lambda p: F.concat(p["o_orderstatus"], F.lit("="), p["n"].cast("string"))).alias("status"), F.sum("n").alias("n"), F.sum("changed").alias("changed"))


@query("""SELECT p_partkey, 'Topic' AS label, arg_max(name, (last_seen, name)) AS name, min(first_seen) AS first_seen, max(last_seen) AS last_seen, sum(mentions)::BIGINT AS mentions, bool_and(created) AS created FROM (
 SELECT l_partkey AS p_partkey, 'old' || l_partkey AS name, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS mentions, false AS created FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01' GROUP BY 1
 UNION ALL SELECT l_partkey, 'new' || l_partkey, min(l_shipdate), max(l_shipdate), count(*), true FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-06-01' GROUP BY 1) GROUP BY 1""")
def node_merges(spark, d):
    line, cut = load(spark, d, "lineitem"), F.lit("1996-06-01").cast("timestamp")
    nodes = lambda df, name: df.groupBy(F.col("l_partkey").alias("p_partkey"), F.lit("Topic").alias("label")).agg(F.concat(F.lit(name), F.first("l_partkey").cast("string")).alias("name"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.count(F.lit(1)).alias("mentions"))
    return G.merged_nodes(nodes(line.where(F.col("l_shipdate") < cut), "old"), nodes(line.where(F.col("l_shipdate") >= cut), "new"), ["p_partkey", "label"])


@query("""SELECT 'n/' || o_orderkey AS path, CASE o_orderkey % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'created' ELSE 'modified' END AS change, NULL::VARCHAR AS moved_from FROM orders WHERE o_orderkey % 10 < 3 UNION ALL SELECT 'moved/' || o_orderkey, 'moved', 'n/' || o_orderkey FROM orders WHERE o_orderkey % 10 = 3""")
def file_changes(spark, d):
    """Two listings of files made from orders: some are gone, new, changed or at another path."""
    k = F.col("o_orderkey")
    o, path, content = load(spark, d, "orders"), F.concat(F.lit("n/"), k.cast("string")), F.sha2(k.cast("string"), 256)
    old = o.where("o_orderkey % 10 != 1").select(path.alias("path"), content.alias("hash"))
    now = F.when(k % 10 == 3, F.concat(F.lit("moved/"), k.cast("string"))).otherwise(path)
    new = o.where("o_orderkey % 10 != 0").select(now.alias("path"), F.when(k % 10 == 2, F.lit("changed")).otherwise(content).alias("hash"))
    return I.file_changes(old, new)


@query("""SELECT o_custkey, o_orderpriority, k AS v FROM (SELECT o_custkey, o_orderpriority, coalesce(max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1), max(o_orderkey)) AS k FROM orders GROUP BY 1, 2) JOIN orders o USING (o_custkey, o_orderpriority) WHERE o.o_orderkey = k AND (k % 3 = 0 OR o_orderdate > TIMESTAMP '1997-01-01')""")
def saved_briefings(spark, d):
    """Briefings of each customer and kind: those with even keys are stored, the last of each with odd keys replaces it, and what has expired goes."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("v"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("expires_at"))
    old = o.where("v % 2 = 0").groupBy("o_custkey", "o_orderpriority").agg(F.max_by(F.struct("v", "expires_at"), "v").alias("r")).select("o_custkey", "o_orderpriority", "r.v", "r.expires_at")
    return I.without_expired(old, o.where("v % 2 = 1"), ["o_custkey", "o_orderpriority"], "expires_at", F.lit("1997-01-01").cast("timestamp"), "v").select("o_custkey", "o_orderpriority", "v")
