"""Queries over a graph that the order tables make: parts are topics, hypotheses and open questions, orders are documents, customers persons, suppliers projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import context as X
from tessella.operators import graph as G
from tessella.operators import knowledge as K
from tessella.registry import query
from tessella.sources.tables import load

_GRAPH = """WITH line AS (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_partkey < 300), nodes AS (SELECT p_partkey AS id, ['Topic', 'Hypothesis', 'OpenQuestion'][(p_partkey % 3 + 1)::INT] AS label, p_name AS name, a AS first_seen, z AS last_seen FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_partkey < 300),
 docs AS (SELECT o_orderkey AS doc, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE o_orderpriority END AS source, o_orderdate AS made FROM orders),
 held AS (SELECT DISTINCT l_partkey AS id, l_orderkey AS doc FROM line)"""
_COUNTED = "SELECT n.id, n.name, count(*) AS context_count, n.first_seen, n.last_seen, list(doc ORDER BY doc) AS sources FROM nodes n JOIN held USING (id) JOIN docs USING (doc) WHERE {where} GROUP BY ALL HAVING count(*) >= {least} ORDER BY {order} LIMIT 20"
_THEMES = _COUNTED.format(where="label = 'Topic' AND made >= TIMESTAMP '1998-06-01'", least=3, order="context_count DESC, id")
_ASSUMPTIONS = _COUNTED.format(where="label = 'Hypothesis' AND last_seen > first_seen", least=2, order="last_seen DESC, id")
_QUESTIONS = _COUNTED.format(where="label = 'OpenQuestion'", least=2, order="context_count DESC, id")


def _graph(spark, d):
    line = load(spark, d, "lineitem").where("l_partkey < 300")
    seen = line.groupBy("l_partkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    label = F.get(F.array(*map(F.lit, ("Topic", "Hypothesis", "OpenQuestion"))), (F.col("p_partkey") % 3).cast("int"))
    nodes = load(spark, d, "part").join(seen, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("id"), label.alias("label"), F.col("p_name").alias("name"), "first_seen", "last_seen")
    docs = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("source"), F.col("o_orderdate").alias("at"))
    return nodes, line.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("doc")), docs


def _ids(patterns):
    return patterns.withColumn("sources", F.transform("sources", lambda s: s["doc"]))


@query(f"{_GRAPH} {_THEMES}")
def pattern_themes(spark, d):
    """Topics in three or more documents since a day."""
    return _ids(K.recurring_themes(*_graph(spark, d), F.lit("1998-06-01").cast("timestamp")))


@query(f"{_GRAPH} {_ASSUMPTIONS}")
def pattern_assumptions(spark, d):
    return _ids(K.changing_assumptions(*_graph(spark, d)))


@query(f"{_GRAPH} {_QUESTIONS}")
def pattern_questions(spark, d):
    return _ids(K.unresolved_questions(*_graph(spark, d)))


_ALL = f"SELECT *, 'recurring_theme' AS kind FROM ({_THEMES}) UNION ALL SELECT *, 'changing_assumption' FROM ({_ASSUMPTIONS}) UNION ALL SELECT *, 'unresolved_question' FROM ({_QUESTIONS})"


@query(f"{_GRAPH} {_ALL}")
def pattern_list(spark, d):
    """All three kinds in one list."""
    return _ids(K.all_patterns(*_graph(spark, d), F.lit("1998-06-01").cast("timestamp")))


@query(f"{_GRAPH} SELECT *, CASE kind WHEN 'recurring_theme' THEN 'trends' ELSE 'contradictions' END AS category FROM ({_ALL}) WHERE kind <> 'unresolved_question' AND context_count >= 4 AND id NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) ORDER BY context_count DESC, kind, id LIMIT 5")
def insight_selection(spark, d):
    """The patterns of two categories with four documents or more, without parts of small size, which are taken to be rated unhelpful."""
    rated = load(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return K.insights(pattern_list(spark, d), rated, ["trends", "contradictions"], least=4)


@query("""SELECT c_custkey AS id, c_name AS name, coalesce((SELECT list_sort(list(DISTINCT 'Meeting ' || o_orderkey))[1:3] FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0), []) AS meetings,
 coalesce((SELECT list_sort(list(DISTINCT s_name))[1:3] FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_custkey = c_custkey AND o_orderkey % 2 = 0), []) AS projects,
 coalesce((SELECT list_sort(list(DISTINCT p_name))[1:2] FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0), []) AS open_items FROM customer WHERE c_mktsegment = 'BUILDING'""")
def participant_histories(spark, d):
    """Customers of a segment with their meetings, projects and open questions, a few of each."""
    o, line, text = load(spark, d, "orders"), load(spark, d, "lineitem"), lambda c: F.col(c).cast("string")
    lines = line.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    edge = lambda df, dst, kind: df.select(F.concat(F.lit("c"), text("o_custkey")).alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))
    edges = (
        edge(o.where("o_orderkey % 2 = 0"), F.concat(F.lit("m"), text("o_orderkey")), "PARTICIPATED_IN")
        .unionByName(edge(lines.where("l_orderkey % 2 = 0"), F.concat(F.lit("s"), text("l_suppkey")), "WORKS_ON"))
        .unionByName(edge(lines.where("l_orderkey % 3 = 0"), F.concat(F.lit("p"), text("l_partkey")), "MENTIONED_IN"))
    )
    people = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), text("c_custkey")).alias("id"), F.col("c_name").alias("name"), "c_custkey")
    meetings = o.select(F.concat(F.lit("m"), text("o_orderkey")).alias("id"), F.concat(F.lit("Meeting "), text("o_orderkey")).alias("name"))
    projects = load(spark, d, "supplier").select(F.concat(F.lit("s"), text("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    questions = load(spark, d, "part").select(F.concat(F.lit("p"), text("p_partkey")).alias("id"), F.col("p_name").alias("name"))
    out = K.histories(people, edges, meetings, projects, questions)
    return people.select(F.col("c_custkey").alias("id"), "name").join(out, "name")


@query("SELECT DISTINCT o_orderkey AS id, s_name AS project, strftime(o_orderdate, '%Y-%m-%d') AS created, 'decision' AS kind FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE contains(lower(s_name), '00001') AND o_orderstatus <> 'F' UNION ALL SELECT DISTINCT l_partkey, s_name, NULL, 'document' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE contains(lower(s_name), '00001') AND l_quantity > 45")
def project_timeline(spark, d):
    """Decisions and documents of projects whose names contain a text, in one list."""
    line = load(spark, d, "lineitem")
    projects = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    edge = lambda df, src, kind: df.select(F.col(src).alias("src"), F.col("l_suppkey").alias("dst"), F.lit(kind).alias("edge_type"))
    edges = edge(line, "l_orderkey", "DECIDED_IN").unionByName(edge(line.where("l_quantity > 45"), "l_partkey", "MENTIONS"))
    decisions = load(spark, d, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))
    documents = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("created"))
    one = K.of_project(projects, "00001", edges, ["DECIDED_IN", "RELATES_TO"], decisions).withColumn("kind", F.lit("decision"))
    return one.unionByName(K.of_project(projects, "00001", edges, ["MENTIONS", "COVERS"], documents).withColumn("kind", F.lit("document")))


@query("""SELECT s_suppkey AS project, s_name AS name, count(DISTINCT l_orderkey) AS document_count, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS decision_count FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
 WHERE l_shipdate >= TIMESTAMP '1998-01-05' AND l_shipdate < TIMESTAMP '1998-01-12' GROUP BY ALL ORDER BY document_count DESC, project LIMIT 10""")
def week_projects(spark, d):
    t = F.col("l_shipdate")
    week = load(spark, d, "lineitem").where((t >= F.lit("1998-01-05").cast("timestamp")) & (t < F.lit("1998-01-12").cast("timestamp")))
    projects = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return K.week_activity(projects, week.select(F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("doc")), week.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("decision")))


@query("SELECT l_suppkey AS project, count(*) AS decisions, list_sort(list(l_partkey) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 48)) AS pending FROM lineitem GROUP BY 1")
def decisions_by_project(spark, d):
    """Decisions of each project, and the titles of those that wait."""
    waits = (F.col("l_returnflag") == "N") & (F.col("l_quantity") > 48)
    g = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("project")).agg(F.count(F.lit(1)).alias("decisions"), F.array_sort(F.collect_list(F.when(waits, F.col("l_partkey")))).alias("pending"))
    return g.withColumn("pending", F.when(F.size("pending") > 0, F.col("pending")))


_SNAPSHOT = """e{i} AS (SELECT l_partkey AS id, count(*) AS mentions FROM lineitem WHERE l_partkey < 60 AND l_orderkey % 3 {when} GROUP BY 1), r{i} AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE b.l_partkey < 60 AND a.l_orderkey % 3 {when} GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 500)"""


def _none_if_empty(x):
    return F.when(F.size(x) > 0, x)


def _snapshot(spark, d, when):
    """Every part that is mentioned, once: one listed twice has the least name, one not listed has none."""
    line = load(spark, d, "lineitem").where(f"l_partkey < 60 AND l_orderkey % 3 {when}")
    counts = line.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    parts = load(spark, d, "part").where("p_partkey < 60").groupBy(F.col("p_partkey").alias("id")).agg(F.min(F.struct(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("kind"))).alias("p"))
    named = counts.join(parts, "id", "left").select("id", "p.name", "p.kind", "mentions")
    return K.snapshot(named.select("id", "name", "kind", "mentions"), line.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("chunk")))


@query(f"WITH {_SNAPSHOT.format(i='', when='= 0')} SELECT (SELECT count(*) FROM e) AS entity_count, (SELECT count(*) FROM r) AS relationship_count, (SELECT list(id ORDER BY mentions DESC, id) FROM e) AS entities, (SELECT list(a || ':' || b || '=' || n ORDER BY n DESC, a, b) FROM r) AS relationships, (SELECT list(mentions ORDER BY mentions DESC, id)[1:10] FROM e) AS themes")
def snapshot_capture(spark, d):
    """Some parts with their mentions in a third of the orders, and the pairs in one order; a list without entries is null."""
    s = _snapshot(spark, d, "= 0")
    edge = F.transform("relationships", lambda r: F.concat(r["a"].cast("string"), F.lit(":"), r["b"].cast("string"), F.lit("="), r["n"].cast("string")))
    lists = {"entities": F.transform("entities", lambda e: e["id"]), "relationships": edge, "themes": F.transform("top_themes", lambda t: t["mentions"])}
    return s.select("entity_count", "relationship_count", *(_none_if_empty(x).alias(n) for n, x in lists.items()))


@query(f"""WITH {_SNAPSHOT.format(i='1', when='= 0 AND l_orderkey % 2 = 0').replace('a.l_orderkey % 3 = 0 AND l_orderkey', 'a.l_orderkey % 3 = 0 AND a.l_orderkey')}, {_SNAPSHOT.format(i='2', when='<> 1')},
 s AS (SELECT p_name || ' ' || id AS name, e1.mentions AS old, e2.mentions AS new, id FROM e1 JOIN e2 USING (id) JOIN part ON p_partkey = id WHERE e1.mentions <> e2.mentions ORDER BY abs(e2.mentions - e1.mentions) DESC, id LIMIT 5)
 SELECT (SELECT count(*) FROM e2 WHERE id NOT IN (SELECT id FROM e1)) AS entities_added, (SELECT count(*) FROM e1 WHERE id NOT IN (SELECT id FROM e2)) AS entities_removed, (SELECT count(*) FROM r2 ANTI JOIN r1 USING (a, b)) AS relationships_added, (SELECT count(*) FROM r1 ANTI JOIN r2 USING (a, b)) AS relationships_removed,
  (SELECT list(name || ' ' || old || ' ' || new ORDER BY abs(new - old) DESC, id) FROM s) AS theme_shifts""")
def snapshot_comparison(spark, d):
    """Two snapshots compared: what came, what went, and whose mentions changed most."""
    out = K.compared(_snapshot(spark, d, "= 0 AND l_orderkey % 2 = 0"), _snapshot(spark, d, "<> 1"))
    return out.withColumn("theme_shifts", _none_if_empty(F.transform("theme_shifts", lambda t: F.concat_ws(" ", t["name"], t["old_count"].cast("string"), t["new_count"].cast("string")))))


_PAIRS = "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n, max(greatest(a.l_shipdate, b.l_shipdate)) AS last FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE a.l_quantity > 45 AND b.l_quantity > 45 GROUP BY 1, 2"
_LABEL = "['Person', 'Meeting', 'Project', 'Hypothesis'][({0} % 4 + 1)::INT]"


@query(f"""SELECT a, b, n, edge_type, weight FROM (SELECT a, b, n, CASE WHEN least({_LABEL.format('a')}, {_LABEL.format('b')}) = 'Meeting' AND greatest({_LABEL.format('a')}, {_LABEL.format('b')}) = 'Person' THEN 'PARTICIPATED_IN' WHEN least({_LABEL.format('a')}, {_LABEL.format('b')}) = 'Person' AND greatest({_LABEL.format('a')}, {_LABEL.format('b')}) = 'Project' THEN 'WORKS_ON'
 WHEN least({_LABEL.format('a')}, {_LABEL.format('b')}) = 'Meeting' AND greatest({_LABEL.format('a')}, {_LABEL.format('b')}) = 'Project' THEN 'RELATES_TO' END AS edge_type, round(least(greatest(0.3 * exp(-0.01 * date_diff('day', last::DATE, DATE '2002-01-01')) + 0.1 * (n - 1), 0), 1), 6) AS weight FROM ({_PAIRS})) WHERE edge_type IS NOT NULL AND weight >= 0.05""")
def typed_edges(spark, d):
    """Pairs of suppliers in few orders: labels by key, types by labels, and old single pairs below the least weight."""
    pairs = G.co_occurrences(load(spark, d, "lineitem").where("l_quantity > 45"), "l_orderkey", "l_suppkey", "l_shipdate")
    label = F.get(F.array(*map(F.lit, ("Person", "Meeting", "Project", "Hypothesis"))), (F.col("s_suppkey") % 4).cast("int"))
    labels = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), label.alias("label"))
    return K.typed_edges(pairs, labels, F.lit("2002-01-01").cast("date")).select("a", "b", "n", "edge_type", "weight")


_ITEMS = """i AS (SELECT c_custkey AS k, s, p, t FROM (SELECT c_custkey, 'events' AS s, 0 AS p, 40 AS t FROM customer UNION ALL SELECT o_custkey, 'documents', (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT, 30 + (o_orderkey % 50)::INT FROM orders
 UNION ALL SELECT o_custkey, 'patterns', (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT, 25 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, 'decisions', (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT, 45 FROM orders WHERE o_orderstatus = 'O'))"""


@query(f"""WITH {_ITEMS}, o AS (SELECT *, sum(t) OVER (PARTITION BY k ORDER BY CASE s WHEN 'events' THEN 0 WHEN 'decisions' THEN 1 WHEN 'patterns' THEN 2 ELSE 3 END, p) AS run FROM i)
 SELECT k AS owner, s AS section, count(*) AS kept, sum(t)::BIGINT AS tokens FROM o WHERE s = 'events' OR run <= 400 GROUP BY ALL""")
def context_sections(spark, d):
    """Sections of each customer's context cut to 400 tokens: documents go first, then patterns, then decisions; events never."""
    items = _items(spark, d)
    kept = X.within_budget(items, "owner", "section", "position", "tokens", 400, ["events", "decisions", "patterns", "documents"], always=["events"])
    return kept.groupBy("owner", "section").agg(F.count(F.lit(1)).alias("kept"), F.sum("tokens").alias("tokens"))


def _items(spark, d):
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "owner")
    place = lambda df, name, tokens: X.placed(df, "owner", "o_orderkey").select("owner", F.lit(name).alias("section"), "position", tokens.cast("int").alias("tokens"))
    events = load(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.lit("events").alias("section"), F.lit(0).alias("position"), F.lit(40).alias("tokens"))
    return (
        events.unionByName(place(o, "documents", 30 + F.col("o_orderkey") % 50)).unionByName(place(o.where("o_orderkey % 3 = 0"), "patterns", F.lit(25))).unionByName(place(o.where("o_orderstatus = 'O'"), "decisions", F.lit(45)))
    )


@query("""WITH ev AS (SELECT o_custkey AS owner, list(o_orderkey ORDER BY o_orderkey) AS events FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-02' AND o_orderdate < TIMESTAMP '1998-03-09' GROUP BY 1),
 doc AS (SELECT o_custkey AS owner, list(l_partkey ORDER BY n DESC, l_partkey)[1:5] AS documents FROM (SELECT o_custkey, l_partkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1),
 dec AS (SELECT o_custkey AS owner, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3] AS decisions FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
 SELECT owner, events, documents, coalesce(decisions, []) AS decisions FROM ev JOIN doc USING (owner) LEFT JOIN dec USING (owner)""")
def morning_contexts(spark, d):
    """For each customer with orders in a week: these, the parts that it orders most, and its oldest open orders."""
    o, t = load(spark, d, "orders").withColumnRenamed("o_custkey", "owner"), F.col("o_orderdate")
    events = o.where((t >= F.lit("1998-03-02").cast("timestamp")) & (t < F.lit("1998-03-09").cast("timestamp"))).select("owner", F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("place"))
    bought = load(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "owner"), "l_orderkey").groupBy("owner", "l_partkey").agg((-F.count(F.lit(1))).alias("place")).withColumnRenamed("l_partkey", "item")
    decisions = o.where("o_orderstatus = 'O'").select("owner", F.col("o_orderkey").alias("item"), F.unix_timestamp("o_orderdate").alias("place"))
    return X.assembled("owner", {"events": (events, None), "documents": (bought, 5), "decisions": (decisions, 3)}, needed=["events", "documents"])
