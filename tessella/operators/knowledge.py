"""Patterns and histories of a graph of typed nodes and edges, snapshots of it, and selections of insights.

nodes: (id, label, name, first_seen, last_seen, mentions); links: (id, doc), a node with a document, in either direction; documents: (doc, title,
source, at). Optional branches are aggregated before they are joined, so that they never multiply each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import graph as G

#: Thresholds of the patterns and how many of each are given.
MIN_CONTEXTS, MIN_DOCUMENTS, MOST_PATTERNS = 3, 2, 20
#: Kinds of patterns and the category of insights each belongs to.
CATEGORIES = {"recurring_theme": "trends", "changing_assumption": "contradictions", "unresolved_question": "connections"}
#: The type of an edge between nodes of two labels, whichever comes first.
EDGE_TYPES = {
    ("Person", "Meeting"): "PARTICIPATED_IN", ("Person", "Project"): "WORKS_ON", ("Document", "Person"): "MENTIONS", ("Project", "Topic"): "HAS_TOPIC", ("Decision", "Project"): "AFFECTS",
    ("Meeting", "Decision"): "PRODUCED", ("Meeting", "Topic"): "DISCUSSED", ("Meeting", "Project"): "RELATES_TO", ("Document", "Topic"): "COVERS", ("Document", "Project"): "REFERENCES",
}


def edge_type(a: Column, b: Column) -> Column:
    """Null for a pair of labels that has none."""
    pair = lambda x, y: F.concat_ws("|", F.least(x, y), F.greatest(x, y))
    return F.create_map(*(F.lit(v) for k, t in EDGE_TYPES.items() for v in ("|".join(sorted(k)), t)))[pair(a, b)]


def typed_edges(pairs: DataFrame, labels: DataFrame, as_of: Column, least: float = 0.05) -> DataFrame:
    """Weighted pairs (a, b, n, last) with the type of their labels (id, label); pairs without a type, or below the least weight, go."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("label_a")), labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
    typed = pairs.join(la, "a").join(lb, "b").withColumn("edge_type", edge_type(F.col("label_a"), F.col("label_b"))).where(F.col("edge_type").isNotNull())
    return G.weighted(typed, as_of, least)


def contexts(nodes: DataFrame, links: DataFrame, documents: DataFrame, least: int) -> DataFrame:
    """Nodes with the distinct documents they are linked with, if at least so many: context_count and sources, in order of documents."""
    held = links.select("id", "doc").distinct().join(documents, "doc")
    source = F.struct("doc", "title", F.coalesce("source", F.lit("unknown")).alias("source"), "at")
    found = held.groupBy("id").agg(F.count(F.lit(1)).alias("context_count"), F.array_sort(F.collect_list(source)).alias("sources")).where(F.col("context_count") >= least)
    return nodes.join(found, "id").select("id", "name", "context_count", "first_seen", "last_seen", "sources")


def recurring_themes(nodes: DataFrame, links: DataFrame, documents: DataFrame, since: Column, least: int = MIN_CONTEXTS, most: int = MOST_PATTERNS) -> DataFrame:
    """Topics in at least so many documents since then."""
    return contexts(nodes.where("label = 'Topic'"), links, documents.where(F.col("at") >= since), least).orderBy(F.desc("context_count"), "id").limit(most)


def changing_assumptions(nodes: DataFrame, links: DataFrame, documents: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """Hypotheses seen again after their first time, in two documents or more, the last seen first."""
    return contexts(nodes.where("label = 'Hypothesis' AND last_seen > first_seen"), links, documents, MIN_DOCUMENTS).orderBy(F.desc("last_seen"), "id").limit(most)


def unresolved_questions(nodes: DataFrame, links: DataFrame, documents: DataFrame, least: int = MIN_DOCUMENTS, most: int = MOST_PATTERNS) -> DataFrame:
    return contexts(nodes.where("label = 'OpenQuestion'"), links, documents, least).orderBy(F.desc("context_count"), "id").limit(most)


def all_patterns(nodes: DataFrame, links: DataFrame, documents: DataFrame, since: Column) -> DataFrame:
    """The three kinds of patterns in one list, those with most documents first."""
    kinds = {"recurring_theme": recurring_themes(nodes, links, documents, since), "changing_assumption": changing_assumptions(nodes, links, documents), "unresolved_question": unresolved_questions(nodes, links, documents)}
    one, two, three = (p.withColumn("kind", F.lit(k)) for k, p in kinds.items())
    return one.unionByName(two).unionByName(three).orderBy(F.desc("context_count"), "kind", "id")


def insights(patterns: DataFrame, rated: DataFrame, enabled: list[str] | None = None, least: int = 2, most: int = 5) -> DataFrame:
    """Patterns of enabled categories with enough contexts, without those about entities rated unhelpful (id), the first `most`."""
    category = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))[F.col("kind")]
    p = patterns.withColumn("category", category).where(F.col("category").isin(*(enabled or set(CATEGORIES.values()))) & (F.col("context_count") >= least))
    return p.join(rated.select("id"), "id", "left_anti").orderBy(F.desc("context_count"), "kind", "id").limit(most)


def branch(nodes: DataFrame, edges: DataFrame, edge_types: list[str], other: DataFrame, name: str, most: int) -> DataFrame:
    """(id, name): up to `most` different names of what each node is linked to by edges (src, dst, edge_type), in order."""
    linked = edges.where(F.col("edge_type").isin(*edge_types)).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    names = linked.join(other.select(F.col("id").alias("dst"), F.col("name").alias("_n")), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("_n").alias("_s"))
    return names.select("id", F.slice(F.array_sort("_s"), 1, most).alias(name))


def histories(people: DataFrame, edges: DataFrame, meetings: DataFrame, projects: DataFrame, questions: DataFrame) -> DataFrame:
    """(name, meetings, projects, open_items) of people (id, name): at most three meetings, three projects and two open items each; none is empty."""
    out = people.select("id", "name")
    for types, other, name, most in ((["PARTICIPATED_IN"], meetings, "meetings", 3), (["WORKS_ON"], projects, "projects", 3), (["MENTIONED_IN"], questions, "open_items", 2)):
        out = out.join(branch(people, edges, types, other, name, most), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select("name", "meetings", "projects", "open_items")


def of_project(projects: DataFrame, part_of_name: str, edges: DataFrame, edge_types: list[str], others: DataFrame) -> DataFrame:
    """What is linked to projects whose name contains the text, whatever its case: (project, id, ...), each once."""
    chosen = projects.where(F.contains(F.lower("name"), F.lit(part_of_name.lower()))).select(F.col("id").alias("dst"), F.col("name").alias("project"))
    return edges.where(F.col("edge_type").isin(*edge_types)).join(chosen, "dst").select(F.col("src").alias("id"), "project").distinct().join(others, "id")


def week_activity(projects: DataFrame, documents: DataFrame, decisions: DataFrame, most: int = 10) -> DataFrame:
    """(name, document_count, decision_count) of projects with documents: documents (project, doc) and decisions (project, decision) of the week, each counted
    on its own before they meet."""
    d = documents.groupBy("project").agg(F.countDistinct("doc").alias("document_count"))
    e = decisions.groupBy("project").agg(F.countDistinct("decision").alias("decision_count"))
    j = projects.select(F.col("id").alias("project"), "name").join(d, "project").join(e, "project", "left")
    return j.select("project", "name", "document_count", F.coalesce("decision_count", F.lit(0)).alias("decision_count")).orderBy(F.desc("document_count"), "project").limit(most)


def snapshot(entities: DataFrame, mentions: DataFrame, most_edges: int = 500, themes: int = 10) -> DataFrame:
    """One row: (entity_count, relationship_count, entities, relationships, top_themes). entities (id, name, kind, mentions) are the ones that an owner has;
    mentions: (id, chunk). Of pairs in one chunk the strongest are kept. All lists are in order. A snapshot is one owner's, whose entities fit a row."""
    m = mentions.join(entities.select("id"), "id", "left_semi")
    edges = G.co_occurrences(m, "chunk", "id").select("a", "b", "n").orderBy(F.desc("n"), "a", "b").limit(most_edges)
    ordered = lambda c, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: x["v"])
    e = entities.agg(F.count(F.lit(1)).alias("entity_count"), ordered(F.struct("id", "name", "kind", "mentions").alias("v"), (-F.col("mentions")).alias("o"), "id").alias("entities"))
    r = edges.agg(F.count(F.lit(1)).alias("relationship_count"), ordered(F.struct("a", "b", F.lit("co_mentioned").alias("kind"), "n").alias("v"), (-F.col("n")).alias("o"), "a", "b").alias("relationships"))
    both = e.join(F.broadcast(r), F.lit(True))
    return both.withColumn("top_themes", F.transform(F.slice("entities", 1, themes), lambda x: F.struct(x["name"].alias("name"), x["mentions"].alias("mentions"))))


def compared(old: DataFrame, new: DataFrame, most: int = 5) -> DataFrame:
    """One row about two snapshots: counts of added and removed entities and relationships, and the entities whose mentions changed most."""
    both = old.select(*(F.col(c).alias(f"o_{c}") for c in ("entities", "relationships"))).join(F.broadcast(new.select(*(F.col(c).alias(f"n_{c}") for c in ("entities", "relationships")))), F.lit(True))
    ids = lambda c: F.transform(c, lambda e: e["id"])
    keys = lambda c: F.transform(c, lambda r: F.concat_ws(":", r["a"], r["b"]))
    left = lambda f, a, b: F.size(F.array_except(f(F.col(a)), f(F.col(b)))).cast("long")
    before = F.map_from_entries(F.transform("o_entities", lambda e: F.struct(e["id"], e["mentions"])))
    shift = F.transform(F.filter("n_entities", lambda e: before[e["id"]].isNotNull() & (before[e["id"]] != e["mentions"])), lambda e: F.struct((-F.abs(e["mentions"] - before[e["id"]])).alias("o"), e["id"].alias("id"), e["name"].alias("name"), before[e["id"]].alias("old_count"), e["mentions"].alias("new_count"), (e["mentions"] - before[e["id"]]).alias("delta")))
    return both.select(
        left(ids, "n_entities", "o_entities").alias("entities_added"), left(ids, "o_entities", "n_entities").alias("entities_removed"),
        left(keys, "n_relationships", "o_relationships").alias("relationships_added"), left(keys, "o_relationships", "n_relationships").alias("relationships_removed"),
        F.transform(F.slice(F.array_sort(shift), 1, most), lambda x: F.struct(x["name"].alias("name"), x["old_count"].alias("old_count"), x["new_count"].alias("new_count"), x["delta"].alias("delta"))).alias("theme_shifts"),
    )
