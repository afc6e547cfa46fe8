"""What stands around search hits: documents' data, addresses, filters, owners' rights, caches and order by themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import columns as C

#: Sources that are known, the one that stands for unknown ones, and addresses of those that have any.
SOURCES = ("google_calendar", "notion", "zoom", "obsidian", "gmail", "slack", "google_docs", "outlook_mail")
UNKNOWN = "notion"
ADDRESSES = {"notion": "https://notion.so/{id}", "google_calendar": "https://calendar.google.com/calendar/event?eid={id}", "zoom": "https://zoom.us/rec/{id}"}
#: A cached answer is used from this similarity on, among so many newest ones.
SIMILAR, NEWEST = 0.95, 100


def address(source: Column, source_id: Column) -> Column:
    """Null where the source has no known address."""
    pattern = F.create_map(*(F.lit(x) for kv in ADDRESSES.items() for x in kv))[source]
    return F.replace(pattern, F.lit("{id}"), source_id)


def enriched(hits: DataFrame, chunks: DataFrame, documents: DataFrame, owner: Column) -> DataFrame:
    """Hits (chunk_id, score, rank, title, ...) of one owner with title, source, date, address and a relevance held between 0 and 1, in the order of rank.
    A hit without a chunk of the owner, or without its document, is left out. chunks: (chunk_id, doc_id, owner); documents:
    (doc_id, title, source, source_id, created_at). The few hits are joined first."""
    own = F.broadcast(hits).join(chunks.where(F.col("owner") == owner).select("chunk_id", "doc_id"), "chunk_id")
    d = documents.select("doc_id", F.col("title").alias("_title"), F.col("source").alias("_source"), "source_id", "created_at")
    j = own.join(d, "doc_id")
    return j.select(
        "rank", "chunk_id", "doc_id", F.coalesce(F.nullif("_title", F.lit("")), "title").alias("title"), F.when(F.col("_source").isin(*SOURCES), F.col("_source")).otherwise(UNKNOWN).alias("source"),
        "created_at", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("relevance"), address(F.col("_source"), F.col("source_id")).alias("url"),
    ).orderBy("rank")


def filtered(hits: DataFrame, sources: list[str] | None = None, since: Column | None = None, until: Column | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Hits by source and by date, both ends included; after the best have been chosen, so that fewer may stay. `excluded` ignores case."""
    if sources:
        hits = hits.where(F.col("source").isin(*sources))
    if since is not None:
        hits = hits.where(F.col("created_at") >= since)
    if until is not None:
        hits = hits.where(F.col("created_at") <= until)
    return hits.where(~F.lower("source").isin(*(x.lower() for x in excluded))) if excluded else hits


def permitted(rows: DataFrame, members: DataFrame, needed: str, rights: dict[str, list[str]]) -> DataFrame:
    """Rows (org_id, user_id, ...) of members (org_id, user_id, role) whose role has the right."""
    roles = [r for r, may in rights.items() if needed in may]
    return rows.join(members.where(F.col("role").isin(*roles)).select("org_id", "user_id"), ["org_id", "user_id"], "left_semi")


def by_themes(hits: DataFrame, themes: list[str], text: Column, order: str) -> DataFrame:
    """Hits that name a theme first, by how many, then the others, both else in their order."""
    low = F.lower(text)
    n = F.size(F.filter(F.array(*map(F.lit, themes)), lambda t: F.contains(low, t))) if themes else F.lit(0)
    return hits.withColumn("theme_hits", n).orderBy(F.desc("theme_hits"), order)


def resolved(lists: DataFrame, key: str, ids: str, documents: DataFrame, doc: str, step: float = 0.05) -> DataFrame:
    """(key, position, doc, ..., relevance): the documents of each list of ids in its order, falling by `step` a place from 1, not below 0; ids
    without a document are left out."""
    each = lists.select(key, F.posexplode(ids).alias("position", doc))
    return each.join(documents, doc).withColumn("relevance", F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("position") * step), 6))


def vector_hash(vector: Column) -> Column:
    """16 hex digits of the vector's values at four places."""
    return F.substring(F.sha2(F.array_join(F.transform(vector, lambda v: F.format_string("%.4f", v.cast("double"))), ","), 256), 1, 16)


def filter_hash(filters: Column) -> Column:
    """16 hex digits of a map of filters with its keys in order, `nf` without any."""
    entries = F.array_sort(F.map_entries(filters))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return F.when(filters.isNull() | (F.size(F.map_keys(filters)) == 0), "nf").otherwise(F.substring(F.sha2(text, 256), 1, 16))


def cached(asked: DataFrame, stored: DataFrame, scope: list[str], similar: float = SIMILAR, newest: int = NEWEST) -> DataFrame:
    """(ask_id, answer_id, similarity): the stored answer for each question of the same scope: one with the same vector hash, else the newest among the
    `newest` of its scope that is similar enough; null without. asked: (scope, ask_id, vector); stored: (scope, answer_id, at, vector)."""
    a = asked.withColumn("h", vector_hash(F.col("vector")))
    s = stored.withColumn("h", vector_hash(F.col("vector")))
    exact = s.groupBy(*scope, "h").agg(F.max_by("answer_id", F.struct("at", "answer_id")).alias("answer_id"))
    hit = a.join(exact, [*scope, "h"]).select("ask_id", "answer_id", F.lit(1.0).alias("similarity"))
    last = s.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("at"), F.desc("answer_id")))).where(F.col("_n") <= newest)
    rest = a.join(hit.select("ask_id"), "ask_id", "left_anti")
    near = rest.join(last.select(*scope, "answer_id", "_n", F.col("vector").alias("_v")), scope).withColumn("similarity", F.round(C.cosine(F.col("vector"), F.col("_v")), 6)).where(F.col("similarity") >= similar)
    slow = near.groupBy("ask_id").agg(F.min_by(F.struct("answer_id", "similarity"), "_n").alias("b")).select("ask_id", "b.answer_id", "b.similarity")
    return asked.select("ask_id").join(hit.unionByName(slow), "ask_id", "left")


def profiled(df: DataFrame, profile: str, profiles: DataFrame, default: str) -> DataFrame:
    """Rows with the columns of their profile (profiles: profile, ...), whatever its case; unknown or missing ones have those of the default profile."""
    known = profiles.select(F.lower(profile).alias("_known"), *(c for c in profiles.columns if c != profile))
    wanted = df.withColumn("_wanted", F.lower(F.col(profile))).join(known.select(F.col("_known").alias("_wanted"), F.lit(True).alias("_is")), "_wanted", "left")
    named = wanted.withColumn("_known", F.when(F.col("_is"), F.col("_wanted")).otherwise(F.lit(default.lower())))
    return named.join(known, "_known", "left").drop("_known", "_wanted", "_is")
