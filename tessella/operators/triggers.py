"""Workflow rules against documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(rule, kind, keywords, match_all, sources) of each rule; kinds are new_document, keyword_match and schedule."""
    return spark.createDataFrame(rows, "rule string, kind string, keywords array<string>, match_all boolean, sources array<string>")


def triggered(events: DataFrame, rules: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """(rule, key) for each rule that an event (key, title, content, source, event_type) sets off. Rules are settings, at most `most`, and travel as
    constants with one scan of the events: a new document of any or of given sources, any or all keywords whatever their case (none, never), or a
    schedule's own event. Works on batches and streams alike."""
    found = rules.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules")
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))

    def condition(r):
        if r.kind == "new_document":
            return F.lit(True) if r.sources is None else F.coalesce("source", F.lit("")).isin(r.sources)
        if r.kind == "keyword_match":
            held = [F.contains(F.col("_text"), F.lit(k.lower())) for k in r.keywords or []]
            out = F.lit(bool(held) and bool(r.match_all))
            for h in held:
                out = out & h if r.match_all else out | h
            return out
        return F.col("event_type") == "schedule"

    names = F.array_compact(F.array(*(F.when(condition(r), F.lit(r.rule)) for r in found))) if found else F.array().cast("array<string>")
    return events.withColumn("_text", text).select(F.explode(names).alias("rule"), key)
