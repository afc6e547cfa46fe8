"""Statements of generated texts checked against their sources: by title, and by the nearest source vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C


def statements(text: Column) -> Column:
    """Lines; headings, rules and bullets whole, other lines cut into sentences before a capital letter, blank lines empty."""
    whole = lambda x: F.trim(x).startswith("#") | F.trim(x).startswith("---") | x.rlike(r"^\s*[-•*]\s+")
    cut = lambda x: F.split(F.trim(x), r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])")
    return F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) == "", F.array(F.lit(""))).when(whole(x), F.array(x)).otherwise(cut(x))))


def _grams(text: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))


def containing(parts: DataFrame, wholes: DataFrame, by: str) -> DataFrame:
    """(by, t, w): each part (by, t) with the wholes (by, w) of its group that contain it. They meet by the part's rarest three characters (all of it, if it has fewer)
    among those of the group's wholes, so that common ones pair nothing. Empty parts meet nothing."""
    w = wholes.select(by, "w").where("w != ''").distinct()
    sizes = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: n <= F.length("w"))
    held = w.select(by, "w", F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda n: _grams(F.col("w"), n))))).alias("g"))
    counts = held.groupBy(by, "g").agg(F.count(F.lit(1)).alias("n"))
    own = parts.select(by, "t").where("t != ''").distinct().select(by, "t", F.explode(F.array_distinct(_grams(F.col("t"), F.least(F.length("t"), F.lit(3))))).alias("g"))
    rarest = own.join(counts, [by, "g"], "left").groupBy(by, "t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).select(by, "t", F.col("r.g").alias("g"))
    return rarest.join(held, [by, "g"]).where(F.contains("w", F.col("t"))).select(by, "t", "w")


def grounded(texts: DataFrame, key: str, text: str, titles: DataFrame, owner: str, remove_invalid: bool = True, mark: str = "") -> DataFrame:
    """(key, position, statement, n_valid, n_invalid, confidence, cleaned): a reference is valid if its title equals, contains or is contained in a known title
    of the owner (titles: owner, title); an owner without titles has all valid. High with a valid reference or for structure, medium with
    invalid ones only, else low. Titles meet the references of their owner, not texts, by equality or by their rarest characters."""
    s = texts.select(key, owner, F.posexplode(statements(F.col(text))).alias("position", "statement")).withColumn("refs", C.citations(F.col("statement")))
    refs = s.select(owner, F.explode("refs").alias("r")).select(owner, F.lower(F.col("r.title")).alias("t")).distinct()
    known = titles.select(owner, F.trim(F.lower("title")).alias("t")).distinct()
    equal = refs.join(known, [owner, "t"], "left_semi")
    within = containing(refs, known.withColumnRenamed("t", "w"), owner).select(owner, "t")
    around = containing(known, refs.withColumnRenamed("t", "w"), owner).select(owner, F.col("w").alias("t"))
    empty = refs.where("t = ''").join(known, owner, "left_semi").unionByName(refs.join(known.where("t = ''"), owner, "left_semi"))
    good = equal.unionByName(within).unionByName(around).unionByName(empty)
    known = known.withColumnRenamed(owner, "_o")
    free = refs.join(known.select(F.col("_o").alias(owner)).distinct(), owner, "left_anti")
    valid = good.unionByName(free).groupBy(owner).agg(F.collect_set("t").alias("valid"))
    j = s.join(valid, owner, "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<string>")))
    ok = lambda r: F.array_contains("valid", F.lower(r["title"]))
    n_valid, n_bad = F.size(F.filter("refs", ok)), F.size(F.filter("refs", lambda r: ~ok(r)))
    structural = F.trim("statement").startswith("#") | F.trim("statement").startswith("---") | (F.trim("statement") == "")
    j = j.withColumn("n_valid", n_valid).withColumn("n_invalid", n_bad)
    j = j.withColumn("confidence", F.when(F.col("n_valid") > 0, "high").when(F.col("n_invalid") > 0, "medium").when(structural, "high").otherwise("low"))
    bad = F.filter("refs", lambda r: ~ok(r))
    cleaned = F.aggregate(bad, F.col("statement"), lambda acc, r: F.replace(acc, r["raw"], F.lit(""))) if remove_invalid else F.col("statement")
    if mark:
        cleaned = F.when(F.col("confidence") == "low", F.concat(F.rtrim(cleaned), F.lit(mark))).otherwise(cleaned)
    return j.select(key, "position", "statement", "n_valid", "n_invalid", "confidence", cleaned.alias("cleaned"))


def without_references(text: Column, invalid: Column, flag: str | None = None) -> Column:
    """The text without the references of `invalid` (an array of their raw forms), or with each flagged; blanks are squeezed."""
    by = lambda raw: F.lit("") if flag is None else F.concat(raw, F.lit(" " + flag))
    return F.trim(F.regexp_replace(F.aggregate(F.array_distinct(invalid), text, lambda acc, raw: F.replace(acc, raw, by(raw))), "  +", " "))


def nearest_sources(sentences: DataFrame, chunks: DataFrame, by: str, high: float = 0.7, medium: float = 0.5) -> DataFrame:
    """(by, sentence, chunk, confidence, level): the most similar chunk of each sentence among the sources of its text. sentences: (by, sentence,
    vector); chunks: (by, chunk, vector). A text has few of both. Similarities below 0 count as 0, with the first chunk."""
    c = chunks.select(by, "chunk", F.col("vector").alias("_v"))
    near = sentences.join(c, by).withColumn("s", F.greatest(F.lit(0.0), C.cosine(F.col("vector"), F.col("_v"))))
    best = near.groupBy(by, "sentence").agg(F.min(F.struct((-F.col("s")).alias("s"), "chunk")).alias("b"))
    s = F.round(-F.col("b.s"), 6)
    return best.select(by, "sentence", F.col("b.chunk").alias("chunk"), s.alias("confidence"), F.when(s > high, "high").when(s >= medium, "medium").otherwise("low").alias("level"))


def quality(scored: DataFrame, by: str, most_low: float = 0.3) -> DataFrame:
    """(by, n, overall, low_ratio, is_valid) of each text."""
    g = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("overall"), F.round(F.avg((F.col("level") == "low").cast("int")), 6).alias("low_ratio"))
    return g.withColumn("is_valid", F.col("low_ratio") <= most_low)
