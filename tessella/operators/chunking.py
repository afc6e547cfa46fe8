"""Splitting of texts into windows and sentences, and breaks of coherence in sequences of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators.analytics import ranked_by_range


def fixed_windows(df: DataFrame, key: str, text: str, most: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of `most` blank-separated tokens that slide by `most - overlap` until one reaches the end: (key, chunk_index, n_tokens, chunk)."""
    step = most - overlap
    t = df.select(key, F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "").alias("t"))
    count = F.greatest(F.ceil((F.size("t") - most) / step) + 1, F.lit(1)).cast("int")
    at = t.select(key, "t", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    piece = F.slice("t", F.col("chunk_index") * step + 1, F.lit(most))
    return at.select(key, "chunk_index", F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("chunk"))


def sentences(df: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.col(text), r"[.!?\n]"), lambda x: F.trim(x)), lambda s: F.length(s) >= least)
    return df.select(key, F.posexplode(parts).alias("position", "sentence"))


def coherence_breaks(df: DataFrame, by: str, order: str, vector: str, sensitivity: float = 1.0, part: int = 4096) -> DataFrame:
    """Positions where the similarity to the vector before is below both its neighbours and below mean - sensitivity x deviation. A group is read in parts of
    `part` rows in order of a number; each part also has the two rows before it and the one after it."""
    ranked = ranked_by_range(df.select(by, order, vector), by, order, "_n")
    own, at = F.floor(F.col("_n") / part), F.pmod("_n", F.lit(part))
    parts = F.array(F.struct(own.alias("part"), F.lit(True).alias("own")), F.struct((own + 1).alias("part"), F.lit(False).alias("own")), F.struct((own - 1).alias("part"), F.lit(False).alias("own")))
    lent = F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | ((i == 1) & (at >= part - 2)) | ((i == 2) & (at == 0)), p)), lambda p: p.isNotNull())
    rows = ranked.withColumn("_p", F.explode(lent)).select(by, order, vector, "_n", "_p.part", "_p.own")
    w = Window.partitionBy(by, "part").orderBy("_n")
    sims = rows.withColumn("_before", F.lag(vector).over(w)).where(F.col("_before").isNotNull())
    sims = sims.select(by, order, "part", "own", "_n", F.round(C.cosine(F.col(vector), F.col("_before")), 6).alias("similarity"))
    low = F.avg("similarity") - sensitivity * F.coalesce(F.stddev_samp("similarity"), F.lit(0.0))
    limits = sims.where("own").groupBy(F.col(by).alias("_by")).agg(low.alias("_t"))
    marked = sims.withColumn("_l", F.lag("similarity").over(w)).withColumn("_r", F.lead("similarity").over(w)).join(limits, F.col(by).eqNullSafe(F.col("_by")))
    return marked.where(F.col("own") & (F.col("similarity") < F.col("_l")) & (F.col("similarity") < F.col("_r")) & (F.col("similarity") < F.col("_t"))).select(by, order, "similarity")


def theme_shifts(df: DataFrame, theme: str, at: str, middle: Column) -> DataFrame:
    """Counts before and from `middle`, and the direction: new, gone, up, down or steady."""
    g = df.groupBy(theme).agg(F.count_if(F.col(at) < middle).alias("previous"), F.count_if(F.col(at) >= middle).alias("current"))
    p, c = F.col("previous"), F.col("current")
    return g.withColumn("direction", F.when(p == 0, "new").when(c == 0, "gone").when(c > p, "up").when(c < p, "down").otherwise("steady"))
