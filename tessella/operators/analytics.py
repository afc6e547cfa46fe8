"""Aggregates, paging, status and usage analytics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 50) -> DataFrame:
    """A page of rows with the total and whether more follow; limits are held between 1 and `most`."""
    limit, offset = max(1, min(limit, most)), max(0, offset)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit)


def latest_per(df: DataFrame, by: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each group; also rolling retention and last-write-wins. Spark cuts to `keep` rows a group in every task before
    the exchange, so a hot group sends no more than that for each."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def hour_histogram(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def peak_hours(histogram: DataFrame, width: int = 3) -> DataFrame:
    """The best run of `width` hours on a circular clock: (start, end, n). The smallest start wins ties; nulls without any hour."""
    turned = histogram.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda o: F.pmod(F.col("hour") - o, F.lit(24)))).alias("start"), "n")
    sums = turned.groupBy("start").agg(F.sum("n").alias("n"))
    best = F.max_by(F.struct("start", "n"), F.struct("n", -F.col("start")))
    return sums.agg(best.alias("b")).select(F.col("b.start").alias("start"), F.pmod(F.col("b.start") + width, F.lit(24)).alias("end"), F.col("b.n").alias("n"))


def title_topics(titles: DataFrame, title: str, source: str, stop: list[str], top: int = 10, least: int = 2) -> DataFrame:
    """Words of titles by frequency, with their sources: longer than two characters before marks are stripped, the top cut before rare words go."""
    w = titles.select(F.explode(F.split(F.col(title), r"\s+")).alias("w"), source).where(F.length("w") > 2)
    w = w.select(F.btrim(F.lower("w"), F.lit(".,;:!?()[]{}\"'")).alias("word"), source).where(~F.col("word").isin(stop))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(source)).alias("sources")).orderBy(F.desc("n"), "word").limit(top).where(F.col("n") >= least)


def budget_prefix(df: DataFrame, by: str, order: str, tokens: str, budget: int, range_rows: int = 4096) -> DataFrame:
    """Rows of each group in order of a number while the sum of tokens stays within the budget. Sums by ranges of the order come first, so
    that only the few ranges that begin within the budget are read in one task, however many rows a group has. Tokens aren't negative."""
    least, most, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    width = max(1, math.ceil(((most or 0) - (least or 0) + 1) * range_rows / max(1, n)))
    ranged = df.withColumn("_r", F.floor((F.col(order) - F.lit(least)) / width))
    sums = ranged.groupBy(by, "_r").agg(F.sum(tokens).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before).where(F.col("_before") <= budget).drop("_s").withColumnRenamed(by, "_by")
    near = ranged.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (ranged["_r"] == starts["_r"])).drop(starts["_r"]).drop("_by")
    running = F.col("_before") + F.sum(tokens).over(Window.partitionBy(by, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("running_tokens", running).where(F.col("running_tokens") <= budget).drop("_r", "_before")


def ranked_by_range(df: DataFrame, by: str, order: str, out: str, range_rows: int = 4096) -> DataFrame:
    """0-based place `out` of each row in its group, in order of a number (nulls first), without a task that reads a whole group: rows are counted by ranges of
    the order, sums over these few counts say where a range begins, and rows are numbered within ranges only."""
    least, most, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    width = max(1, math.ceil(((most or 0) - (least or 0) + 1) * range_rows / max(1, n)))
    ranged = df.withColumn("_r", F.coalesce(F.floor((F.col(order) - F.lit(least or 0)) / width), F.lit(-1)))
    counts = ranged.groupBy(by, "_r").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(by).alias("_by"), F.col("_r").alias("_range"), before.alias("_before"))
    near = ranged.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_r") == F.col("_range")))
    inside = F.row_number().over(Window.partitionBy(by, "_r").orderBy(order)) - 1
    return near.withColumn(out, (F.col("_before") + inside).cast("long")).drop("_r", "_before", "_by", "_range")


def within_seconds(df: DataFrame, by: str, at: str, seconds: int) -> Column:
    """Rows of the group in the last `seconds` up to each row, itself included."""
    return F.count(F.lit(1)).over(Window.partitionBy(by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0))


def newest(df: DataFrame, order: list[Column], n: int, most: int = 200) -> DataFrame:
    return df.orderBy(*order).limit(max(1, min(n, most)))


def queue_health(depths: DataFrame, depth: str, workers: int) -> DataFrame:
    """One row: the sum of depths that could be read, whether any could not (below 0), and the status; without workers it is degraded too."""
    bad = F.coalesce(F.bool_or(F.col(depth) < 0), F.lit(False))
    return depths.agg(F.coalesce(F.sum(F.when(F.col(depth) >= 0, F.col(depth))), F.lit(0)).alias("total_pending"), bad.alias("any_error"), F.when(bad | F.lit(workers == 0), "degraded").otherwise("up").alias("status"))


def quota(df: DataFrame, plan: str, used: str, limits: dict[str, int | None], default: int) -> DataFrame:
    """With `allowed` (null: no limit) and whether one more may be used."""
    allowed = F.lit(default)
    for name, most in limits.items():
        allowed = F.when(F.col(plan) == name, F.lit(most).cast("int")).otherwise(allowed)
    return df.withColumn("allowed", allowed).withColumn("may", F.col("allowed").isNull() | (F.col(used) < F.col("allowed")))
