"""Contexts put together from sections, and cut to a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.analytics import ranked_by_range


def placed(df: DataFrame, owner: str, order: str) -> DataFrame:
    """0-based position of each row among its owner's, in order of a number."""
    return ranked_by_range(df, owner, order, "position").withColumn("position", F.col("position").cast("int"))


def first_items(items: DataFrame, owner: str, most: int | None) -> DataFrame:
    """(owner, items): each owner's (item, place) rows in order of place and item, at most so many. Spark cuts to `most` in every task first."""
    if most is not None:
        items = items.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy("place", "item"))).where(F.col("_n") <= most).drop("_n")
    ordered = F.array_sort(F.collect_list(F.struct("place", "item")))
    return items.groupBy(owner).agg(F.transform(ordered, lambda x: x["item"]).alias("items"))


def assembled(owner: str, sections: dict[str, tuple[DataFrame, int | None]], needed: list[str]) -> DataFrame:
    """One row for each owner that has all `needed` sections, with each section's items; other sections may be empty."""
    out: DataFrame | None = None
    for name, (items, most) in sorted(sections.items(), key=lambda x: x[0] not in needed):
        part = first_items(items, owner, most).withColumnRenamed("items", name)
        out = part if out is None else out.join(part, owner, "inner" if name in needed else "left")
    for name in sections:
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out.select(owner, *sections)


def within_budget(items: DataFrame, owner: str, section: str, position: str, tokens: str, budget: int, priority: list[str], always: list[str] = ()) -> DataFrame:
    """Items that stay when a context is cut from the end of its least important section upward until it is within the budget: those up to which
    the sum of tokens, in order of importance, is within it. Sections of `always` stay whatever they cost. Tokens add up and aren't negative."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(section))
    running = F.sum(tokens).over(Window.partitionBy(owner).orderBy(rank, position).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("_run", running).where((F.col("_run") <= budget) | F.col(section).isin(*always)).drop("_run")
