"""Chains of sinks behind a stream, and states that follow a feed of changes.

Each batch of a stream is written under its number, and a number is written over, never beside: a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A step's name, the step before it that it reads ("" for the batch itself), and what it makes of it.
Step = tuple[str, str, Callable[[DataFrame], DataFrame]]


def run_batch(batch: DataFrame, number: int, root: str, steps: list[Step]) -> None:
    """All steps for one batch: each reads what the step it follows has written for this batch, and writes the folder of its own for it."""
    spark = batch.sparkSession
    for name, before, make in steps:
        source = batch if not before else spark.read.parquet(f"{root}/{before}/batch={number}")
        make(source).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")


def fan_out(stream: DataFrame, root: str, steps: list[Step]) -> StreamingQuery:
    """Steps behind a stream until all that is there now is done. The checkpoint lies beside the tables, so that a call after a failure, or later, goes on."""
    return stream.writeStream.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: run_batch(df, n, root, steps)).start()


def written(spark: SparkSession, root: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """A step's table; with `keys`, each key's rows of the last batch that has any only."""
    df = spark.read.parquet(f"{root}/{name}")
    if keys:
        last = df.groupBy(*keys).agg(F.max("batch").alias("batch"))
        df = df.join(last, [*keys, "batch"], "left_semi")
    return df.drop("batch")


def followed(state: DataFrame, changes: DataFrame, key: str, order: list[str], gone: str) -> DataFrame:
    """A state after a feed of changes with the state's columns, `order` columns and the flag `gone`: each key as its last change has it, without those
    that this removes. Keys that the feed lacks stay."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*state.columns, gone), F.struct(*order)).alias("c"))
    stay = state.join(last, key, "left_anti")
    return stay.unionByName(last.where(~F.coalesce(F.col(f"c.{gone}"), F.lit(False))).select(*(F.col(f"c.{c}").alias(c) for c in state.columns)))


def resynced(state: DataFrame, everything: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A state after a full listing, and the keys that it no longer has: the listing replaces all, what it lacks is gone."""
    return everything.select(*state.columns), state.join(everything, key, "left_anti").select(key)


def synced(state: DataFrame, feed: DataFrame | None, listing: Callable[[], DataFrame], key: str, order: list[str], gone: str) -> DataFrame:
    """By the feed of changes since the token, or, where the token is void and there is no feed, by a full listing."""
    return followed(state, feed, key, order, gone) if feed is not None else resynced(state, listing(), key)[0]


def first_seen_stream(rows: DataFrame, key: str, at: str, keep: str = "30 days", since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of a stream whose key comes for the first time, of the days from `since` up to `until`. Seen keys are kept as state until the watermark, which
    `keep` holds back, has passed their latest time; what is older than the watermark is late and not taken."""
    of_range = rows
    if since:
        of_range = of_range.where(F.col(at) >= F.lit(since).cast("timestamp"))
    if until:
        of_range = of_range.where(F.col(at) < F.lit(until).cast("timestamp"))
    columns = rows.columns

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got = pd.concat(batches)
        latest = int(got["_at"].max())
        if not state.exists:
            yield got.sort_values("_at", kind="stable")[columns].head(1)
        else:
            latest = max(latest, state.get[0])
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    sent = of_range.withWatermark(at, keep).withColumn("_at", F.unix_millis(at))
    return sent.groupBy(key).applyInPandasWithState(step, rows.schema, T.StructType([T.StructField("latest", T.LongType())]), "append", GroupStateTimeout.EventTimeTimeout)


def latest_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's last row."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where("_n = 1").drop("_n")
