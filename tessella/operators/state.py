"""Operators with a memory along time: limiters that count accepted requests only, circuit breakers, and states of records.

A key's rows are read in order by one task, row by row; what is remembered has a fixed size, so a hot key needs time but no memory. The same
functions serve batches here and streams in tessella.streaming.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A breaker opens after so many failures and stays open so many seconds.
FAILURES, RECOVERY = 3, 1800.0
#: States of an assumption, and those it never leaves.
STATUSES, TERMINAL = ("open", "confirmed", "refuted", "revised"), ("confirmed", "refuted")


def fold(df: DataFrame, key: str, order: list[str], columns: list[str], step: Callable, fresh: Callable, schema: str) -> DataFrame:
    """The columns and, for each row in order, what `step(state, row)` gives back as a tuple for `schema`; a new state for each key."""
    kept = T.StructType([df.schema[c] for c in [key, *columns]])
    fields = T.StructType([*kept.fields, *T.StructType.fromDDL(schema).fields])
    target = to_arrow_schema(fields)
    n = len(kept.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            out = []
            for row in rows:
                if row[0] != now:
                    now, state = row[0], fresh()
                out.append(step(state, row[1:]))
            if rows:
                cols = [*b.columns, *(pa.array(c, target.field(n + i).type) for i, c in enumerate(zip(*out, strict=True)))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, fields)


class Window:
    """Times of the last accepted requests, at most `most` of them."""

    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.seconds, self.times = most, seconds, deque()

    def ask(self, at: float, closed: bool) -> tuple[bool, int]:
        """Whether a request is accepted, and how many more are. `closed`: one exactly a window old still counts."""
        while self.times and (self.times[0] < at - self.seconds if closed else self.times[0] <= at - self.seconds):
            self.times.popleft()
        if len(self.times) >= self.most:
            return False, 0
        self.times.append(at)
        return True, self.most - len(self.times)


def limited(requests: DataFrame, key: str, at: str, order: list[str], most: int, seconds: float, closed: bool = True) -> DataFrame:
    """Requests with `accepted` and `remaining` by a sliding log in which only accepted ones count. `order` ends in a column that tells rows of
    one time apart; `at` is in seconds."""
    return fold(requests, key, order, order, lambda s, row: s.ask(row[order.index(at)], closed), lambda: Window(most, seconds), "accepted boolean, remaining int")


class Breaker:
    """Closed until `failures` in a row, then open for `seconds`, then half open for one probe that closes or opens it again."""

    def __init__(self, failures: int = FAILURES, seconds: float = RECOVERY) -> None:
        self.most, self.seconds, self.failed, self.opened = failures, seconds, 0, None

    def call(self, at: float, ok: bool) -> tuple[str, bool, str]:
        """State met, whether the call went through, and the state after it."""
        met = "closed" if self.opened is None else "half_open" if at - self.opened >= self.seconds else "open"
        if met == "open":
            return met, False, met
        if ok:
            self.failed, self.opened = 0, None
            return met, True, "closed"
        self.failed += 1
        if met == "half_open" or self.failed >= self.most:
            self.opened = at
            return met, True, "open"
        return met, True, "closed"


def breaker(calls: DataFrame, key: str, at: str, ok: str, order: list[str], failures: int = FAILURES, seconds: float = RECOVERY) -> DataFrame:
    """Calls with the state met, whether they were let through, and the state after."""
    columns = [*order, ok]
    return fold(calls, key, order, columns, lambda s, row: s.call(row[order.index(at)], row[-1]), lambda: Breaker(failures, seconds), "met string, passed boolean, after string")


def latest_valid_status(changes: DataFrame, key: str, order: list[str], status: str, start: str = "open") -> DataFrame:
    """(key, status, n_refused) after changes in order: unknown states and changes from a terminal state are refused. As a terminal state is never
    left, it is the first of them that counts, and without one the last known state; so no order need be kept beyond two aggregates."""
    known, terminal = F.col(status).isin(*STATUSES), F.col(status).isin(*TERMINAL)
    at = F.struct(*order)
    g = changes.groupBy(key).agg(
        F.min(F.when(terminal, F.struct(*order, F.col(status).alias("s")))).alias("_end"), F.max(F.when(known, F.struct(*order, F.col(status).alias("s")))).alias("_last"), F.count_if(~known).alias("_unknown")
    )
    late = changes.where(known).join(g.where(F.col("_end").isNotNull()).select(F.col(key), F.col("_end")), key).where(at > F.struct(*(F.col("_end")[o].alias(o) for o in order))).groupBy(key).agg(F.count(F.lit(1)).alias("_late"))
    out = g.join(late, key, "left")
    return out.select(key, F.coalesce("_end.s", "_last.s", F.lit(start)).alias("status"), (F.col("_unknown") + F.coalesce("_late", F.lit(0))).alias("n_refused"))


def reminder_after(action: Column, now: Column, due: Column, snooze_days: int = 3) -> Column:
    """State of a reminder after an action: acknowledged and dismissed are resolved now; snoozed is due again after three days."""
    done = action.isin("acknowledged", "dismissed")
    return F.struct(action.alias("status"), F.when(action == "snoozed", now + F.make_dt_interval(F.lit(snooze_days))).otherwise(due).alias("due_at"), F.when(done, now).alias("resolved_at"))


def escalated(reminders: DataFrame, now: Column) -> DataFrame:
    """Pending follow-ups that are overdue become urgent."""
    late = (F.col("status") == "pending") & (F.col("kind") == "follow_up") & (F.col("due_at") < now)
    return reminders.withColumn("urgency", F.when(late, "high").otherwise(F.col("urgency")))
