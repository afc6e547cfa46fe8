"""Limiters and breakers on streams: each key's memory is kept by Spark between batches and has a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.state import FAILURES, RECOVERY, Breaker, Window


def limited_stream(requests: DataFrame, key: str, at: str, most: int, seconds: float) -> DataFrame:
    """Requests (key, at in seconds) with `accepted` and `remaining`, by a sliding log of accepted ones. Within a batch requests are taken in order of time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = Window(most, seconds)
        w.times.extend(state.get[0] if state.exists else [])
        rows = pd.concat(batches).sort_values(at, kind="stable")
        done = [w.ask(float(t), True) for t in rows[at]]
        state.update((list(w.times),))
        yield pd.DataFrame({key: k[0], at: rows[at], "accepted": [d[0] for d in done], "remaining": [d[1] for d in done]})

    out = T.StructType([requests.schema[key], requests.schema[at], T.StructField("accepted", T.BooleanType()), T.StructField("remaining", T.IntegerType())])
    return requests.select(key, at).groupBy(key).applyInPandasWithState(step, out, T.StructType([T.StructField("times", T.ArrayType(T.DoubleType()))]), "append", GroupStateTimeout.NoTimeout)


def breaker_stream(calls: DataFrame, key: str, at: str, ok: str, failures: int = FAILURES, seconds: float = RECOVERY) -> DataFrame:
    """Calls (key, at in seconds, ok) with the state met, whether they were let through, and the state after."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(failures, seconds)
        if state.exists:
            b.failed, b.opened = state.get
        rows = pd.concat(batches).sort_values(at, kind="stable")
        done = [b.call(float(t), bool(o)) for t, o in zip(rows[at], rows[ok], strict=True)]
        state.update((b.failed, None if b.opened is None else float(b.opened)))
        yield pd.DataFrame({key: k[0], at: rows[at], "met": [d[0] for d in done], "passed": [d[1] for d in done], "after": [d[2] for d in done]})

    out = T.StructType([calls.schema[key], calls.schema[at], T.StructField("met", T.StringType()), T.StructField("passed", T.BooleanType()), T.StructField("after", T.StringType())])
    memory = T.StructType([T.StructField("failed", T.IntegerType()), T.StructField("opened", T.DoubleType())])
    return calls.select(key, at, ok).groupBy(key).applyInPandasWithState(step, out, memory, "append", GroupStateTimeout.NoTimeout)
