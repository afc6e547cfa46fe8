"""Functions over Arrow batches, made when a query uses them: their types are parsed by a running session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(returns: str) -> Callable:
    def made(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return made
