"""Table functions for SQL."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class LaggedPairs:
    """(key, i, lag, x, y): a series' rows in order, each label beside the signal of up to `max_lag` rows before. Holds max_lag + 1 rows."""

    def __init__(self) -> None:
        self.held: deque = deque()

    def eval(self, row: Row, max_lag: int) -> Iterator[tuple]:
        key, i, x, y = (row[k] for k in range(4))
        self.held.append((key, i, x))
        if len(self.held) > max_lag + 1:
            self.held.popleft()
        for lag, (k, at, then) in enumerate(reversed(self.held)):
            yield k, at, lag, then, y


def register(spark: SparkSession) -> None:
    """lagged_pairs(TABLE(...) PARTITION BY key ORDER BY (i), max_lag) in this session; the table's columns are key, i, x, y."""
    spark.udtf.register("lagged_pairs", udtf(LaggedPairs, returnType="key long, i long, lag long, x double, y long"))
