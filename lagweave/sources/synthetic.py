"""Series with planted lags, for checks of the estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def noise(key: Column, seed: int) -> Column:
    """A number from -1 to 1 that depends on the key alone, so any partitioning gives the same series."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1


def causal_series(ids: DataFrame, key: str, length: int) -> DataFrame:
    """subject, i, n, x1, x2, y: y follows x1 by one step and x2 by two; an id gives a row, `length` ids a series."""
    k = F.col(key)
    rows = ids.select(F.floor(k / length).cast("long").alias("subject"), (k % length).cast("long").alias("i"), noise(k, 1).alias("x1"), noise(k, 2).alias("x2"), noise(k, 3).alias("_e"))
    w = Window.partitionBy("subject").orderBy("i")
    y = F.coalesce(F.lag("x1", 1).over(w), F.lit(0.0)) + 0.8 * F.coalesce(F.lag("x2", 2).over(w), F.lit(0.0)) + 0.2 * F.col("_e")
    return rows.withColumn("y", y).withColumn("n", F.count("*").over(Window.partitionBy("subject"))).drop("_e")
