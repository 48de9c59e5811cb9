"""Positions, lags and interpolation of long series: a series is cut into ranges, and what a range needs of others comes from a row a range.

The functions give the rows that those of `series` give, but no task holds more of a series than a range (and `max_lag` rows of the next).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_starts(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _range, _start, n: the rows in the ranges before each, and in all, from a row a range (keys, _range, _rows)."""
    w = Window.partitionBy(*keys)
    before = F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*keys, "_range", F.coalesce(before, F.lit(0)).cast("long").alias("_start"), F.sum("_rows").over(w).cast("long").alias("n"))


def series_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: Column) -> DataFrame:
    """i: 0-based position in a series; n: its length. `part` numbers the ranges, rising with the first column of the order, such as the day of a time."""
    rows = df.withColumn("_range", part)
    starts = range_starts(rows.groupBy(*keys, "_range").agg(F.count("*").alias("_rows")), keys)
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return rows.withColumn("_i", inside).join(starts, [*keys, "_range"]).withColumn("i", (F.col("_start") + F.col("_i")).cast("long")).drop("_i", "_start", "_range")


def lag_align(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, max_lag: int, block: int, order: str = "i", length: str = "n", others: Sequence[str] = ()) -> DataFrame:
    """(x at i, y at i + lag) for lags 0..max_lag: ranges of `block` positions, each with the labels of the next ranges' first rows."""
    at = F.floor(F.col(order) / block)
    spans = F.floor((F.col(order) - max_lag) / block)  # a row is also seen by the ranges that end up to max_lag rows before it
    rows = df.select(*keys, order, length, *x, *others, F.col(y).alias("_l"), F.explode(F.sequence(F.greatest(F.lit(0), spans), at)).alias("_range"), at.alias("_own"))
    w = Window.partitionBy(*keys, "_range").orderBy(order)
    leads = F.array(*[F.struct(F.lead("_l", k).over(w).alias("y")) for k in range(max_lag + 1)])
    wide = rows.withColumn("_y", leads).where("_range = _own").select(*keys, order, length, *x, *others, F.posexplode("_y").alias("lag", "_s"))
    return wide.where(F.col(order) < F.col(length) - F.col("lag")).select(*keys, order, length, *others, "lag", *x, F.col("_s.y").alias(y))


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block: int) -> DataFrame:
    """Linear between known neighbours by position, the nearest known value outside; all-null series stay null.

    Each range of `block` positions has a row with its first and last known value of every column; running over these rows gives
    each range the last known value before it and the first one after it.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / block))
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v")))
    ends = rows.groupBy(*keys, "_range").agg(*[f(known(c)).alias(f"_{c}_{e}") for c in columns for e, f in (("first", F.min), ("last", F.max))])
    w = Window.partitionBy(*keys)
    back, ahead = w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [x for c in columns for x in (F.last(f"_{c}_last", True).over(back).alias(f"_{c}_before"), F.last(f"_{c}_first", True).over(ahead).alias(f"_{c}_after"))]
    rows = rows.join(ends.select(*keys, "_range", *carried), [*keys, "_range"])
    own = Window.partitionBy(*keys, "_range")
    before = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = own.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    new = {}
    for c in columns:
        a = F.coalesce(F.last(known(c), True).over(before), F.col(f"_{c}_before"))
        b = F.coalesce(F.last(known(c), True).over(after), F.col(f"_{c}_after"))
        line = a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["at"]) / (b["at"] - a["at"])
        new[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)
    return rows.withColumns(new).drop("_range", *[f"_{c}_{e}" for c in columns for e in ("before", "after")])
