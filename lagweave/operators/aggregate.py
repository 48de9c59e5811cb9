"""Aggregations: pivots, standardising, and summaries of decomposition results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMS = ("R", "U1", "U2", "S")


def pivot_first(df: DataFrame, keys: Sequence[str], event: str, value: str, order: str, names: Sequence[str]) -> DataFrame:
    """Long events to one column a name: the first non-null value under the order."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).pivot(event, list(names)).agg(F.min_by(value, order))


def fit_standardizer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: mean and population deviation, nulls skipped; a zero deviation is 1."""
    one = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def apply_standardizer(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The fitted table has one row a column and goes into the plan as numbers."""
    p = {r["column"]: r for r in fitted.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(p[c]["mean"])) / F.lit(p[c]["std"]) for c in columns})


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.withColumn("share", F.col("n") / F.lit(float(total)))


def valid_mi() -> Column:
    return F.col("MI").isNotNull() & ~F.isnan("MI") & (F.col("MI") > 1e-9)


def normalize_terms(df: DataFrame) -> DataFrame:
    """Each term over MI where MI counts, else zero."""
    return df.withColumns({f"{t}_norm": F.when(valid_mi(), F.col(t) / F.col("MI")).otherwise(0.0) for t in TERMS})


def average_over_lags(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of MI, the terms and the normalised terms over a pair's valid lags."""
    return normalize_terms(df).where(valid_mi()).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in (*TERMS, "MI", *[f"{t}_norm" for t in TERMS])], F.count("*").alias("lags"))


def dominant_terms(df: DataFrame, keys: Sequence[str], threshold: float = 0.4, share: float = 0.9) -> DataFrame:
    """The term that leads, above the threshold, in at least this share of a pair's valid lags; the first such of R, U1, U2, S; null if none."""
    n = normalize_terms(df).where(valid_mi())
    values = F.array(*[f"{t}_norm" for t in TERMS])
    top = F.array_max(values)
    led = n.withColumn("_led", F.when(top > threshold, F.array_position(values, top)))
    counts = led.groupBy(*keys).agg(F.count("*").alias("lags"), *[F.count_if(F.col("_led") == k + 1).alias(f"led_{t}") for k, t in enumerate(TERMS)])
    return counts.withColumn("dominant", F.coalesce(*[F.when(F.col(f"led_{t}") / F.col("lags") >= share, t) for t in TERMS]))


def dominance_summary(dominant: DataFrame) -> DataFrame:
    """Number of pairs for each of the four terms, zeros kept."""
    one = dominant.agg(*[F.count_if(F.col("dominant") == t).alias(t) for t in TERMS])
    return one.unpivot([], list(TERMS), "term", "pairs")


def share_of_total(df: DataFrame, value: str, by: Sequence[str], to: str = "share") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(to, F.when(total == 0, 0.0).otherwise(F.col(value) / total))
