"""Joins: item dictionaries, containing intervals, semi and anti joins, pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import spread


def dictionary(items: DataFrame, wanted: Sequence[str], label: str, item: str, order: str) -> DataFrame:
    """(item, label) of the wanted labels; of several items with one label the first one under the order."""
    return items.where(F.col(label).isin(sorted(set(wanted)))).groupBy(label).agg(F.min_by(item, order).alias(item))


def dictionary_join(events: DataFrame, names: DataFrame, item: str) -> DataFrame:
    """Events of the dictionary's items with their names. The dictionary has one row a wanted name, which bounds the broadcast."""
    return events.join(F.broadcast(names), item)


def interval_pairs(events: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str, days: int = 1, rows: int = 0) -> DataFrame:
    """Every event with every interval of its subject that contains its time, both ends included: columns of both.

    The equality key is the subject and a period of `days` days: an interval comes once for each period it touches, an event is in one,
    so an event meets only intervals near it and a busy subject is many tasks' work. With the number of events given, `rows`, the parts follow it.
    """
    period = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    cells = spans.where(F.col(start) <= F.col(end)).withColumn("_d", F.explode(F.sequence(period(start), period(end))))
    met = spread(events.withColumn("_d", period(time)), [*keys, "_d"], rows).join(cells, [*keys, "_d"]).drop("_d")
    return met.where(F.col(time).between(F.col(start), F.col(end)))


def interval_join_first(events: DataFrame, spans: DataFrame, keys: Sequence[str], event: str, time: str, span: str, start: str, end: str, days: int = 1, rows: int = 0) -> DataFrame:
    """Each event with the earliest-starting interval of its subject that contains its time, both ends included.

    Unmatched events stay, with nulls; ties go to the smaller interval id. The matches, found by periods of `days` days, are
    reduced before they are joined back.
    """
    found = interval_pairs(events.select(*keys, event, time), spans.select(*keys, span, start, end), keys, time, start, end, days, rows)
    first = spread(found, [event], rows).groupBy(event).agg(F.min(F.struct(start, span, end)).alias("_s")).select(event, f"_s.{span}", f"_s.{start}", f"_s.{end}")
    return events.join(first, event, "left")


def keep_valid(df: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return df.join(valid.select(key).distinct(), key, "left_semi")


def with_missing_flag(base: DataFrame, rows: DataFrame, key: str, values: str) -> DataFrame:
    """base with the array of its values (empty where there are none) and the missing flag."""
    joined = base.join(rows.select(key, values), key, "left")
    return joined.withColumn("missing", F.col(values).isNull().cast("int")).withColumn(values, F.coalesce(values, F.array()))


def min_observations(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Keys with at least so many rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= rows)


def pair_generate(names: DataFrame, name: str) -> DataFrame:
    """Unordered pairs of a table of names (modalities, columns): an array holds the few names, so no join is needed."""
    one = names.agg(F.array_sort(F.collect_set(name)).alias("_a"))
    left = one.select("_a", F.posexplode("_a").alias("_i", "mod1"))
    return left.select("mod1", F.explode(F.slice(F.col("_a"), F.col("_i") + 2, F.size("_a"))).alias("mod2"))
