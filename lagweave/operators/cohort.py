"""Cohort records and datasets for models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.sources.storage import written

from .aggregate import apply_standardizer, fit_standardizer, pivot_first
from .joins import dictionary_join, interval_join_first, keep_valid, min_observations
from .sampling import split_random
from .series import dedupe_first, hours_between, sliding_windows, truncate_pad


def ordered(df: DataFrame, key: str, time: str, fields: Sequence[str], to: str) -> DataFrame:
    """One row a key: its rows as an array of structs in time order. A stay is bounded in time, so the array is too."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(time, *fields))).alias(to))


def stay_records(stays: DataFrame, key: str, modalities: dict[str, DataFrame], required: Sequence[str] = ()) -> DataFrame:
    """Stays with an array for each modality (key and an array column of its name) and its missing flag; stays without a required one go."""
    out = stays
    for name, rows in modalities.items():
        out = out.join(rows.select(key, name), key, "inner" if name in required else "left")
        out = out.withColumn(f"{name}_missing", F.col(name).isNull().cast("long")).withColumn(name, F.coalesce(name, F.array()))
    return out


def los_label(stay_hours: Column, died: Column, limit: float = 96) -> Column:
    return F.when((stay_hours < limit) & (died == 0), 1).otherwise(0).cast("long")


def inside_stays(events: DataFrame, admissions: DataFrame, stays: DataFrame, keys: Sequence[str], event: str, time: str, days: int = 5, rows: int = 0) -> DataFrame:
    """Events with the first admission and the first stay that contain them, and the hours since both began (hosp, icu). `rows`: the number of events."""
    one = interval_join_first(events, admissions, keys, event, time, "hadm_id", "admittime", "dischtime", days, rows)
    two = interval_join_first(one, stays, keys, event, time, "stay_id", "intime", "outtime", days, rows)
    return two.withColumns({"hosp": hours_between(F.col("admittime"), F.col(time)), "icu": hours_between(F.col("intime"), F.col(time))})


def named_events(sources: Sequence[tuple[DataFrame, DataFrame]], item: str) -> DataFrame:
    """Raw events of several sources, each with its own dictionary of (item, name), under one another."""
    found = [dictionary_join(events, names, item) for events, names in sources]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def irregular_series(events: DataFrame, keys: Sequence[str], name: str, value: str, order: str, names: Sequence[str]) -> DataFrame:
    """Located events as a wide series: one row a time of an admission, one column a name. Events outside every admission go, those outside stays have null stay columns."""
    ids = [*keys, "hadm_id", "stay_id", "hosp", "icu"]
    return pivot_first(events.where("hadm_id is not null"), ids, name, value, order, names)


def task_window(rows: dict[str, DataFrame], times: dict[str, str], stays: DataFrame, key: str, hours: float | None = None, least_days: float = 0, min_rows: int = 0, sparse: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Each modality's rows from the stay's start to `hours`, of stays of at least `least_days`; the sparse ones of stays with at least `min_rows` of them."""
    valid = stays.where(hours_between(F.col("intime"), F.col("outtime")) >= 24 * least_days)
    out = {}
    for name, df in rows.items():
        t = F.col(times[name])
        df = keep_valid(df.where((t >= 0) if hours is None else t.between(0, hours)), valid, key)
        out[name] = keep_valid(df, min_observations(df, key, min_rows), key) if name in sparse and min_rows else df
    return out


def task_stays(rows: dict[str, DataFrame], key: str, include_missing: bool = False) -> DataFrame:
    """Ids of stays that have rows of every modality, or of any where missing ones are allowed."""
    first, *rest = [df.select(key).distinct() for df in rows.values()]
    for more in rest:
        first = first.union(more) if include_missing else first.intersect(more)
    return first.distinct()


def split_and_standardize(rows: dict[str, DataFrame], ids: DataFrame, key: str, seed: int, scaled: Sequence[str] = (), columns: Sequence[str] = ()) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame]]:
    """The ids' splits, the rows with the scaled modalities standardised, and their scalers, fitted on the training stays' rows.

    Ids, splits and scalers are written, as several steps read them.
    """
    split = written(split_random(written(ids, "ids"), key, seed).select(key, "split"), "split")
    train = split.where("split = 'train'")
    scalers = {name: written(fit_standardizer(keep_valid(rows[name], train, key), columns), f"scaler-{name}") for name in scaled}
    return split, {name: apply_standardizer(df, scalers[name], columns) if name in scalers else df for name, df in rows.items()}, scalers


def series_steps(columns: Sequence[str]) -> dict[str, Column]:
    """A step's values in column order with zeros for nulls, and which of them were observed."""
    return {"v": F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns]), "observed": F.array(*[F.col(c).isNotNull().cast("long") for c in columns])}


def windows_dataset(df: DataFrame, keys: Sequence[str], size: int, step: int, values: Sequence[str], label: str) -> DataFrame:
    """Windows with their values in order and the most frequent label, the smallest on ties."""
    w = sliding_windows(df, keys, size, step)
    return w.groupBy(*keys, "w").agg(F.array_sort(F.collect_list(F.struct("pos", *values))).alias("rows"), F.mode(label, True).alias("label"))



def sequence_dataset(aligned: DataFrame, key: str, modality: str, size: int, dims: dict[str, int], keep_last: bool = False) -> DataFrame:
    """One row a stay: for each modality, in name order, `size` vectors and their mask, cut or filled with zeros and false.

    `aligned` has a row a step (t, v, mask). A modality without steps is all zeros and false.
    """
    names = sorted(dims)
    each = [F.array_sort(F.collect_list(F.when(F.col(modality) == m, F.struct("t", "v", "mask")))).alias(m) for m in names]
    rows = aligned.groupBy(key).agg(*each)
    for m in names:
        none = F.struct(F.lit(None).cast("long").alias("t"), F.array_repeat(F.lit(0.0), dims[m]).alias("v"), F.lit(False).alias("mask"))
        rows = rows.withColumn(m, F.transform(truncate_pad(F.col(m), size, none, keep_last), lambda s: F.struct(s["v"].alias("v"), s["mask"].alias("mask"))))
    return rows.select(key, *names)


__all__ = ["dedupe_first", "hours_between", "inside_stays", "irregular_series", "los_label", "named_events", "ordered", "sequence_dataset", "series_steps", "split_and_standardize", "stay_records", "task_stays", "task_window", "windows_dataset"]
