"""Projection, filtering and cleaning of sensor and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sensor table's layout.
LOCATIONS = ("hand", "chest", "ankle")
SENSORS = ("temp", "acc16g_x", "acc16g_y", "acc16g_z", "acc6g_x", "acc6g_y", "acc6g_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z", "orient_w", "orient_x", "orient_y", "orient_z")
SENSOR_COLUMNS = ["timestamp", "activity_id", "heart_rate", *(f"{s}_{l}" for l in LOCATIONS for s in SENSORS)]


def select_sensors(df: DataFrame, keys: Sequence[str] = ("timestamp", "activity_id")) -> DataFrame:
    """Keys and sensors without the orientation columns, which are not valid in the data."""
    return df.select([c for c in df.columns if c in keys or not c.startswith("orient")])


def drop_transient(df: DataFrame, label: str = "activity_id") -> DataFrame:
    """Without the rows between activities."""
    return df.where(F.col(label) != 0)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column with its number of missing values."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "missing")


def drop_null_any(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; what can't be cast becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def column_modality(name: Column) -> Column:
    """Modality of a sensor column by its name; null where none fits."""
    return F.when(name.contains("heart") | (name == "hr"), "heart_rate").when(name.contains("chest"), "chest").when(name.contains("hand"), "hand").when(name.contains("ankle"), "ankle")


def categorize_columns(columns: DataFrame, name: str = "column") -> DataFrame:
    return columns.withColumn("modality", column_modality(F.col(name)))


def modality_vectors(df: DataFrame, modalities: dict[str, Sequence[str]], pad: int = 1) -> DataFrame:
    """One array column a modality; a modality without columns is `pad` zeros."""
    arrays = {m: F.array(*[F.col(c).cast("double") for c in cs]) if cs else F.array_repeat(F.lit(0.0), pad) for m, cs in modalities.items()}
    return df.withColumns(arrays)


def label_index(df: DataFrame, label: str, to: str, labels: DataFrame | None = None) -> DataFrame:
    """Sorted distinct labels as 0..C-1; rows whose label isn't listed go.

    The label table is one row a class: classes are counted over all rows before, in a single small window.
    """
    from pyspark.sql import Window

    known = (df if labels is None else labels).select(label).where(F.col(label).isNotNull()).distinct()
    coded = known.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("long").alias(to))
    return df.join(coded, label)


def time_filter(df: DataFrame, column: str, hours: float) -> DataFrame:
    return df.where(F.col(column).between(0, hours))


def observed_mask(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).isNotNull().cast("int") for c in columns])


def zero_filled(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def rename_values(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    return df.replace(names, subset=[column])


def replace_inf(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and not-a-number values become null."""
    return df.withColumns({c: F.when((F.abs(c) == float("inf")) | F.isnan(c), None).otherwise(F.col(c)) for c in columns})


def assert_same_features(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """Fail before any job where two tables have different feature columns."""
    left, right = ([c for c in df.columns if c not in keys] for df in (a, b))
    if left != right:
        raise ValueError(f"features differ: {sorted(set(left) ^ set(right)) or 'order'}")


def min_length(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows of the series with more than so many rows."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*keys), list(keys), "left_semi")


def validate_labels(df: DataFrame, label: str, classes: int) -> DataFrame:
    """One row: lowest and highest label, number of classes seen, whether all are in range, whether there is but one."""
    one = df.agg(F.min(label).cast("long").alias("lowest"), F.max(label).cast("long").alias("highest"), F.count_distinct(label).alias("seen"))
    return one.withColumn("in_range", (F.col("lowest") >= 0) & (F.col("highest") < classes)).withColumn("single", F.col("seen") < 2)


def parse_id_list(text: str) -> list[int]:
    """'1', '1,2' or '1-6' as ids, in order."""
    ids: list[int] = []
    for part in text.split(","):
        low, _, high = part.strip().partition("-")
        ids += range(int(low), int(high or low) + 1)
    return ids


def keys_first(df: DataFrame, keys: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys and c not in drop])
