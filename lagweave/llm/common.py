"""Helpers shared by the training-data operators: written tables, shared files, skew-safe look-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.sources.storage import new_path, shared_dir, written

__all__ = ["file_system", "in_slices", "lookup", "map_slices", "new_path", "one_task_each", "sample_of", "shared_dir", "table", "written"]

#: Rows, and bytes of them, that a worker turns into Python objects at a time.
SLICE, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path in it, for binary files that Spark has no writer for."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and bytes; a row that is longer comes alone."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str | T.StructType) -> DataFrame:
    """Apply a function of a slice of rows, which returns the columns by name, in every task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            columns = function(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def lookup(rows: DataFrame, values: DataFrame, keys: str | Sequence[str], n: str) -> DataFrame:
    """Left join with a table that has one row a key, where n tells how many of the rows have that key.

    A key with more than `part` rows is dealt over several salts, so no task gets a hot key whole. There
    are at most 2000 such keys, as n adds up to no more than the number of rows: that bounds the broadcast.
    Null keys find nothing. They, and the rows of a hot key, are dealt by their place in their partition, so equal
    rows are dealt out too; the rows are to come from files or a written table, whose places are the same if a task runs again.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = values.agg(F.sum(n)).first()[0] or 0
    part = max(100, total // 2000)
    hot = F.broadcast(values.where(F.col(n) > part).select(*keys, F.ceil(F.col(n) / part).cast("int").alias("_salts")))
    other = [c for c in values.columns if c not in keys]
    place, null = F.monotonically_increasing_id(), F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    salt = F.when(null, F.pmod(place, F.lit(4096))).when(F.col("_salts").isNotNull(), F.pmod(place, F.col("_salts"))).otherwise(0)
    left = rows.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    right = values.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return left.join(right.select(*keys, "_salt", *other), [*keys, "_salt"], "left").drop("_salt")


def one_task_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The rows with one task for each: for files, of which the driver knows the names. It is a join by number, and the names are broadcast."""
    named = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_task long, {schema}")
    return spark.range(0, len(rows), 1, max(1, len(rows))).withColumnRenamed("id", "_task").join(F.broadcast(named), "_task").drop("_task")


def sample_of(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most so many rows, the same ones in every run: those with the smallest hash."""
    return df.orderBy(F.xxhash64(*by), *by).limit(rows)
