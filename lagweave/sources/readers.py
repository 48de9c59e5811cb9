"""Sources and sinks: sensor text, gzipped CSV, Parquet, binary assets, nested results, predictions and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lagweave.operators.clean import SENSOR_COLUMNS


def read_sensor_text(spark: SparkSession, path: str, columns: Sequence[str] = SENSOR_COLUMNS, subject: str = r"(\d+)\.[^.]*$") -> DataFrame:
    """Headerless white-space separated files with fixed columns; the subject is taken from the file's name. NaN is null."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), subject, 1).cast("long").alias("subject_id"), F.split(F.trim("value"), r"\s+").alias("_p"))
    number = lambda k: F.get("_p", F.lit(k)).try_cast("double")
    return lines.select("subject_id", *[F.when(~F.isnan(number(k)), number(k)).alias(c) for k, c in enumerate(columns)])


def read_csv_gz(spark: SparkSession, path: str, schema: str | T.StructType, partitions: int | None = None) -> DataFrame:
    """CSV with a header and a declared schema. A gzip file is read by one task, so its rows are dealt out after."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.repartition(partitions) if partitions else df


def asset_path(subject: Column, study: Column, name: Column) -> Column:
    s = subject.cast("string")
    return F.concat_ws("/", F.concat(F.lit("p"), F.substring(s, 1, 2)), F.concat(F.lit("p"), s), F.concat(F.lit("s"), study.cast("string")), F.concat(name, F.lit(".jpg")))


def existing_assets(spark: SparkSession, rows: DataFrame, root: str, path: str, pattern: str = "*") -> DataFrame:
    """Rows whose file is below the root; the listing is Spark's, contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(F.regexp_replace("path", "^.*?" + root.rstrip("/").removeprefix("file://") + "/", "").alias(path))
    return rows.join(files, path, "left_semi")


def write_assets(rows: DataFrame, path: str, content: str, root: str) -> int:
    """A file below the root for each row, written by the tasks; returns how many. A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for name, data in zip(batch[path].to_pylist(), batch[content].to_pylist(), strict=True):
                store.create_dir(f"{base}/{name}".rpartition("/")[0])
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(data or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], "int64")], ["n"])

    return rows.select(path, F.col(content).cast("binary").alias(content)).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


#: Values that an encoder is given at once.
BATCH = 256


def batch_map(df: DataFrame, column: str, to: str, load: Callable[[], Callable[[list], list]], kind: str = "array<double>") -> DataFrame:
    """A batched encoder over a column. `load` runs once a task and returns the encoder of a list of values, which gets `BATCH` at a time.

    The other columns stay Arrow buffers, and only the values of one such list are Python objects.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(to, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, coded = load(), to_arrow_type(schema[to].dataType)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield part.append_column(to, pa.array(encode(part.column(column).to_pylist()), coded))

    return df.mapInArrow(run, schema)


def hashing_encoder(size: int = 8) -> Callable[[], Callable[[list], list]]:
    """A stand-in encoder: counts of words by hash."""

    def load() -> Callable[[list], list]:
        import zlib

        def encode(texts: list) -> list:
            out = []
            for t in texts:
                v = [0.0] * size
                for w in (t or "").split():
                    v[zlib.crc32(w.encode()) % size] += 1
                out.append(v)
            return out

        return encode

    return load


def nest_results(terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a pair with its lags as an array, in lag order."""
    rest = [c for c in terms.columns if c not in keys]
    return terms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", *[c for c in rest if c != "lag"]))).alias("lag_results"))


def write_results(nested: DataFrame, path: str, *by: str) -> None:
    nested.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_results_flat(spark: SparkSession, path: str) -> DataFrame:
    """Nested results as one row a lag; what was a file name is a partition column."""
    nested = spark.read.parquet(path)
    return nested.select(*[c for c in nested.columns if c != "lag_results"], F.inline("lag_results"))


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
