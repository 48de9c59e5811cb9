"""Tables and folders that all executors share: where lineage is cut and files are exchanged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Parts for each core before they grow.
ROUNDS = 4


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def dealt(df: DataFrame, rows: int, tag: str, weight: Column | None = None, most: int = 0) -> DataFrame:
    """The rows, written, in parts of about so many: for few bytes that are much work. With a weight, parts are larger rather than more
    than `ROUNDS` for each core, up to a weight of about `most`, as each costs a task's start."""
    done = written(df, tag)
    n, weighed = done.agg(F.count("*"), F.sum(weight if weight is not None else F.lit(0))).first()
    parts = -(-n // rows)
    if weight is not None:
        parts = min(parts, max(ROUNDS * df.sparkSession.sparkContext.defaultParallelism, -(-int(weighed or 0) // most)))
    return done.repartition(max(1, parts))
