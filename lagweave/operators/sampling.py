"""Reproducible sampling, splits and batches: order by a hash of the id, not by a random draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.arrays import bind, total


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same in every run."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def ranked(df: DataFrame, key: str, seed: int, buckets: int = 4096, by: Sequence[str] = ()) -> DataFrame:
    """rank: 0-based place of each row in the hash order, of all rows or of its group; total: the rows there are.

    No task sorts all rows: the hash deals them into equal ranges of its own order, and counts of the ranges before, a table
    of at most `buckets` rows a group, give each range its start.
    """
    h = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int"))
    w = Window.partitionBy(*by)
    before = F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = h.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(w).cast("long").alias("total"))
    placed = h.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)))
    found = placed.join(starts if by else F.broadcast(starts), [*by, "_b"]).withColumn("rank", (F.col("_start") + F.col("_r") - 1).cast("long"))
    return found.drop("_h", "_b", "_r", "_start", *([] if by else ["total"]))


def split_random(df: DataFrame, key: str, seed: int, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """split: exactly int(train n) and int(valid n) rows, the rest test."""
    n = df.count()
    a, b = int(train * n), int(train * n) + int(valid * n)
    return ranked(df, key, seed).withColumn("split", F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "val").otherwise("test"))


def split_temporal(df: DataFrame, share: float = 0.8, order: str = "i", length: str = "n") -> DataFrame:
    """The first part of each series trains."""
    return df.withColumn("split", F.when(F.col(order) < F.floor(F.col(length) * F.lit(share)), "train").otherwise("test"))


def split_by_subject(df: DataFrame, subject: str, splits: dict[str, Sequence[int]]) -> DataFrame:
    """Rows of the listed subjects with their split."""
    return df.withColumn("split", F.coalesce(*[F.when(F.col(subject).isin(list(ids)), name) for name, ids in splits.items()])).where("split is not null")


def minibatches(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    return ranked(df, key, seed).withColumn("batch_id", F.floor(F.col("rank") / size).cast("long"))


def topk(logits: Column, k: int) -> Column:
    """(expert, weight) of the k largest logits, softmax over them; ties to the smaller expert. The logits are sorted once."""
    pairs = F.transform(logits, lambda x, j: F.struct((-x).alias("neg"), j.cast("long").alias("expert")))
    exps = lambda top: F.transform(top, lambda s: F.exp(F.get(top, F.lit(0))["neg"] - s["neg"]))
    weigh = lambda top, e: bind(total(e), lambda t: F.zip_with(top, e, lambda s, x: F.struct(s["expert"].alias("expert"), (x / t).alias("weight"))))
    return bind(F.slice(F.array_sort(pairs), 1, k), lambda top: bind(exps(top), lambda e: weigh(top, e)))


def top_indices(logits: Column, k: int) -> Column:
    """The experts of `topk` alone."""
    pairs = F.transform(logits, lambda x, j: F.struct((-x).alias("neg"), j.cast("long").alias("expert")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["expert"])
