"""Exact duplicates against immutable snapshots: static filters screen new digests, exact buckets and bytes decide.

A store is a row of snapshots that never change once written. Each has the digests that were new when it was made, in buckets, and
a binary-fuse filter for each bucket. A new batch is grouped by itself; its digests then meet the
filters of all snapshots, bucket by bucket, and only those that a filter affirms are looked up in the snapshot's exact bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fuse
from .common import lookup, new_path, written

#: Digests of a bucket of one snapshot, about: a task holds a bucket and its filters. Buckets at least, so that small tables spread too.
BUCKET, LEAST = 1 << 17, 256
#: Batches that a table is dealt into: all but the first meet snapshots.
BATCHES = 3

FILTER = "bucket long, seed long, length long, segments long, cells binary"


def as_is(text: Column) -> Column:
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keys_of(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest as a number; shorter ones are filled up with zeros."""
    return np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "little") for d in digests.to_pylist()], "u8").view("i8")


class Store:
    """Snapshots of distinct digests under a shared path. The number of buckets holds for the store's whole life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets, self.snapshots = spark, path, buckets, 0

    def read(self, what: str) -> DataFrame:
        """The exact buckets, or the filters, of all snapshots, with the snapshot's number."""
        parts = [self.spark.read.parquet(f"{self.path}/{k}/{what}").withColumn("snapshot", F.lit(k).cast("long")) for k in range(self.snapshots)]
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
        return out

    def screened(self, groups: DataFrame) -> DataFrame:
        """groups (bucket, digest, ..) with the numbers of the snapshots whose filter affirms the digest: all that hold it, and few others."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = groups.withColumn("hits", F.array(F.lit(0).cast("long"))).schema
        arrow = to_arrow_schema(schema)

        def screen(new: pa.Table, filters: pa.Table) -> pa.Table:
            keys, hits = keys_of(new["digest"]), [[] for _ in range(new.num_rows)]
            for row in filters.to_pylist():
                held = fuse.BinaryFuse(row["seed"], row["length"], row["segments"], np.frombuffer(row["cells"], "u1"))
                for k in np.flatnonzero(held.may_hold(keys)) if len(keys) else ():
                    hits[k].append(row["snapshot"])
            return new.append_column("hits", pa.array(hits, pa.list_(pa.int64()))).select(arrow.names).cast(arrow)

        return groups.groupBy("bucket").cogroup(self.read("filters").groupBy("bucket")).applyInArrow(screen, schema)

    def add(self, groups: DataFrame) -> DataFrame:
        """groups (bucket, digest, one row a digest, and more) with `home`, the snapshot that holds the digest.

        Digests that no filter affirms, and those that an exact bucket doesn't confirm, are new: they become the next
        snapshot, with its filters. Both are written before the result is read.
        """
        if self.snapshots:
            groups = written(self.screened(groups), "screened")
            held = self.read("exact").select("snapshot", "bucket", "digest")
            asked = groups.where(F.size("hits") > 0).select("bucket", "digest", F.explode("hits").alias("snapshot"))
            found = written(asked.join(held, ["snapshot", "bucket", "digest"]).select("digest", F.col("snapshot").alias("home")), "found")
            groups = groups.drop("hits").join(found, "digest", "left")
        else:
            groups = groups.withColumn("home", F.lit(None).cast("long"))
        at, number = f"{self.path}/{self.snapshots}", F.lit(self.snapshots).cast("long")
        groups.where("home is null").select("bucket", "digest").repartition("bucket").sortWithinPartitions("bucket", "digest").write.parquet(f"{at}/exact")

        def build(rows: pa.Table) -> pa.Table:
            f = fuse.build(keys_of(rows["digest"]))
            return pa.table({"bucket": rows["bucket"][:1], "seed": [f.seed], "length": [f.length], "segments": [f.segments], "cells": pa.array([f.cells.tobytes()], pa.binary())})

        self.spark.read.parquet(f"{at}/exact").groupBy("bucket").applyInArrow(build, FILTER).write.parquet(f"{at}/filters")
        self.snapshots += 1
        return groups.withColumn("home", F.coalesce("home", number))


def clashing(docs: DataFrame, members: DataFrame, digest: Callable[[Column], Column], normal: Callable[[Column], Column]) -> DataFrame:
    """Digests of more than one text: all texts of every digest that more than one row has, compared by their bytes.

    Only rows of such digests bring their text. Hot digests are dealt out, and equal texts meet in their task before they are shuffled.
    """
    several = members.groupBy("home", "digest").agg(F.sum("n").alias("n")).where("n > 1").groupBy("digest").agg(F.sum("n").alias("n"))
    text = normal(F.coalesce("text", F.lit("")))
    rows = docs.select(text.alias("text")).withColumn("digest", digest(F.col("text")))
    rows = lookup(rows, several.withColumn("several", F.lit(True)), "digest", "n").where("several")
    return rows.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_duplicates(docs: DataFrame, batches: int = BATCHES, normal: Callable[[Column], Column] = as_is, digest: Callable[[Column], Column] = sha256, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: of equal texts the row with the largest doc_id stays.

    The table is dealt by doc_id into batches, which are added to a new store one after the other; in each, equal digests are grouped before
    they are shuffled, so a group of copies is one row. A batch's digest belongs to the snapshot that holds it, or to the one it
    founds; sizes and largest ids add up by snapshot and digest. Then the bytes of all texts whose digest isn't alone
    are compared; should a digest have several texts, its rows are grouped by the texts themselves.

    Null and empty texts are equal. Of rows that repeat both text and doc_id one stays; null doc_ids are smaller than all others, and a
    group of null ids has a null keep_id. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    text = normal(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("place"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"))
    rows = written(rows, "digests")
    store = Store(spark, new_path(spark, "snapshots"), buckets or max(LEAST, -(-rows.count() // BUCKET)))
    members = None
    for k in range(batches):
        own = rows.where(F.col("batch") == k).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "place")).alias("keep"))
        own = own.select(F.pmod(F.xxhash64("digest"), F.lit(store.buckets)).alias("bucket"), "digest", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.place").alias("keep_place"))
        found = store.add(written(own, "groups")).withColumn("batch", F.lit(k).cast("long"))
        members = found if members is None else members.unionByName(found)
    members = written(members.drop("bucket"), "members")
    whole = members.groupBy("home", "digest").agg(F.sum("n").alias("group_size"), F.max(F.struct(F.col("keep_id").alias("doc_id"), F.col("keep_place").alias("place"))).alias("keep"))
    groups = written(members.select("home", "digest", "batch", "n").join(whole, ["home", "digest"]).drop("home"), "classes")
    clash = written(clashing(docs, members, digest, normal), "clashes")
    some = clash.count()
    done = lookup(rows if not some else rows.join(clash, "digest", "left_anti"), groups, ["digest", "batch"], "n")
    done = done.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("keep.place")).alias("kept"), "text_sha256")
    return done.union(by_text(docs, clash, digest, normal)) if some else done


def by_text(docs: DataFrame, clash: DataFrame, digest: Callable[[Column], Column], normal: Callable[[Column], Column]) -> DataFrame:
    """The same columns for rows of clashing digests, grouped by text."""
    text = normal(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text"))).join(clash, "digest", "left_semi")
    w = Window.partitionBy("digest", "text")
    first = F.row_number().over(w.orderBy(F.desc("doc_id")))
    return rows.select("doc_id", F.max("doc_id").over(w).alias("keep_id"), F.count("*").over(w).alias("group_size"), (first == 1).alias("kept"), F.sha2("text", 256).alias("text_sha256"))
