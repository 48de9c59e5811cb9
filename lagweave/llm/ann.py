"""Nearest neighbours by vantage-point trees, one a shard, pruned by the triangle inequality.

A child is left out where factor * gap exceeds the distance of the worst neighbour found so far; the gap is
what the triangle inequality proves. Factor 1 is exact; a larger factor visits fewer nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, new_path

#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD, BLOCK, LEAF = 4096, 2048, 48
FOUND = "query_id long, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of columns of a and columns of b, summed number by number: the last digit is the same wherever they are computed."""
    total = np.zeros((a.shape[1], b.shape[1]))
    for x, y in zip(a, b, strict=True):
        d = x[:, None] - y[None, :]
        total += d * d
    return np.sqrt(total)


class VantageTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.columns, self.leaf = ids, np.ascontiguousarray(vectors.T), leaf
        self.root = self.build(np.arange(len(ids)))

    def build(self, rows: np.ndarray) -> tuple:
        """(rows,) or (vantage row, near child, far child, their distance ranges). Halves by rank, so ties can't unbalance it."""
        if len(rows) <= self.leaf:
            return (rows,)
        vantage, rest = rows[0], rows[1:]
        far = distances(self.columns[:, [vantage]], self.columns[:, rest])[0]
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        near, away = order[:half], order[half:]
        return vantage, self.build(rest[near]), self.build(rest[away]), (far[near[0]], far[near[-1]]), (far[away[0]], far[away[-1]])

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest (distance, id) of each query but the query's own id; inf and -1 where there are fewer.

        All queries go down together. First each takes the leaf it falls in, for a first bound; then every
        node is visited once by the queries that the bound doesn't rule out.
        """
        best, ids = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, "i8")
        seen, columns = np.zeros(len(queries), "i8"), np.ascontiguousarray(queries.T)
        self.land(self.root, np.arange(len(queries)), own, columns, best, ids, seen)
        self.visit(self.root, np.arange(len(queries)), own, columns, best, ids, seen, factor)
        return best, ids

    def offer(self, rows: np.ndarray, at: np.ndarray, far: np.ndarray, own: np.ndarray, best: np.ndarray, ids: np.ndarray) -> None:
        far = np.where(self.ids[rows] == own[at, None], np.inf, far)
        better = (far.min(1) <= best[at, -1]) & np.isfinite(far.min(1))
        at, far = at[better], far[better]
        if not len(at):
            return
        d = np.concatenate([best[at], far], 1)
        i = np.concatenate([ids[at], np.broadcast_to(self.ids[rows], far.shape)], 1)
        order = np.lexsort((i, d), axis=1)[:, : best.shape[1]]
        line = np.arange(len(at))[:, None]
        best[at], ids[at] = d[line, order], i[line, order]

    def take(self, rows: np.ndarray, at: np.ndarray, own, queries, best, ids) -> None:
        self.offer(rows, at, distances(queries[:, at], self.columns[:, rows]), own, best, ids)

    def gaps(self, node: tuple, far: np.ndarray) -> list[np.ndarray]:
        return [np.maximum(np.maximum(low - far, far - high), 0) for low, high in node[3:]]

    def land(self, node: tuple, at: np.ndarray, own, queries, best, ids, seen) -> None:
        if not len(at):
            return
        if len(node) == 1:
            seen[at] = id(node)
            return self.take(node[0], at, own, queries, best, ids)
        near, away = self.gaps(node, distances(queries[:, at], self.columns[:, [node[0]]])[:, 0])
        self.land(node[1], at[near <= away], own, queries, best, ids, seen)
        self.land(node[2], at[near > away], own, queries, best, ids, seen)

    def visit(self, node: tuple, at: np.ndarray, own, queries, best, ids, seen, factor: float) -> None:
        if not len(at):
            return
        if len(node) == 1:
            return self.take(node[0], at[seen[at] != id(node)], own, queries, best, ids)
        far = distances(queries[:, at], self.columns[:, [node[0]]])[:, 0]
        self.offer(np.array([node[0]]), at, far[:, None], own, best, ids)
        for child, gap in zip(node[1:3], self.gaps(node, far), strict=True):
            # a hair below the proven gap, as distances are rounded
            self.visit(child, at[factor * gap * (1 - 1e-12) - 1e-12 <= best[at, -1]], own, queries, best, ids, seen, factor)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has only finite numbers, not all of them zero, as doubles."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    there = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.where(there & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def blocks(path: str, width: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """vec_id and vectors of the written queries of one width, block by block."""
    fs, at = file_system(path)
    for info in sorted(fs.get_file_info(pa.fs.FileSelector(at)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(size, columns=["vec_id", "embedding"]):
                batch = batch.filter(pc.equal(pc.list_value_length(batch["embedding"]), width))
                if batch.num_rows:
                    yield batch["vec_id"].to_numpy(), batch["embedding"].flatten().to_numpy().reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by Euclidean distance, ties to the smaller vec_id.

    Rows are dealt by hash into shards of about `shard`. A task builds a shard's tree once and then reads the queries,
    which are written to the shared folder, block by block past it: it holds a shard and a block, and only rows of the
    table are shuffled, once. Copies of one vector land in all shards alike. Vectors that are null, zero or not
    finite take no part, nor do rows with a null vec_id; of a repeated vec_id one row (the smallest vector) counts;
    vectors of another length than the query's are not compared. Fewer than k candidates: all of them. Empty
    tables give no rows; extra columns are ignored.
    """
    spread = lambda df: usable(df).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards, path = max(1, -(-vectors.count() // shard)), new_path(vectors.sparkSession, "queries")
    spread(queries).write.parquet(path)
    rows = spread(vectors).select("vec_id", "embedding", F.size("embedding").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "width", "vec_id")

    def answers(held: list[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([b["vec_id"].to_numpy() for b in held])
        tree = VantageTree(ids, np.concatenate([b["embedding"].flatten().to_numpy() for b in held]).reshape(-1, width))
        for own, points in blocks(path, width, block):
            score, near = tree.search(own, points, k, factor)
            there = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, there.sum(1))), pa.array(near[there]), pa.array(score[there])], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            shard_of, width = batch["shard"].to_numpy(), batch["width"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(width) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key is not None and key != (shard_of[a], width[a]):
                    yield from answers(held, int(key[1]))
                    held = []
                key = shard_of[a], width[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from answers(held, int(key[1]))

    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = rows.mapInArrow(search, FOUND).withColumn("rank", best)
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
