"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_slices, written

#: Pieces that are packed together: enough for tight bins, few enough for one task's memory.
GROUP = 2048
SEED = 7
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long"


class Tournament:
    """A complete binary tree over bins; a node holds the largest room below it. All bins start empty."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """Put it in the first bin with room for it: the bin, and the room that was there. O(log bins)."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        there = room[k]
        room[k] = there - size
        at, k = k - self.leaves, k // 2
        while k and room[k] != (most := max(room[2 * k], room[2 * k + 1])):
            room[k] = most
            k //= 2
        return at, there


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, none longer than a bin. Equal lengths go in the order given."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bins[k], there = tree.first_fit(lengths[k])
        offsets[k] = capacity - there
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, lower: bool = True, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, end each with end_id and cut them every `size` ids.

    Null and empty texts have the end id alone; a row with a null doc_id is encoded like any other. place numbers the rows.
    """

    def pieces(batch) -> dict:
        encode, out = bpe.encoder(path, lower).encode, {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "place", "ids")}
        end = end_id.to_bytes(4, "little")
        for doc, text, place in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "place")), strict=True):
            ids = encode(text) + end
            n = len(ids) // 4
            for at in range(0, n, size):
                part = ids[4 * at : 4 * (at + size)]
                row = (doc, at, len(part) // 4, zlib.crc32(part), n, place, np.frombuffer(part, "<u4").astype("i8") if with_ids else None)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    return map_slices(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")), pieces, PIECES + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they are packed at.

    Documents are dealt at random (by a hash of their place in the table) into groups of about `group` pieces, so no
    source, key or group of copies gathers in one task, and each group is packed alone by first-fit decreasing. Pieces of
    exactly `size` ids fill a sequence; they are dealt each for itself, so that a very long document loads no
    group. Repeated rows of a doc_id are packed each; an empty table gives no rows; extra columns are ignored.
    The pieces are written, so texts are encoded once. sequence_id is the group times 2**24 plus the bin.
    """
    pieces = written(token_pieces(docs, path, end_id, size, with_ids=with_ids), "pieces")
    groups = max(1, math.ceil(pieces.count() / group))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "start"], kind="stable")
        bins, rows["offset"] = first_fit_decreasing(rows["length"].tolist(), size)
        rows["sequence_id"] = rows["_group"] * 2**24 + np.array(bins, "i8")
        return rows.drop(columns=["_group", "place"])

    kept = [c for c in pieces.columns if c != "place"]
    schema = ", ".join(f"{c} {dict(pieces.dtypes)[c]}" for c in kept) + ", offset long, sequence_id long"
    alone = F.when(F.col("length") == size, F.col("start")).otherwise(-1)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("place", alone, F.lit(SEED)), F.lit(groups)))
    result = dealt.groupBy("_group").applyInPandas(packed, schema)
    return result.select(*PIECES.replace(", place long", "").replace(" long", "").split(", "), "sequence_id", "offset", *(["ids"] if with_ids else []))
