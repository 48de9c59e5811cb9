"""Token ids in flat binary files in doc_id order, with 64-bit document offsets, read by memory map.

A part has three files: NAME.ids (unsigned 16- or 32-bit integers, little-endian), NAME.offsets (unsigned
64-bit: where each document begins, and the end) and NAME.docs (signed 64-bit doc_id). The base of a part is
the sum of the ids in the parts before it.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import file_system, in_slices, one_task_each

#: How a null doc_id is written.
NO_DOC = -(2**63)
PART = "part int, name string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2, lower: bool = False, vocabulary: int = 50257) -> list[dict]:
    """Encode whole texts in ascending doc_id order and write the files; returns one entry a part, with its base.

    Null texts have the end id alone; null doc_ids come first; rows of one doc_id follow in the table's order and may be
    spread over parts, so a doc_id or null that many rows have is no part of its own. An empty table has no parts. Ids
    take 16 bits where the vocabulary allows. Texts are shuffled and then encoded: compressed they are as small as ids,
    which would have to be written before, as drawing the ranges reads the rows twice. What comes to the driver is a
    name and two counts a part. A task that runs twice writes under another name, and only the named files are read.
    """
    code = "H" if max(vocabulary, end_id + 1) <= 1 << 16 else "I"
    end = array(code, [end_id])

    def write(batches):
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        name, n, count, ids_of = f"{part:06d}-{uuid.uuid4().hex}", 0, 0, bpe.encoder(path, lower, code).encode
        with fs.open_output_stream(f"{at}/{name}.ids") as ids, fs.open_output_stream(f"{at}/{name}.docs") as names, fs.open_output_stream(f"{at}/{name}.offsets") as starts:
            for rows in in_slices(batches):
                names.write(np.array([NO_DOC if x is None else x for x in rows["doc_id"].to_pylist()], "<i8").tobytes())
                begins = []
                for text in rows["text"].to_pylist():
                    begins.append(n)
                    ids.write(found := ids_of(text) + end.tobytes())
                    n += len(found) // end.itemsize
                starts.write(np.array(begins, "<u8").tobytes())
                count += len(begins)
            starts.write(np.array([n], "<u8").tobytes())
        if count:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [count], "n_tokens": [n]})

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    parts = sorted((r.asDict() for r in ordered.mapInArrow(write, PART).collect()), key=lambda r: r["part"])
    bases = np.cumsum([0, *(p["n_tokens"] for p in parts)])
    return [p | {"base": int(b), "folder": folder, "width": end.itemsize} for p, b in zip(parts, bases, strict=False)]


def mapped(folder: str, name: str, width: int) -> tuple[Callable[[int, int], np.ndarray], np.ndarray, np.ndarray]:
    """ids from one place to another, offsets and doc_ids of a part: memory maps where the store is a file system of the machine, else ranges are read."""
    fs, at = file_system(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        ids, offsets, docs = (np.memmap(f"{at}/{name}.{kind}", dtype, "r") for kind, dtype in (("ids", f"<u{width}"), ("offsets", "<u8"), ("docs", "<i8")))
        return lambda a, b: ids[a:b], offsets, docs
    ids, offsets, docs = (fs.open_input_file(f"{at}/{name}.{kind}") for kind in ("ids", "offsets", "docs"))
    return lambda a, b: np.frombuffer(ids.read_at((b - a) * width, a * width), f"<u{width}"), np.frombuffer(offsets.read(), "<u8"), np.frombuffer(docs.read(), "<i8")


def read_token_files(spark: SparkSession, parts: list[dict]) -> DataFrame:
    """doc_id, start (over all parts), n_tokens and the checksum of the ids as 32-bit integers, from the files; one task a part."""
    schema = "part int, name string, n_docs long, n_tokens long, base long, folder string, width int"
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for rows in batches:
            for p in rows.to_pylist():
                between, offsets, docs = mapped(p["folder"], p["name"], p["width"])
                offsets = np.asarray(offsets).astype("i8")
                for at in range(0, len(docs), 1024):
                    doc, ends = np.asarray(docs[at : at + 1024]), offsets[at : at + 1025]
                    crc = [zlib.crc32(between(a, b).astype("<u4")) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_DOC), pa.array(ends[:-1] + p["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [tuple(p[f.strip().split()[0]] for f in schema.split(",")) for p in parts]
    return one_task_each(spark, rows, schema).mapInArrow(read, out)
