"""WARC archives: one-stream gzip files are inflated once and rewritten a member a record, with an offset index."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, in_slices, lookup, new_path, one_task_each, written

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
LEVEL, CHUNK = 3, 1 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, size long, record_id string"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(page or 0) % 2**64)}>"


def page_of(identifier: str | None) -> int | None:
    if not identifier:
        return None
    n = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    return n - 2**64 if n >= 2**63 else n


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's headers alone, which tell the payload's length."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += ["X-Page: none"] if page is None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in chunks of at most CHUNK bytes, read once."""
    state = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if part := state.decompress(data, CHUNK):
                yield part
            data = state.unconsumed_tail
            if state.eof:
                data, state = state.unused_data, zlib.decompressobj(31)
    yield state.flush()


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, blank lines included, of a stream of any chunks."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise_file(source: str, target: str) -> list[tuple[int, int, str]]:
    """Rewrite one archive, each record its own member; writes TARGET.idx and returns (offset, size, record id)."""
    fs, at = file_system(source)
    found, offset = [], 0
    with fs.open_input_stream(at, compression=None) as stream, fs.open_output_stream(file_system(target)[1], compression=None) as out:
        for whole in split_records(inflate(stream)):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(whole) + packer.flush()
            found.append((offset, len(member), headers(whole[: whole.find(b"\r\n\r\n")])["warc-record-id"]))
            out.write(member)
            offset += len(member)
    with fs.open_output_stream(file_system(target)[1] + ".idx", compression=None) as out:
        out.write("".join(f"{a}\t{n}\t{i}\n" for a, n, i in found).encode())
    return found


def refers(pages: DataFrame) -> DataFrame:
    """digest, the page that is the response, and the number of pages, of equal payloads that are long enough."""
    return pages.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """A one-stream gzip archive for each task; returns the files' names. Pages with equal long payloads refer to the largest page_id.

    Null html is an empty payload, null url a placeholder. Only digests that occur twice go into the join; it
    is broadcast by Spark only if its written size is below the session's limit, else salted.
    """
    html = F.coalesce("html", F.lit(""))
    digested = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    marked = lookup(digested, written(refers(digested), "refers"), "digest", "n")
    long = F.col("bytes") >= LEAST_REVISIT
    rows = marked.select("page_id", "url", "html", "digest", F.when(long & (F.col("response") != F.col("page_id")), F.col("response")).alias("refers_to"))

    def write(batches):
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        name, count, packer = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for part in in_slices(batches):
                for r in part.to_pylist():
                    out.write(packer.compress(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])))
                    count += 1
            out.write(packer.flush())
        if count:
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"]})

    return written(rows.mapInArrow(write, "file string"), "archives")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """The index of the rewritten archives: one task a file, as a stream is inflated from its start. The driver sees the files' names."""

    def rewrite(batches):
        for rows in batches:
            for source in rows["file"].to_pylist():
                fs, at = file_system(folder)
                fs.create_dir(at, recursive=True)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                found = normalise_file(source, target)
                for k in range(0, len(found), 10_000):
                    a, n, i = zip(*found[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([target] * len(a)), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(i)], ["file", "offset", "size", "record_id"])

    names = sorted((r["file"],) for r in files.collect())
    return written(one_task_each(files.sparkSession, names, "file string").mapInArrow(rewrite, INDEX), "index")


def parse(member: bytes) -> dict:
    """A record read from its own member; the digest is checked against the payload where there is one."""
    whole = zlib.decompress(member, 31)
    end = whole.find(b"\r\n\r\n")
    h, block = headers(whole[:end]), whole[end + 4 : -4]
    stop = block.find(b"\r\n\r\n")
    payload, length = block[stop + 4 :], int(headers(block[:stop])["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't match its digest")
    page = None if h.get("x-page") == "none" else page_of(h["warc-record-id"])
    return {"page_id": page, "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": page_of(h.get("warc-refers-to"))}


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, read at its offset."""

    def read(batches):
        for rows in in_slices(batches):
            found, name, stream = [], None, None
            for r in rows.to_pylist():
                if r["file"] != name:
                    fs, at = file_system(name := r["file"])
                    stream = fs.open_input_file(at)
                found.append(parse(stream.read_at(r["size"], r["offset"])))
            yield pa.RecordBatch.from_pylist(found, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return index.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives, rewrite them a member a record, and read them back through the index.

    One row a page, repeated rows too (rows of one page_id with one payload don't refer to themselves). Null
    page_ids are responses unless another page has their payload. An empty table gives no rows; extra columns are ignored.
    """
    return read_archives(normalise(write_archives(pages, new_path(spark, "monolithic")), new_path(spark, "warc")))
