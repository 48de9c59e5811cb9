"""SimHash near-duplicates: fingerprints linked at few differing bits, found through segment popcounts.

A fingerprint has 32 segments of two bits; their popcounts (0, 1 or 2) are a point of a 32-dimensional grid.
The Manhattan distance of two points is at most the number of differing bits. So of two fingerprints with at
most three differing bits, one half of the point (16 segments) is at distance 0 or 1: the same grid cell or
a neighbouring one. Each half's cell, and each neighbour one step up, is a key of the range join; within a
key the whole Manhattan distance is checked first and the bits last.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, map_slices, written

#: Differing bits that the half-cells can find: the halves' distances add up to this at most.
MOST_BITS = 3
#: Fingerprints of a cell that one task compares; a fuller cell is compared in pairs of blocks.
BLOCK = 1024
#: Fingerprints that one task turns into keys: they are a few bytes, their 26 keys each are not.
SPREAD = 20_000
EVEN_BITS = 0x5555555555555555


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64 bits, unsigned; zero for a text without words."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return 0
    line, size = b" ".join(parts), min(words, len(parts))
    lengths = np.fromiter(map(len, parts), "i8", len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")
    set_bits = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[at : at + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, others: str = "") -> DataFrame:
    """doc_id and fp (the bits as a signed long) of every row, and other long columns; null and empty texts have zero."""
    others = others.split()

    def compute(rows) -> dict:
        bits = np.array([fingerprint(t, words) for t in rows["text"].to_pylist()], "u8")
        return {"doc_id": rows["doc_id"], "fp": bits.view("i8")} | {c: rows[c] for c in others}

    return map_slices(docs.select("doc_id", "text", *others), compute, ", ".join(f"{c} long" for c in ("doc_id", "fp", *others)))


def half_popcounts(fp: Column, half: int) -> Column:
    """Two bits for each of the half's 16 segments: how many of its bits are set."""
    bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))


def grid_keys(groups: DataFrame) -> DataFrame:
    """(cell, step, fp): the cell of each half (step 0) and its neighbours one up in one segment (step 1).

    A cell holds the half in bit 32. A pair at distance one meets where one has step 1; a pair at distance
    zero meets at step 0.
    """
    keys = []
    for half in (0, 1):
        cell = half_popcounts(F.col("fp"), half) + F.lit(half << 32)
        keys.append(F.struct(cell.alias("cell"), F.lit(0).alias("step")))
        keys += [F.when(F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3)) < 2, F.struct((cell + F.lit(1 << 2 * k)).alias("cell"), F.lit(1).alias("step"))) for k in range(16)]
    return groups.select("fp", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.cell", "k.step", "fp")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link a node: to the smallest of its component."""
    nodes, k = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = k[: len(a)], k[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def popcounts_of(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(EVEN_BITS))


def manhattan(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of the 32 segments' differences of two packed points."""
    low, total = np.uint64(0x3333333333333333), 0
    for shift in (0, 2):
        x, y = ((v >> np.uint64(shift)) & low for v in (p, q))  # a segment in each four bits
        d = (x | np.uint64(0x8888888888888888)) - y  # 8 + x - y in each four bits
        for k in range(0, 64, 4):
            total = total + np.abs(((d >> np.uint64(k)) & np.uint64(15)).astype("i1") - 8)
    return total


def links_of_runs(run: np.ndarray, step: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (sorted), as a spanning set; work is the pairs of each run, memory is not."""
    alive, found_a, found_b, held = np.arange(len(run)), [], [], 0
    for d in range(1, len(run)):
        alive = alive[: np.searchsorted(alive, len(run) - d)]
        alive = alive[run[alive + d] == run[alive]]
        if not len(alive):
            break
        pairs = alive[(step[alive] & step[alive + d]) == 0]
        a, b = fp[pairs], fp[pairs + d]
        near = np.bitwise_count(popcounts_of(a) ^ popcounts_of(b)) <= 2 * bits  # a difference changes two packed bits at most
        a, b = a[near], b[near]
        near = manhattan(popcounts_of(a), popcounts_of(b)) <= bits
        a, b = a[near], b[near]
        near = (np.bitwise_count(a ^ b) <= bits) & (a != b)
        found_a.append(a[near])
        found_b.append(b[near])
        held += int(near.sum())
        if held > 200_000:
            found_a, found_b = ([x] for x in spanning(np.concatenate(found_a), np.concatenate(found_b)))
            held = len(found_a[0])
    if not found_a:
        return np.array([], "u8"), np.array([], "u8")
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def links(groups: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links between different fingerprints; every pair within `bits` is joined by a path of them.

    Cells with one fingerprint go first, after a count. A cell with more than BLOCK is compared as pairs of
    blocks, each in its own task; links leave a task as a spanning set, never as all pairs of a group.
    The keys are never broadcast: Spark takes them for as small as the fingerprints that they are made of.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be 0 to {MOST_BITS}")
    keys = grid_keys(groups.repartition(max(1, -(-groups.count() // SPREAD))))
    full = keys.groupBy("cell").agg(F.count("*").alias("n"), F.min("step").alias("least")).where("n > 1 and least = 0")
    blocks = full.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = keys.hint("merge").join(blocks, "cell").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    dealt = met.select("cell", "step", "fp", F.explode(pairs).alias("p")).select("cell", "p.i", "p.j", "step", "fp")
    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "step")
    names = ["a", "b"]

    def compare(batches):
        kept = None
        for batch in batches:
            rows = [batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "i", "j", "step", "fp")]
            rows = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)) + 1
            cut = change[-1] if len(change) else 0
            kept = [x[cut:] for x in rows]  # the last run may go on in the next batch
            if cut:
                yield out([x[:cut] for x in rows], change)
        if kept is not None:
            yield out(kept, np.array([], "i8"))

    def out(rows: list[np.ndarray], change: np.ndarray):
        run = np.zeros(len(rows[0]), "i8")
        run[change[change < len(run)]] = 1
        a, b = links_of_runs(np.cumsum(run), rows[3], rows[4].astype("i8").view("u8"), bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], names)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, and one node of its component. Large-star and small-star rounds.

    Each round points a node's neighbours at the smallest of them; the rounds end when no root is itself a
    child and no child has two roots. A round's links are written, so its lineage ends there. Hubs are salted.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("root")).distinct(), "links")
    while not (now.groupBy("child").count().where("count > 1").isEmpty() and now.join(now.select(F.col("child").alias("root")), "root", "left_semi").isEmpty()):
        both = now.union(now.select("root", "child"))
        least = both.groupBy("child").agg(F.least(F.min("root"), F.col("child")).alias("m"), F.count("*").alias("n"))
        large = lookup(both, written(least, "least"), "child", "n").where("root > child").select(F.col("root").alias("child"), F.col("m").alias("root")).where("child <> root").distinct()
        large = written(large, "large")
        least = large.groupBy("child").agg(F.min("root").alias("m"), F.count("*").alias("n"))
        small = lookup(large, written(least, "least"), "child", "n").select(F.explode(F.array(F.struct(F.col("root").alias("child"), F.col("m").alias("root")), F.struct("child", F.col("m").alias("root")))).alias("e")).select("e.child", "e.root")
        now = written(small.where("child <> root").distinct(), "links")
    return now.select(F.col("child").alias("node"), "root").union(now.select("root", "root").distinct())


def classes(rows: DataFrame, bits: int) -> DataFrame:
    """fp, n (rows of it), least (its smallest doc_id) and root (its component) of each fingerprint."""
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    found = written(components(links(groups, bits)), "components").withColumnRenamed("node", "fp")
    return written(groups.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicates(docs: DataFrame, bits: int = MOST_BITS, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row.

    Fingerprints are written once; equal ones are one class with its smallest doc_id, and only classes are
    compared. Texts without words, null among them, have fingerprint zero and are linked like any other.
    A null doc_id is no component's name unless no row of the component has another. Repeated rows come
    out each. An empty table gives no rows; extra columns are ignored.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    named = classes(rows, bits)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    names = lookup(named.select("fp", "root", F.col("n").alias("rows")), written(least, "names"), "root", "n").select("fp", F.col("rows").alias("n"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return lookup(rows, written(names, "named"), "fp", "n").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = MOST_BITS, words: int = 3) -> DataFrame:
    """One row of each component, all columns, whatever their names: that with the smallest doc_id.

    Null doc_ids come after all others; of rows with equal doc_ids one stays, so of repeated rows exactly one does.
    Texts without words are one component. An empty table gives no rows. The rows are written with a number each,
    which then means the same row in every task, and only numbers and fingerprints are compared. The numbers to keep
    grow with the table, so they are never broadcast; each occurs once, so no task gets more than its share.
    """
    held = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "numbered")
    rows = written(fingerprints(held.select("place", "row.doc_id", "row.text"), words, "place"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    best = rows.groupBy("fp").agg(first).join(classes(rows, bits).select("fp", "root"), "fp")
    keep = best.groupBy("root").agg(F.min("first").alias("first")).select("first.place")
    return held.join(written(keep, "kept").hint("shuffle_hash"), "place", "left_semi").select("row.*")
