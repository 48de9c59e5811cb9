"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, numpy SGD.

Features of a whole text: each word, each pair of neighbouring words, and each run of 3 or 4 characters in a
word with its bounds. All are hashed into 2**BITS buckets with a learned vector each. As the average goes
straight into the softmax, a bucket's share in the score is one number, so scoring sums one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, sample_of

BITS, SIZE, EPOCHS, RATE, SEED = 18, 8, 5, 1.0, 11
#: Labelled rows that are fitted, at most: those with the smallest hash of doc_id.
FITTED = 2000
#: Longer texts are scored whole, but not fitted: what reaches the driver is at most FITTED times so many characters.
LONGEST = 10_000
#: Characters whose features are made at a time, some hundred bytes each.
CHUNK = 400_000
THRESHOLD = 0.3
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(1_000_003)
BLANKS = np.array([9, 10, 11, 12, 13, 32], "u4")


def bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return (h >> np.uint64(64 - BITS)).astype("i8")


def characters(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, all ASCII white space as a blank, and where they are blank."""
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "u4")
    blank = (x <= 32) & np.isin(x, BLANKS)
    return np.where(blank, 32, x).astype("u8"), blank


def keyed(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a character adds to the hash of its word."""
    return (x + np.uint64(1)) * ((place.astype("u8") + np.uint64(1)) * MIX | np.uint64(1))


def pair_buckets(words: np.ndarray) -> np.ndarray:
    """Of neighbouring words in either order; equal neighbours share one bucket, so repeating any word is one feature. Hashed in order
    instead, pairs of words that no labelled text has say nothing of repeats: held-out accuracy falls from 1.0 to 0.97."""
    return bucket((words[:-1] ^ words[1:]) + np.uint64(7))


def gram_buckets(x: np.ndarray, inner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and begins of the runs of n characters; their bounds may be blank, what is between them not."""
    last = len(x) - n + 1
    valid = inner[1 : 1 + last].copy()
    for k in range(2, n - 1):
        valid &= inner[k : k + last]
    begin = np.flatnonzero(valid)
    h = x[begin] ^ (MIX >> np.uint64(n))
    for k in range(1, n):
        h = h * STEP + x[begin + k]
    return bucket(h), begin


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features and the text each belongs to. Null and empty texts have none."""
    x, blank = characters(" " + " ".join(t or "" for t in texts) + " ")
    ends = np.cumsum([len(t or "") + 1 for t in texts])  # a text's characters and the blank after it
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(starts):
        return np.array([], "i8"), np.array([], "i8")
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    place = np.arange(len(x)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(x)]])))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(blank, 0, keyed(x, place)), dtype="u8")])
    words = sums[stops] - sums[starts]
    of = np.searchsorted(ends, starts - 1, "right")
    together = of[:-1] == of[1:]
    found, owner = [bucket(words), pair_buckets(words)[together]], [of, of[:-1][together]]
    inner, at = ~blank, np.repeat(np.arange(len(texts) + 1, dtype="i4"), np.diff(np.concatenate([[0], ends + 1, [len(x)]])))
    for n in (3, 4):
        h, begin = gram_buckets(x, inner, n)
        found.append(h)
        owner.append(at[begin + 1])
    return np.concatenate(found), np.concatenate(owner)


def long_features(text: str, size: int = CHUNK) -> Iterator[np.ndarray]:
    """The buckets of one text, part by part: the same as `features` gives, with memory for `size` characters."""
    held, held_inner = np.array([], "u8"), np.array([], bool)  # the last three characters
    open_sum, open_place, before = np.zeros(1, "u8"), 0, np.array([], "u8")  # of the word that goes on; the last whole word
    for at in range(0, len(text) + 1, size):
        x, blank = characters(" " * (at == 0) + text[at : at + size] + " " * (at + size > len(text)))
        known = np.concatenate([[open_place == 0], blank])
        starts, stops = np.flatnonzero(known[:-1] & ~known[1:]), np.flatnonzero(~known[:-1] & known[1:])
        begins = np.concatenate([[0], starts]) if open_place else starts
        since = np.concatenate([[0], begins])
        place = np.arange(len(x)) - np.repeat(since, np.diff(np.concatenate([since, [len(x)]])))
        if open_place:
            place[: starts[0] if len(starts) else len(x)] += open_place
        sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(blank, 0, keyed(x, place)), dtype="u8")])
        words = sums[stops] - sums[begins[: len(stops)]]
        goes_on = len(begins) > len(stops)
        rest = sums[-1:] - sums[begins[-1:]] if goes_on else np.zeros(1, "u8")
        if open_place:
            words, rest = (np.concatenate([words[:1] + open_sum, words[1:]]), rest) if len(stops) else (words, rest + open_sum)  # no blank: it still goes on
        open_sum, open_place = rest, int(place[-1]) + 1 if goes_on else 0
        chain = np.concatenate([before, words])
        found, before = [bucket(words), pair_buckets(chain)], chain[-1:]
        x, inner = np.concatenate([held, x]), np.concatenate([held_inner, ~blank])
        for n in (3, 4):
            skip = max(0, len(held) - n + 1)  # runs that ended in the part before
            if len(x) - skip >= n:
                found.append(gram_buckets(x[skip:], inner[skip:], n)[0])
        held, held_inner = x[-3:], inner[-3:]
        yield np.concatenate(found)


def feature_parts(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`features` of texts in parts of about `size` characters; a longer text is a part or more of its own."""
    part: list[int] = []
    long = [k for k, t in enumerate(texts) if t and len(t) > size]
    for k in long:
        for buckets in long_features(texts[k], size):
            yield buckets, np.full(len(buckets), k)
    rest, held = sorted(set(range(len(texts))).difference(long)), 0
    for k in rest:
        part.append(k)
        held += len(texts[k] or "")
        if held > size or k == rest[-1]:
            buckets, of = features([texts[j] for j in part])
            yield buckets, np.array(part)[of]
            part, held = [], 0


@dataclass
class Model:
    """Share of each bucket in the score of label 1, and the bias."""

    shares: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Between 0 and 1; a text without features gets the bias alone."""
        n, total = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, of in feature_parts(texts):
            n += np.bincount(of, minlength=len(texts))
            total += np.bincount(of, self.shares[buckets], len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Stochastic gradient descent over the rows, in a fixed random order. One label alone gives a constant."""
    y = np.array(labels, "i8")
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS), 3.0 if not labels or labels[0] else -3.0)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE))
    out, bias = np.zeros((SIZE, 2)), np.zeros(2)
    rows = []
    for t in texts:
        buckets, counts = np.unique(features([t])[0], return_counts=True)
        rows.append((buckets.astype("i4"), (counts / max(1, counts.sum())).astype("f4")))
    for epoch in range(EPOCHS):
        for done, k in enumerate(rng.permutation(len(rows))):
            rate = RATE * (1 - (epoch * len(rows) + done) / (EPOCHS * len(rows)))
            buckets, share = rows[k]
            hidden = share @ vectors[buckets]
            p = np.exp((z := hidden @ out + bias) - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # each bucket's step is scaled up by the features' spread, else rare ones hardly move
            vectors[buckets] -= rate * 50 * np.outer(share, back)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FITTED) -> DataFrame:
    """doc_id, text and quality of rows that may be learned from, at most so many, one a doc_id (its greatest text).

    Null labels, doc_ids and texts, and texts above LONGEST, are left out; of several labels of a doc_id the greatest
    counts. The bounded set of ids is broadcast; only its texts leave the scan.
    """
    some = sample_of(labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")), rows, "doc_id")
    found = docs.where(F.length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, rows: int = FITTED) -> Model:
    got = sorted(labelled(docs, labels, rows).collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in got], [r["quality"] for r in got])


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    Null and empty texts get the bias's score. Repeated rows and null doc_ids come out each (held_out is null
    for a null doc_id). An empty table gives no rows; extra columns are ignored.
    """

    def score(rows) -> dict:
        return {"doc_id": rows["doc_id"], "score": model.score(rows["text"].to_pylist())}

    scored = map_slices(docs.select("doc_id", "text"), score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, all columns, whatever their names.

    Null and empty texts have the bias's score; repeated rows stay or go together; an empty table gives no rows.
    """
    schema = docs.schema

    def keep(batches):
        import pyarrow as pa

        from .common import in_slices

        for rows in in_slices(batches):
            yield rows.filter(pa.array(model.score(rows["text"].to_pylist()) >= threshold))

    return docs.mapInArrow(keep, schema)
