"""Quality rules: counts over whole texts, and an isolation forest over rates made from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import FITTED, labelled
from .common import map_slices

# Fixed values of the base rules.
BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

UPPER = bytes(range(65, 91))
TREES, SAMPLE, SEED = 100, 256, 5
#: Thresholds between 0 and 1 that are tried.
STEPS = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_next_equal")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    if len(seen := set(windows)) == len(windows):
        return 0
    number = {w: k for k, w in enumerate(seen)}
    ids = np.fromiter(map(number.__getitem__, windows), "i8", len(windows))
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[twice + k] = True
    return int(inside.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; all zero for null."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words, without = data.split(), lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    equal = sum(a == b for a, b in zip(words, words[1:])) if len(set(words)) < len(words) else 0  # noqa: B905
    return (len(words), len(text) - without(BLANKS), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), without(UPPER), equal)


def rates(rows: np.ndarray) -> np.ndarray:
    """What the forest sees of COUNTS: a rate between 0 and 1 for each statistic, so length alone makes no outlier.

    A mean word length has no upper end: it is taken as x² / (x² + 5²); so are symbols a word, as x / (x + 1).
    """
    n, chars, symbols, lines, repeated, upper, equal = rows.T.astype("f8")
    words, chars = np.maximum(n, 1), np.maximum(chars, 1)
    mean = (chars / words) ** 2
    return np.stack([mean / (mean + 25), symbols / (symbols + words), lines / words, repeated / words, upper / chars, equal / words], 1)


def usual_depth(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class Forest:
    """Trees of random splits over small samples; short mean paths mark outliers.

    A split is drawn from the whole of a node's part of the unit cube, not from between its rows: a rate that is the
    same in all rows splits too, and what no row has comes to an early leaf. Cuts may miss the rows, so trees are
    half as deep again as usual.
    """

    def __init__(self, points: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(points))
        self.depth = max(1, int(np.ceil(1.5 * np.log2(max(2, self.size)))))
        self.trees = [self.grow(points[rng.choice(len(points), self.size, replace=False)], rng) for _ in range(trees)]

    def grow(self, points: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """feature, split, child (the left one; the right one follows), path length at a leaf."""
        width = points.shape[1]
        feature, split, child, length, todo = [], [], [], [], [(points, 0, np.zeros(width), np.ones(width))]
        while len(feature) < len(todo):
            rows, depth, low, high = todo[len(feature)]
            if depth < self.depth and len(rows) > 1:
                f = int(rng.integers(width))
                at = rng.uniform(low[f], high[f])
                for x, y in ((feature, f), (split, at), (child, len(todo)), (length, 0.0)):
                    x.append(y)
                cut, left = np.arange(width) == f, rows[:, f] < at
                todo += [(rows[left], depth + 1, low, np.where(cut, at, high)), (rows[~left], depth + 1, np.where(cut, at, low), high)]
            else:
                for x, y in ((feature, 0), (split, np.inf), (child, len(feature)), (length, depth + usual_depth(len(rows)))):
                    x.append(y)
        return np.array(feature), np.array(split), np.array(child), np.array(length)

    def score(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the more of an outlier."""
        total, line = np.zeros(len(points)), np.arange(len(points))
        for feature, split, child, length in self.trees:
            node = np.zeros(len(points), "i8")
            for _ in range(self.depth):
                left = points[line, feature[node]] < split[node]
                node = child[node] + np.where(left | np.isinf(split[node]), 0, 1)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(usual_depth(self.size), 1e-9))


def calibrate(forest: Forest, docs: DataFrame, labels: DataFrame) -> float:
    """The lowest threshold with the largest difference of the shares of bad and good rows above it.

    All labelled rows that pass the base rules count, whatever their length; only their number in each of STEPS
    comes to the driver. Nothing is rejected without good and bad rows.
    """
    quality = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    scored = apply_rules(docs.where("doc_id is not null"), forest, float("inf")).where("not base_failed")
    step = F.ceil(F.col("anomaly") * STEPS).cast("int")
    got = scored.select("doc_id", step.alias("step")).join(quality, "doc_id").groupBy("step", "quality").count().collect()
    n = np.zeros((2, STEPS + 1), "i8")
    for r in got:
        n[r["quality"], r["step"]] = r["count"]
    if not n.sum(1).all():
        return float("inf")
    bad, good = 1 - n.cumsum(1) / n.sum(1)[:, None]
    return int(np.argmax(bad - good)) / STEPS


def train(docs: DataFrame, labels: DataFrame, rows: int = FITTED) -> tuple[Forest | None, float]:
    """Forest and threshold. The trees grow from the good ones of at most so many labelled rows that pass the base rules."""
    some = labelled(docs, labels, rows).where("quality = 1")
    got = map_slices(some, lambda b: {"doc_id": b["doc_id"], "counts": [list(counts(t)) for t in b["text"].to_pylist()]}, "doc_id long, counts array<long>").collect()
    got = sorted((r for r in got if not fails(r["counts"])), key=lambda r: (r["doc_id"], r["counts"]))
    if not got:
        return None, float("inf")
    forest = Forest(rates(np.array([r["counts"] for r in got])))
    return forest, calibrate(forest, docs, labels)


def fails(row: list[int]) -> bool:
    return row[0] < LEAST_WORDS or 100 * row[4] > MOST_REPEATED * row[0]


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def apply_rules(docs: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """The counts, base_failed, the forest's anomaly score and kept for every row.

    Null and empty texts have zero counts and fail the base rules. Without a forest nothing else is rejected.
    Repeated rows and null doc_ids come out each; an empty table gives no rows; extra columns are ignored.
    """

    def measure(rows) -> dict:
        table = np.array([counts(t) for t in rows["text"].to_pylist()])
        score = forest.score(rates(table)) if forest else np.zeros(len(table))
        return {"doc_id": rows["doc_id"], "anomaly": score} | {c: table[:, k] for k, c in enumerate(COUNTS[:5])}

    measured = map_slices(docs.select("doc_id", "text"), measure, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", anomaly double")
    failed = measured.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= threshold)).select("doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly")
