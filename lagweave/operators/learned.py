"""Decomposition from class posteriors: fitted or counted posteriors, couplings of minibatches, and the four terms."""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions.arrays import equal_width_bin, kl, row_mean
from lagweave.sources.storage import dealt, written

from .coupling import coupling, joint_information
from .posterior import Posterior

SMOOTH = 1e-8


def hist_posterior(df: DataFrame, state: Sequence[str], y: str, classes: int, to: str = "posterior") -> DataFrame:
    """One row a state with P(y | state) for y = 0..classes-1, counts smoothed by 1e-8."""
    counts = [F.count_if(F.col(y) == k).cast("double") for k in range(classes)]
    one = df.groupBy(*state).agg(F.array(*counts).alias("_n"))
    total = F.aggregate("_n", F.lit(classes * SMOOTH), lambda s, x: s + x)
    return one.select(*state, F.transform("_n", lambda x: (x + SMOOTH) / total).alias(to))


#: Rows that a posterior is fitted on, at most: those with the least hash.
FITTED = 4096


def posterior_model(df: DataFrame, features: str, y: str, classes: int, rows: int = FITTED, seed: int = 0) -> Posterior | None:
    """A nonlinear posterior of y on a feature array, fitted in one task on at most `rows` rows that have both; None where no row has."""
    from .posterior import fit

    some = df.where(F.col(features).isNotNull() & F.col(y).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(y).cast("long").alias("y"))
    drawn = some.orderBy(F.xxhash64(F.lit(seed), "x", "y"), "x", "y").limit(rows)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(fit(np.stack(frame["x"].to_numpy()), frame["y"].to_numpy(), classes, seed))]})

    found = drawn.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(learn, "model binary").first()
    return found and pickle.loads(found["model"])


def with_posterior(df: DataFrame, model: Posterior | None, features: str, classes: int, to: str = "posterior") -> DataFrame:
    """df with the model's class posterior as an array; null where there are no features or no model."""

    @F.pandas_udf("array<double>")
    def predict(x: pd.Series) -> pd.Series:
        out = np.full(len(x), None, object)
        there = np.flatnonzero(x.notna().to_numpy() & (model is not None))
        for k, p in zip(there, model.predict(np.stack(x.to_numpy()[there])) if len(there) else (), strict=True):
            out[k] = p
        return pd.Series(out)

    return df.withColumn(to, predict(F.col(features).cast("array<double>")))


def fit_posterior(df: DataFrame, features: str, y: str, classes: int, to: str = "posterior", train: Column | None = None, **options) -> DataFrame:
    """df with a class posterior as an array: random cosine features under a ridge softmax, fitted on a bounded sample of the training rows."""
    return with_posterior(df, posterior_model(df if train is None else df.where(train), features, y, classes, **options), features, classes, to)


def with_prior(df: DataFrame, y: str, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """df with the class shares of its group, or of all rows, as an array."""
    found = df.groupBy(*keys).agg(F.array(*[F.count_if(F.col(y) == k) / F.count("*") for k in range(classes)]).alias("prior"))
    if keys:
        return df.join(found, list(keys))
    return df.withColumn("prior", F.array(*[F.lit(x) for x in found.first()["prior"] or [0.0] * classes]))


def mi_from_posterior(df: DataFrame, keys: Sequence[str], posterior: str, of: str = "prior", unit: str = "bits") -> DataFrame:
    """keys, mi: mean divergence of the posterior from the prior."""
    scale = 1 / math.log(2) if unit == "bits" else 1.0
    return df.groupBy(*keys).agg((F.avg(kl(F.col(posterior), F.col(of))) * scale).alias("mi"))


def cross_entropy(df: DataFrame, keys: Sequence[str], posterior: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(-F.log(F.get(posterior, F.col(y).cast("int")))).alias("loss"))


#: Minibatches of a task, rows of all of them where there are very many, and numbers of the systems that it solves together.
TASK, ROWS, TOGETHER = 16, 32_768, 2_000_000
#: The duality gap in nats that ends a minibatch.
STOP = 1e-7


def batch_joint(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """[y, i, j]: independent within each class, with rows P(y | x1_i) and columns P(y | x2_j) rescaled to the rows' class mass.

    Rows with equal posteriors are one row of their joint weight: that changes no information, and counted
    posteriors take only as many values as there are states.
    """
    (u1, n1), (u2, n2) = (np.unique(p, axis=0, return_counts=True) for p in (p1, p2))
    rows, columns = (u1 * n1[:, None]).T / len(p1), (u2 * n2[:, None]).T / len(p2)
    mass = rows.sum(1, keepdims=True)
    columns = columns / np.maximum(columns.sum(1, keepdims=True), 1e-300) * mass
    joint = rows[:, :, None] * columns[:, None, :] / np.maximum(mass, 1e-300)[:, :, None]
    return joint / joint.sum()


def solved(joints: list[np.ndarray], stop: float = STOP) -> pd.DataFrame:
    """i_start, i_q, gap, rounds and off of joints that may differ in shape: empty rows and columns fill them up, and change nothing."""
    p = np.zeros((len(joints), *np.max([x.shape for x in joints], 0)))
    for k, x in enumerate(joints):
        p[k, : x.shape[0], : x.shape[1], : x.shape[2]] = x
    q, rounds, gap = coupling(p, stop)
    i_start, i_q = joint_information(p), joint_information(q)
    kept = i_q > i_start  # no more than rounding told them apart: the start, a coupling too, is then the answer
    q[kept], i_q[kept] = p[kept], i_start[kept]
    off = np.maximum(np.abs(q.sum(3) - p.sum(3)).max((1, 2)), np.abs(q.sum(2) - p.sum(2)).max((1, 2)))
    return pd.DataFrame({"i_start": i_start, "i_q": i_q, "gap": gap, "rounds": rounds, "off": off})


def system(joint: np.ndarray) -> int:
    """Numbers that a round works on for one joint."""
    k, m, n = joint.shape
    return k * k * n * (m + n)


def batch_couplings(df: DataFrame, keys: Sequence[str], p1: str = "p1", p2: str = "p2", batch: str = "batch_id", stop: float = STOP) -> DataFrame:
    """keys, batch, rows, i_start, i_q, gap (nats), rounds, off: each minibatch's least information over couplings with the posteriors'
    margins, at most `gap` above the true one, and how far the margins are off.

    A minibatch's posteriors are gathered into arrays, which its size bounds; a task solves `TASK` batches, or more with up to `ROWS` rows.
    """
    types, by = dict(df.dtypes), [*keys, batch]

    def solve(frames):
        for frame in frames:
            done, joints, size = 0, [], 1
            for k, (a, b) in enumerate(zip(frame["_p1"], frame["_p2"], strict=True)):
                one = batch_joint(np.stack(a), np.stack(b))
                if joints and max(size, system(one)) * (len(joints) + 1) > TOGETHER:
                    yield pd.concat([frame.iloc[done:k][[*by, "rows"]].reset_index(drop=True), solved(joints, stop)], axis=1)
                    done, joints, size = k, [], 1
                joints.append(one)
                size = max(size, system(one))
            if joints:
                yield pd.concat([frame.iloc[done:][[*by, "rows"]].reset_index(drop=True), solved(joints, stop)], axis=1)

    arrays = df.select(*by, p1, p2).groupBy(*by).agg(F.count("*").alias("rows"), F.collect_list(p1).alias("_p1"), F.collect_list(p2).alias("_p2"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", rows long, i_start double, i_q double, gap double, rounds long, off double"
    return dealt(arrays, TASK, "batches", F.col("rows"), ROWS).mapInPandas(solve, schema)


def decompose_learned(df: DataFrame) -> DataFrame:
    """i1, i2, i12, iq as R, U1, U2, S, none below zero, and their sum as MI."""
    low = lambda c: F.greatest(F.lit(0.0), c)
    i1, i2, i12, iq = (F.col(c) for c in ("i1", "i2", "i12", "iq"))
    terms = df.withColumns({"R": low(i1 + i2 - iq), "U1": low(iq - i2), "U2": low(iq - i1), "S": low(i12 - iq)})
    return terms.withColumn("MI", F.col("R") + F.col("U1") + F.col("U2") + F.col("S"))


def learned_terms(df: DataFrame, keys: Sequence[str], classes: int, y: str = "y") -> DataFrame:
    """keys, i1, i2, i12, iq, gap (the greatest of a minibatch, in bits like all) and the terms, from rows with posteriors p1, p2, p12 and a
    batch_id, and class shares `prior` or else the rows' own."""
    keyed = keys or ["_all"]
    rows = (df if "prior" in df.columns else with_prior(df, y, classes, keys)).withColumn("_all", F.lit(0))
    parts = rows.groupBy(*keyed).agg(*[(F.avg(kl(F.col(p), F.col("prior"))) / math.log(2)).alias(i) for p, i in (("p1", "i1"), ("p2", "i2"), ("p12", "i12"))])
    q = batch_couplings(df.withColumn("_all", F.lit(0)), keyed).groupBy(*keyed).agg((F.sum(F.col("i_q") * F.col("rows")) / F.sum("rows") / math.log(2)).alias("iq"), (F.max("gap") / math.log(2)).alias("gap"))
    return decompose_learned(parts.join(q, list(keyed)).drop("_all"))


def reduce_dims(df: DataFrame, features: str, k: int, method: str = "pca", seed: int = 0, to: str = "reduced") -> DataFrame:
    """At most k numbers (pca) or one state of k (cluster) from a feature array; narrow arrays stay as they are."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = df.select(F.max(F.size(features))).first()[0] or 0
    if width <= k:
        return df.withColumn(to, F.col(features))
    rows = df.withColumn("_v", array_to_vector(F.col(features)))
    rows = StandardScaler(inputCol="_v", outputCol="_z", withMean=True).fit(rows).transform(rows)
    if method == "pca":
        return PCA(k=k, inputCol="_z", outputCol="_p").fit(rows).transform(rows).withColumn(to, vector_to_array("_p")).drop("_v", "_z", "_p")
    return KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="_c").fit(rows).transform(rows).withColumn(to, F.array(F.col("_c").cast("double"))).drop("_v", "_z", "_c")


def reduction(width: int, method: str = "auto") -> str:
    """What is done to two modalities of so many features together before they are counted: nothing, components, or clusters."""
    if method not in ("auto", "none", "pca", "cluster"):
        raise ValueError("method is 'auto', 'none', 'pca' or 'cluster'")
    return method if method != "auto" else "cluster" if width > 20 else "pca" if width > 10 else "none"


def state_of(df: DataFrame, features: str, method: str, k: int, to: str, bins: int = 16, seed: int = 0) -> DataFrame:
    """df with a whole-number state of a feature array: its cluster of k, or the bin of the mean of its k components or, as it is, of its numbers.

    Arrays of at most k features aren't reduced, whatever the method: their state is the bin of their mean. Bins are of equal width between
    the least and the greatest number.
    """
    wide = (df.select(F.max(F.size(features))).first()[0] or 0) > k
    if method == "cluster" and wide:
        return reduce_dims(df, features, k, "cluster", seed, "_s").withColumn(to, F.get("_s", F.lit(0)).cast("long")).drop("_s")
    rows = reduce_dims(df, features, k, "pca", seed, "_s") if method == "pca" and wide else df.withColumn("_s", F.col(features))
    rows = written(rows, "reduced")
    edges = rows.agg(F.min(F.array_min("_s")), F.max(F.array_max("_s"))).first()
    return rows.withColumn(to, equal_width_bin(row_mean(F.col("_s")), F.lit(edges[0]), F.lit(edges[1]), bins)).drop("_s")


def reduced_hist(df: DataFrame, keys: Sequence[str], x1: str, x2: str, y: str, max_lag: int, method: str = "auto", k: int = 5, bins: int = 16, seed: int = 0) -> DataFrame:
    """method, lag, b1, b2, yb, n: joint counts of two vector columns of series (keys, i, n) after reduction, at lags 0..max_lag.

    The states are made of all rows, written once, and then paired with later labels. `method` is the one that 'auto' chose by both widths.
    """
    from .series import lag_align

    widths = df.agg(F.max(F.size(x1)), F.max(F.size(x2))).first()
    chosen = reduction(sum(w or 0 for w in widths), method)
    rows = df.select(*keys, "i", "n", y, x1, x2).where(F.col(x1).isNotNull() & F.col(x2).isNotNull())
    rows = state_of(state_of(rows, x1, chosen, k, "b1", bins, seed), x2, chosen, k, "b2", bins, seed)
    rows = written(rows.select(*keys, "i", "n", "b1", "b2", F.col(y).cast("long").alias("yb")), "states")
    pairs = lag_align(rows, keys, ["b1", "b2"], "yb", max_lag).where("yb is not null")
    return pairs.groupBy(F.lit(chosen).alias("method"), F.col("lag").cast("long").alias("lag"), "b1", "b2", "yb").agg(F.count("*").alias("n"))
