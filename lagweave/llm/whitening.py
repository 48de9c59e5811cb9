"""Whitening of embeddings: leading principal components of the distinct vectors, scaled to unit variance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, written
from .eigen import leading

#: x = floor(SCALE * entry) + SHIFT; components at most; eigenvalues below FLAT times the largest are rounding, not variance.
SCALE, SHIFT, COMPONENTS, FLAT = 64, 1_000_000, 16, 1e-12
#: Rows that a worker turns into a matrix at a time, and bytes of them.
ROWS, BYTES = 4096, 8 << 20


@dataclass
class Whitening:
    """n vectors of the fit list with their sums; eigenvalues, unit eigenvectors (rows) and the trace of their covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the difference is taken of whole numbers, so S / n isn't rounded first."""
        if self.n * float(np.abs(x).max(initial=0)) < 2**62:
            return (self.n * x - self.sums) / self.n
        return x - self.sums / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; None where it needs more than 63 bits."""
        if ((self.n * self.centred(x)) ** 2).sum(1).max(initial=0) < 2**62 and self.n * float(np.abs(x).max(initial=0)) < 2**62:
            return ((self.n * x - self.sums) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 2**63 else None for v in exact]


def whole_numbers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift)


def usable(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x of rows whose vector has entries that are all finite and, scaled, whole numbers below 2**53."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale + shift < 2**53))
    there = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fits, F.lit(False))
    return vectors.where(there).select("vec_id", whole_numbers(F.col("embedding"), scale, shift).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ()) -> Iterator[tuple]:
    for rows in in_slices(batches, ROWS, BYTES):
        if rows.num_rows:
            yield rows["x"].flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1), *[rows[c] for c in columns]


def added_up(fit_list: DataFrame, part, places: int, whole: bool = False) -> tuple[np.ndarray, int]:
    """Sum over the fit list of part(matrix), a vector of `places` numbers: every task adds its rows, then the tasks' numbers are added place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for (x,) in matrices(batches):
            found = part(x)
            total, n = found if total is None else total + found, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(places), pa.int64()), pa.array(total, kind), pa.array([n] + [0] * (places - 1), pa.int64())], ["place", "v", "n"])

    kind = pa.int64() if whole else pa.float64()
    sums = fit_list.mapInArrow(run, f"place long, v {'long' if whole else 'double'}, n long").groupBy("place").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = sorted(sums.collect())  # `places` rows
    return np.array([r["v"] for r in got]), sum(r["n"] for r in got)


def fit(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """Components from the list of distinct x vectors, all of it: their sums first, then the covariance centred by the mean.

    Copies of a vector meet before they are shuffled, and the list is written, as three passes read it. A task holds a
    few thousand rows and one matrix; the driver a matrix of as many places as the vectors squared, whatever their number. Components
    whose eigenvalue is below FLAT times the largest have no variance but rounding's, and are left out. Vectors of
    several widths are an error: they aren't in one space.
    """
    fit_list = written(usable(vectors, scale, shift).select("x").distinct(), "distinct-vectors")
    widths = fit_list.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of {widths[0]} to {widths[1]} numbers can't be whitened together")
    width = widths[0] or 0
    if not width:
        return Whitening(0, np.zeros(0, "i8"), np.zeros(0), np.zeros((0, 0)), 0.0)
    sums, n = added_up(fit_list, lambda x: x.sum(0), width, whole=True)
    centred = Whitening(n, sums, np.zeros(0), np.zeros((0, width)), 0.0).centred
    scatter = lambda x: ((c := centred(x)).T @ c).ravel()
    covariance = added_up(fit_list, scatter, width * width)[0].reshape(width, width) / n
    values, components = leading((covariance + covariance.T) / 2, k)
    varied = values > FLAT * max(values.max(initial=0), 0)
    model = Whitening(n, sums, values[varied], components[varied], float(np.trace(covariance)))
    model.identity_error = identity_error(fit_list, model)
    return model


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry, in size, of the whitened list's covariance less the identity: measured on all rows, centred by their mean."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = added_up(fit_list, lambda x: model.project(x).sum(0), k)[0] / model.n
    scatter = lambda x: ((c := model.project(x) - mean).T @ c).ravel()
    return float(np.abs(added_up(fit_list, scatter, k * k)[0].reshape(k, k) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, whitened (an array with a number for each component, by falling eigenvalue) and deviation of every usable row.

    The components go to the tasks, which bounds them by width times components; rows aren't shuffled. Rows whose
    vector is null, empty, or has null, non-finite or unscalable entries go; repeated rows and null ids come out each; where the
    fit list has fewer than two vectors the arrays are empty. Empty tables give no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in matrices(batches, ("vec_id",)):
            found = model.project(x)
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([ids, whitened, pa.array(model.deviation(x), pa.int64())], ["vec_id", "whitened", "deviation"])

    rows = usable(vectors, scale, shift)
    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, whitened array<double>, deviation long")


def components(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row a vector and component, with the component's share of the variance and the fit's figures."""
    share = F.array(*[F.lit(float(v)) for v in model.values / (model.trace or 1.0)])
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
