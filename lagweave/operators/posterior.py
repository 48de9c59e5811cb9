"""Nonlinear class posteriors in numpy: random cosine features under a ridge softmax. `fit` is for a few thousand rows, `whole` for any number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Cosine features, their scales, the ridges that are tried (the strongest first), rounds for each, and states of a codebook.
FEATURES, SCALES, RIDGES, ROUNDS, STATES = 96, (0.7, 2.0), (1.0, 0.1, 0.01, 0.001), 30, 32
#: A direction with less than this share of the largest one's spread is left out.
FLAT = 1e-6
#: Rows that are scored together.
TOGETHER = 256


@dataclass
class Posterior:
    """Standardised numbers and cosines of random projections of them, then a linear softmax; prior where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    ridge: float
    loss: float  # mean on the rows held out to choose the ridge

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) * self.scale
        return np.concatenate([np.ones((len(z), 1)), z, np.cos(z @ self.projection + self.phase)], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class shares of each row, `TOGETHER` rows at a time, whose cosines stay in the processor's cache."""
        wide, out = 1 + x.shape[1], np.empty((len(x), self.weights.shape[1]))
        for at in range(0, len(x), TOGETHER):
            z = (x[at : at + TOGETHER] - self.mean) * self.scale
            out[at : at + TOGETHER] = softmax(self.weights[0] + z @ self.weights[1:wide] + np.cos(z @ self.projection + self.phase) @ self.weights[wide:])
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def share(onehot: np.ndarray) -> np.ndarray:
    """Class shares, none of them 0."""
    s = np.maximum(onehot.sum(0), 1e-3)
    return s / s.sum()


def descended(z: np.ndarray, spread: np.ndarray, onehot: np.ndarray, ridge: float, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of a ridge softmax beside the class shares: accelerated steps, each direction's by its bound on the curvature.

    The columns of z are orthogonal, at least over all rows, with these sums of squares; the softmax bends by half of that at most.
    """
    n, w, ahead, offset = len(z), start, start, np.log(share(onehot))
    bound = (0.5 * spread / n + ridge)[:, None]
    for k in range(rounds):
        step = ahead - (z.T @ (softmax(z @ ahead + offset) - onehot) / n + ridge * ahead) / bound
        ahead, w = step + k / (k + 3) * (step - w), step
    return w


def mean_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())


def blank(mean: np.ndarray, std: np.ndarray, classes: int, seed: int, features: int, conditions: int) -> Posterior:
    """Standardisation and random cosines, without weights yet."""
    rng, d = np.random.default_rng(seed), len(mean)
    varied = std > 1e-9 * np.maximum(np.abs(mean), 1e-9)
    projection = rng.normal(size=(d, features)) * np.resize(SCALES, features) / np.sqrt(max(d - conditions, 1))
    scale = np.where(varied, 1 / np.where(varied, std, 1), 0)
    if conditions:
        scale[-conditions:] = 1
        projection[-conditions:] = rng.uniform(-np.pi, np.pi, (conditions, features))
    return Posterior(mean, scale, projection, rng.uniform(0, 2 * np.pi, features), np.zeros((1 + d + features, classes)), np.inf, np.inf)


def fit(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 0, features: int = FEATURES, conditions: int = 0) -> Posterior:
    """P(y | x) of rows x [n, d] with labels 0..classes-1.

    The last `conditions` columns tell apart cases of one model, one column a case: they shift the cosines' phases, whatever the
    number of cases, and so bend each case's posterior another way.

    Every fifth row chooses the ridge, and the weights are then learned from all rows. Where no ridge beats the class shares on
    those rows, or a class is alone, the posterior is the class shares.
    """
    n, found = len(x), blank(x.mean(0), x.std(0), classes, seed, features, conditions)
    onehot, raw = np.eye(classes)[y], found.features(x)[:, 1:]
    center = raw.mean(0)
    values, basis = np.linalg.eigh((raw - center).T @ (raw - center))
    kept = values > FLAT * max(values.max(initial=0), 1e-3)
    values, basis = values[kept], basis[:, kept]
    z, hold = (raw - center) @ basis, np.arange(n) % 5 == 4
    w = np.zeros((len(values), classes))
    found.weights[0] = np.log(share(onehot))
    if len(values) and hold.any():
        seen = share(onehot[~hold])
        found.loss = mean_loss(np.tile(seen, (int(hold.sum()), 1)), y[hold])
        for ridge in RIDGES:
            w = descended(z[~hold], values * (~hold).mean() * 1.25, onehot[~hold], ridge, w)
            loss = mean_loss(softmax(z[hold] @ w + np.log(seen)), y[hold])
            if loss < found.loss - 1e-6:
                found.loss, found.ridge = loss, ridge
    if np.isfinite(found.ridge):
        outer = basis @ descended(z, values, onehot, found.ridge, np.zeros_like(w), 2 * ROUNDS)
        found.weights[0] -= center @ outer
        found.weights[1:] = outer
    return found


def codebook(p: np.ndarray, states: int = STATES, rounds: int = 12, weight: np.ndarray | None = None) -> np.ndarray:
    """At most `states` posteriors that stand for the rows p [n, k], which may have weights, with little divergence: nearest-mean rounds from spread-out starts."""
    centers = p[:1]
    least = divergences(p, centers)[:, 0]
    while len(centers) < states and least.max() > 1e-6:
        centers = np.concatenate([centers, p[[least.argmax()]]])
        least = np.minimum(least, divergences(p, centers[-1:])[:, 0])
    for _ in range(rounds):
        of = divergences(p, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, p if weight is None else p * weight[:, None])
        filled = np.bincount(of, minlength=len(centers)) > 0
        centers = sums[filled] / sums[filled].sum(1, keepdims=True)
    return centers


def divergences(p: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """KL(row || center) in nats."""
    own = (p * np.log(np.maximum(p, 1e-300))).sum(1, keepdims=True)
    return own - p @ np.log(np.maximum(centers, 1e-12)).T
