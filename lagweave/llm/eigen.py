"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, Sturm-count bisection, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo("f8").eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of H A H, and the unit vectors of the reflections that H is made of. A's largest entry is about 1."""
    a, n, reflections = np.array(a, "f8"), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[np.abs(v) < 1e-60] = 0  # else squares underflow, and what comes out is no reflection
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        length = np.linalg.norm(v)
        reflections.append(v := v / length if length else v)
        if length:
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
            low = a[k + 1 :, k + 1 :]
            p = low @ v
            w = 2 * (p - v * (v @ p))
            low -= np.outer(v, w) + np.outer(w, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each x: negative pivots of its shifted factorisation."""
    tiny = EPS * max(np.abs(d).max(), np.abs(e).max(initial=0), EPS)
    q, count = d[0] - x, np.zeros(len(x), "i8")
    count += q < 0
    for k in range(1, len(d)):
        q = d[k] - x - e[k - 1] ** 2 / np.where(np.abs(q) < tiny * EPS, np.where(q < 0, -1, 1) * tiny * EPS, q)
        count += q < 0
    return count


def bisected(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The `most` largest eigenvalues, falling, each halved down to neighbouring doubles or the matrix's rounding."""
    n = len(d)
    spread = np.concatenate([[0], np.abs(e)]) + np.concatenate([np.abs(e), [0]])
    low, high = np.full(most, (d - spread).min()), np.full(most, (d + spread).max())
    size = max(np.abs(low[0]), np.abs(high[0]))
    low, high = low - 4 * EPS * size, high + 4 * EPS * size
    below = n - 1 - np.arange(most)  # the largest eigenvalue has n - 1 below it
    for _ in range(200):
        middle = (low + high) / 2
        if ((high - low) <= EPS * size / 8).all() or ((middle == low) | (middle == high)).all():
            break
        up = count_below(d, e, middle) <= below
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shifts: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = b for every shift (row), by elimination with row exchanges; zero pivots become tiny ones."""
    m, n = b.shape
    b = b.copy()
    diagonal = d[None, :] - shifts[:, None]
    first, second, pivot = np.zeros((m, n)), np.zeros((m, n)), np.zeros((m, n))  # of the upper factor
    tiny = EPS * max(np.abs(d).max(), np.abs(e).max(initial=0)) or 1.0
    now, right = diagonal[:, 0].copy(), np.full(m, e[0] if n > 1 else 0.0)
    for k in range(n - 1):
        under, over = np.full(m, e[k]), np.full(m, e[k + 1] if k + 2 < n else 0.0)
        swap = np.abs(under) > np.abs(now)
        top = np.where(swap, under, now)
        top = np.where(np.abs(top) < tiny, tiny, top)
        pivot[:, k], first[:, k], second[:, k] = top, np.where(swap, diagonal[:, k + 1], right), np.where(swap, over, 0)
        factor = np.where(swap, now, under) / top
        b[:, k], rest = np.where(swap, b[:, k + 1], b[:, k]), np.where(swap, b[:, k], b[:, k + 1])
        b[:, k + 1] = rest - factor * b[:, k]
        now, right = np.where(swap, right, diagonal[:, k + 1]) - factor * first[:, k], np.where(swap, 0, over) - factor * second[:, k]
    pivot[:, -1] = np.where(np.abs(now) < tiny, tiny, now)
    x = np.zeros_like(b)
    for k in range(n - 1, -1, -1):
        rest = b[:, k].copy()
        if k + 1 < n:
            rest -= first[:, k] * x[:, k + 1]
        if k + 2 < n:
            rest -= second[:, k] * x[:, k + 2]
        x[:, k] = rest / pivot[:, k]
    return x


def vectors_of(d: np.ndarray, e: np.ndarray, values: np.ndarray, seed: int = 1, rounds: int = 5, near: float = 1e-3) -> np.ndarray:
    """Unit eigenvectors (rows) of falling eigenvalues by inverse iteration; in each round those of a cluster, values within
    `near` of the norm, are made orthogonal to one another. Equal values start from different random vectors."""
    size = max(np.abs(d).max(), np.abs(e).max(initial=0))
    shifts = values.copy()
    for k in range(1, len(shifts)):  # shifts of a cluster differ a little, else all of them find one vector
        shifts[k] = min(shifts[k], shifts[k - 1] - 4 * EPS * size)
    cluster = np.concatenate([[0], np.cumsum(-np.diff(values) > near * size)])
    x = np.random.default_rng(seed).normal(size=(len(values), len(d)))
    for _ in range(rounds):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = solve_shifted(d, e, shifts, x)
        x /= np.abs(x).max(1, keepdims=True)
        orthogonal(x, cluster)
    return orthogonal(x, np.zeros(len(x)))  # a vector of which a cluster left little may lean on the others


def orthogonal(x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Unit rows, each less its parts along the earlier ones of its cluster; in place."""
    for k in range(len(x)):
        own = x[:k][cluster[:k] == cluster[k]]
        for _ in range(2):
            x[k] -= own.T @ (own @ x[k])
            x[k] /= np.linalg.norm(x[k])
    return x


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` largest eigenvalues, falling, and their unit eigenvectors as rows."""
    most = min(most, len(a))
    if not most or not np.any(a):
        return np.zeros(most), np.eye(len(a))[:most]
    scale = np.abs(a).max()
    d, e, reflections = tridiagonal(a / scale)
    values = bisected(d, e, most)
    x = vectors_of(d, e, values)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        x[:, k + 1 :] -= 2 * np.outer(x[:, k + 1 :] @ v, v)
    return values * scale, x
