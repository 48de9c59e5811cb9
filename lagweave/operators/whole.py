"""Posteriors fitted on all rows of groups that are too large for one task.

Rows lie in blocks. In each round every model that is not done asks its blocks for sums (`asked_of`), and is moved on by them (`Fit.take`):
moments, then the spread of its features, then the loss and its slope at the weights to be tried for every ridge, then at those of the
chosen ridge, and last the shares of its posteriors. All models go in one Spark job a round, whatever their number.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.sources.storage import written

from .posterior import FLAT, RIDGES, Posterior, blank, codebook, share

#: Rows of a block, and those whose features are held together.
PACK, TOGETHER = 8192, 1024
#: What may be left to gain in nats, by the last steps' curvature: of the weights that choose the ridge, and of the model's. Rounds, where that is not met.
LEFT, ROUNDS = {"ridges": 1e-6, "all": 1e-8}, {"ridges": 20, "all": 60}
#: Steps that tell a problem's curvature. Bytes of models that are broadcast, and of sums that a task holds.
STEPS, BROADCAST, HELD = 8, 8 << 20, 64 << 20
#: Blocks that meet a copy of their group's models where those are not broadcast.
MEET = 16
#: Cells to an edge of the cube of posteriors' roots, and how many of them are kept apart.
GRID, CELLS = 128, 4096


@dataclass
class Problem:
    """The weights [directions, classes] of one ridge: those accepted so far, those to be tried, and the last steps with their changes of slope."""

    ridge: float
    tried: np.ndarray
    w: np.ndarray | None = None
    loss: float = np.inf
    slope: np.ndarray | None = None
    held: float = np.inf
    ahead: np.ndarray | None = None
    steps: list = field(default_factory=list)
    length: float = 1.0
    rounds: int = 0
    done: bool = False

    def move(self, loss: float, slope: np.ndarray, held: float, solve: Callable, left: float, most: int) -> None:
        """Take the tried weights, if they gain enough, and look on in the direction of the last steps' curvature; else look half as far."""
        self.rounds += 1
        gain = 1e-4 * self.length * (self.slope * self.ahead).sum() if self.w is not None else 0.0
        if self.w is None or loss <= self.loss + gain:
            if self.w is not None and ((slope - self.slope) * (self.tried - self.w)).sum() > 1e-300:
                self.steps = [*self.steps, (self.tried - self.w, slope - self.slope)][-STEPS:]
            self.w, self.loss, self.slope, self.held, self.length = self.tried, loss, slope, held, 1.0
            q, used = slope, []
            for s, d in reversed(self.steps):
                used.append((s * q).sum() / (s * d).sum())
                q = q - used[-1] * d
            q = solve(q, self.ridge)
            for (s, d), a in zip(self.steps, reversed(used), strict=True):
                q = q + s * (a - (d * q).sum() / (s * d).sum())
            self.ahead = -q
            self.done = max((slope * q).sum(), (slope * solve(slope, self.ridge)).sum()) < 2 * left
        else:
            self.length /= 2
            self.done = self.length < 1e-6  # the loss is as low as its rounding lets it be seen
        self.tried = self.w + self.length * self.ahead
        self.done |= self.rounds >= most


@dataclass
class Fit:
    """One posterior on its way: `kind` is what it asks for next, '' when it is done."""

    single: bool
    classes: int
    seed: int
    features: int
    told: int
    kind: str = "moments"
    model: Posterior | None = None
    states: np.ndarray | None = None
    problems: list = field(default_factory=list)

    def active(self) -> list[Problem]:
        return [p for p in self.problems if not p.done]

    def asks(self) -> tuple:
        if self.kind not in ("ridges", "all"):
            return self.kind, self.model, None, None
        outer = np.concatenate([self.basis @ p.tried for p in self.active()], 1)
        return self.kind, self.model, outer, np.tile(np.log(self.seen if self.kind == "ridges" else self.shares), len(self.active())) - self.center @ outer

    def take(self, sums: list) -> None:
        if self.kind == "moments":
            _, mean, square, rows = sums
            self.model, self.rows, self.kind = blank(mean, np.sqrt(square / sums[0]), self.classes, self.seed, self.features, self.told), int(rows), "spread"
        elif self.kind == "spread":
            n, total, square, counts, held = sums
            self.center, self.shares, self.seen = total / n, share(counts[None]), share(np.maximum(counts - held, 0)[None])
            values, basis = np.linalg.eigh(square - n * np.outer(self.center, self.center))
            kept = values > FLAT * max(values.max(initial=0), 1e-3)
            self.values, self.basis = values[kept] / n, basis[:, kept]
            self.model.weights[0] = np.log(self.shares)
            if kept.any() and held.sum() > 0:
                self.model.loss = float(-(held @ np.log(self.seen)) / held.sum())
                self.problems, self.kind = [Problem(r, np.zeros((kept.sum(), self.classes))) for r in RIDGES], "ridges"
            else:
                self.fitted()
        elif self.kind in LEFT:
            self.descend(*sums)
        else:
            cells, of, _ = sums
            self.states, self.kind = codebook(of[:, :-1] / of[:, -1:], weight=of[:, -1]), ""

    def descend(self, n: float, loss: np.ndarray, slope: np.ndarray, rest: np.ndarray, held_n: float, held: np.ndarray) -> None:
        shares = self.seen if self.kind == "ridges" else self.shares
        bends, turn = np.linalg.eigh(np.diag(shares) - np.outer(shares, shares))
        solve = lambda g, ridge: (g @ turn) / (self.values[:, None] * np.maximum(bends, 0) + ridge) @ turn.T  # noqa: E731  # exact where nothing is learned
        slopes = self.basis.T @ (slope - np.outer(self.center, rest)) / n
        for k, p in enumerate(self.active()):
            own = slopes[:, k * self.classes : (k + 1) * self.classes] + p.ridge * p.tried
            p.move(loss[k] / n + p.ridge / 2 * (p.tried**2).sum(), own, held[k] / held_n if held_n else np.inf, solve, LEFT[self.kind], ROUNDS[self.kind])
        if self.active():
            return
        if self.kind == "all":
            outer = self.basis @ self.problems[0].w
            self.model.weights[0] -= self.center @ outer
            self.model.weights[1:] = outer
            return self.fitted()
        best = None
        for p in self.problems:
            if p.held < self.model.loss - 1e-6:
                self.model.loss, self.model.ridge, best = p.held, p.ridge, p.w
        if best is None:
            return self.fitted()
        self.problems, self.kind = [Problem(self.model.ridge, best)], "all"

    def fitted(self) -> None:
        self.problems, self.kind = [], "states" if self.single else ""


def packed(rows: DataFrame, own: Sequence[str], modalities: Sequence[str], y: str, parts: int) -> DataFrame:
    """own, _meet, block: the rows (with _part, _told, _share and _held) of each part as arrays, written in even files."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        there = {m: frame[m].notna().to_numpy() for m in modalities}
        x = {m: np.stack(frame[m][there[m]].to_numpy()).astype("f8") if there[m].any() else None for m in modalities}
        told = np.stack(frame["_told"].to_numpy()).astype("f8")
        block = (there, x, told, frame[y].to_numpy("i8"), frame["_share"].to_numpy("f8"), frame["_held"].to_numpy(bool))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in own}, "_meet": [frame["_part"].iloc[0] // MEET], "block": [pickle.dumps(block, 5)]})

    types = dict(rows.dtypes)
    blocks = rows.select(*own, "_part", "_told", "_share", "_held", y, *modalities).groupBy(*own, "_part").applyInPandas(pack, ", ".join(f"`{k}` {types[k]}" for k in own) + ", _meet int, block binary")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return written(blocks.repartition(max(1, min(parts, 4 * cores), parts // 32)), "blocks")


def rows_of(block: tuple, names: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Inputs, labels, weights and which are held out, of the rows that have all of these modalities."""
    there, x, told, y, share, held = block
    both = np.logical_and.reduce([there[m] for m in names])
    if not both.any():
        return np.zeros((0, 0)), y[both], share[both], held[both]
    return np.concatenate([*[x[m][both[there[m]]] for m in names], told[both]], 1), y[both], share[both], held[both]


def asked_of(block: tuple, names: Sequence[str], classes: int, kind: str, model: Posterior | None, outer: np.ndarray | None, bias: np.ndarray | None) -> list | None:
    """A block's sums of one model; None where it has no row of it."""
    x, y, share, held = rows_of(block, names)
    if not len(x):
        return None
    if kind == "moments":
        mean = share @ x / share.sum()
        return [share.sum(), mean, share @ (x - mean) ** 2, len(x)]
    if kind == "states":
        return cells_of(model.predict(x), share)
    out = None
    for at in range(0, len(x), TOGETHER):
        some = slice(at, at + TOGETHER)
        if kind == "spread":
            raw, s, onehot = model.features(x[some])[:, 1:], share[some], np.eye(classes)[y[some]]
            part = [s.sum(), s @ raw, (raw * s[:, None]).T @ raw, s @ onehot, (s * held[some]) @ onehot]
        else:
            part = slope_of(x[some], y[some], share[some] * ~held[some] if kind == "ridges" else share[some], share[some] * held[some], model, outer, bias)
        out = part if out is None else [a + b for a, b in zip(out, part, strict=True)]
    return out


def slope_of(x: np.ndarray, y: np.ndarray, fits: np.ndarray, held: np.ndarray, model: Posterior, outer: np.ndarray, bias: np.ndarray) -> list:
    """Weight, loss and slope of the rows that fit, weight and loss of those held out. Single precision, whose cosines cost a tenth, is enough
    for some rows; their sums are added in double precision."""
    z = ((x - model.mean) * model.scale).astype("f4")
    raw = np.concatenate([z, np.cos(z @ model.projection.astype("f4") + model.phase.astype("f4"))], 1)
    p = (raw @ outer.astype("f4") + bias.astype("f4")).reshape(len(x), -1, model.weights.shape[1])
    p -= p.max(2, keepdims=True)
    own = p[np.arange(len(x)), :, y]
    np.exp(p, out=p)
    total = p.sum(2)
    loss = np.log(total, dtype="f8") - own
    p *= (fits[:, None] / total).astype("f4")[:, :, None]
    p[np.arange(len(x)), :, y] -= fits[:, None].astype("f4")
    rest = p.reshape(len(x), -1)
    return [fits.sum(), fits @ loss, (raw.T @ rest).astype("f8"), rest.sum(0, dtype="f8"), held.sum(), held @ loss]


def cells_of(p: np.ndarray, share: np.ndarray, grid: int = GRID) -> list:
    """Cells of posteriors, the sums of the posteriors in each and their weight, and the grid: every row counts in its cell."""
    return merged_cells(np.minimum((np.sqrt(p) * grid).astype("i8"), grid - 1), np.concatenate([p * share[:, None], share[:, None]], 1), grid)


def merged_cells(cells: np.ndarray, of: np.ndarray, grid: int) -> list:
    while True:
        code = np.zeros(len(cells), "i8")
        for column in cells.T:
            code = np.unique(code * grid + column, return_inverse=True)[1]
        one = np.unique(code, return_index=True)[1]
        sums = np.stack([np.bincount(code, c, len(one)) for c in of.T], 1)
        cells, of = cells[one], sums
        if len(one) <= CELLS or grid == 1:
            return [cells, of, grid]
        cells, grid = cells // 2, grid // 2


def added(kind: str, a: list, b: list) -> list:
    """The sums of two parts."""
    if kind == "moments":
        n, d = a[0] + b[0], b[1] - a[1]
        return [n, a[1] + d * b[0] / n, a[2] + b[2] + d**2 * (a[0] * b[0] / n), a[3] + b[3]]
    if kind == "states":
        while a[2] != b[2]:
            a, b = (a, b) if a[2] > b[2] else (b, a)
            a = [a[0] // 2, a[1], a[2] // 2]
        return merged_cells(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), a[2])
    return [x + y for x, y in zip(a, b, strict=True)]


def size_of(sums: list) -> int:
    return sum(np.asarray(x).nbytes for x in sums)


def answers(blocks: DataFrame, asked: DataFrame, groups: DataFrame, own: Sequence[str], fits: Sequence[tuple[str, ...]], classes: int, few: bool) -> DataFrame:
    """own, _fit, sums: a task's blocks together. Models come to the blocks, which stay where they are if the models are few."""
    models = asked.groupBy(*own).agg(F.collect_list(F.struct("_fit", "ask")).alias("_asked"))
    if few:
        joined = blocks.join(F.broadcast(models), list(own))
    else:
        each = models.join(groups, list(own)).withColumn("_meet", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_parts") / MEET).cast("int") - 1)))
        joined = blocks.hint("merge").join(each, [*own, "_meet"])
    types = dict(blocks.dtypes)

    def run(frames):
        found, held = {}, 0

        def out():
            rows = [(*key, f, pickle.dumps((kind, sums), 5)) for (key, f), (kind, sums) in found.items()]
            return pd.DataFrame(rows, columns=[*own, "_fit", "sums"])

        for frame in frames:
            for row in frame.to_dict("records"):
                block, key = pickle.loads(row["block"]), tuple(row[k] for k in own)
                for one in row["_asked"]:
                    ask, f = pickle.loads(one["ask"]), one["_fit"]
                    sums = asked_of(block, fits[f], classes, *ask)
                    if sums is None:
                        continue
                    if (key, f) in found:
                        sums = added(ask[0], found[key, f][1], sums)
                    else:
                        held += size_of(sums)
                    found[key, f] = ask[0], sums
                if held > HELD:
                    yield out()
                    found, held = {}, 0
        if found:
            yield out()

    return joined.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in own) + ", _fit int, sums binary")


def moved(sums: DataFrame, states: DataFrame, own: Sequence[str]) -> DataFrame:
    """own, _fit, ask, state: each model after its sums; one that asked but met no row goes."""

    def move(sums: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0]
        if row["ask"] is None:
            return state
        if not len(sums):
            return state.head(0)
        fit = pickle.loads(row["state"])
        parts = [pickle.loads(s) for s in sums["sums"]]
        fit.take(reduce(lambda a, b: added(fit.kind, a, b), [p for _, p in parts]))
        return pd.DataFrame({**{k: [row[k]] for k in (*own, "_fit")}, "ask": [pickle.dumps(fit.asks(), 5) if fit.kind else None], "state": [pickle.dumps(fit, 5)]})

    by = [*own, "_fit"]
    return sums.groupBy(*by).cogroup(states.select(*by, "ask", "state").groupBy(*by)).applyInPandas(move, states.select(*by, "ask", "state").schema)


def fitted_on_all(rows: DataFrame, groups: DataFrame, own: Sequence[str], fits: Sequence[tuple[str, ...]], y: str, classes: int, seed: int, features: int, told: int) -> DataFrame:
    """own, _fit, model (the posterior, and a codebook of it for a single modality): of each group (own, _parts) on all its rows (own, _part,
    _told, _share, _held, y, modalities), of which the held ones choose the ridge first."""
    groups = written(groups.select(*own, "_parts"), "groups")
    count, parts = groups.agg(F.count("*"), F.sum("_parts")).first()
    blocks = packed(rows, own, sorted({m for f in fits for m in f}), y, int(parts))
    begin = [(k, Fit(len(f) == 1, classes, seed, features, told)) for k, f in enumerate(fits)]
    start = groups.sparkSession.createDataFrame([(k, bytearray(pickle.dumps(f.asks(), 5)), bytearray(pickle.dumps(f, 5))) for k, f in begin], "_fit int, ask binary, state binary")
    states = written(groups.select(*own).crossJoin(F.broadcast(start)), "fits")
    few = count * len(fits) * 8 * features * (classes * len(RIDGES) + 4) < BROADCAST
    while not (asked := states.where("ask is not null")).isEmpty():
        states = written(moved(answers(blocks, asked.select(*own, "_fit", "ask"), groups, own, fits, classes, few), states, own), "fits")

    def models(frames):
        for frame in frames:
            found = [pickle.loads(s) for s in frame["state"]]
            yield frame[[*own, "_fit"]].assign(model=[pickle.dumps((f.model, f.states)) for f in found])

    types = dict(states.dtypes)
    return states.select(*own, "_fit", "state").mapInPandas(models, ", ".join(f"`{k}` {types[k]}" for k in own) + ", _fit int, model binary")
