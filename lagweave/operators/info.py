"""Joint histograms over lags, mutual information, transfer entropy and the decomposition of two inputs' information."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.arrays import equal_width_bin, row_mean
from lagweave.sources.storage import dealt

from .coupling import certified, coupling, joint_information
from .series import lag_align, lag_align_ranged

CELL = ("b1", "b2", "yb")


def lagged_bins(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, max_lag: int, bins: int) -> DataFrame:
    """keys, lag, a bin column for each of x, and yb. Edges come from each lag's own slices, in the pass that has the leads."""
    binned = [equal_width_bin(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), bins).alias("yb" if c == y else f"{c}_b") for c in (*x, y)]
    return lag_align_ranged(df, keys, x, y, max_lag).select(*keys, "lag", *binned)


def joint_hist_multilag(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], y: str, max_lag: int, bins: int = 4, binning: str = "width", by: Sequence[str] | None = None) -> DataFrame:
    """by, mod1, mod2, lag, b1, b2, yb, n: joint counts of every pair at every lag in one job, of each series or pooled over those with equal `by`, of the keys.

    Rows become small integers before they are multiplied by the pairs, and counting combines them before
    the shuffle: at most bins**3 rows a group leave a task. With `binning` 'auto' a series, pair and lag whose three slices
    hold whole numbers only is counted by the numbers' ranks instead, its labels too.
    """
    if binning not in ("width", "auto"):
        raise ValueError("binning is 'width' or 'auto'")
    by = keys if by is None else by
    columns = sorted({c for p in pairs for c in p})
    rows = lagged_bins(df, keys, columns, y, max_lag, bins) if binning == "width" else lagged_codes(df, keys, columns, y, max_lag, bins)

    def cell(a: str, b: str) -> Column:
        ways = {"b1": f"{a}_b", "b2": f"{b}_b", "yb": "yb"}
        if binning == "auto":
            whole = F.col(f"{a}_w") & F.col(f"{b}_w") & F.col("y_w")
            ways = {k: F.when(whole, F.col(c.removesuffix("_b") + "_r" if c != "yb" else "y_r")).otherwise(F.col(c)) for k, c in ways.items()}
        return F.struct(F.lit(a).alias("mod1"), F.lit(b).alias("mod2"), *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in ways.items()])

    flat = rows.select(*by, "lag", F.explode(F.array(*[cell(*p) for p in pairs])).alias("p")).select(*by, "p.mod1", "p.mod2", "lag", "p.b1", "p.b2", "p.yb")
    return flat.where("b1 is not null and b2 is not null and yb is not null").groupBy(*by, "mod1", "mod2", "lag", *CELL).agg(F.count("*").alias("n"))


def lagged_codes(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, max_lag: int, bins: int) -> DataFrame:
    """What `lagged_bins` gives, and for each of x (c_w, c_r) and y (y_w, y_r) whether a lag's slice has whole numbers only, and then the number's rank.

    Ranks are those of a slice's distinct numbers, by windows within the series' own part of the rows.
    """
    binned = [equal_width_bin(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), bins).alias("yb" if c == y else f"{c}_b") for c in (*x, y)]
    values = [F.when(F.col(f"{c}_w"), F.col(c)).alias("y_v" if c == y else f"{c}_v") for c in (*x, y)]
    rows = lag_align_ranged(df, keys, x, y, max_lag, True).select(*keys, "lag", *values, *binned, *[F.col(f"{c}_w").alias("y_w" if c == y else f"{c}_w") for c in (*x, y)])
    for c in (*x, "y"):
        rank = F.dense_rank().over(Window.partitionBy(*keys, "lag").orderBy(F.asc_nulls_last(f"{c}_v")))
        rows = rows.withColumn(f"{c}_r", F.when(F.col(f"{c}_v").isNotNull(), (rank - 1).cast("long"))).drop(f"{c}_v")
    return rows


def joint_hist_vectors(df: DataFrame, x1: str, x2: str, y: str, bins: int = 16) -> DataFrame:
    """b1, b2, yb, n of two vectors: edges from all numbers of a vector column, the binned value is the row's mean."""
    e = df.agg(*[f(g(c)).alias(f"{c}_{n}") for c in (x1, x2) for n, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))]).first()
    b = lambda c: equal_width_bin(row_mean(F.col(c)), F.lit(e[f"{c}_lo"]), F.lit(e[f"{c}_hi"]), bins)
    return df.select(b(x1).alias("b1"), b(x2).alias("b2"), F.col(y).alias("yb")).groupBy(*CELL).agg(F.count("*").alias("n"))


def marginals(hist: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """All one- and two-variable marginals in one pass: the variables that are summed out are null."""
    sets = [[*keys, *s] for s in (("b1",), ("b2",), ("yb",), ("b1", "yb"), ("b2", "yb"), ("b1", "b2"))]
    return hist.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, *CELL)]).agg(F.sum(n).alias("n"))


def margin_sums(hist: DataFrame, keys: Sequence[str], sets: dict[str, Sequence[str]], n: str = "n") -> DataFrame:
    """keys, the sum of c ln c over the cells c of each named margin, and _n, the sum of all counts: one pass over the
    counts for all margins, and one over their cells for the sums. Empty cells don't occur and count nothing."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    code = lambda by: sum(1 << k for k, c in enumerate(reversed(columns)) if c not in by)
    cells = hist.groupingSets([[F.col(c) for c in (*keys, *s)] for s in sets.values()], *[F.col(c) for c in (*keys, *columns)]).agg(F.sum(n).cast("double").alias("_c"), F.grouping_id().alias("_g"))
    part = lambda by, value: F.sum(F.when(F.col("_g") == code(by), value).otherwise(0.0))
    xlogx = F.when(F.col("_c") > 0, F.col("_c") * F.log("_c")).otherwise(0.0)
    return cells.groupBy(*keys).agg(*[part(s, xlogx).alias(name) for name, s in sets.items()], part(next(iter(sets.values())), F.col("_c")).alias("_n"))


def mutual_information(hist: DataFrame, keys: Sequence[str], a: Sequence[str], b: Sequence[str], n: str = "n", unit: str = "nats") -> DataFrame:
    """keys, mi: I(A; B) from counts (or weights): sums over one table of margins, no joins."""
    s = margin_sums(hist, keys, {"_ab": [*a, *b], "_a": a, "_b": b}, n)
    scale = 1 / math.log(2) if unit == "bits" else 1.0
    return s.select(*keys, F.greatest(F.lit(0.0), ((F.col("_ab") - F.col("_a") - F.col("_b")) / F.col("_n") + F.log("_n")) * scale).alias("mi"))


def conditional_mi(hist: DataFrame, keys: Sequence[str], given: str, other: str, unit: str = "nats") -> DataFrame:
    """keys, cmi: I(Y; other | given), the slices' information weighted by their mass."""
    s = margin_sums(hist, keys, {"_all": [given, other, "yb"], "_gy": [given, "yb"], "_go": [given, other], "_g1": [given]})
    scale = 1 / math.log(2) if unit == "bits" else 1.0
    return s.select(*keys, F.greatest(F.lit(0.0), (F.col("_all") - F.col("_gy") - F.col("_go") + F.col("_g1")) / F.col("_n") * scale).alias("cmi"))


def information(hist: DataFrame, keys: Sequence[str], unit: str = "nats") -> DataFrame:
    """keys, i1 = I(Y; X1), i2 = I(Y; X2), total = I(Y; X1, X2), co = i1 + i2 - total, all from one table of margins."""
    s = margin_sums(hist, keys, {"_12y": CELL, "_1y": ["b1", "yb"], "_2y": ["b2", "yb"], "_12": ["b1", "b2"], "_1": ["b1"], "_2": ["b2"], "_y": ["yb"]})
    scale = 1 / math.log(2) if unit == "bits" else 1.0
    mi = lambda x: F.greatest(F.lit(0.0), ((F.col(f"_{x}y") - F.col(f"_{x}") - F.col("_y")) / F.col("_n") + F.log("_n")) * scale)
    found = s.select(*keys, mi("1").alias("i1"), mi("2").alias("i2"), mi("12").alias("total"))
    return found.withColumn("co", F.col("i1") + F.col("i2") - F.col("total"))


def transfer_entropies(df: DataFrame, keys: Sequence[str], directions: Sequence[tuple[str, str]], lags: Sequence[int], bins: int = 4, variant: str = "standard") -> DataFrame:
    """keys, source, target, lag, te (bits) of every direction and lag: I(target now; source at -lag | target at -lag), over equal-width
    bins of the whole series. All come from one window over the series and one pass over the counts.

    The variant 'weighted' takes each term, p(now | both past) log(p(now | both past) / p(now | target past)), by the joint share once more than
    the standard measure's weights have it: by p(now, both past) p(now | both past).
    """
    if variant not in ("standard", "weighted"):
        raise ValueError("variant is 'standard' or 'weighted'")
    columns = sorted({c for p in directions for c in p})
    whole = Window.partitionBy(*keys)
    edged = df.select(*keys, "i", "n", *columns, *[f(c).over(whole).alias(f"{c}_{e}") for c in columns for e, f in (("lo", F.min), ("hi", F.max))])
    binned = edged.select(*keys, "i", "n", *[equal_width_bin(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), bins).alias(c) for c in columns])
    rows = lag_align(binned.withColumn("_t", F.struct(*columns)), keys, columns, "_t", max(lags)).where(F.col("lag").isin(list(lags)))
    each = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(b).alias("b1"), F.col(a).alias("b2"), F.col(f"_t.{b}").alias("yb")) for a, b in directions])
    by = [*keys, "source", "target", "lag"]
    hist = rows.select(*keys, F.col("lag").cast("long").alias("lag"), F.explode(each).alias("p")).select(*keys, "p.source", "p.target", "lag", "p.b1", "p.b2", "p.yb")
    hist = hist.where("b1 is not null and b2 is not null and yb is not null").groupBy(*by, *CELL).agg(F.count("*").alias("n"))
    if variant == "standard":
        return conditional_mi(hist, by, "b1", "b2", unit="bits").withColumnRenamed("cmi", "te")
    total = lambda *c: F.sum("n").over(Window.partitionBy(*by, *c))
    cells = hist.select(*by, (F.col("n") / total()).alias("_p"), (F.col("n") / total("b1", "b2")).alias("_c"), (total("b1", "yb") / total("b1")).alias("_t"))
    return cells.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(F.col("_p") * F.col("_c") * F.log(F.col("_c") / F.col("_t"))) / math.log(2)).alias("te"))


def transfer_entropy(df: DataFrame, keys: Sequence[str], source: str, target: str, lag: int, bins: int = 4, variant: str = "standard") -> DataFrame:
    """keys, te: one direction and lag of `transfer_entropies`."""
    return transfer_entropies(df, keys, [(source, target)], [lag], bins, variant).select(*keys, "te")


def tensors(cells: pd.Series) -> np.ndarray:
    """[group, y, x1, x2] of flat lists of yb, b1, b2, n, each group adding up to 1."""
    flat = np.concatenate(cells.to_list()).reshape(-1, 4)
    of = np.repeat(np.arange(len(cells)), [len(x) // 4 for x in cells])
    codes = flat[:, :3].astype("i8")
    p = np.zeros((len(cells), *(codes.max(0) + 1)))
    np.add.at(p, (of, *codes.T), flat[:, 3])
    return p / p.sum((1, 2, 3), keepdims=True)


def decompose(p: np.ndarray) -> dict[str, np.ndarray]:
    """R, U1, U2, S and MI in nats of p [group, y, x1, x2]; also the solver's rounds and its duality gap, by which R and S are at most
    too small, U1 and U2 too large."""
    q, rounds, gap = coupling(p)
    i1, i2 = joint_information(p.sum(3, keepdims=True)), joint_information(p.sum(2, keepdims=True))
    i12, iq = joint_information(p), joint_information(q)
    return {"R": i1 + i2 - iq, "U1": iq - i2, "U2": iq - i1, "S": i12 - iq, "MI": i12, "rounds": rounds, "gap": gap}


#: Groups that a task solves together, which bounds its memory at a few MB for small histograms, and cells of all its groups.
TOGETHER, MOST = 256, 1 << 17


def gathered(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a group with its cells as flat numbers, of which there are at most 4 bins**3, dealt into tasks of `TOGETHER` groups, or of more with up to `MOST` cells where there are very many."""
    one = F.array(*[F.col(c).cast("double") for c in ("yb", "b1", "b2", "n")])
    cells = hist.groupBy(*keys).agg(F.flatten(F.collect_list(one)).alias("cells"))
    return dealt(cells, TOGETHER, "cells", F.size("cells") / 4, MOST)


def pid_coupling(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, b1, b2, yb, v: the coupling's cells of every group, and the numbers that prove it: rows without b2 have a(yb, b1), rows
    without b1 have b(yb, b2). The sum over yb of exp(a + b) is at most 1 for each (b1, b2), and the margins times
    a and b add up to the least that any coupling can have of the sum of q log(q(yb | b1, b2))."""

    def solve(frames):
        for frame in frames:
            for at in range(0, len(frame), TOGETHER):
                part = frame.iloc[at : at + TOGETHER]
                p = tensors(part["cells"])
                q, _, _, a, b = certified(p)
                for values, held in ((q, q > 0), (a[..., None], p.sum(3, keepdims=True) > 0), (b[:, :, None], p.sum(2, keepdims=True) > 0)):
                    g, y, i, j = np.nonzero(held)
                    places = pd.DataFrame({"b1": i, "b2": j}, dtype="Int64")
                    if values is not q:
                        places["b2" if values.shape[3] == 1 and held.shape[2] == p.shape[2] else "b1"] = pd.NA
                    yield pd.DataFrame({**{k: part[k].to_numpy()[g] for k in keys}, "b1": places["b1"], "b2": places["b2"], "yb": y, "v": values[g, y, i, j]})

    types = dict(hist.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", b1 long, b2 long, yb long, v double"
    return gathered(hist, keys).mapInPandas(solve, schema)


def pid(hist: DataFrame, keys: Sequence[str], unit: str = "nats") -> DataFrame:
    """keys, R, U1, U2, S, MI, rounds, gap (nats) of every group of joint counts, which are codes from 0."""
    scale = 1 / math.log(2) if unit == "bits" else 1.0

    def solve(frames):
        for frame in frames:
            for at in range(0, len(frame), TOGETHER):
                part = frame.iloc[at : at + TOGETHER]
                found = decompose(tensors(part["cells"]))
                yield pd.DataFrame({**{k: part[k].to_numpy() for k in keys}, **{k: v * scale if k in ("R", "U1", "U2", "S", "MI") else v for k, v in found.items()}})

    types = dict(hist.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", R double, U1 double, U2 double, S double, MI double, rounds long, gap double"
    return gathered(hist, keys).mapInPandas(solve, schema)


def with_failed_lags(found: DataFrame, groups: DataFrame, keys: Sequence[str], lags: Sequence[int], method: str = "joint") -> DataFrame:
    """A row for each group and lag: where nothing was found, or no number, the terms are NaN and the method 'failed'."""
    terms = [c for c in found.columns if c not in (*keys, "lag")]
    grid = groups.select(*keys).distinct().withColumn("lag", F.explode(F.array(*[F.lit(k).cast("long") for k in lags])))
    rows = grid.join(found.withColumn("lag", F.col("lag").cast("long")), [*keys, "lag"], "left")
    ok = F.col("MI").isNotNull() & ~F.isnan("MI")
    doubles = {c for c, t in found.dtypes if t == "double"}
    return rows.select(*keys, "lag", *[F.when(ok, F.col(c)).otherwise(float("nan") if c in doubles else None).alias(c) for c in terms], F.when(ok, method).otherwise("failed").alias("method"))


def entropy_of(share: Column) -> Column:
    return F.sum(F.when(share > 0, -share * F.log(share)).otherwise(0.0))
