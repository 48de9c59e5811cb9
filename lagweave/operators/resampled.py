"""Learned decompositions that are fitted on one part of the rows and scored on the other, over several resamples.

All posteriors of all groups, pairs and draws are fitted by one grouped job, scored by another, and their couplings solved by a third.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.arrays import equal_width_bin, row_mean
from lagweave.sources.storage import written

from .coupling import coupling, joint_information
from .info import CELL, pid
from .learned import decompose_learned
from .posterior import FEATURES, codebook, fit
from .sampling import ranked
from .series import lag_align, vector_bucket_mean
from .whole import PACK, fitted_on_all

#: Training rows that are fitted in one task; more are fitted in blocks.
SMALL = 2560
#: Test rows that a task scores together, models of a fitting task, couplings that are solved together.
BLOCK, CHUNK, TOGETHER = 20_000, 16, 64
#: Duality gap of a group's coupling, in nats.
STOP = 1e-7
TERMS = ("R", "U1", "U2", "S", "MI")


def zscored(df: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Arrays less the mean and over the population deviation of each of their places, over all rows. The places' numbers come by a scalar query."""
    for c in columns:
        flat = df.select(F.posexplode(c).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        both = flat.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("p")).scalar()  # one struct a place
        df = df.withColumn("_p", both).withColumn(c, F.zip_with(F.col(c), F.col("_p"), lambda x, p: (x - p["m"]) / (p["s"] + eps))).drop("_p")
    return df


def fits_of(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, ...]]:
    """What is fitted: each modality by itself once, however many pairs it is in, and each pair."""
    return [(m,) for m in sorted({m for p in pairs for m in p})] + [tuple(p) for p in pairs]


def inputs(rows: pd.DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have all of these modalities, and their numbers side by side, with the case that a model is told, if any, last."""
    there = np.logical_and.reduce([rows[m].notna().to_numpy() for m in names])
    some = rows[there]
    return there, np.concatenate([np.stack(some[m].to_numpy()).astype("f8") for m in (*names, "_told")], 1) if there.any() else np.zeros((0, 0))


def weighed(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of x and how many rows of each class each stands for; all rows as they are where most differ."""
    code = np.zeros(len(x), "i8")
    for column in x.T:
        values, place = np.unique(column, return_inverse=True)
        code = np.unique(code * len(values) + place, return_inverse=True)[1]
        if 2 * code.max(initial=0) > len(x):
            return x, np.eye(classes)[y]
    one = np.unique(code, return_index=True)[1]
    return x[one], np.bincount(code * classes + y, minlength=len(one) * classes).reshape(-1, classes).astype("f8")


def group_sizes(base: DataFrame, keys: Sequence[str], own: Sequence[str], y: str, classes: int, need: int, draws: int) -> DataFrame:
    """A row a group: rows of both parts, class shares of all rows, draws (one where all fitting rows are drawn), blocks of test rows,
    the fitting rows of its model. `own`, of the keys, tell apart models; groups with equal ones share theirs."""
    counts = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if("_train").alias("train_rows"), F.array(*[F.count_if(F.col(y) == k) / F.count("*") for k in range(classes)]).alias("prior"))
    test, fitting = F.col("_n") - F.col("train_rows"), F.sum("train_rows").over(Window.partitionBy(*own))
    return counts.select(*keys, "train_rows", test.alias("test_rows"), "prior", F.when(fitting <= need, 1).otherwise(draws).alias("_draws"), F.ceil(test / BLOCK).cast("int").alias("_blocks"), fitting.alias("_fitting"))


def fitted(base: DataFrame, sizes: DataFrame, keys: Sequence[str], own: Sequence[str], fits: Sequence[tuple[str, ...]], y: str, classes: int, need: int, seed: int) -> DataFrame:
    """own, _draw, _fit, model, and the number of blocks where each group has its own: for each draw of at most `need` training rows every posterior, and a codebook of it for a single modality.

    A draw is the rows with the least hash over their group's share of the draw; rows above a bound that leaves out none but needless
    ones aren't shuffled.
    """
    modalities = sorted({m for f in fits for m in f})
    unit = lambda d: F.pmod(F.xxhash64(F.lit(seed), d, F.col("_key"), *keys), F.lit(1 << 40)) / float(1 << 40)
    part = need * F.col("_weight")
    bound = (part + 6 * F.sqrt(part) + 10) / F.col("train_rows")
    drawn = F.filter(F.sequence(F.lit(0), F.col("_draws") - 1), lambda d: (F.col("_draws") == 1) | (unit(d) < bound))
    rows = base.where("_train").join(sizes.where("test_rows > 0").select(*keys, "train_rows", "_draws", "_blocks"), list(keys))
    kept = [*own, "_draw", *(["_blocks"] if list(own) == list(keys) else [])]
    rows = rows.withColumn("_draw", F.explode(drawn)).withColumn("_u", unit(F.col("_draw")) / bound)
    chunks = [list(range(at, min(at + CHUNK, len(fits)))) for at in range(0, len(fits), CHUNK)]
    held = {m: [k for k, c in enumerate(chunks) if any(m in fits[f] for f in c)] for m in modalities}
    rows = rows.withColumn("_chunk", F.explode(F.array(*[F.lit(k) for k in range(len(chunks))])))
    rows = rows.select(*kept, "_chunk", "_u", "_key", "_told", y, *[F.when(F.col("_chunk").isin(held[m]), F.col(m)).alias(m) for m in modalities])
    types = dict(base.dtypes)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_u", "_key"]).head(need)
        out = []
        for f in chunks[frame["_chunk"].iloc[0]]:
            there, x = inputs(frame, fits[f])
            if there.any():
                told = len(frame["_told"].iloc[0])
                model = fit(x, frame[y].to_numpy("i8")[there], classes, seed, FEATURES * (2 if told else 1), told)
                states = codebook(model.predict(x)) if len(fits[f]) == 1 else None
                out.append((f, pickle.dumps((model, states))))
        first = {k: frame[k].iloc[0] for k in kept}
        return pd.DataFrame({**{k: [v] * len(out) for k, v in first.items()}, "_fit": [f for f, _ in out], "model": [m for _, m in out]})

    schema = ", ".join(f"`{k}` {types.get(k, 'int')}" for k in kept) + ", _fit int, model binary"
    return rows.groupBy(*own, "_draw", "_chunk").applyInPandas(learn, schema)


def fitted_whole(base: DataFrame, sizes: DataFrame, keys: Sequence[str], own: Sequence[str], fits: Sequence[tuple[str, ...]], y: str, classes: int, seed: int) -> DataFrame:
    """What `fitted` gives, one draw, of models with any number of training rows: every row of a model's groups counts by its group's weight."""
    modalities, told = sorted({m for f in fits for m in f}), len(base.select("_told").first()[0])
    parts = F.ceil(F.col("_fitting") / PACK).cast("int")
    rows = base.where("_train").join(sizes.select(*keys, "train_rows", "_fitting", parts.alias("_parts")), list(keys))
    dealt = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), F.lit(seed), "_key", *keys), parts)
    share = F.lit(1.0) if list(own) == list(keys) else F.col("_weight") * F.col("_fitting") / F.col("train_rows")
    rows = rows.select(*own, dealt(11, F.col("_parts")).cast("int").alias("_part"), share.alias("_share"), (dealt(13, F.lit(5)) == 4).alias("_held"), "_told", y, *modalities)
    groups = sizes.groupBy(*own).agg(F.max(parts).alias("_parts"))
    found = fitted_on_all(rows, groups, own, fits, y, classes, seed, FEATURES * (2 if told else 1), told)
    kept = found.join(sizes.select(*keys, "_blocks"), list(own)) if list(own) == list(keys) else found
    return kept.select(*own, F.lit(0).alias("_draw"), *(["_blocks"] if list(own) == list(keys) else []), "_fit", "model")


def scored(base: DataFrame, models: DataFrame, sizes: DataFrame, keys: Sequence[str], own: Sequence[str], fits: Sequence[tuple[str, ...]], y: str, classes: int) -> DataFrame:
    """keys, _draw, _fit, v: of each model over all test rows the number of rows, the sums of p log p, of the loss and of p, and for a single
    modality the sum of p in each state. Test rows are dealt into blocks, which meet the group's models; only sums leave a block."""
    modalities = sorted({m for f in fits for m in f})
    rows = base.where("not _train").join(sizes.where("train_rows > 0").select(*keys, "_blocks"), list(keys))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(7)), F.col("_blocks")).cast("int")).select(*keys, "_block", "_told", y, *modalities)
    models = models if "_blocks" in models.columns else models.join(sizes.select(*keys, "_blocks"), list(own))
    spread = models.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    types = dict(base.dtypes)

    def score(block: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out, made = [], {}
        for _, row in models.sort_values("_fit").iterrows() if len(block) else ():
            if row["_fit"] not in made:  # the draws of a fit score the same inputs
                there, x = inputs(block, fits[row["_fit"]])
                made = {row["_fit"]: weighed(x, block[y].to_numpy("i8")[there], classes) if there.any() else None}
            if made[row["_fit"]] is None:
                continue
            x, counts = made[row["_fit"]]
            n = counts.sum(1)
            model, states = pickle.loads(row["model"])
            p = model.predict(x)
            logs, shares = np.log(np.maximum(p, 1e-300)), p * n[:, None]
            sums = [[n.sum(), (shares * logs).sum(), -(counts * logs).sum()], shares.sum(0)]
            if states is not None:
                of = (p @ np.log(np.maximum(states, 1e-12)).T).argmax(1)  # the least divergence
                sums.append(np.stack([np.bincount(of, s, len(states)) for s in shares.T], 1).ravel())
            out.append((*[row[k] for k in keys], row["_draw"], row["_fit"], np.concatenate(sums)))
        return pd.DataFrame(out, columns=[*keys, "_draw", "_fit", "v"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _draw int, _fit int, v array<double>"
    parts = rows.groupBy(*keys, "_block").cogroup(spread.groupBy(*keys, "_block")).applyInPandas(score, schema)
    flat = parts.select(*keys, "_draw", "_fit", F.posexplode("v").alias("at", "v")).groupBy(*keys, "_draw", "_fit", "at").agg(F.sum("v").alias("v"))
    return flat.groupBy(*keys, "_draw", "_fit").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("v"))


def joint_of(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[y, i, j]: independent within each class, of states' class masses r and c, c rescaled to r's class masses."""
    mass = r.sum(1, keepdims=True)
    c = c / np.maximum(c.sum(1, keepdims=True), 1e-300) * mass
    joint = r[:, :, None] * c[:, None, :] / np.maximum(mass, 1e-300)[:, :, None]
    return joint / joint.sum()


def informations(sums: DataFrame, sizes: DataFrame, keys: Sequence[str], fits: Sequence[tuple[str, ...]], pairs: Sequence[tuple[str, str]], classes: int) -> DataFrame:
    """keys, _draw, mod1, mod2, i1, i2, i12, iq, lost, gap (bits), loss (nats): of every pair whose three posteriors were scored."""
    at = {f: k for k, f in enumerate(fits)}
    rows, types = sums.join(sizes.select(*keys, "prior"), list(keys)), dict(sums.dtypes)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        prior = np.maximum(np.array(frame["prior"].iloc[0], "f8"), 1e-12)
        found = {f: np.asarray(v, "f8") for f, v in zip(frame["_fit"], frame["v"], strict=True)}
        mi = {f: (v[1] - v[3 : 3 + classes] @ np.log(prior)) / v[0] for f, v in found.items()}
        cells = {f: (v[3 + classes :].reshape(-1, classes) / v[0]).T for f, v in found.items() if len(v) > 3 + classes}
        some = [p for p in pairs if all(at[f] in found for f in ((p[0],), (p[1],), tuple(p)))]
        out = []
        for k in range(0, len(some), TOGETHER):
            part = some[k : k + TOGETHER]
            joints = [joint_of(cells[at[a,]], cells[at[b,]]) for a, b in part]
            p = np.zeros((len(part), classes, max(j.shape[1] for j in joints), max(j.shape[2] for j in joints)))
            for one, j in zip(p, joints, strict=True):
                one[:, : j.shape[1], : j.shape[2]] = j
            q, _, gap = coupling(p, STOP)
            i1, i2, iq = joint_information(p.sum(3, keepdims=True)), joint_information(p.sum(2, keepdims=True)), joint_information(q)
            for n, (a, b) in enumerate(part):
                lost = max(mi[at[a,]] - i1[n], mi[at[b,]] - i2[n])
                out.append((a, b, *(x / math.log(2) for x in (i1[n], i2[n], mi[at[a, b]], iq[n], lost, gap[n])), found[at[a, b]][2] / found[at[a, b]][0]))
        first = {k: frame[k].iloc[0] for k in (*keys, "_draw")}
        done = pd.DataFrame(out, columns=["mod1", "mod2", "i1", "i2", "i12", "iq", "lost", "gap", "loss"])
        return pd.concat([pd.DataFrame({k: [v] * len(out) for k, v in first.items()}), done], axis=1)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _draw int, mod1 string, mod2 string, i1 double, i2 double, i12 double, iq double, lost double, gap double, loss double"
    return rows.groupBy(*keys, "_draw").applyInPandas(solve, schema)


def resampled_terms(rows: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], y: str, key: str, train: Column, classes: int, size: int | None = None, resamples: int = 10, seed: int = 42, asked: DataFrame | None = None, told: tuple[str, Sequence[int], Sequence[float]] | None = None) -> DataFrame:
    """keys, mod1, mod2, R, U1, U2, S, MI (bits), i1, i2, i12, iq, lost, gap, loss, train_rows, test_rows, method: a row for each group and pair.

    A nonlinear posterior of each modality and pair is fitted on all training rows of a group, and all rows of the other part are scored.
    With a `size`, for each group and resample ten times as many training rows are drawn without replacement, or all rows if there are no more
    (then, as without a size, the resamples are equal and one is made). Information is the scored posteriors' mean divergence from the class shares of all rows. A modality's posteriors
    are put into at most 32 states, of which the coupling of least information is solved, once a pair: i1, i2 and iq are the states' own, and `lost` is
    the most that a single posterior tells beyond its states. The resamples' informations are averaged before the terms
    are cut at 0. Rows without a label go; a row counts for the posteriors of which it has all modalities. Where a part has no
    row, or a modality no number, and for groups that are `asked` for (keys) but have no row, terms are NaN and the method is 'failed'.
    With `told` (a key, its values, the weight of each) groups that differ in that key only share their models, which are told the value; the
    rows of a value count, or are drawn, by its weight. loss is the pair posterior's mean on the scored rows, in nats.
    """
    need, fits = 10 * size if size else SMALL, fits_of(pairs)
    modalities = sorted({m for p in pairs for m in p})
    used = ["_all", *keys]
    name, values, weights = told or (None, [], [])
    own = [k for k in used if k != name]
    case = F.array(*[F.when(F.col(name) == v, 1.0).otherwise(0.0) for v in values]) if values else F.array().cast("array<double>")
    weight = F.coalesce(*[F.when(F.col(name) == v, F.lit(w / sum(weights))) for v, w in zip(values, weights, strict=True)]) if values else F.lit(1.0)
    base = rows.where(F.col(y).isNotNull()).select(*keys, F.col(key).cast("string").alias("_key"), F.col(y).cast("long").alias(y), train.alias("_train"), case.alias("_told"), weight.alias("_weight"), *modalities)
    base = written(base.withColumn("_all", F.lit(0)).where("_train is not null"), "resampled")
    sizes = written(group_sizes(base, used, own, y, classes, need, resamples if size else 1), "sizes")
    if size:
        models = written(fitted(base, sizes, used, own, fits, y, classes, need, seed), "models")
    else:
        few = F.col("_fitting") <= (0 if name else SMALL)  # rows with weights are for the blocks
        models = written(fitted(base, sizes.where(few), used, own, fits, y, classes, need, seed), "models")
        large = sizes.where(~few & (F.col("train_rows") > 0) & (F.col("test_rows") > 0))
        if not large.isEmpty():
            models = models.unionByName(written(fitted_whole(base, large, used, own, fits, y, classes, seed), "models"))
    sums = written(scored(base, models, sizes, used, own, fits, y, classes), "sums")
    found = informations(sums, sizes, used, fits, pairs, classes)
    mean = found.groupBy(*used, "mod1", "mod2").agg(*[F.avg(c).alias(c) for c in ("i1", "i2", "i12", "iq")], F.max("lost").alias("lost"), F.max("gap").alias("gap"), F.avg("loss").alias("loss"))
    terms = decompose_learned(mean)
    values, counts = [*TERMS, "i1", "i2", "i12", "iq", "lost", "gap", "loss"], ["train_rows", "test_rows"]
    rows = terms.select(*keys, "mod1", "mod2", *values, *[F.lit(None).cast("long").alias(c) for c in counts])
    none = [F.lit(None).cast("double").alias(c) for c in values]
    rows = rows.union(sizes.select(*keys, each_of(pairs), *counts).select(*keys, "p.*", *none, *counts))
    if asked is not None:
        rows = rows.union(asked.select(*keys, each_of(pairs)).select(*keys, "p.*", *none, *[F.lit(0).cast("long").alias(c) for c in counts]))
    out = rows.groupBy(*keys, "mod1", "mod2").agg(*[F.max(c).alias(c) for c in (*values, *counts)])
    return out.select(*keys, "mod1", "mod2", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in values], *counts, F.when(F.col("MI").isNull(), "failed").otherwise("batch").alias("method"))


def each_of(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("mod1"), F.lit(b).alias("mod2")) for a, b in pairs])).alias("p")


def asked_for(groups: DataFrame, by: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Every group and lag."""
    grid = groups.select(*by).distinct() if by else groups.sparkSession.range(1).select()
    return grid.withColumn("lag", F.explode(F.array(*[F.lit(k).cast("long") for k in lags])))


def temporal_batch(df: DataFrame, keys: Sequence[str], key: str, pairs: Sequence[tuple[str, str]], y: str, lags: Sequence[int], classes: int, share: float = 0.8, by: Sequence[str] = (), weights: Sequence[float] | None = None, **options) -> DataFrame:
    """by, lag, and what `resampled_terms` gives of each pair of vectors of series (keys, i, n), paired with the label `lag` steps on:
    fitted on the first `share` of each series' pairs of rows, scored on the rest. `by`, some of the keys, tells apart groups that
    have posteriors of their own. With `weights`, one a lag, each group has one model for all lags, which is told the lag and trained on
    rows of the lags by weight. A group and lag that leave a part without rows are a failed row."""
    modalities = sorted({m for p in pairs for m in p})
    aligned = lag_align(df.select(*keys, "i", "n", key, y, *modalities), keys, modalities, y, max(lags), others=[key])
    aligned = aligned.where(F.col("lag").isin(list(lags))).withColumn("lag", F.col("lag").cast("long"))
    train = F.col("i") < F.floor((F.col("n") - F.col("lag")) * F.lit(share))
    return resampled_terms(aligned, [*by, "lag"], pairs, y, key, train, classes, asked=asked_for(df, by, lags), told=weights and ("lag", list(lags), list(weights)), **options)


def sequence_batch(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]], y: str, lags: Sequence[int], classes: int, mask: str | dict[str, str] | None = None, pooling: str = "timestep", share: float = 0.8, seed: int = 42, **options) -> DataFrame:
    """lag, and what `resampled_terms` gives of each pair of modalities of labelled sequences (key, t, n) without their last `lag` steps.

    Pooling 'timestep' makes each step a row, 'mean' each sequence, by the mean of a modality's steps where its mask holds (one mask column, or
    one for each modality); a sequence without such a step has no number of the modality. A random `share` of the rows fits, the rest is scored.
    """
    if pooling not in ("timestep", "mean"):
        raise ValueError("pooling is 'timestep' or 'mean'")
    modalities = sorted({m for p in pairs for m in p})
    masks = mask if isinstance(mask, dict) else dict.fromkeys(modalities, mask)
    steps = df.withColumn("lag", F.explode(F.array(*[F.lit(k).cast("long") for k in lags]))).where(F.col("t") < F.col("n") - F.col("lag"))
    if pooling == "timestep":
        rows = steps.select("lag", F.concat_ws(":", F.col(key).cast("string"), F.col("t").cast("string")).alias("_k"), *modalities, y)
    else:
        rows = steps.groupBy("lag", key).agg(F.min(y).alias(y))
        kept = lambda m: steps if not masks[m] else steps.where(masks[m])
        for m in modalities:
            rows = rows.join(vector_bucket_mean(kept(m), ["lag", key], m), ["lag", key], "left")
        rows = rows.where(F.greatest(*[F.col(m).isNotNull() for m in modalities], F.lit(False))).withColumn("_k", F.col(key).cast("string"))
    placed = ranked(rows.where(F.col(y).isNotNull()), "_k", seed, by=["lag"])
    train = F.col("rank") < F.expr(f"int({share}D * total)")
    return resampled_terms(placed, ["lag"], pairs, y, "_k", train, classes, seed=seed, asked=asked_for(df, (), lags), **options)


def choose_method(width: int) -> str:
    """By the number of features of both inputs: counts of row means, or fitted posteriors."""
    return "joint" if width <= 50 else "batch"


def counted_vectors(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]], y: str, lags: Sequence[int], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """by, lag, mod1, mod2, b1, b2, yb, n: a vector's bin is its mean's, between the least and greatest number of the modality's vectors in
    the group and lag. Vectors are three numbers each before they are paired with later labels."""
    modalities = sorted({m for p in pairs for m in p})
    flat = df.select(*keys, "i", "n", y, *[F.array(row_mean(F.col(m)), F.array_min(m), F.array_max(m)).alias(m) for m in modalities])
    rows = lag_align(flat, keys, modalities, y, max(lags)).where(F.col("lag").isin(list(lags)) & F.col(y).isNotNull()).withColumn("lag", F.col("lag").cast("long"))
    edges = rows.groupBy(*by, "lag").agg(*[f(F.get(m, F.lit(k))).alias(f"_{m}_{e}") for m in modalities for e, f, k in (("lo", F.min, 1), ("hi", F.max, 2))])
    binned = [equal_width_bin(F.get(m, F.lit(0)), F.col(f"_{m}_lo"), F.col(f"_{m}_hi"), bins).alias(m) for m in modalities]
    rows = rows.join(edges, [*by, "lag"]).select(*by, "lag", F.col(y).cast("long").alias("yb"), *binned)
    each = F.array(*[F.struct(F.lit(a).alias("mod1"), F.lit(b).alias("mod2"), F.col(a).alias("b1"), F.col(b).alias("b2")) for a, b in pairs])
    rows = rows.select(*by, "lag", "yb", F.explode(each).alias("p")).select(*by, "lag", "p.*", "yb").where("b1 is not null and b2 is not null")
    return rows.groupBy(*by, "lag", "mod1", "mod2", *CELL).agg(F.count("*").alias("n"))


def vector_terms(df: DataFrame, keys: Sequence[str], key: str, pairs: Sequence[tuple[str, str]], y: str, classes: int, lags: Sequence[int] = (0,), method: str = "auto", bins: int = 16, by: Sequence[str] = (), **options) -> DataFrame:
    """by, lag, mod1, mod2, terms in bits, gap and method of pairs of vector columns of series (keys, i, n): all groups, pairs and lags at once.

    The method goes by the widths of a pair's two columns (the widest row of each), or is given: 'joint' counts bins of row means, 'batch' fits posteriors. Groups
    and lags from which nothing could be learned are rows with the method 'failed' and NaN terms.
    """
    if method not in ("auto", "joint", "batch"):
        raise ValueError("method is 'auto', 'joint' or 'batch'")
    modalities = sorted({m for p in pairs for m in p})
    chosen = dict.fromkeys(pairs, method)
    if method == "auto":
        widths = df.agg(*[F.coalesce(F.max(F.size(m)), F.lit(0)).alias(m) for m in modalities]).first()
        chosen = {p: choose_method(widths[p[0]] + widths[p[1]]) for p in pairs}
    counted, fits = ([p for p in pairs if chosen[p] == m] for m in ("joint", "batch"))
    columns, parts = [*by, "lag", "mod1", "mod2", *TERMS, "gap", "method"], []
    if counted:
        found = pid(counted_vectors(df, keys, counted, y, lags, bins, by), [*by, "lag", "mod1", "mod2"], unit="bits").withColumn("method", F.lit("joint"))
        grid = asked_for(df, by, lags).select(*by, "lag", each_of(counted)).select(*by, "lag", "p.*")
        rows = grid.join(found, [*by, "lag", "mod1", "mod2"], "left")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in (*TERMS, "gap")}).withColumn("method", F.coalesce("method", F.lit("failed")))
        parts.append(rows.select(*columns))
    if fits:
        parts.append(temporal_batch(df, keys, key, fits, y, lags, classes, by=by, **options).select(*columns))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
