"""Diagnostics over routing logs: (sample, modality, t, probabilities, chosen experts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions.arrays import jsd, log_softmax, total

from .aggregate import share_of_total


def activation_ratio(df: DataFrame, experts: int) -> DataFrame:
    """modality, expert, n, ratio: percent of a modality's slots sent to each expert, zero cells kept."""
    chosen = df.select("modality", F.explode("experts").alias("expert")).groupBy("modality", "expert").agg(F.count("*").alias("n"))
    grid = df.select("modality").distinct().select("modality", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(experts - 1).cast("long"))).alias("expert"))
    all_ = grid.join(chosen, ["modality", "expert"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return share_of_total(all_, "n", ["modality"], "ratio").withColumn("ratio", F.col("ratio") * 100)


def expert_composition(ratios: DataFrame) -> DataFrame:
    """Per expert the share of each modality's ratio."""
    return share_of_total(ratios, "ratio", ["expert"], "share")


def load_balance(df: DataFrame, experts: int) -> DataFrame:
    """experts * sum of (share of slots * mean probability): 1 when balanced."""
    slots = df.select(F.explode("experts").alias("expert")).groupBy("expert").agg(F.count("*").alias("n"))
    mean = df.select(F.posexplode("probs").alias("expert", "p")).groupBy(F.col("expert").cast("long").alias("expert")).agg(F.avg("p").alias("p"))
    joined = mean.join(slots, "expert", "left")
    return joined.agg((experts * F.sum(F.coalesce("n", F.lit(0)) * F.col("p")) / F.sum("n")).alias("loss"))


def modality_pairs(df: DataFrame, keys: Sequence[str], probs: str = "probs") -> DataFrame:
    """keys, m1, m2, p1, p2: a token's modalities in pairs. Few modalities share a token, so pairs come from its own array."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("modality", F.col(probs).alias("p")))).alias("_a"))
    one = rows.select(*keys, "_a", F.posexplode("_a").alias("_i", "_x"))
    two = one.select(*keys, "_x", F.explode(F.slice("_a", F.col("_i") + 2, F.size("_a"))).alias("_z"))
    return two.select(*keys, F.col("_x.modality").alias("m1"), F.col("_z.modality").alias("m2"), F.col("_x.p").alias("p1"), F.col("_z.p").alias("p2"))


def divergence(variant: str = "standard") -> Column:
    p, q = F.col("p1"), F.col("p2")
    if variant == "reference":
        p, q = (F.transform(log_softmax(x), lambda v: F.exp(v)) for x in (p, q))
    return jsd(p, q)


def no_synergy(synergy_experts: Sequence[int]) -> Column:
    at = lambda c: total(F.array(*[F.get(c, F.lit(k)) for k in synergy_experts]))
    return 1 - (at("p1") + at("p2")) / 2


def divergence_where(pairs: DataFrame, condition, sign: float = 1.0, variant: str = "standard") -> DataFrame:
    """Mean divergence of the pairs' routing where the condition holds, times sign; 0 where it never does.

    variant 'reference' takes the softmax of the probabilities once more before comparing.
    """
    return pairs.where(condition).agg(F.count("*").alias("n"), (sign * F.coalesce(F.avg(divergence(variant)), F.lit(0.0))).alias("loss"))


def synergy_assignment(pairs: DataFrame, condition, synergy_experts: Sequence[int]) -> DataFrame:
    """Mean of 1 - the two modalities' mean probability of the synergy experts."""
    return pairs.where(condition).agg(F.count("*").alias("n"), F.coalesce(F.avg(no_synergy(synergy_experts)), F.lit(0.0)).alias("loss"))


def gate(pairs: DataFrame, unique: DataFrame, shared: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every pair (on, m1, m2, p1, p2) with its information terms at that time: u1 and u2 of its modalities in unique
    (on, m, u), r and s of the pair in shared (on, m1, m2, r, s); null where there are none."""
    of = lambda k: unique.select(*on, F.col("m").alias(f"m{k}"), F.col("u").alias(f"u{k}"))
    return pairs.join(of(1), [*on, "m1"], "left").join(of(2), [*on, "m2"], "left").join(shared.select(*on, "m1", "m2", "r", "s"), [*on, "m1", "m2"], "left")


def counts_for(term: str, limit: float) -> Column:
    """Whether a row of `gate` counts for a term: for U both modalities' u are above the limit, for R and S the pair's own term is."""
    return (F.col("u1") > limit) & (F.col("u2") > limit) if term == "U" else F.col(term.lower()) > limit


def gated_losses(rows: DataFrame, limits: dict[str, float], synergy_experts: Sequence[int], weights: dict[str, float] | None = None, variant: str = "standard") -> DataFrame:
    """term, n, loss of the rows of `gate` whose information terms are above their limits, all three in one pass.

    U: minus the divergence; R: the divergence; S: one minus the mean probability of the synergy experts. Means over the
    pairs that count, times the term's weight; 0 where none does. A pair without a term counts for none.
    """
    value = {"U": -divergence(variant), "R": divergence(variant), "S": no_synergy(synergy_experts)}
    count = {t: counts_for(t, limits[t]) for t in value}
    one = rows.agg(*[x for t, v in value.items() for x in (F.count_if(count[t]).alias(f"n{t}"), F.avg(F.when(count[t], v)).alias(f"l{t}"))])
    weigh = lambda t: F.coalesce(F.col(f"l{t}"), F.lit(0.0)) * (weights or {}).get(t, 1.0)
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"n{t}").alias("n"), weigh(t).alias("loss")) for t in value])))


def weighted_mix(chosen: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, v: sum over the chosen experts of weight times the expert's output number, from (keys, expert, weight) and (expert, pos, v)."""
    return chosen.join(outputs, "expert").groupBy(*keys, "pos").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
