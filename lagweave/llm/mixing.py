"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed by (source, lang, topic); these cells are raked until their marginals meet the targets;
each document is then kept with a probability in proportion to its cell's fitted weight a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A marginal's target share goes as its natural share to this power: below 1 evens a dimension out.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 1.0}
ROUNDS, SEED = 8, 17
WORD = r"[^ \t\n\x0B\f\r]+"
LEGAL = "licen[sc]e|rights reserved|copyright"
#: Share of the tokens to keep, of what the most wanted cell allows.
BUDGET = 1.0
#: Cells that one task rakes; more are dealt by level and written after each round.
ONE_TASK = 50_000


def default_topic() -> Column:
    """A coarse topic, by what is in the whole text: contact data, legal lines, tables, or prose."""
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(F.lower(text).rlike(LEGAL), "legal")
        .when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table")
        .otherwise("prose")
    )


def token_count() -> Column:
    """Words of the whole text, as ASCII white space separates them."""
    text = F.coalesce("text", F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def dimensions(topic: Column | None = None) -> dict[str, Column]:
    """Null sources and languages are a level of their own, 'none'."""
    none = F.lit("none")
    return {"source": F.coalesce("source", none), "lang": F.coalesce("lang", none), "topic": default_topic() if topic is None else topic}


def targets(cells: DataFrame, powers: dict[str, float], goals: dict[str, DataFrame] | None = None) -> DataFrame:
    """dimension, level, target: the share each level of the cells is to have; those of a dimension add up to 1.

    goals has tables (a level in the dimension's column, _target) for some or all dimensions; the others go by their
    power. Goals of levels without tokens can't be met and are left out; a level without a goal is an error.
    """
    goals, each = goals or {}, [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in powers]
    levels = cells.select("tokens", F.explode(F.array(*each)).alias("x")).groupBy("x.dimension", "x.level").agg(F.sum("tokens").cast("double").alias("tokens"))
    wish = F.coalesce(*[F.when(F.col("dimension") == d, F.pow("tokens", F.lit(p))) for d, p in powers.items() if d not in goals], F.lit(None).cast("double"))
    wished = levels.withColumn("wish", wish)
    for d, goal in goals.items():
        given = goal.groupBy(F.col(d).cast("string").alias("level")).agg(F.sum("_target").cast("double").alias("given")).withColumn("dimension", F.lit(d))
        wished = wished.join(given, ["dimension", "level"], "left").withColumn("wish", F.coalesce("given", "wish")).drop("given")
    wished = written(wished, "goals")
    lacking = wished.where("wish is null").limit(5).collect()
    if lacking:
        raise ValueError(f"no goal for {sorted((r['dimension'], r['level']) for r in lacking)}")
    return wished.select("dimension", "level", (F.col("wish") / F.sum("wish").over(Window.partitionBy("dimension"))).alias("target"))


def rake(cells: DataFrame, goals: DataFrame, dims: list[str], rounds: int = ROUNDS, one_task: int = ONE_TASK) -> DataFrame:
    """cells with weight: in turn for each dimension, weights are scaled so its marginal is the target.

    goals: what `targets` returns. A step reads the weights once, through a window over the dimension's level, so
    the plan grows by one window a step. Few cells are raked in one task without a shuffle; else each round is written.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in dims:
        now = now.join(goals.where(F.col("dimension") == d).select(F.col("level").alias(d), F.col("target").alias(f"goal_{d}")), d)
    now = written(now, "cells")
    few = now.count() <= one_task
    now = now.coalesce(1) if few else now
    for _ in range(rounds):
        for d in dims:
            now = now.withColumn("weight", F.col("weight") * F.col(f"goal_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        now = now if few else written(now, "raked")
    return written(now.drop(*[f"goal_{d}" for d in dims]), "raked")


def marginals(raked: DataFrame, goals: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, level, target and share after raking: how far the rounds have come."""
    each = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in dims]
    sums = raked.select("weight", F.explode(F.array(*each)).alias("x")).groupBy("x.dimension", "x.level").agg(F.sum("weight").alias("weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("dimension"))
    return sums.join(goals, ["dimension", "level"]).select("dimension", "level", "target", share.alias("share"))


def draw(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """A number from 0 to 1 that depends on doc_id alone: ten hex digits of a digest that any SQL engine has."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("none")))
    return F.conv(F.substring(F.md5(name), 1, 10), 16, 10).cast("double") / float(1 << 40)


def chances(counted: DataFrame, powers: dict[str, float], budget: float, rounds: int, goals: dict[str, DataFrame] | None) -> DataFrame:
    """probability of each cell: its fitted weight a token over the largest such ratio, times budget.

    The table is written, so that Spark knows its size: rows find their cell in a broadcast if it is below the
    session's limit, else by a shuffle, in which Spark splits cells that hold very many rows.
    """
    dims = list(powers)
    cells = written(counted.where("n_tokens > 0").groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "cells")
    ratio = rake(cells, targets(cells, powers, goals), dims, rounds).withColumn("_ratio", F.col("weight") / F.col("tokens"))
    most = ratio.agg(F.max("_ratio")).first()[0] or 1.0
    return written(ratio.select(*dims, F.least(F.lit(1.0), budget * F.col("_ratio") / F.lit(most)).alias("probability")), "chances")


def mix(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED, topic: Column | None = None, goals: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and sampled of every row.

    The draw is a hash of doc_id, the same in every run; rows of one doc_id in one cell go together. Texts
    without words (null ones too) have no tokens, belong to no cell and are not sampled: probability 0. An
    empty table gives no rows; extra columns are ignored. Texts are read once: what the fit needs of them is written.
    """
    powers = powers or POWERS
    counted = written(docs.select("doc_id", *(c.alias(d) for d, c in dimensions(topic).items()), token_count().alias("n_tokens")), "counted")
    found = counted.join(chances(counted, powers, budget, rounds, goals), list(powers), "left")
    found = found.withColumn("probability", F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", (draw(seed=seed) < F.col("probability")).alias("sampled"))


def sampled_documents(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED, topic: Column | None = None, goals: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents that `mix` samples, all columns, whatever their names. Repeated rows and rows of one doc_id in one
    cell go or stay together; texts without words go; an empty table gives no rows.

    The rows are written beside what the fit needs of their texts, so the patterns pass over each text once.
    """
    powers = powers or POWERS
    held = docs.select(F.struct("*").alias("row"), *(c.alias(d) for d, c in dimensions(topic).items()), token_count().alias("n_tokens"))
    held = written(held, "counted").where("n_tokens > 0")
    found = held.join(chances(held.drop("row"), powers, budget, rounds, goals), list(powers))
    return found.where(draw("row.doc_id", seed) < F.col("probability")).select("row.*")


def mix_sql(powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """What `mix` computes over the table documents, as one DuckDB statement; the probability has six digits."""
    powers = powers or POWERS
    dims = ", ".join(powers)
    parts = [
        f"""counted AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
  CASE WHEN regexp_matches(lower(coalesce(text, '')), '{LEGAL}') THEN 'legal' WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), ' | ') THEN 'table' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens,
  CAST(CAST(concat('0x', substr(md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), 'none'))), 1, 10)) AS BIGINT) AS DOUBLE) / {float(1 << 40)}::DOUBLE AS draw FROM documents)""",
        f"w0 AS (SELECT {dims}, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS weight FROM counted WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for d, p in powers.items():
        parts.append(f"goal_{d} AS (SELECT {d}, t / sum(t) OVER () AS target FROM (SELECT {d}, pow(sum(tokens), {p}::DOUBLE) AS t FROM w0 GROUP BY {d}))")
    step = 0
    for _ in range(rounds):
        for d in powers:
            step += 1
            parts.append(f"w{step} AS MATERIALIZED (SELECT {dims}, tokens, weight * target / sum(weight) OVER (PARTITION BY {d}) AS weight FROM w{step - 1} JOIN goal_{d} USING ({d}))")
    parts.append(f"chance AS (SELECT {dims}, least(1.0::DOUBLE, {budget}::DOUBLE * (weight / tokens) / max(weight / tokens) OVER ()) AS p FROM w{step})")
    chosen = "CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END"
    return f"WITH {', '.join(parts)} SELECT doc_id, {dims}, n_tokens, round({chosen}, 6) AS probability, draw < {chosen} AS sampled FROM counted LEFT JOIN chance USING ({dims})"
