"""Splitting notes into chunks under a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chunks that are gathered before they move to the list of full blocks.
BLOCK = 256


def word_count(text: Column) -> Column:
    """The default token counter: words separated by blanks and tabs."""
    return F.regexp_count(text, F.lit(r"[^ \t]+")).cast("long")


def chunk_lines(text: Column, budget: int = 510, count: Callable[[Column], Column] = word_count, block: int = BLOCK) -> Column:
    """array<struct<chunk, tokens>>: lines packed greedily, joined by a blank, each chunk within the budget.

    A line above the budget is a chunk of its own; the tail is a chunk too; empty chunks don't occur; null for a null
    text. Chunks are gathered in blocks, so a step copies at most a block and the list of full blocks.
    """
    chunks = "array<struct<chunk:string,tokens:bigint>>"
    none = F.array().cast(chunks)
    empty = F.struct(F.array().cast(f"array<{chunks}>").alias("full"), none.alias("block"), F.lit("").alias("chunk"), F.lit(0).cast("long").alias("tokens"))
    lines = F.filter(F.split(text, "\n"), lambda x: count(x) > 0)

    def added(s: Column) -> Column:
        return F.concat(s["block"], F.array(F.struct(s["chunk"].alias("chunk"), s["tokens"].alias("tokens"))))

    def step(s: Column, line: Column) -> Column:
        n = count(line)
        fits = (s["tokens"] + n <= budget) | (s["tokens"] == 0)
        moved = ~fits & (F.size(s["block"]) >= block - 1)
        joined = F.when(s["tokens"] > 0, F.concat(s["chunk"], F.lit(" "), line)).otherwise(line)
        return F.struct(
            F.when(moved, F.concat(s["full"], F.array(added(s)))).otherwise(s["full"]).alias("full"),
            F.when(fits, s["block"]).when(moved, none).otherwise(added(s)).alias("block"),
            F.when(fits, joined).otherwise(line).alias("chunk"),
            F.when(fits, s["tokens"] + n).otherwise(n).alias("tokens"),
        )

    return F.aggregate(lines, empty, step, lambda s: F.flatten(F.concat(s["full"], F.array(F.when(s["tokens"] > 0, added(s)).otherwise(s["block"])))))
