"""Array functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def row_mean(a: Column) -> Column:
    return total(a) / F.size(a)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: a lambda's variable over an array of one."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(a: Column) -> Column:
    """One pass each for the largest, the exponentials, their sum and the shares."""
    exps = lambda v: bind(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return bind(a, lambda v: bind(exps(v), lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t))))


def log_softmax(a: Column) -> Column:
    logs = lambda v, m: F.log(total(F.transform(v, lambda x: F.exp(x - m)))) + m
    return bind(a, lambda v: bind(bind(F.array_max(v), lambda m: logs(v, m)), lambda t: F.transform(v, lambda x: x - t)))


def argmax(a: Column) -> Column:
    """0-based index of the largest number, the first on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def kl(p: Column, q: Column) -> Column:
    """Sum of p ln(p / q); terms with p = 0 count nothing, and one with q = 0 alone makes it infinite."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x <= 0, 0.0).when(y > 0, x * F.log(x / y)).when(y == 0, float("inf"))))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, m) + kl(q, m)) / 2


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0..bins-1 over equal bins of [low, high]; the right edge and a constant column fall in the last bin."""
    width = (high - low) / float(bins)
    passed = sum((F.when(x >= low + float(k) * width, 1).otherwise(0) for k in range(2, bins)), F.when(x >= low + width, 1).otherwise(0)) if bins > 1 else F.lit(0)
    return F.when(x.isNotNull(), passed).cast("long")
