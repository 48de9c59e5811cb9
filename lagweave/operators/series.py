"""Time-series operators: positions, lags, interpolation, grids and row windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a part that holds whole series, about.
PART = 50_000


def spread(df: DataFrame, keys: Sequence[str], rows: int, part: int = PART) -> DataFrame:
    """df, of so many rows, dealt by its keys into parts of about `part` rows: what a task holds then doesn't grow with the table.
    Where the session's own number of parts does, it stays."""
    parts = -(-rows // part)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def series_index(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """i: 0-based position in a series; n: the series' length. One shuffle by series for both."""
    w = Window.partitionBy(*keys)
    return df.withColumn("i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count("*").over(w))


def lag_align(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, max_lag: int, order: str = "i", length: str = "n", others: Sequence[str] = ()) -> DataFrame:
    """(x at i, y at i + lag) for lags 0..max_lag: all leads in one window pass, exploded afterwards.

    Rows without a partner are left out by position, so a null label stays a null label.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    leads = F.array(*[F.struct(F.lead(y, k).over(w).alias("y")) for k in range(max_lag + 1)])
    wide = df.select(*keys, order, length, *x, *others, leads.alias("_y"))
    out = wide.select(*keys, order, length, *x, *others, F.posexplode("_y").alias("lag", "_s"))
    return out.where(F.col(order) < F.col(length) - F.col("lag")).select(*keys, order, length, *others, "lag", *x, F.col("_s.y").alias(y))


def lag_align_ranged(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, max_lag: int, whole: bool = False) -> DataFrame:
    """keys, lag, x, y as `lag_align` has them, and of each column its least and greatest number over the lag's slice (c_lo, c_hi), and with
    `whole` whether all are whole numbers (c_w). These come from the window that has the leads, before rows are multiplied by lags: no join, no shuffle."""
    w, every = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def facts(c: str, lag: int) -> list[Column]:
        there = F.when(F.col("i") >= lag if c == y else F.col("i") < F.col("n") - lag, F.col(c))
        found = [F.min(there).over(every).alias(f"{c}_lo"), F.max(there).over(every).alias(f"{c}_hi")]
        return [*found, F.coalesce(F.min(there == F.floor(there)).over(every), F.lit(True)).alias(f"{c}_w")] if whole else found

    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(y, k).over(w).alias(y), *[f for c in (*x, y) for f in facts(c, k)]) for k in range(max_lag + 1)])
    wide = df.select(*keys, "i", "n", *x, y).select(*keys, "i", "n", *x, lags.alias("_s"))
    out = wide.select(*keys, "i", "n", *x, F.explode("_s").alias("_s")).where("i < n - _s.lag")
    return out.select(*keys, *x, "_s.*")


def lag_trim(df: DataFrame, lag: Column, order: str = "t", length: str = "n") -> DataFrame:
    """Without the last `lag` steps of each series."""
    return df.where(F.col(order) < F.col(length) - lag)


def lag_grid(length: int, lags: int) -> list[int]:
    """Evenly spaced lags, 0 first; the length must be a multiple."""
    if length % lags:
        raise ValueError("the length must be divisible by the number of lags")
    return [k * length // lags for k in range(lags)]


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Linear between known neighbours by position, the nearest known value outside; all-null series stay null.

    The next known value is the last one in reverse order: a frame that only grows, so time is linear in the series.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    new = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(order))
        v0, i0, v1, i1 = F.last(c, True).over(before), F.last(at, True).over(before), F.last(c, True).over(after), F.last(at, True).over(after)
        new[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(v0 + (v1 - v0) * (F.col(order) - i0) / (i1 - i0))
    return df.withColumns(new)


def bucket(hours: Column, width: float = 1.0) -> Column:
    """Bucket of a time, cut towards zero, so (-1, 0] falls in bucket 0 too."""
    return (hours / width).cast("long")


def bucket_mean(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], width: float = 1.0) -> DataFrame:
    """Mean of each bucket, nulls skipped; negative buckets go."""
    b = df.withColumn("t", bucket(F.col(time), width)).where("t >= 0")
    return b.groupBy(*keys, "t").agg(*[F.avg(c).alias(c) for c in columns])


def regular_grid(df: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Every whole step from 0 to each series' last one; steps without a row have nulls, but true keys."""
    grid = df.groupBy(*keys).agg(F.max(time).alias("_m")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias(time))
    return grid.join(df, [*keys, time], "left")


def impute(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], width: float = 1.0, upto: int | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Bucket means on a regular grid, interpolated, and the column's mean over all rows where a series has none.

    With `upto` the grid ends there: later buckets only lend their values to the line that leads to them. With `keep` only
    these keys' series are made; the means are still those of all rows.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    kept = df if keep is None else df.join(keep.select(*keys).distinct(), list(keys), "left_semi")
    last = F.max(bucket(F.col(time), width)) + 1
    steps = kept.groupBy(*keys).agg((last if upto is None else F.least(last, F.lit(upto + 1))).alias("_n")).agg(F.sum("_n")).first()[0] or 0  # decides the number of parts only
    buckets = spread(bucket_mean(kept, keys, time, columns, width), [*keys, "t"], steps)
    if upto is None:
        grid = regular_grid(buckets, keys)
    else:
        ends = buckets.groupBy(*keys).agg(F.least(F.max("t"), F.lit(upto).cast("long")).alias("_m")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("t"))
        grid = ends.join(buckets, [*keys, "t"], "left").unionByName(buckets.where(F.col("t") > upto))
    filled = interpolate_linear(spread(grid, keys, steps), keys, "t", columns)
    if upto is not None:
        filled = filled.where(F.col("t") <= upto)
    return filled.fillna({c: means[c] for c in columns if means[c] is not None})


def vector_bucket_mean(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of vectors by key, in (pos, value) order; partial sums, so no vectors are gathered."""
    flat = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = flat.groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(vector))


def align_vectors(rows: DataFrame, steps: DataFrame, key: str, time: str, vector: str, dims: int, width: float = 1.0, interpolate: bool = False) -> DataFrame:
    """(key, t, vector, mask) on each key's grid of n steps, which `steps` (key, n) gives: a bucket's mean, zeros and a false mask elsewhere.

    With `interpolate`, a key that has any vector gets lines between them, the nearest one outside, and a true mask
    throughout. Times off the grid go; a key without vectors stays zero and false, one of no steps has no rows.
    """
    placed = rows.withColumn("t", bucket(F.col(time), width)).join(steps, key).where("t >= 0 and t < n")
    means = vector_bucket_mean(placed, [key, "t"], vector)
    grid = steps.where("n > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("t")).join(means, [key, "t"], "left")
    if interpolate:
        before = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        after = Window.partitionBy(key).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        known = F.when(F.col(vector).isNotNull(), F.struct("t", vector))
        grid = grid.withColumn("_a", F.last(known, True).over(before)).withColumn("_b", F.last(known, True).over(after))
        share = (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
        line = F.zip_with(F.col(f"_a.{vector}"), F.col(f"_b.{vector}"), lambda x, y: x + (y - x) * share)
        grid = grid.withColumn(vector, F.coalesce(vector, F.when(F.col("_a").isNull(), F.col(f"_b.{vector}")).when(F.col("_b").isNull(), F.col(f"_a.{vector}")).otherwise(line)))
    return grid.select(key, "t", F.coalesce(vector, F.array_repeat(F.lit(0.0), dims)).alias(vector), F.col(vector).isNotNull().alias("mask"))


def sliding_windows(df: DataFrame, keys: Sequence[str], size: int, step: int, order: str = "i", length: str = "n") -> DataFrame:
    """Each row once for each full window of `size` rows that holds it; w is the window's number, pos the place in it."""
    i, last = F.col(order), F.floor((F.col(length) - size) / step)
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / step))
    high = F.least(F.floor(i / step), last)
    held = df.where(F.col(length) >= size).withColumn("_lo", low.cast("long")).withColumn("_hi", high.cast("long")).where("_lo <= _hi")
    return held.withColumn("w", F.explode(F.sequence("_lo", "_hi"))).withColumn("pos", i - F.col("w") * step).drop("_lo", "_hi")


def truncate_pad(values: Column, size: int, fill: Column, keep_last: bool = False) -> Column:
    """An array of exactly `size`: the first or last ones, or filled up on the right."""
    cut = F.when(F.size(values) > size, F.slice(values, F.greatest(F.size(values) - size + 1, F.lit(1)) if keep_last else F.lit(1), F.lit(size))).otherwise(values)
    return F.concat(cut, F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 3.6e9


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key under an order, without sorting groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def timeline_segments(lags: DataFrame, steps: int, count: int) -> DataFrame:
    """Rows by lag index k spread over `steps` time steps: equal blocks, the last reaching the end."""
    width = max(1, steps // count)
    grid = lags.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    return grid.where(F.least(F.floor(F.col("t") / width), F.lit(count - 1)) == F.col("k"))


def timeline_interp(knots: DataFrame, keys: Sequence[str], steps: int, value: str = "value") -> DataFrame:
    """Values at lags, clamped to the last step, as a line over the steps; flat outside the knots."""
    k = knots.withColumn("t", F.least(F.col("lag").cast("long"), F.lit(steps - 1).cast("long")))
    k = k.groupBy(*keys, "t").agg(F.max_by(value, "lag").alias(value))
    grid = k.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("t"))
    return interpolate_linear(grid.join(k, [*keys, "t"], "left"), keys, "t", [value])


def timeline_symmetric(rows: DataFrame, value: str) -> DataFrame:
    """(m1, m2, t, value) in both orders, for terms that belong to a pair; a pair that comes twice counts once."""
    both = F.array(F.struct(F.col("mod1").alias("m1"), F.col("mod2").alias("m2")), F.struct(F.col("mod2").alias("m1"), F.col("mod1").alias("m2")))
    flat = rows.select(F.explode(both).alias("m"), F.col("t").cast("long").alias("t"), value).select("m.m1", "m.m2", "t", value)
    return flat.groupBy("m1", "m2", "t").agg(F.first(value).alias(value))


def timeline_unique(rows: DataFrame, u1: str, u2: str) -> DataFrame:
    """(m, t, u): the largest unique term of a modality over its pairs, at least 0."""
    each = F.array(F.struct(F.col("mod1").alias("m"), F.col(u1).alias("u")), F.struct(F.col("mod2").alias("m"), F.col(u2).alias("u")))
    flat = rows.select(F.explode(each).alias("x"), F.col("t").cast("long").alias("t"))
    return flat.groupBy("x.m", "t").agg(F.greatest(F.lit(0.0), F.max("x.u")).alias("u"))
