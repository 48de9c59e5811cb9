"""Evaluation of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.sources.storage import written


def confusion_matrix(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """actual, predicted, n with zero cells kept, over the labels seen on either side."""
    seen = df.agg(F.array_sort(F.array_union(F.collect_set(F.col(y).cast("long")), F.collect_set(F.col(predicted).cast("long")))).alias("_l"))
    grid = seen.select("_l", F.explode("_l").alias("actual")).select("actual", F.explode("_l").alias("predicted"))
    counts = df.groupBy(F.col(y).cast("long").alias("actual"), F.col(predicted).cast("long").alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; 0 where undefined."""
    c = matrix.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("named")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("named")))).alias("x")).select("x.*")
    s = c.groupBy("label").agg(F.sum("support").alias("support"), F.sum("hit").alias("hit"), F.sum("named").alias("named"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    s = s.withColumns({"precision": zero(F.try_divide("hit", "named")), "recall": zero(F.try_divide("hit", "support"))})
    return s.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("label", "precision", "recall", "f1", "support")


def overall_metrics(matrix: DataFrame) -> DataFrame:
    """accuracy and the metrics weighted by support."""
    accuracy = matrix.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")).first()[0]
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return class_metrics(matrix).agg(F.lit(accuracy).alias("accuracy"), w("precision"), w("recall"), w("f1"))


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row a distinct score with its positives and negatives."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def roc_curve(df: DataFrame, y: str, score: str, buckets: int = 64) -> DataFrame:
    """score, tp, fp: positives and negatives at or above each distinct score.

    Running sums without one task for all scores: scores are dealt into ranges by their quantiles, summed
    within a range, and the few ranges' totals before are added.
    """
    counts = score_counts(df, y, score)
    cuts = counts.agg(F.percentile_approx("score", [k / buckets for k in range(1, buckets)])).first()[0] or []
    part = counts.withColumn("_b", F.aggregate(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>"), F.lit(0), lambda s, c: s + F.when(F.col("score") <= c, 1).otherwise(0)))
    sizes = part.groupBy("_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_q"))
    inside = Window.partitionBy("_b").orderBy(F.desc("score"))
    run = part.withColumn("_tp", F.sum("pos").over(inside)).withColumn("_fp", F.sum("neg").over(inside))
    return run.join(F.broadcast(starts), "_b").select("score", (F.col("_tp") + F.col("_p")).alias("tp"), (F.col("_fp") + F.col("_q")).alias("fp"), "pos", "neg")


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """auc by trapezoids; 0 where there is one class."""
    c = roc_curve(df, y, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.agg(F.coalesce(F.try_divide(area, F.sum("pos") * F.sum("neg")), F.lit(0.0)).alias("auc"))


def log_loss(df: DataFrame, y: str, probability: str) -> DataFrame:
    """Mean of -ln of the probability given to the true of two classes, kept within 1e-12 of 0 and 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-12)), F.lit(1 - 1e-12))
    return df.agg(F.avg(-F.log(F.when(F.col(y) == 1, p).otherwise(1 - p))).alias("loss"))


def log_loss_classes(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """Mean of -ln of the probability given to the true class, kept at or above 1e-12; a class without a number has 0."""
    p = F.coalesce(F.get(probabilities, F.col(y).cast("int")), F.lit(0.0))
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"))


def roc_auc_classes(df: DataFrame, y: str, probabilities: str, classes: int) -> DataFrame:
    """auc of each class against the rest, averaged by the classes' rows; 0 where a class has no row or there is one class."""
    df = written(df.select(y, probabilities), "predictions")  # read once a class and more
    one = lambda k: roc_auc(df.select((F.col(y) == k).cast("long").alias("_y"), F.get(probabilities, F.lit(k)).alias("_p")), "_y", "_p")
    each = reduce(DataFrame.union, [one(k).select(F.lit(k).alias("_k"), "auc") for k in range(classes)])
    rows = df.groupBy(F.col(y).cast("int").alias("_k")).agg(F.count("*").alias("_n"))
    seen = each.join(rows, "_k", "left")
    return seen.agg(F.when((F.count("_n") == classes) & (F.lit(classes) > 1), F.sum(F.col("auc") * F.col("_n")) / F.sum("_n")).otherwise(0.0).alias("auc"))


def best_epoch(df: DataFrame, epoch: str, metric: str) -> DataFrame:
    """The epoch with the highest metric, the earliest on ties."""
    return df.agg(F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias(epoch), F.max(metric).alias(metric))
