"""Class scores, model choice and label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_f1(pairs: DataFrame, truth: str = "gt", prediction: str = "pred") -> DataFrame:
    """``class, tp, n_gt, n_pred, f1`` for each class that occurs on either side.

    Pairs are first counted by (truth, prediction), which leaves at most classes squared rows, so a class
    that holds most of the rows is combined before the shuffle.
    """
    counts = pairs.groupBy(F.col(truth).alias("g"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("g").alias("class"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                         F.col("n").alias("n_gt"), F.lit(0).cast("bigint").alias("n_pred")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                         F.lit(0).cast("bigint").alias("n_gt"), F.col("n").alias("n_pred")),
            )
        ).alias("s")
    ).select("s.*")
    out = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gt", "n_pred")])
    return out.withColumn("f1", 2.0 * F.col("tp") / (F.col("n_gt") + F.col("n_pred")))


def macro_f1(pairs: DataFrame, ignored: tuple = (), truth: str = "gt", prediction: str = "pred") -> DataFrame:
    """Mean F1 over the classes that are not ignored."""
    scores = class_f1(pairs, truth, prediction)
    if ignored:
        scores = scores.filter(~F.col("class").isin(*ignored))
    return scores.agg(F.count(F.lit(1)).alias("n_classes"), F.avg("f1").alias("macro_f1"))


def best_run(runs: DataFrame, run: str, metric: str) -> DataFrame:
    """The run with the greatest value; the smaller name wins a tie."""
    best = runs.agg(F.max(metric).alias(metric))
    return runs.join(best, metric).groupBy(metric).agg(F.min(run).alias(run)).select(run, metric)


def alphabet(texts: DataFrame, column: str) -> DataFrame:
    """Distinct characters with their number of occurrences."""
    chars = texts.select(F.explode(F.split(F.col(column), "")).alias("symbol")).filter(F.col("symbol") != "")
    return chars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
