"""Recognised text against labels, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions.alignment import edit_ratio
from gridweft.functions.text import normalize_label


def pair_labels(predictions: DataFrame, labels: DataFrame, key: str = "image") -> DataFrame:
    """``image, pred, gt``; images without a label have an empty one."""
    return predictions.select(key, "pred").join(labels.select(key, "gt"), key, "left").withColumn(
        "gt", F.coalesce("gt", F.lit(""))
    )


def mark_correct(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("is_correct", F.col("pred") == F.col("gt"))


def recognition_scores(pairs: DataFrame) -> DataFrame:
    """Share of exact matches, strict, without case, and on letters and digits only; mean similarity ``ned``.

    The values are null unless every row has a label.
    """

    def share(a: Column, b: Column) -> Column:
        return F.avg((a == b).cast("double"))

    p, g = F.col("pred"), F.col("gt")
    out = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(g == "").alias("n_unlabelled"),
        share(p, g).alias("word_acc"),
        share(F.lower(p), F.lower(g)).alias("word_acc_ignore_case"),
        share(normalize_label(p), normalize_label(g)).alias("word_acc_ignore_case_symbol"),
        F.avg(1.0 - edit_ratio(p, g)).alias("ned"),
    )
    complete = F.col("n_unlabelled") == 0
    names = ("word_acc", "word_acc_ignore_case", "word_acc_ignore_case_symbol", "ned")
    return out.select("n", *[F.when(complete, F.col(c)).alias(c) for c in names])


def split_by_correctness(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Correct rows, and their complement."""
    marked = mark_correct(pairs)
    return marked.filter("is_correct"), marked.filter("NOT is_correct")
