"""Entity spans from BIO tags and their exact-match scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The entity categories.
CATEGORIES = (
    "address", "book", "company", "game", "government", "movie", "name", "organization", "position", "scene",
)


def bio_spans(tags: DataFrame, keys: tuple[str, ...] = ("doc",), position: str = "pos", tag: str = "tag") -> DataFrame:
    """``keys, category, start, stop`` (inclusive) of each run ``B-x, I-x, ...``.

    A span starts at every ``B-``; ``I-`` tags continue it while the category stays the same and
    no other tag lies between.  ``I-`` without a start opens no span.
    """
    w = Window.partitionBy(*keys).orderBy(position)
    marked = tags.withColumn("_cat", F.substring_index(tag, "-", -1))
    # a run is everything since the last start or the last break
    breaks = F.col(tag).startswith("B-") | ~F.col(tag).startswith("I-") | (F.col("_cat") != F.lag("_cat").over(w))
    marked = marked.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.filter(F.col(tag) != "O")
    spans = runs.groupBy(*keys, "_run").agg(
        F.min_by("_cat", position).alias("category"),
        F.min_by(tag, position).alias("_first"),
        F.min(position).alias("start"),
        F.max(position).alias("stop"),
    )
    return spans.filter(F.col("_first").startswith("B-")).select(*keys, "category", "start", "stop")


def entity_scores(pred: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Precision, recall and F1 of spans that agree in position and category."""
    on = [*keys, "category", "start", "stop"]
    sides = (
        truth.select(*on, F.lit(1).alias("t"), F.lit(0).alias("p"))
        .unionByName(pred.select(*on, F.lit(0).alias("t"), F.lit(1).alias("p")))
        .groupBy(*on)
        .agg(F.max("t").alias("t"), F.max("p").alias("p"))
    )
    sums = sides.agg(
        F.sum(F.col("t") * F.col("p")).cast("bigint").alias("n_hit"),
        F.sum("p").cast("bigint").alias("n_pred"),
        F.sum("t").cast("bigint").alias("n_gt"),
    )
    return sums.select(
        "n_hit",
        "n_pred",
        "n_gt",
        F.when(F.col("n_pred") > 0, F.col("n_hit") / F.col("n_pred")).otherwise(0.0).alias("precision"),
        F.when(F.col("n_gt") > 0, F.col("n_hit") / F.col("n_gt")).otherwise(0.0).alias("recall"),
        F.when(F.col("n_pred") + F.col("n_gt") > 0, 2.0 * F.col("n_hit") / (F.col("n_pred") + F.col("n_gt")))
        .otherwise(0.0)
        .alias("f1"),
    )
