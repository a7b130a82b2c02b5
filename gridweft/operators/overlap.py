"""Box overlap joins on a grid.

Comparing all boxes of an image with each other is quadratic.  Here a box is entered into grid cells on
a grid whose cell is about as large as the box, and two boxes meet on the grid of the larger one.  The join key
is image, grid level and cell, so a large image is spread over many keys.

For overlaps of any size a box is entered into the cells it touches, at most four, and a pair is taken only in
the cell that holds the top left corner of the common area.  For a least overlap the centres are
compared instead.  Either way no pair appears twice and no distinct step is needed.

Coordinates travel as plain doubles: array accesses would blow up the generated code of the join beyond what
the JVM compiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SMALLEST = 1e-3
_CLASS = 3
"""Levels (powers of two) in a class of extents."""
_EDGES = ("x1", "y1", "x2", "y2")


def _flat(df: DataFrame, side: str) -> DataFrame:
    """The box as four columns, named after the side."""
    for i, e in enumerate(_EDGES):
        df = df.withColumn(f"_{side}{e}", F.get("box", i))
    return df.drop("box")


def _extent(side: str, axis: str) -> Column:
    return F.greatest(F.col(f"_{side}{axis}2") - F.col(f"_{side}{axis}1"), F.lit(_SMALLEST))


def _level(extent: Column) -> Column:
    # the small shift keeps exact powers of two on their level in spite of rounding
    return F.ceil(F.log2(extent) - 1e-9).cast("int")


def _with_iou(met: DataFrame) -> DataFrame:
    def common(axis: str) -> Column:
        end = F.least(f"_l{axis}2", f"_r{axis}2")
        return F.greatest(end - F.greatest(f"_l{axis}1", f"_r{axis}1"), F.lit(0.0))

    def area(side: str) -> Column:
        # from the edges once boxes have met: every column travels as often as the box is entered
        return (F.col(f"_{side}x2") - F.col(f"_{side}x1")) * (F.col(f"_{side}y2") - F.col(f"_{side}y1"))

    both = common("x") * common("y")
    union = area("l") + area("r") - both
    return met.withColumn("iou", F.when(union > 0, both / union).otherwise(F.lit(0.0)))


def _boxes_back(df: DataFrame) -> DataFrame:
    for side in ("l", "r"):
        names = [f"_{side}{e}" for e in _EDGES]
        df = df.withColumn(f"{side}_box", F.array(*names)).drop(*names)
    return df


def overlap_pairs(left: DataFrame, right: DataFrame, image: str = "image", min_iou: float | None = None) -> DataFrame:
    """Pairs of boxes of one image that overlap: the columns of both sides, ``iou``, ``l_box`` and ``r_box``.

    Both sides need the columns ``image`` and ``box`` (doubles); all other column names must differ.  With
    ``min_iou`` only pairs of at least that value are returned.
    """
    left, right = _flat(left, "l"), _flat(right, "r")
    if min_iou is not None:
        met = _with_iou(_similar_pairs(left, right, image, min_iou)).filter(F.col("iou") >= min_iou)
    else:
        met = _with_iou(_touching_pairs(left, right, image)).filter(F.col("iou") > 0)
    return _boxes_back(met)


def _touching_pairs(left: DataFrame, right: DataFrame, image: str) -> DataFrame:
    def own(side: str) -> Column:
        return _level(F.greatest(_extent(side, "x"), _extent(side, "y")))

    tops = (
        left.select(image, own("l").alias("l"))
        .unionByName(right.select(image, own("r").alias("l")))
        .groupBy(image)
        .agg(F.max("l").alias("_top"))
    )

    def gridded(df: DataFrame, side: str) -> DataFrame:
        df = df.join(tops, image).withColumn(f"_{side}own", own(side))
        df = df.withColumn("_level", F.explode(F.sequence(F.col(f"_{side}own"), F.col("_top")))).drop("_top")
        # a level belongs to one of the two: the own level of a box meets own and finer ones, finer ones never meet there
        at_home = F.col("_level") == F.col(f"_{side}own")
        away = 0 if side == "l" else 1
        both = F.array(F.lit(0), F.lit(1)) if side == "l" else F.array(F.lit(0))
        df = df.withColumn("_turn", F.explode(F.when(at_home, both).otherwise(F.array(F.lit(away)))))
        size = F.pow(F.lit(2.0), F.col("_level"))

        def touched(axis: str) -> Column:
            first = F.floor(F.col(f"_{side}{axis}1") / size).cast("bigint")
            last = F.floor(F.col(f"_{side}{axis}2") / size).cast("bigint")
            return F.sequence(first, F.greatest(first, last))

        return df.withColumn("_gx", F.explode(touched("x"))).withColumn("_gy", F.explode(touched("y")))

    met = gridded(left, "l").join(gridded(right, "r").hint("merge"), [image, "_level", "_turn", "_gx", "_gy"])
    size = F.pow(F.lit(2.0), F.col("_level"))
    met = met.filter(
        (F.col("_gx") == F.floor(F.greatest("_lx1", "_rx1") / size))
        & (F.col("_gy") == F.floor(F.greatest("_ly1", "_ry1") / size))
    )
    return met.drop("_level", "_turn", "_gx", "_gy", "_lown", "_rown")


def _similar_pairs(left: DataFrame, right: DataFrame, image: str, min_iou: float) -> DataFrame:
    """Candidates for at least ``min_iou``: boxes of similar size with centres close to each other.

    If the overlap is at least ``t``, widths differ at most by the factor ``1 / t``; the same holds for heights.
    Each axis therefore has classes of extents, of a factor of 8 each, with a grid of twice the largest extent of the class.  Of two
    extents ``w <= W`` at least ``t W`` is common, so the centres are at most ``(w + W) / 2 - t W`` apart.  The left box
    is entered once: in its own class, under its centre.  The right one is entered in every class that a partner may have, mostly one,
    under all grid columns within that distance, mostly one or two.  A pair meets once.

    What is sent and sorted grows with the number of entries; smaller cells and finer classes need several times as many and
    spare comparisons only, which are cheap.

    Boxes are repeated on entering, which the optimizer does not foresee, so the join is asked not to
    broadcast.
    """

    def class_of(extent: Column) -> Column:
        return F.floor(_level(extent) / _CLASS).cast("int")

    def axis(df: DataFrame, side: str, name: str) -> DataFrame:
        extent, centre = _extent(side, name), (F.col(f"_{side}{name}1") + F.col(f"_{side}{name}2")) / 2
        size = F.pow(F.lit(2.0), (F.col(f"_k{name}") + 1) * _CLASS)

        def column(at: Column) -> Column:
            return F.floor(at / size).cast("bigint")

        if side == "l":
            return df.withColumn(f"_k{name}", class_of(extent)).withColumn(f"_g{name}", column(centre))
        # the factor covers rounding
        least, most = extent * (min_iou * (1 - 1e-9)), extent / (min_iou * (1 - 1e-9))
        df = df.withColumn(f"_k{name}", F.explode(F.sequence(class_of(least), class_of(most))))
        widest = extent / min_iou if min_iou < 0.5 else extent
        # the last term covers rounding
        reach_out = extent / 2 + widest * (0.5 - min_iou) + size * 1e-9
        return df.withColumn(f"_g{name}", F.explode(F.sequence(column(centre - reach_out), column(centre + reach_out))))

    on = [image, "_kx", "_ky", "_gx", "_gy"]
    entered = [axis(axis(df, side, "x"), side, "y") for df, side in ((left, "l"), (right, "r"))]
    return entered[0].join(entered[1].hint("merge"), on).drop(*on[1:])


def representatives(
    df: DataFrame, number: str, image: str = "image", order: Column | None = None, copies: str | None = None
) -> DataFrame:
    """One row for each distinct box of an image: the one that comes first.

    ``order`` is a struct that sorts copies; the smallest wins (default: the number).  ``copies`` names a
    column for the number of equal boxes.
    """
    others = [c for c in df.columns if c not in (image, "box")]
    key = order if order is not None else F.col(number)
    best = df.groupBy(image, "box").agg(
        F.min_by(F.struct(*others), key).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    out = best.select(image, "box", *[F.col(f"_r.{c}").alias(c) for c in others], "_n")
    return out.withColumnRenamed("_n", copies) if copies else out.drop("_n")
