"""Put recognised text lines into the cells of a recognised table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions import geometry as G
from gridweft.operators.overlap import overlap_pairs, representatives


def assign_lines(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """``image, line_no, cell_no, how``: the cell of each text line.

    A line goes to the cell that holds its centre, otherwise to the cell with the largest overlap; ties go
    to the lower cell number.  Lines that touch no cell are not returned.
    """
    reps = representatives(cells.select("image", "box", "cell_no"), "cell_no")
    met = overlap_pairs(lines.select("image", "box", "line_no"), reps)
    cx = (F.get("l_box", 0) + F.get("l_box", 2)) / 2
    cy = (F.get("l_box", 1) + F.get("l_box", 3)) / 2
    rank = F.struct(
        G.has_point("r_box", cx, cy).alias("inside"),
        F.col("iou").alias("iou"),
        (-F.col("cell_no")).alias("c"),
    )
    best = met.groupBy("image", "line_no").agg(F.max(rank).alias("b"))
    return best.select(
        "image",
        "line_no",
        (-F.col("b.c")).alias("cell_no"),
        F.when(F.col("b.inside"), "centre").otherwise("overlap").alias("how"),
    )


def fill_cells(lines: DataFrame, cells: DataFrame, glue: str = " ") -> DataFrame:
    """Cells with the text of their lines, top to bottom and left to right."""
    placed = assign_lines(lines, cells).join(lines.select("image", "line_no", "box", "text"), ["image", "line_no"])
    piece: Column = F.struct(F.get("box", 1), F.get("box", 0), "line_no", "text")
    texts = placed.groupBy("image", "cell_no").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    texts = texts.select("image", "cell_no", F.array_join(F.transform("p", lambda x: x["text"]), glue).alias("text"))
    return cells.join(texts, ["image", "cell_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))
