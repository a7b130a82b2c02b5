"""Column functions over boxes and polygons.

A polygon is one flat array ``x1, y1, x2, y2, ...``; a box is ``x1, y1, x2, y2``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweft.functions.bind import bind


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def xs(coords: Column | str) -> Column:
    return F.filter(_col(coords), lambda v, i: i % 2 == 0)


def ys(coords: Column | str) -> Column:
    return F.filter(_col(coords), lambda v, i: i % 2 == 1)


def bounds_xywh(coords: Column | str) -> Column:
    """Bounding box of a polygon as ``x, y, width, height``."""
    return bind(
        F.struct(xs(coords).alias("x"), ys(coords).alias("y")),
        lambda c: F.array(
            F.array_min(c["x"]),
            F.array_min(c["y"]),
            F.array_max(c["x"]) - F.array_min(c["x"]),
            F.array_max(c["y"]) - F.array_min(c["y"]),
        ),
    )


def polygon_area(coords: Column | str) -> Column:
    """Area by the shoelace formula."""

    def area(c: Column) -> Column:
        n = F.size(c["x"])

        def term(x: Column, i: Column) -> Column:
            k = (i + 1) % n
            return x * F.get(c["y"], k) - F.get(c["x"], k) * F.get(c["y"], i)

        twice = F.aggregate(F.transform(c["x"], term), F.lit(0.0), lambda a, t: a + t)
        return F.abs(twice) / 2

    doubles = _col(coords).cast("array<double>")
    return bind(F.struct(xs(doubles).alias("x"), ys(doubles).alias("y")), area)


def interleave(x: Column | str, y: Column | str) -> Column:
    """Arrays of x and y to ``x1, y1, x2, y2, ...``."""
    return F.flatten(F.zip_with(_col(x), _col(y), lambda a, b: F.array(a, b)))


def word_outline(char_quads: Column | str) -> Column:
    """Outline of a word from its character quads, coordinates cut to whole numbers.

    Each quad runs top left, top right, bottom right, bottom left.  The outline follows the top edges
    left to right and the bottom edges back.
    """
    quads = _col(char_quads)
    top = F.flatten(F.transform(quads, lambda q: F.slice(q, 1, 4)))
    bottom = F.flatten(F.transform(F.reverse(quads), lambda q: F.slice(q, 5, 4)))
    return F.concat(top, bottom).cast("array<int>")


def box_to_quad(box: Column | str) -> Column:
    """Corners of a box, clockwise from the top left."""
    b = _col(box)
    # Which box coordinate goes where.
    return F.array(*[F.get(b, i) for i in (0, 1, 2, 1, 2, 3, 0, 3)])


def clamp_box(box: Column | str, width: Column | str, height: Column | str, expand: tuple[int, int, int, int]) -> Column:
    """Box grown by ``expand`` (top, bottom, left, right) and cut at the image border."""
    b, (top, bottom, left, right) = _col(box), expand
    return F.array(
        F.greatest(F.lit(0), F.get(b, 0) - left),
        F.greatest(F.lit(0), F.get(b, 1) - top),
        F.least(_col(width), F.get(b, 2) + right),
        F.least(_col(height), F.get(b, 3) + bottom),
    )


def intersection(a: Column, b: Column) -> Column:
    w = F.least(F.get(a, 2), F.get(b, 2)) - F.greatest(F.get(a, 0), F.get(b, 0))
    h = F.least(F.get(a, 3), F.get(b, 3)) - F.greatest(F.get(a, 1), F.get(b, 1))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: Column) -> Column:
    return (F.get(a, 2) - F.get(a, 0)) * (F.get(a, 3) - F.get(a, 1))


def iou(a: Column | str, b: Column | str) -> Column:
    """Overlap of two boxes over their union; 0 when the union is empty."""
    a, b = _col(a), _col(b)
    both = intersection(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def has_point(box: Column | str, x: Column, y: Column) -> Column:
    b = _col(box)
    return (F.get(b, 0) <= x) & (x < F.get(b, 2)) & (F.get(b, 1) <= y) & (y < F.get(b, 3))
