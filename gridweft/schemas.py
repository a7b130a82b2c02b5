"""Declared schemas of the file formats."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()

ANNOTATION = _struct(
    iscrowd=_I, category_id=_I, bbox=ArrayType(_D), area=_D, segmentation=ArrayType(ArrayType(_D))
)
ANNOTATION_LINE = _struct(file_name=_S, height=_I, width=_I, annotations=ArrayType(ANNOTATION))
COCO = _struct(
    images=ArrayType(_struct(id=_L, file_name=_S, height=_I, width=_I, segm_file=_S)),
    annotations=ArrayType(
        _struct(
            id=_L, image_id=_L, iscrowd=_I, category_id=_I, bbox=ArrayType(_D), area=_D,
            segmentation=ArrayType(ArrayType(_D)),
        )
    ),
)
POLYGON_XML = _struct(
    _file=_S,
    box=ArrayType(_struct(_height=_I, _width=_I, _left=_I, _top=_I, label=_S, segs=_S)),
)
RECTANGLE_XML = _struct(
    imageName=_S,
    lex=_S,
    taggedRectangles=_struct(taggedRectangle=ArrayType(_struct(_x=_I, _y=_I, _width=_I, _height=_I, tag=_S))),
)
