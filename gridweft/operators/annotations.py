"""Annotations of images: parsing of label lines, conversion, nesting, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions import geometry as G
from gridweft.functions.text import missing_word

# Annotations of one image are nested in pieces of this size, so that no list grows without bound.
PIECE = 10_000
CROWD_MARK = "###"


def parse_quad_line(line: Column | str, layout: str = "quad2015") -> Column:
    """``STRUCT<coords, language, text, iscrowd>`` from eight numbers and the rest of the line.

    ``quad2015`` has the text in field 8 and may start with a byte order mark, ``quad2017`` has the
    language in field 8 and the text in field 9.  The text ``###`` marks a box to ignore.
    """
    if layout not in ("quad2015", "quad2017"):
        raise ValueError(f"unknown layout {layout}")
    value = F.col(line) if isinstance(line, str) else line
    parts = F.split(F.trim(F.regexp_replace(value, "^﻿", "")), ",")
    at = 8 if layout == "quad2015" else 9
    text = F.get(parts, at)
    return F.struct(
        F.slice(parts, 1, 8).cast("array<int>").alias("coords"),
        (F.get(parts, 8) if at == 9 else F.lit(None).cast("string")).alias("language"),
        text.alias("text"),
        F.when(text == CROWD_MARK, 1).otherwise(0).alias("iscrowd"),
    )


def parse_curve_line(line: Column | str) -> Column:
    """``STRUCT<coords, text>`` from 28 numbers and ``####text``; null if field 28 has no ``#``."""
    value = F.col(line) if isinstance(line, str) else line
    parts = F.split(F.trim(value), ",")
    fields = F.struct(
        F.slice(parts, 1, 28).cast("array<int>").alias("coords"),
        F.regexp_replace(F.array_join(F.slice(parts, 29, F.size(parts)), ","), "^#+", "").alias("text"),
    )
    return F.when(F.get(parts, 28).startswith("#"), fields)


def annotation(coords: Column | str, iscrowd: Column | None = None, bbox: Column | None = None) -> Column:
    """``STRUCT<iscrowd, category_id, bbox, area, segmentation>`` of one polygon."""
    coords = F.col(coords) if isinstance(coords, str) else coords
    doubles = coords.cast("array<double>")
    return F.struct(
        (F.lit(0) if iscrowd is None else iscrowd).cast("int").alias("iscrowd"),
        F.lit(1).alias("category_id"),
        (G.bounds_xywh(doubles) if bbox is None else bbox.cast("array<double>")).alias("bbox"),
        G.polygon_area(doubles).alias("area"),
        F.array(doubles).alias("segmentation"),
    )


def nested_contours(df: DataFrame, x: str = "x", y: str = "y", word: str = "word") -> DataFrame:
    """Word polygons with flat ``contour`` and filled ``word``; ``#`` words and single points are left out."""
    out = df.withColumn(word, missing_word(word)).filter(F.col(word) != "#")
    return out.withColumn("contour", G.interleave(x, y)).filter(F.size("contour") != 2)


def words_with_boxes(df: DataFrame, strs: str = "strs", char_quads: str = "char_quads") -> DataFrame:
    """Give each word of an image its characters and outline.

    ``strs`` is an array of texts, ``char_quads`` one quad for each character that is no whitespace, in the
    same order.  Word ``i`` owns the characters from the summed length of the words before it.
    """
    words = F.filter(F.flatten(F.transform(strs, lambda s: F.split(s, r"\s+"))), lambda w: w != "")
    out = df.withColumn("_words", words).withColumn("_len", F.transform("_words", F.length))
    out = out.withColumn(
        "_start", F.transform("_words", lambda w, i: F.aggregate(F.slice("_len", 1, i), F.lit(0), lambda a, x: a + x))
    )
    keep = [c for c in df.columns if c not in (strs, char_quads)]
    rows = out.select(*keep, char_quads, "_start", F.posexplode("_words").alias("word_no", "word"))
    start = F.get("_start", F.col("word_no"))
    rows = rows.withColumn("char_start", start).withColumn("char_stop", F.col("char_start") + F.length("word"))
    rows = rows.withColumn("quads", F.slice(char_quads, F.col("char_start") + 1, F.length("word")))
    return rows.withColumn("outline", G.word_outline("quads")).drop(char_quads, "_start")


def char_annotations(text: Column | str, boxes: Column | str) -> Column:
    """``ARRAY<STRUCT<char_box, char_text>>``: the i-th box with the i-th character."""
    text = F.col(text) if isinstance(text, str) else text
    boxes = F.col(boxes) if isinstance(boxes, str) else boxes
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(
        boxes, lambda b, i: F.struct(b.cast("array<double>").alias("char_box"), F.get(chars, i).alias("char_text"))
    )


def known_only(annotations: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    return annotations.join(images.select(key), key, "left_semi")


def nest_annotations(
    images: DataFrame, annotations: DataFrame, key: str = "image_id", number: str = "anno_no", piece: int = PIECE
) -> DataFrame:
    """Images with their annotations as an ordered list; images without any keep an empty one.

    ``annotations`` has the columns ``key, number, anno``.  ``number`` counts from 0 within an image.  An image
    with more than ``piece`` annotations gets several rows, told apart by ``piece_no``; ``first_no`` is the number of the
    first annotation of a row.
    """
    piece_no = F.floor(F.col(number) / piece).cast("int").alias("piece_no")
    lists = annotations.groupBy(key, piece_no).agg(F.sort_array(F.collect_list(F.struct(number, "anno"))).alias("_l"))
    lists = lists.select(key, "piece_no", F.transform("_l", lambda a: a["anno"]).alias("annotations"))
    empty = F.array().cast(lists.schema["annotations"].dataType)
    return images.join(lists, key, "left").select(
        *images.columns,
        F.coalesce("piece_no", F.lit(0)).alias("piece_no"),
        (F.coalesce("piece_no", F.lit(0)).cast("bigint") * piece).alias("first_no"),
        F.coalesce("annotations", empty).alias("annotations"),
    )


def coco_frames(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of COCO documents as two frames."""
    images = documents.select(F.explode("images").alias("i")).select("i.*")
    annotations = documents.select(F.explode("annotations").alias("a")).select("a.*")
    return images, annotations


def coco_rows(nested: DataFrame, split: Column) -> tuple[DataFrame, DataFrame]:
    """Images and annotations, a row each, with their split; ids as in ``coco_documents``."""
    image = [F.col("image_id").cast("bigint").alias("id"), "file_name", "height", "width", "segm_file"]
    images = nested.select(split.alias("split"), *image).distinct()
    base = F.shiftleft(F.col("image_id").cast("bigint"), 32) + F.col("first_no")
    rows = nested.select(split.alias("split"), F.col("image_id").cast("bigint").alias("image_id"), base.alias("_base"), F.posexplode("annotations").alias("_i", "a"))
    return images, rows.select("split", (F.col("_base") + F.col("_i")).alias("id"), "image_id", "a.*")


def coco_documents(nested: DataFrame, shard: Column, split: Column) -> DataFrame:
    """COCO documents ``split, shard, images, annotations`` from nested images.

    Annotation ids are image id times 2^32 plus position, so no global count is needed and ids of images never meet.
    The shard has to bound the number of images in one document.
    """
    image = F.struct(F.col("image_id").alias("id"), "file_name", "height", "width", "segm_file")
    base = F.shiftleft(F.col("image_id").cast("bigint"), 32) + F.col("first_no")
    annos = F.transform(
        "annotations",
        lambda a, i: F.struct(
            (base + i).alias("id"),
            F.col("image_id").alias("image_id"),
            a["iscrowd"].alias("iscrowd"),
            a["category_id"].alias("category_id"),
            a["bbox"].alias("bbox"),
            a["area"].alias("area"),
            a["segmentation"].alias("segmentation"),
        ),
    )
    rows = nested.select(split.alias("split"), shard.alias("shard"), "piece_no", image.alias("image"), annos.alias("annos"))
    return rows.groupBy("split", "shard").agg(
        F.sort_array(F.collect_set(F.col("image"))).alias("images"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("image.id", "piece_no", "annos"))), lambda r: r["annos"])).alias("annotations"),
    )
