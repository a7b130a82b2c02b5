"""File sources.  Each reader returns a lazy frame with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridweft import schemas
from gridweft.functions.names import base_name, dir_name, is_image, truth_path
from gridweft.operators.annotations import parse_curve_line, parse_quad_line
from gridweft.session import materialize
from gridweft.sources.writers import NULL_LINE


def read_html_tables(spark: SparkSession, path: str, glob: str = "*.htm") -> DataFrame:
    """``file, html``: every matching file as one document."""
    docs = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return docs.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("html"))


_PLACE = ("_part", "_file", "_block")


def _line_place() -> list[Column]:
    """Where a line stands: the number of its part file (0 for other names), the file, its block, and a row id."""
    file = F.col("_metadata.file_path")
    part = F.regexp_extract(file, r"/part-([0-9]+)[^/]*\z", 1)
    return [
        F.coalesce(part.try_cast("bigint"), F.lit(0)).alias("_part"),
        file.alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    ]


def _unescaped(text: Column) -> Column:
    """The reverse of ``writers.quoted_line``: each backslash and the character after it."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    plain = F.transform(
        pieces, lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p)
    )
    return F.when(text.contains("\\"), F.array_join(plain, "")).otherwise(text)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` with line numbers from 0; part files of a folder follow each other by number.

    Files stay splittable.  Rows of one block follow each other in one task, so the number of a line is its
    position in the block plus the number of lines in the blocks before it; only the list of blocks
    is sorted.  The files are scanned once, and lines are written with their place: counts and numbers come from the same cut into
    blocks, whatever the settings are when the result is read.
    """
    rows = materialize(spark.read.text(path).select("value", *_line_place()), "numbered-lines")
    blocks = rows.groupBy(*_PLACE).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # one row per file block; adaptive execution broadcasts it after measuring its size
    out = rows.join(blocks, list(_PLACE))
    return out.select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, gold`` from single-quoted lines."""
    lines = read_numbered_lines(spark, path)
    return lines.select("line_no", F.regexp_extract("value", r"^\s*'(.*)'\s*$", 1).alias("gold"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, table_id``; the line number is that of the gold sentence."""
    lines = read_numbered_lines(spark, path)
    return lines.select("line_no", F.rtrim("value").try_cast("int").alias("table_id"))


def read_linearized(spark: SparkSession, path: str) -> DataFrame:
    """``table_id, line_no, input`` from quoted lines in ``<table_id>.src`` files or ``table_id=<id>`` folders.

    Line n of a table id, over all its part files, is its n-th variation.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", *_line_place()
    )
    number = F.regexp_extract("_file", r"/(?:table_id=)?([0-9]+)(?:\.src\z|/[^/]*\z)", 1)
    inner = F.regexp_extract("value", r"(?s)\A\s*'(.*)'\s*\z", 1)
    text = F.when(F.trim("value") == NULL_LINE, F.lit(None)).when(F.trim("value").startswith("'"), inner).otherwise(F.col("value"))
    # a table id has as many lines as variations
    order = Window.partitionBy("table_id").orderBy(*_PLACE, "_id")
    return rows.select(
        number.try_cast("int").alias("table_id"), _unescaped(text).alias("input"), *_PLACE, "_id"
    ).select("table_id", (F.row_number().over(order) - 1).alias("line_no"), "input")


def read_coco(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schemas.COCO).option("multiLine", multi_line).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType, keys: list[str] | None = None) -> DataFrame:
    """Named keys of a JSON-lines file."""
    return spark.read.schema(schema).json(path).select(*(keys or [f.name for f in schema.fields]))


def read_label_lines(
    spark: SparkSession,
    path: str,
    keys: tuple[str, ...] = ("filename", "text"),
    keys_idx: tuple[int, ...] = (0, 1),
    separator: str = " ",
) -> DataFrame:
    parts = F.split(F.rtrim("value"), f"\\Q{separator}\\E")
    return spark.read.text(path).select(*[F.get(parts, i).alias(k) for k, i in zip(keys, keys_idx)])


def read_quad_labels(spark: SparkSession, path: str, layout: str = "quad2015") -> DataFrame:
    """``segm_file, coords, language, text, iscrowd``: one row per line of each label file."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    fields = parse_quad_line("value", layout)
    return rows.select(F.col("_metadata.file_name").alias("segm_file"), fields.alias("q")).select("segm_file", "q.*")


def read_curve_labels(spark: SparkSession, path: str) -> DataFrame:
    """``segm_file, coords, text`` of 14-point polygons; lines without the text mark have nulls."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.col("_metadata.file_name").alias("segm_file"), parse_curve_line("value").alias("q")).select(
        "segm_file", "q.*"
    )


def read_polygon_xml(spark: SparkSession, path: str) -> DataFrame:
    """``image, bbox, coords, label`` from XML with one ``box`` per polygon."""
    return polygon_boxes(spark.read.format("xml").option("rowTag", "image").schema(schemas.POLYGON_XML).load(path))


def polygon_boxes(docs: DataFrame) -> DataFrame:
    """A row per box of ``image`` elements."""
    boxes = docs.select(F.col("_file").alias("image"), F.posexplode("box").alias("box_no", "b"))
    return boxes.select(
        "image",
        "box_no",
        F.array("b._left", "b._top", "b._width", "b._height").alias("bbox"),
        F.split(F.trim("b.segs"), ",").cast("array<int>").alias("coords"),
        F.col("b.label").alias("label"),
    )


def read_rectangle_xml(spark: SparkSession, path: str) -> DataFrame:
    """``image, rect_no, lexicon, x, y, width, height, tag`` from XML with tagged rectangles."""
    return tagged_rectangles(spark.read.format("xml").option("rowTag", "image").schema(schemas.RECTANGLE_XML).load(path))


def tagged_rectangles(docs: DataFrame) -> DataFrame:
    """A row per rectangle of ``image`` elements."""
    rects = docs.select(
        F.col("imageName").alias("image"),
        F.col("lex").alias("lexicon"),
        F.posexplode("taggedRectangles.taggedRectangle").alias("rect_no", "r"),
    )
    return rects.select(
        "image", "rect_no", "lexicon", F.col("r._x").alias("x"), F.col("r._y").alias("y"),
        F.col("r._width").alias("width"), F.col("r._height").alias("height"), F.col("r.tag").alias("tag"),
    )


def rectangle_labels(rects: DataFrame) -> DataFrame:
    """Rectangles cut at the image origin, with lower-case tag and lexicon and its size."""
    zero = F.lit(0)
    return rects.select(
        "image",
        "rect_no",
        F.greatest(zero, "x").alias("x1"),
        F.greatest(zero, "y").alias("y1"),
        F.greatest(zero, F.col("x") + F.col("width")).alias("x2"),
        F.greatest(zero, F.col("y") + F.col("height")).alias("y2"),
        F.lower("tag").alias("tag"),
        F.lower("lexicon").alias("lexicon"),
        F.size(F.split(F.lower("lexicon"), ",")).alias("lex_size"),
    )


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, length`` of all files below a folder; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    return files.load(path).select("path", "length")


def list_images(spark: SparkSession, path: str, gt_dir: str, layout: str) -> DataFrame:
    """``image_file, split, truth_file``; the split is the name of the folder of an image."""
    images = list_files(spark, path).filter(is_image("path"))
    split = base_name(dir_name("path"))
    folder: Column = F.concat(F.lit(gt_dir.rstrip("/") + "/"), split)
    return images.select(
        F.col("path").alias("image_file"), split.alias("split"), truth_path("path", folder, layout, split).alias("truth_file")
    )


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, height, width`` of image files."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return images.select(
        base_name("image.origin").alias("file_name"), F.col("image.height").alias("height"), F.col("image.width").alias("width")
    )


def existing_pairs(pairs: DataFrame, files: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pairs whose files all exist in the listing ``files(path)``."""
    for c in columns:
        pairs = pairs.join(files.select(F.col("path").alias(c)), c, "left_semi")
    return pairs


def missing_files(listed: DataFrame, files: DataFrame, column: str = "path") -> DataFrame:
    return listed.join(files.select(F.col("path").alias(column)), column, "left_anti")
