"""Queries over file sources and sinks: write derived rows, read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft import schemas
from gridweft.functions import geometry as G
from gridweft.functions import markup as M
from gridweft.functions.names import variation
from gridweft.operators import annotations as A
from gridweft.operators import generation as GEN
from gridweft.operators import linearize as L
from gridweft.operators import recognition as R
from gridweft.operators.ordering import running_index
from gridweft.plans import derived as D
from gridweft.plans.catalog_annotations import _IMAGES, _QUADS, _RECTS, annotations, contours, rectangles
from gridweft.plans.catalog_evaluation import _LABELS, label_pairs
from gridweft.plans.catalog_tables import _CUSTOMER_TEXT, _DAMAGE
from gridweft.operators import summaries as S
from gridweft.operators import text_scores as X
from gridweft.plans.catalog_text import _BLEU, _BLEU_SCORE, _LCS, _MAP, _ORDER_GOLD, _PAIRS, _ngram_counts, _rouge_words, gold_lines, id_map
from gridweft.plans.registry import BOXES, LINES, ROWS, query
from gridweft.session import scratch_path
from gridweft.sources import documents as DC
from gridweft.sources import readers as RD
from gridweft.sources import writers as WR
from gridweft.streaming.incremental import read_scores, score_new_predictions


def _text_of(coords: str = "coords"):
    return F.array_join(F.col(coords).cast("array<string>"), ",")


# ---------------------------------------------------------------- sources


def page_files(spark, sf):
    path = scratch_path(spark, "pages")
    pages = D.table(spark, sf, "pages")
    name = F.format_string("page_%d.htm", "page_id")
    WR.write_named_files(pages.select(name.alias("name"), F.col("html").alias("content")), path)
    return path


@query("S1_html_files", "SELECT printf('page_%d.htm', page_id) AS file, html FROM pages")
def s1(spark, sf):
    return RD.read_html_tables(spark, page_files(spark, sf)).select("file", "html")


@query("S2_truth_files", """
SELECT printf('page_%d.htm', page_id) AS file, html AS pred, html AS truth FROM pages""")
def s2(spark, sf):
    pred = RD.read_html_tables(spark, page_files(spark, sf)).select("file", F.col("html").alias("pred"))
    true = RD.read_html_tables(spark, page_files(spark, sf)).select("file", F.col("html").alias("truth"))
    return pred.join(true, "file")


def _write_lines(df, order, value, path):
    """Text lines in a total order, over any number of part files."""
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select(value.alias("value")).write.text(path)


@query("S3_gold_lines", f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, {_ORDER_GOLD} AS gold FROM orders")
def s3(spark, sf):
    path = scratch_path(spark, "gold")
    text = F.concat(F.lit("'Order of priority "), F.lower("o_orderpriority"), F.lit(" has status "), F.col("o_orderstatus"), F.lit(" .'"))
    _write_lines(D.table(spark, sf, "orders"), ["o_orderkey"], text, path)
    return RD.read_gold(spark, path)


@query("S4_id_map", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, CAST(o_custkey AS INTEGER) AS table_id FROM orders")
def s4(spark, sf):
    path = scratch_path(spark, "id-map")
    _write_lines(D.table(spark, sf, "orders"), ["o_orderkey"], F.concat(F.col("o_custkey").cast("string"), F.lit("\r")), path)
    return RD.read_id_map(spark, path)


def linearized_customers(spark, sf):
    tables = L.linearize(D.customer_tables(spark, sf))
    return tables.select("table_id", "variation", "input")


@query("S5_linearized_files", f"""SELECT c_nationkey AS table_id, {_CUSTOMER_TEXT} AS input,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS line_no FROM customer""")
def s5(spark, sf):
    path = scratch_path(spark, "src")
    WR.write_linearized(linearized_customers(spark, sf), path)
    return RD.read_linearized(spark, path)


def coco_files(spark, sf):
    """One document per split; the folder they are in."""
    path = scratch_path(spark, "coco")
    nested = A.nest_annotations(D.images(spark, sf), annotations(spark, sf))
    DC.write_coco_documents(*A.coco_rows(nested, F.col("split")), path)
    return path


@query("S6_coco", f"""WITH {LINES}, {_QUADS}, {_IMAGES}
SELECT image_id, any_value(file_name) AS file_name, count(anno_no) AS n, sum(w * h)::DOUBLE AS area
FROM images LEFT JOIN quads USING (image_id) GROUP BY image_id""")
def s6(spark, sf):
    images, annos = DC.read_coco_records(spark, coco_files(spark, sf))
    images = images.select("id", "file_name")
    counts = annos.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))
    # the sizes of what is read from the documents are unknown to the optimizer, which would send either side through the driver
    out = images.withColumnRenamed("id", "image_id").join(counts.hint("merge"), "image_id", "left")
    return out.select("image_id", "file_name", F.coalesce("n", F.lit(0)).alias("n"), "area")


def annotation_lines(spark, sf):
    nested = A.nest_annotations(D.images(spark, sf), annotations(spark, sf))
    return nested.select("file_name", "height", "width", "piece_no", "annotations")


@query("S7_json_lines", f"""WITH {LINES}, {_QUADS}, {_IMAGES}
SELECT any_value(file_name) AS file_name, 600 AS height, count(anno_no) AS n FROM images LEFT JOIN quads USING (image_id) GROUP BY image_id""")
def s7(spark, sf):
    path = scratch_path(spark, "lines")
    WR.write_json_lines(annotation_lines(spark, sf), path)
    rows = RD.read_json_lines(spark, path, schemas.ANNOTATION_LINE, ["file_name", "height", "annotations"])
    return rows.select("file_name", "height", F.size("annotations").cast("bigint").alias("n"))


@query("S8_label_lines", """
SELECT sep, 'word_' || p_partkey || '.png' AS filename, CASE sep WHEN 'tab' THEN p_name ELSE replace(p_name, ' ', '_') END AS text
FROM part, (VALUES ('space'), ('tab')) AS s(sep)""")
def s8(spark, sf):
    p = D.table(spark, sf, "part")
    name = F.concat(F.lit("word_"), F.col("p_partkey").cast("string"), F.lit(".png"))
    spaced, tabbed = scratch_path(spark, "labels"), scratch_path(spark, "labels-tab")
    p.select(F.concat_ws(" ", name, F.replace("p_name", F.lit(" "), F.lit("_")))).write.text(spaced)
    p.select(F.concat_ws("\t", name, "p_name")).write.text(tabbed)
    a = RD.read_label_lines(spark, spaced).withColumn("sep", F.lit("space"))
    return a.unionByName(RD.read_label_lines(spark, tabbed, separator="\t").withColumn("sep", F.lit("tab")))


@query("S9_quad_labels", f"""WITH {LINES}, {_QUADS}
SELECT layout, CAST(x AS INTEGER) AS x1, CAST(y + h AS INTEGER) AS y4, CASE layout WHEN 'quad2017' THEN 'Latin' END AS language, text,
       CASE WHEN text = '###' THEN 1 ELSE 0 END AS iscrowd FROM quads, (VALUES ('quad2015'), ('quad2017')) AS l(layout)""")
def s9(spark, sf):
    q = D.quads(spark, sf)
    # a byte order mark in front of each first line
    mark = F.when(F.col("anno_no") == 1, "﻿").otherwise("")
    out = None
    for layout, line in (
        ("quad2015", F.concat(mark, F.concat_ws(",", _text_of(), "text"))),
        ("quad2017", F.concat_ws(",", _text_of(), F.lit("Latin"), "text")),
    ):
        path = scratch_path(spark, layout)
        q.select(line).write.text(path)
        rows = RD.read_quad_labels(spark, path, layout).select(
            F.lit(layout).alias("layout"), F.get("coords", 0).alias("x1"), F.get("coords", 7).alias("y4"), "language", "text", "iscrowd"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def curve_coords():
    """Fourteen points: seven along the top, seven back along the bottom."""
    x, y = F.get("coords", 0), F.get("coords", 1)
    points = [(x + i, y) for i in range(7)] + [(x + 6 - i, y + 10) for i in range(7)]
    return F.array(*[v for p in points for v in p])


_CURVE = "list_transform(range(7), lambda i: (x + i) || ',' || y), list_transform(range(7), lambda i: (x + 6 - i) || ',' || (y + 10))"


@query("S10_curve_labels", f"""WITH {LINES}, {_QUADS}
SELECT array_to_string(list_concat({_CURVE}), ',') AS points, CASE WHEN text = '###' THEN '' ELSE text END AS text FROM quads""")
def s10(spark, sf):
    path = scratch_path(spark, "curves")
    line = F.concat(_text_of("c"), F.lit(",####"), F.col("text"))
    D.quads(spark, sf).withColumn("c", curve_coords()).select(line).write.text(path)
    return RD.read_curve_labels(spark, path).select(_text_of().alias("points"), "text")


@query("S11_polygon_xml", f"""WITH {LINES}, {_QUADS}
SELECT 'img_' || image_id AS image, CAST(row_number() OVER (PARTITION BY image_id ORDER BY anno_no) - 1 AS INTEGER) AS box_no,
       x || ',' || y || ',6,10' AS bbox, 60.0::DOUBLE AS area, replace(text, '###', 'hidden') AS label FROM quads""")
def s11(spark, sf):
    q = D.quads(spark, sf).withColumn("c", curve_coords())
    box = F.concat(
        F.lit('<box height="10" width="6" left="'), F.get("coords", 0).cast("string"), F.lit('" top="'), F.get("coords", 1).cast("string"),
        F.lit('"><label>'), F.replace("text", F.lit("###"), F.lit("hidden")), F.lit("</label><segs>"), _text_of("c"), F.lit("</segs></box>"),
    )
    images = q.groupBy("image_id", F.floor(F.col("anno_no") / A.PIECE)).agg(F.sort_array(F.collect_list(F.struct("anno_no", box.alias("b")))).alias("b"))
    xml = F.concat(
        F.lit('<image file="img_'), F.col("image_id").cast("string"), F.lit('">'),
        F.array_join(F.transform("b", lambda r: r["b"]), ""), F.lit("</image>"),
    )
    path = scratch_path(spark, "polygon-xml")
    name = F.format_string("part_%d.xml", F.floor(F.col("image_id") / 100_000))
    DC.write_xml_documents(images.select(name.alias("name"), "image_id", xml.alias("xml")), path, ["image_id"])
    rows = RD.polygon_boxes(DC.read_xml_elements(spark, path, "image", schemas.POLYGON_XML))
    return rows.select("image", "box_no", _text_of("bbox").alias("bbox"), G.polygon_area("coords").alias("area"), "label")


@query("S12_rectangle_xml", f"""WITH {LINES}, {_RECTS}
SELECT image, rect_no, x1, y1, tag, lexicon FROM rects""")
def s12(spark, sf):
    rect = F.concat(
        F.lit('<taggedRectangle x="'), F.col("x").cast("string"), F.lit('" y="'), F.col("y").cast("string"),
        F.lit('" width="'), F.col("width").cast("string"), F.lit('" height="'), F.col("height").cast("string"),
        F.lit('"><tag>'), F.col("tag"), F.lit("</tag></taggedRectangle>"),
    )
    # one image element per rectangle: its number goes with the image name
    xml = F.concat(
        F.lit("<image><imageName>"), F.col("image"), F.lit("#"), F.col("rect_no").cast("string"), F.lit("</imageName><lex>"),
        F.col("lexicon"), F.lit("</lex><taggedRectangles>"), rect, F.lit("</taggedRectangles></image>"),
    )
    path = scratch_path(spark, "rectangle-xml")
    name = F.format_string("part_%d.xml", F.floor(F.col("rect_no") / 1_000_000))
    DC.write_xml_documents(rectangles(spark, sf).select(name.alias("name"), "rect_no", xml.alias("xml")), path, ["rect_no"])
    rows = RD.rectangle_labels(RD.tagged_rectangles(DC.read_xml_elements(spark, path, "image", schemas.RECTANGLE_XML)))
    return rows.select(
        F.substring_index("image", "#", 1).alias("image"), F.substring_index("image", "#", -1).cast("bigint").alias("rect_no"),
        "x1", "y1", "tag", "lexicon",
    )


def supplier_files(spark, sf):
    """An image file per supplier in credit, a label file per supplier; returns folder and listing."""
    path = scratch_path(spark, "pairs")
    s = D.table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    img = s.filter("s_acctbal >= 0").select(F.concat(F.lit("img/"), key, F.lit(".jpg")).alias("name"), F.lit("i").alias("content"))
    txt = s.select(F.concat(F.lit("txt/"), key, F.lit(".txt")).alias("name"), F.col("s_name").alias("content"))
    WR.write_named_files(img.unionByName(txt), path)
    files = RD.list_files(spark, path).select(F.regexp_extract("path", r"((?:img|txt)/[^/]*)\z", 1).alias("path"))
    pairs = s.select(
        "s_suppkey", F.concat(F.lit("img/"), key, F.lit(".jpg")).alias("image"), F.concat(F.lit("txt/"), key, F.lit(".txt")).alias("anno")
    )
    return files, pairs


@query("S13_existing_pairs", "SELECT s_suppkey, 'img/' || s_suppkey || '.jpg' AS image, 'txt/' || s_suppkey || '.txt' AS anno FROM supplier WHERE s_acctbal >= 0")
def s13(spark, sf):
    files, pairs = supplier_files(spark, sf)
    return RD.existing_pairs(pairs, files, ("image", "anno")).select("s_suppkey", "image", "anno")


@query("F14_missing_files", "SELECT 'img/' || s_suppkey || '.jpg' AS image FROM supplier WHERE s_acctbal < 0")
def f14(spark, sf):
    files, pairs = supplier_files(spark, sf)
    return RD.missing_files(pairs.select("image"), files, "image")


@query("S14_image_sizes", """
SELECT 'img_' || s_suppkey || '.bmp' AS file_name, s_nationkey + 1 AS height, CAST(8 + s_suppkey % 50 AS INTEGER) AS width FROM supplier""")
def s14(spark, sf):
    width, height = (8 + F.col("s_suppkey") % 50).cast("int"), F.col("s_nationkey") + 1
    row = (F.ceil(width / 4) * 4).cast("int")

    def number(value, size):
        # little-endian bytes in hex
        big = F.lpad(F.hex(value), 2 * size, "0")
        return F.concat(*[F.substring(big, 2 * (size - i) - 1, 2) for i in range(size)])

    pixels = row * height
    head = F.concat(
        F.lit("424d"), number(pixels + 1078, 4), F.lit("00000000"), number(F.lit(1078), 4), number(F.lit(40), 4),
        number(width, 4), number(height, 4), F.lit("01000800"), F.lit("00000000"), number(pixels, 4),
        F.lit("00000000" * 2), number(F.lit(256), 4), F.lit("00000000"),
    )
    body = F.concat(head, F.repeat(F.lit("00"), F.lit(1024)), F.repeat(F.lit("00"), pixels))
    name = F.format_string("img_%d.bmp", "s_suppkey")
    path = scratch_path(spark, "images")
    WR.write_named_files(D.table(spark, sf, "supplier").select(name.alias("name"), F.unhex(body).alias("content")), path)
    return RD.image_sizes(spark, path)


@query("S15_list_images", """
SELECT 'imgs/training/img_' || s_suppkey || '.jpg' AS image_file, 'training' AS split, 'gt/training/gt_img_' || s_suppkey || '.txt' AS truth_file
FROM supplier WHERE s_acctbal >= 0""")
def s15_list(spark, sf):
    path = scratch_path(spark, "listing")
    s = D.table(spark, sf, "supplier")
    # names in credit are images, the others are not listed
    suffix = F.when(F.col("s_acctbal") >= 0, ".jpg").otherwise(".gif")
    name = F.concat(F.lit("imgs/training/img_"), F.col("s_suppkey").cast("string"), suffix)
    WR.write_named_files(s.select(name.alias("name"), F.lit("i").alias("content")), path)
    images = RD.list_images(spark, path + "/imgs", "gt", "quad")
    return images.select(F.regexp_extract("image_file", r"(imgs/training/[^/]*)\z", 1).alias("image_file"), "split", "truth_file")


@query("S16_nested_tables", f"""WITH {LINES}
SELECT l_orderkey AS image_id, l_linenumber AS anno_no, CASE WHEN ls = 'O' THEN '???' ELSE flag || ls END AS word,
  concat_ws(',', l_partkey % 500, l_suppkey % 500, l_partkey % 500 + qty, l_suppkey % 500, l_partkey % 500, l_suppkey % 500 + 10) AS points
FROM lines WHERE qty >= 5 AND NOT (flag = 'R' AND ls = 'F')""")
def s16(spark, sf):
    path = scratch_path(spark, "nested")
    contours(spark, sf).write.parquet(path)
    kept = A.nested_contours(spark.read.parquet(path))
    return kept.select("image_id", "anno_no", "word", _text_of("contour").alias("points"))


# ---------------------------------------------------------------- sinks


@query("K1_write_linearized", f"SELECT c_nationkey AS table_id, '''' || {_CUSTOMER_TEXT} || '''' AS value FROM customer")
def k1(spark, sf):
    path = scratch_path(spark, "k1")
    WR.write_linearized(linearized_customers(spark, sf), path)
    return spark.read.schema("value string, table_id int").text(path).select("table_id", "value")


@query("K2_score_map", """
WITH n AS (SELECT c_name, c_acctbal, row_number() OVER (ORDER BY c_name) - 1 AS n FROM customer)
SELECT n AS line_no, CASE WHEN n = 0 THEN '{' ELSE ',' END || '"' || c_name || '": ' || CAST(c_acctbal AS VARCHAR) AS value FROM n
UNION ALL SELECT count(*), '}' FROM n""")
def k2(spark, sf):
    path = scratch_path(spark, "k2")
    scores = D.table(spark, sf, "customer").select(F.col("c_name").alias("file"), F.col("c_acctbal").alias("score"))
    WR.write_score_map(scores, path)
    return RD.read_numbered_lines(spark, path)


@query("K3_metric_records", f"""{_BLEU}
SELECT CAST(pair_id % 25 AS INTEGER) AS table_id, CAST(pair_id AS BIGINT) AS variation, lp::DOUBLE AS translation_length,
       round({_BLEU_SCORE}, 6) AS bleu FROM bleu""")
def k3(spark, sf):
    path = scratch_path(spark, "k3")
    scored = X.bleu(D.sentences(spark, sf)).withColumn("table_id", (F.col("pair_id") % 25).cast("int"))
    records = scored.select("table_id", F.col("pair_id").alias("variation"), F.col("translation_length").cast("double"), "bleu")
    WR.write_metric_records(records, path)
    written = spark.read.schema("variation bigint, translation_length double, bleu double, table_id int").json(path)
    return written.withColumn("bleu", F.round("bleu", 6))


_CHAIN_PAIRS = f"""{_MAP},
gold AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, {_ORDER_GOLD} AS gold FROM orders),
pairs AS (
  SELECT c_custkey AS pair_id, c_nationkey AS table_id, regexp_replace(gold, '([0-9])-', '\\1 - ', 'g') AS reference,
         'The table has ' || CASE WHEN c_acctbal < 0 THEN 2 ELSE 3 END || ' values in 1 rows .' AS prediction
  FROM customer JOIN last ON c_nationkey = table_id JOIN gold USING (line_no))"""
_CHAIN_ROUGE = _ngram_counts("rwords", "(1), (2)").replace("grams", "rgrams").replace("hits", "rhits")


@query("E2_summary_chain", f"""{_BLEU.replace(_PAIRS, _CHAIN_PAIRS)},
rwords AS (SELECT pair_id, {_rouge_words('prediction')} AS p, {_rouge_words('reference')} AS r FROM pairs),
{_CHAIN_ROUGE},
rouge AS (
  SELECT pair_id, 2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 1), 0) / (any_value(len(p)) + any_value(len(r))) AS rouge1,
         2.0::DOUBLE * coalesce(max(h) FILTER (WHERE n = 2), 0) / (any_value(len(p)) + any_value(len(r)) - 2) AS rouge2
  FROM rwords LEFT JOIN rhits USING (pair_id) GROUP BY pair_id),
longest AS (SELECT pair_id, 2.0::DOUBLE * {_LCS} / (len(p) + len(r)) AS l FROM rwords)
SELECT CAST(table_id AS INTEGER) AS table_id, CAST(pair_id AS BIGINT) AS variation, round(p1, 6) AS precision_1,
       CASE WHEN least(p1, p2, p3, p4) > 0 THEN round(bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 6) ELSE 0.0::DOUBLE END AS bleu,
       round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(l, 6) AS "rougeL", true AS has_gold
FROM pairs JOIN bleu USING (pair_id) JOIN rouge USING (pair_id) JOIN longest USING (pair_id)
UNION ALL SELECT CAST(c_nationkey AS INTEGER), CAST(c_custkey AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false
FROM customer WHERE c_custkey NOT IN (SELECT pair_id FROM pairs)""")
def e2(spark, sf):
    """From tables to records: linearise, generate, attach gold, BLEU and ROUGE merged, one JSON record per variation.

    Predictions without a gold sentence have a record too; their scores are 0 and ``has_gold`` is false.
    """
    made = GEN.generate(linearized_customers(spark, sf), GEN.template_model).select("table_id", "variation", "prediction")
    pairs = S.attach_gold(made, id_map(spark, sf), gold_lines(spark, sf)).withColumnRenamed("gold", "reference")
    fields = ["precision_1", "bleu", "rouge1", "rouge2", "rougeL"]
    keys = ["table_id", "variation", "has_gold"]
    merged = X.wide_metrics(X.long_metrics(X.score_text(pairs, ["bleu", "rouge"]), ["bleu", "rouge"], keys), keys, fields)
    path = scratch_path(spark, "e2")
    WR.write_metric_records(merged, path)
    schema = "variation bigint, has_gold boolean, " + ", ".join(f"{f} double" for f in fields) + ", table_id int"
    return spark.read.schema(schema).json(path).select(*keys, *(F.round(f, 6).alias(f) for f in fields))


@query("K4_write_predictions", """
SELECT c_nationkey AS table_id, '''The table has ' || CASE WHEN c_acctbal < 0 THEN 2 ELSE 3 END || ' values in 1 rows .''' AS value FROM customer""")
def k4(spark, sf):
    path = scratch_path(spark, "k4")
    WR.write_predictions(GEN.generate(linearized_customers(spark, sf), GEN.template_model), path)
    return spark.read.schema("value string, table_id int").text(path).select("table_id", "value")


@query("K5_annotation_lines", f"""WITH {LINES}, {_QUADS}, {_IMAGES}
SELECT file_name, x::DOUBLE AS x, h::DOUBLE AS h, (w * h)::DOUBLE AS area, CASE WHEN text = '###' THEN 1 ELSE 0 END AS iscrowd
FROM images JOIN quads USING (image_id)""")
def k5(spark, sf):
    path = scratch_path(spark, "k5")
    WR.write_json_lines(annotation_lines(spark, sf), path)
    rows = RD.read_json_lines(spark, path, schemas.ANNOTATION_LINE, ["file_name", "annotations"])
    rows = rows.select("file_name", F.explode("annotations").alias("a"))
    return rows.select("file_name", F.get("a.bbox", 0).alias("x"), F.get("a.bbox", 3).alias("h"), "a.area", "a.iscrowd")


@query("K6_coco_by_split", f"""WITH {LINES}, {_QUADS}, {_IMAGES}
SELECT split, count(DISTINCT image_id) AS n_images, count(anno_no) AS n_annotations FROM images LEFT JOIN quads USING (image_id) GROUP BY split""")
def k6(spark, sf):
    records = DC.read_json_records(spark, coco_files(spark, sf))
    split = F.regexp_extract("file", r"/instances_([a-z]+)\.json\z", 1).alias("split")
    counts = [F.count(F.when(F.col("section") == s, 1)).alias(f"n_{s}") for s in ("images", "annotations")]
    return records.groupBy(split).agg(*counts)


@query("K7_results", f"WITH {_LABELS} SELECT pred = gt AS is_correct, image || ' ' || pred || ' ' || gt AS value FROM pairs")
def k7(spark, sf):
    path = scratch_path(spark, "k7")
    WR.write_results(R.mark_correct(label_pairs(spark, sf)), path)
    return spark.read.schema("value string, is_correct boolean").text(path).select("is_correct", "value")


@query("K8_coordinate_files", f"""WITH {LINES}, {BOXES}
SELECT image, concat_ws(',', x1, y1, x2, y1, x2, y2, x1, y2, CAST(score AS VARCHAR)) AS value FROM det""")
def k8(spark, sf):
    path = scratch_path(spark, "k8")
    det = D.detected_boxes(spark, sf).withColumn("coords", G.box_to_quad("box").cast("array<int>"))
    WR.write_coordinates(det, path)
    return spark.read.schema("value string, image bigint").text(path).select("image", "value")


@query("K9_keyed_rows", """
SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR) AS key, '{"name":"' || c_name || '"}' AS value FROM customer
UNION ALL SELECT 'total_number', CAST(count(*) AS VARCHAR) FROM customer""")
def k9(spark, sf):
    path = scratch_path(spark, "k9")
    value = F.to_json(F.struct(F.col("c_name").alias("name")))
    WR.keyed_rows(D.table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], value).write.parquet(path)
    return spark.read.parquet(path)


@query("K10_wrapped_documents", """
SELECT 's_' || s_suppkey || '.htm' AS file, '<html><body><table><tr><td>' || s_name || '</td></tr></table></body></html>' AS html FROM supplier""")
def k10(spark, sf):
    path = scratch_path(spark, "k10")
    rows = F.concat(F.lit("<tr><td>"), F.col("s_name"), F.lit("</td></tr>"))
    name = F.format_string("s_%d.htm", "s_suppkey")
    WR.write_named_files(D.table(spark, sf, "supplier").select(name.alias("name"), M.wrap_document(rows).alias("content")), path)
    return RD.read_html_tables(spark, path)


@query("K11_crop_labels", f"""WITH {LINES}, {_RECTS}
SELECT printf('image/img_%04d.jpg', row_number() OVER (ORDER BY image, rect_no)) || ' ' || tag || ' ' || lex_size || ' ' || lexicon AS value FROM rects""")
def k11(spark, sf):
    path = scratch_path(spark, "k11")
    rects = running_index(RD.rectangle_labels(rectangles(spark, sf)), ["image", "rect_no"], start=1)
    rects.select(WR.crop_label_line(rects)).write.text(path)
    return spark.read.text(path)


@query("K12_raw_outputs", f"WITH {LINES}, {BOXES} SELECT image, det_no, x1::DOUBLE AS x1, score FROM det")
def k12(spark, sf):
    path = scratch_path(spark, "k12")
    D.detected_boxes(spark, sf).write.parquet(path)
    return spark.read.parquet(path).select("image", "det_no", F.get("box", 0).alias("x1"), "score")


# ---------------------------------------------------------------- incremental


_HAS_PREDICTION = "k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"


def arrivals(spark, sf, pred, late, **options):
    """Predictions that arrive in two parts, the even variations first; the folder of their scores."""
    base = scratch_path(spark, "t1")
    D.html_tables(spark, sf).select("file", F.col("true_html").alias("html")).write.parquet(f"{base}/true")
    truth = spark.read.parquet(f"{base}/true").filter(options.pop("truth", F.lit(True)))
    for part in (pred.filter(~late), pred.filter(late)):
        part.write.mode("append").parquet(f"{base}/pred")
        score_new_predictions(spark, truth, f"{base}/pred", f"{base}/scores", f"{base}/state", **options)
    return f"{base}/scores"


def is_late():
    return variation("file") % 2 == 1


@query("T1_incremental_scores", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, CAST(n_true AS INTEGER) AS n_true, CAST(n_pred AS INTEGER) AS n_pred,
  round(1 - distance / greatest(n_true, n_pred), 6) AS score FROM damage WHERE {_HAS_PREDICTION}""")
def t1(spark, sf):
    scores = read_scores(spark, arrivals(spark, sf, D.html_pred(spark, sf), is_late()))
    return scores.select("file", "n_true", "n_pred", F.round("score", 6).alias("score"))


@query("T1_names_sent_twice", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, CASE WHEN v = 3 THEN -1.0 ELSE round(1 - distance / greatest(n_true, n_pred), 6) END AS score,
  CASE WHEN v = 3 THEN 'no_truth' ELSE 'ok' END AS flag FROM damage WHERE {_HAS_PREDICTION}""")
def t1_twice(spark, sf):
    """Every name of the first part comes again in the second, then as an empty document; no truth for the last variation of a table."""
    pred = D.html_pred(spark, sf).withColumn("again", F.lit(False))
    again = pred.filter(~is_late()).select("file", F.lit("").alias("html"), F.lit(True).alias("again"))
    late = is_late() | F.col("again")
    path = arrivals(spark, sf, pred.unionByName(again), late, truth=variation("file") % 4 != 3)
    scores = read_scores(spark, path)
    return scores.select("file", F.coalesce(F.round("score", 6), F.lit(-1.0)).alias("score"), "flag")
