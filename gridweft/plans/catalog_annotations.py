"""Queries over annotations: boxes, polygons, characters, nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.functions import geometry as G
from gridweft.functions import text as T
from gridweft.functions.names import stem, target_path, truth_path
from gridweft.operators import annotations as A
from gridweft.operators import datasets as DS
from gridweft.operators import vocabulary as V
from gridweft.operators.ordering import running_index
from gridweft.plans import derived as D
from gridweft.plans.registry import LINES, query
from gridweft.sources.readers import rectangle_labels

_XY = "l_partkey % 500 AS x, l_suppkey % 500 AS y, qty + 10 AS w, l_linenumber * 4 + 8 AS h"
_QUADS = f"""quads AS (
  SELECT l_orderkey AS image_id, l_linenumber AS anno_no, x, y, w, h,
         CASE WHEN l_linenumber = 3 THEN '###' ELSE flag || ls END AS text
  FROM (SELECT *, {_XY} FROM lines))"""
_IMAGES = """images AS (
  SELECT o_orderkey AS image_id, CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'test' ELSE 'validation' END AS split,
         CASE o_orderstatus WHEN 'F' THEN 'training' WHEN 'O' THEN 'test' ELSE 'validation' END || '/img_' || o_orderkey || '.jpg' AS file_name
  FROM orders)"""


@query("P9_bounds", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM quads""")
def p9(spark, sf):
    q = D.quads(spark, sf).withColumn("b", G.bounds_xywh(F.col("coords").cast("array<double>")))
    return q.select("image_id", "anno_no", *[F.get("b", i).alias(n) for i, n in enumerate("xywh")])


@query("P10_area", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no, (w * h)::DOUBLE AS area FROM quads""")
def p10(spark, sf):
    return D.quads(spark, sf).select("image_id", "anno_no", G.polygon_area("coords").alias("area"))


@query("P11_interleave", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no, concat_ws(',', x, y, x + w, y, x + w, y + h, x, y + h) AS points FROM quads""")
def p11(spark, sf):
    q = D.quads(spark, sf).select("image_id", "anno_no", G.xs("coords").alias("xs"), G.ys("coords").alias("ys"))
    return q.select("image_id", "anno_no", F.array_join(G.interleave("xs", "ys").cast("array<string>"), ",").alias("points"))


def part_chars(spark, sf):
    """``image_id, strs, char_quads``: part name as two texts, a box of width 10 for each letter."""
    p = D.table(spark, sf, "part")
    letters = F.filter(F.split(F.replace("p_name", F.lit(" "), F.lit("")), ""), lambda c: c != "")
    size = F.col("p_size")
    quads = F.transform(
        letters,
        lambda c, i: F.array(i * 10, size, i * 10 + 9, size, i * 10 + 9, size + 12, i * 10, size + 12).cast("array<double>"),
    )
    return p.select(F.col("p_partkey").alias("image_id"), F.array("p_name", "p_type").alias("strs"),
                    F.concat(quads, F.transform(F.filter(F.split("p_type", ""), lambda c: c != ""), lambda c, i: F.array(
                        i * 10, size + 20, i * 10 + 9, size + 20, i * 10 + 9, size + 32, i * 10, size + 32).cast("array<double>"))).alias("char_quads"))


_WORDS = """words AS (
  SELECT p_partkey AS image_id, p_size, word_no, word, coalesce(sum(len(word)) OVER (PARTITION BY p_partkey ORDER BY word_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT p_partkey, p_size, generate_subscripts(w, 1) - 1 AS word_no, unnest(w) AS word FROM (
      SELECT p_partkey, p_size, list_append(string_split(p_name, ' '), p_type) AS w FROM part)))"""


@query("W3_word_ranges", f"""WITH {_WORDS}
SELECT image_id, CAST(word_no AS INTEGER) AS word_no, word, CAST(s AS INTEGER) AS char_start, CAST(s + len(word) AS INTEGER) AS char_stop FROM words""")
def w3(spark, sf):
    return A.words_with_boxes(part_chars(spark, sf)).select("image_id", "word_no", "word", "char_start", "char_stop")


@query("P12_word_outline", f"""WITH {_WORDS},
placed AS (SELECT *, CASE WHEN word_no = max(word_no) OVER (PARTITION BY image_id) THEN 0 ELSE s END AS o,
              p_size + CASE WHEN word_no = max(word_no) OVER (PARTITION BY image_id) THEN 20 ELSE 0 END AS y FROM words)
SELECT image_id, CAST(word_no AS INTEGER) AS word_no,
  array_to_string(list_transform(range(CAST(len(word) AS BIGINT)), lambda i: concat_ws(',', (o + i) * 10, y, (o + i) * 10 + 9, y)), ',') || ',' ||
  array_to_string(list_reverse(list_transform(range(CAST(len(word) AS BIGINT)), lambda i: concat_ws(',', (o + i) * 10 + 9, y + 12, (o + i) * 10, y + 12))), ',') AS outline
FROM placed""")
def p12(spark, sf):
    words = A.words_with_boxes(part_chars(spark, sf))
    return words.select("image_id", "word_no", F.array_join(F.col("outline").cast("array<string>"), ",").alias("outline"))


@query("J11_char_annotations", """
SELECT image_id, CAST(i - 1 AS INTEGER) AS pos, substr(p_name, i, 1) AS char_text, ((i - 1) * 10)::DOUBLE AS left FROM (
  SELECT p_partkey AS image_id, p_name, unnest(range(1, len(p_name) + 1)) AS i FROM part)""")
def j11(spark, sf):
    p = D.table(spark, sf, "part")
    boxes = F.transform(F.sequence(F.lit(0), F.length("p_name") - 1), lambda i: F.array(i * 10, F.lit(0), i * 10 + 9, F.lit(12)))
    chars = p.select(F.col("p_partkey").alias("image_id"), A.char_annotations("p_name", boxes).alias("a"))
    rows = chars.select("image_id", F.posexplode("a").alias("pos", "c"))
    return rows.select("image_id", "pos", "c.char_text", F.get("c.char_box", 0).alias("left"))


@query("P13_box_to_quad", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no, concat_ws(',', x, y, x + w, y, x + w, y + h, x, y + h) AS quad FROM quads""")
def p13(spark, sf):
    q = D.quads(spark, sf)
    box = F.array(*[F.get("coords", i) for i in (0, 1, 4, 5)])
    quad = F.array_join(G.box_to_quad(box).cast("array<string>"), ",")
    return q.select("image_id", "anno_no", quad.alias("quad"))


@query("P14_clamp_box", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no, greatest(0, x - 3) AS x1, greatest(0, y - 1) AS y1, least(400, x + w + 3) AS x2, least(300, y + h + 1) AS y2 FROM quads""")
def p14(spark, sf):
    q = D.quads(spark, sf)
    box = F.array(*[F.get("coords", i).cast("bigint") for i in (0, 1, 4, 5)])
    q = q.withColumn("b", G.clamp_box(box, F.lit(400), F.lit(300), (1, 1, 3, 3)))
    return q.select("image_id", "anno_no", *[F.get("b", i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def rectangles(spark, sf):
    """Tagged rectangles of suppliers' images, partly left of the origin."""
    li = D.lines(spark, sf)
    return li.select(
        F.concat(F.lit("img/"), F.col("l_suppkey").cast("string"), F.lit(".jpg")).alias("image"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rect_no"),
        F.concat_ws(",", F.lit("RETURN"), "l_returnflag", "l_linestatus").alias("lexicon"),
        (F.col("l_partkey") % 500 - 20).cast("int").alias("x"),
        (F.col("l_suppkey") % 500 - 10).cast("int").alias("y"),
        (F.col("qty") + 10).alias("width"),
        (F.col("l_linenumber") * 4 + 8).alias("height"),
        F.concat("l_returnflag", "l_linestatus").alias("tag"),
    )


_RECTS = """rects AS (
  SELECT 'img/' || l_suppkey || '.jpg' AS image, l_suppkey, l_orderkey * 8 + l_linenumber AS rect_no,
         CAST(greatest(0, l_partkey % 500 - 20) AS INTEGER) AS x1, CAST(greatest(0, l_suppkey % 500 - 10) AS INTEGER) AS y1,
         CAST(greatest(0, l_partkey % 500 - 10 + qty) AS INTEGER) AS x2,
         CAST(greatest(0, l_suppkey % 500 - 2 + l_linenumber * 4) AS INTEGER) AS y2,
         lower(flag || ls) AS tag, lower('return,' || flag || ',' || ls) AS lexicon, 3 AS lex_size FROM lines)"""


@query("P15_rectangle_labels", f"""WITH {LINES}, {_RECTS} SELECT image, rect_no, x1, y1, x2, y2, tag, lexicon, lex_size FROM rects""")
def p15(spark, sf):
    return rectangle_labels(rectangles(spark, sf))


@query("W5_running_index", f"""WITH {LINES}, {_RECTS}
SELECT image, rect_no, row_number() OVER (ORDER BY image, rect_no) AS "index" FROM rects""")
def w5(spark, sf):
    rects = rectangle_labels(rectangles(spark, sf)).select("image", "rect_no")
    return running_index(rects, ["image", "rect_no"], start=1)


@query("P16_running_names", f"""WITH {LINES}, {_RECTS}
SELECT image, rect_no, printf('img_%04d.jpg', row_number() OVER (ORDER BY image, rect_no)) AS crop FROM rects""")
def p16(spark, sf):
    rects = running_index(rectangle_labels(rectangles(spark, sf)).select("image", "rect_no"), ["image", "rect_no"], start=1)
    return rects.select("image", "rect_no", F.format_string("img_%04d.jpg", "index").alias("crop"))


def contours(spark, sf):
    """Nested word polygons: open lines have no word, closed returns the word ``#``, small lines one point."""
    li = D.lines(spark, sf)
    word = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "#").when(
        F.col("l_linestatus") == "O", "").otherwise(F.concat("l_returnflag", "l_linestatus"))
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 500
    one = F.col("qty") < 5
    return li.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("anno_no"),
        F.when(one, F.array(x)).otherwise(F.array(x, x + F.col("qty"), x)).alias("x"),
        F.when(one, F.array(y)).otherwise(F.array(y, y, y + 10)).alias("y"),
        word.alias("word"),
    )


_WORD = "CASE WHEN flag = 'R' AND ls = 'F' THEN '#' WHEN ls = 'O' THEN '???' ELSE flag || ls END"


@query("P17_missing_word", f"""WITH {LINES} SELECT l_orderkey AS image_id, l_linenumber AS anno_no, {_WORD} AS word FROM lines""")
def p17(spark, sf):
    return contours(spark, sf).select("image_id", "anno_no", T.missing_word("word").alias("word"))


@query("F3_drop_hash_words", f"""WITH {LINES}
SELECT l_orderkey AS image_id, l_linenumber AS anno_no, {_WORD} AS word FROM lines WHERE {_WORD} <> '#'""")
def f3(spark, sf):
    words = contours(spark, sf).withColumn("word", T.missing_word("word"))
    return words.filter(F.col("word") != "#").select("image_id", "anno_no", "word")


@query("F4_drop_single_points", f"""WITH {LINES}
SELECT l_orderkey AS image_id, l_linenumber AS anno_no, {_WORD} AS word, qty * 5.0::DOUBLE AS area FROM lines
WHERE qty >= 5 AND {_WORD} <> '#'""")
def f4(spark, sf):
    kept = A.nested_contours(contours(spark, sf))
    return kept.select("image_id", "anno_no", "word", G.polygon_area("contour").alias("area"))


@query("F5_ignored_text", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no, CASE WHEN text = '###' THEN 1 ELSE 0 END AS iscrowd FROM quads""")
def f5(spark, sf):
    q = D.quads(spark, sf)
    line = F.concat_ws(",", F.array_join(F.col("coords").cast("array<string>"), ","), F.lit("Latin"), "text")
    return q.select("image_id", "anno_no", A.parse_quad_line(line, "quad2017")["iscrowd"].alias("iscrowd"))


@query("F6_known_images", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no FROM quads WHERE image_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def f6(spark, sf):
    images = D.images(spark, sf).filter("split <> 'validation'")
    return A.known_only(D.quads(spark, sf), images).select("image_id", "anno_no")


@query("F13_split_rule", """
SELECT o_orderkey AS image_id, 'annotations/img_' || o_orderkey || '.xml' AS truth_file FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'annotations/000img_' || o_orderkey || '.txt' FROM orders WHERE o_orderstatus = 'O'""")
def f13(spark, sf):
    images = D.images(spark, sf).withColumn("truth_file", truth_path("file_name", F.lit("annotations"), "curved", "split"))
    return images.filter(F.col("truth_file").isNotNull()).select("image_id", "truth_file")


def annotations(spark, sf):
    q = D.quads(spark, sf)
    crowd = F.when(F.col("text") == A.CROWD_MARK, 1).otherwise(0)
    return q.select("image_id", "anno_no", A.annotation("coords", crowd).alias("anno"))


@query("P18_pick_fields", f"""WITH {LINES}, {_QUADS}
SELECT image_id, anno_no, '{{"iscrowd":' || CASE WHEN text = '###' THEN 1 ELSE 0 END || ',"category_id":1,"bbox":['
  || concat_ws(',', x::DOUBLE, y::DOUBLE, w::DOUBLE, h::DOUBLE) || ']}}' AS record FROM quads""")
def p18(spark, sf):
    picked = F.struct("anno.iscrowd", "anno.category_id", "anno.bbox")
    return annotations(spark, sf).select("image_id", "anno_no", F.to_json(picked).alias("record"))


@query("A19_nested_annotations", f"""WITH {LINES}, {_QUADS}
SELECT image_id, count(*) AS n, string_agg(x || ':' || y, ' ' ORDER BY anno_no) AS corners, sum(w * h)::DOUBLE AS area
FROM quads GROUP BY image_id""")
def a19(spark, sf):
    nested = A.nest_annotations(D.images(spark, sf), annotations(spark, sf)).filter(F.size("annotations") > 0)
    corner = F.transform("annotations", lambda a: F.concat_ws(":", *[F.get(a["bbox"], i).cast("int").cast("string") for i in (0, 1)]))
    area = F.aggregate("annotations", F.lit(0.0), lambda s, a: s + a["area"])
    return nested.select(
        "image_id", F.size("annotations").cast("bigint").alias("n"), F.array_join(corner, " ").alias("corners"), area.alias("area")
    )


@query("J6_images_with_annotations", f"""WITH {LINES}, {_QUADS}, {_IMAGES}
SELECT image_id, any_value(file_name) AS file_name, count(anno_no) AS n FROM images LEFT JOIN quads USING (image_id) GROUP BY image_id""")
def j6(spark, sf):
    nested = A.nest_annotations(D.images(spark, sf), annotations(spark, sf))
    return nested.select("image_id", "file_name", F.size("annotations").cast("bigint").alias("n"))


@query("J7_image_truth_files", f"""WITH {_IMAGES}
SELECT file_name, split || '/gt_img_' || image_id || '.txt' AS segm_file FROM images WHERE split <> 'validation'""")
def j7(spark, sf):
    images = D.images(spark, sf)
    names = images.select("file_name", truth_path("file_name", "split", "quad").alias("segm_file"))
    truths = images.filter("split <> 'validation'").select("segm_file")
    return names.join(truths, "segm_file").select("file_name", "segm_file")


@query("P19_target_path", f"""WITH {_IMAGES} SELECT file_name, '/out/img_' || image_id || '.txt' AS target FROM images""")
def p19(spark, sf):
    return D.images(spark, sf).select("file_name", target_path("/out", "file_name", ".txt").alias("target"))


@query("P20_normalize_label", """
SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^0-9a-z]', '', 'g') AS label FROM part""")
def p20(spark, sf):
    p = D.table(spark, sf, "part")
    return p.select("p_partkey", T.normalize_label(F.concat_ws("-", "p_name", "p_brand")).alias("label"))


_DIGITS = tuple("0123456789abcdefghijklmnopqrstuvwxyz")


@query("P21_encode_labels", """
SELECT p_partkey, '37,' || array_to_string(list_transform(string_split(lower(p_name), ''), lambda c:
   CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 87 ELSE 36 END), ',')
   || ',38' || repeat(',39', CAST(20 - 2 - len(p_name) AS BIGINT)) AS codes FROM part""")
def p21(spark, sf):
    p = D.table(spark, sf, "part")
    chars = F.filter(F.split(F.lower("p_name"), ""), lambda c: c != "")
    codes = V.encode(chars, _DIGITS, 20)
    return p.select("p_partkey", F.array_join(codes.cast("array<string>"), ",").alias("codes"))


@query("P22_outside_alphabet", f"""WITH {LINES}
SELECT '<table>' AS token, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber // 50 FROM lines)
UNION ALL SELECT '</table>', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber // 50 FROM lines)
UNION ALL SELECT '<html>', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber // 50 FROM lines)
UNION ALL SELECT '</html>', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber // 50 FROM lines)
UNION ALL SELECT '<body>', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber // 50 FROM lines)
UNION ALL SELECT '</body>', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber // 50 FROM lines)""")
def p22(spark, sf):
    tokens = D.single_tables(spark, sf).select(F.explode(V.structure_tokens("html")).alias("token"))
    return V.outside_alphabet(tokens, V.structure_alphabet(spark))


@query("F12_within_length", "SELECT p_partkey, p_name FROM part WHERE length(p_name) <= 9")
def f12(spark, sf):
    return V.within_length(D.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 9)


@query("F12_cut_tokens", """
SELECT doc_id, left(text, 75) AS cut FROM documents""")
def f12_cut(spark, sf):
    chars = F.slice(F.filter(F.split("text", ""), lambda c: c != ""), 1, V.MAX_LABEL)
    return D.table(spark, sf, "documents").select("doc_id", F.array_join(chars, "").alias("cut"))


@query("F12_first_words", """
SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''), 1, 1024), ' ') AS cut
FROM documents""")
def f12_words(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", V.first_words("text").alias("cut"))


@query("S15_truth_paths", """
SELECT p_partkey, 'gt/gt_img' || p_partkey || '.txt' AS quad,
  CASE WHEN p_size > 25 THEN 'gt/img' || p_partkey || '.xml' ELSE 'gt/000img' || p_partkey || '.txt' END AS curved,
  CASE WHEN p_size > 25 THEN 'gt/gt_img' || p_partkey || '.mat' ELSE 'gt/poly_gt_img' || p_partkey || '.mat' END AS nested,
  'img' || p_partkey AS stem FROM part""")
def s15(spark, sf):
    p = D.table(spark, sf, "part")
    path = F.concat(F.lit("imgs/training/img"), F.col("p_partkey").cast("string"), F.lit(".jpeg"))
    split = F.when(F.col("p_size") > 25, "training").otherwise("test")
    return p.select(
        "p_partkey",
        truth_path(path, F.lit("gt"), "quad").alias("quad"),
        truth_path(path, F.lit("gt"), "curved", split).alias("curved"),
        truth_path(path, F.lit("gt"), "nested", split).alias("nested"),
        stem(path).alias("stem"),
    )


# ---------------------------------------------------------------- data sets


@query("U_1_concat", """
SELECT 'orders' AS dataset, o_orderkey AS id FROM orders UNION ALL SELECT 'parts', p_partkey FROM part
UNION ALL SELECT 'customers', c_custkey FROM customer""")
def u_1(spark, sf):
    return DS.concat_datasets({
        "orders": D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")),
        "parts": D.table(spark, sf, "part").select(F.col("p_partkey").alias("id")),
        "customers": D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
    }).select("dataset", "id")


@query("U_2_repeat", "SELECT p_partkey, CAST(r AS INTEGER) AS repetition FROM part, range(1, 21) AS t(r)")
def u_2(spark, sf):
    return DS.repeat_dataset(D.table(spark, sf, "part").select("p_partkey"), 20)


_MIX = """h AS (SELECT o_orderkey, o_orderstatus AS source, md5('7:' || o_orderkey) AS hash FROM orders),
sizes AS (SELECT source, count(*) AS n FROM h GROUP BY source),
lead AS (SELECT n / {r}::DOUBLE AS total FROM sizes WHERE source = '{lead}'),
ranked AS (SELECT o_orderkey, source, row_number() OVER (PARTITION BY source ORDER BY hash) AS rn FROM h)"""
_SHARE = "floor(CASE source WHEN 'F' THEN 0.5::DOUBLE WHEN 'O' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END * total + 1e-9)"
_RATIOS = {"F": 0.5, "O": 0.3, "P": 0.2}


def _orders(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source"))


@query("U_3_mix_by_ratio", f"""WITH {_MIX.format(r='0.5', lead='F')}
SELECT o_orderkey, source FROM ranked, lead WHERE rn <= {_SHARE}""")
def u_3(spark, sf):
    return DS.mix_by_ratio(_orders(spark, sf), "source", "o_orderkey", _RATIOS, seed=7)


@query("U_3_mix_batches", f"""WITH {_MIX.format(r='0.5', lead='F')}
SELECT o_orderkey, source, CAST(floor((rn - 0.5::DOUBLE) / (CASE source WHEN 'F' THEN 0.5::DOUBLE WHEN 'O' THEN 0.3::DOUBLE
       ELSE 0.2::DOUBLE END * 64)) AS BIGINT) AS batch FROM ranked, lead WHERE rn <= {_SHARE}""")
def u_3_batches(spark, sf):
    return DS.batches_by_ratio(_orders(spark, sf), "source", "o_orderkey", _RATIOS, 64, seed=7)


@query("U_3_mix_last_leads", f"""WITH {_MIX.format(r='0.2', lead='P')}
SELECT o_orderkey, source FROM ranked, lead WHERE rn <= {_SHARE}""")
def u_3_last(spark, sf):
    return DS.mix_by_ratio(_orders(spark, sf), "source", "o_orderkey", _RATIOS, seed=7, mode=1)


@query("U_3_mix_with_unused", f"""WITH {_MIX.format(r='0.5', lead='F')}
SELECT o_orderkey, source, rn <= {_SHARE} AS used FROM ranked, lead""")
def u_3_unused(spark, sf):
    return DS.mix_by_ratio(_orders(spark, sf), "source", "o_orderkey", _RATIOS, seed=7, mode=2)


@query("U_3_mix_all", "SELECT o_orderkey, o_orderstatus AS source FROM orders")
def u_3_all(spark, sf):
    return DS.mix_by_ratio(_orders(spark, sf), "source", "o_orderkey", _RATIOS, mode=-1)


@query("U_5_select_split", "SELECT o_orderkey AS image_id FROM orders WHERE o_orderstatus = 'F'")
def u_5(spark, sf):
    return DS.select_split(D.images(spark, sf), "training").select("image_id")
