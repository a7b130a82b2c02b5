"""Queries over detections, recognised text, classes and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.operators import classification as CL
from gridweft.operators import detection as DT
from gridweft.operators import entities as E
from gridweft.operators import layout_merge as LM
from gridweft.operators import recognition as R
from gridweft.plans import derived as D
from gridweft.plans.registry import BOXES, LINES, PAIRS, iou_sql, query

_MUTUAL = """by_det AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} image, det_no ORDER BY iou DESC, gt_no) AS rn FROM {p}) WHERE rn = 1),
by_gt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} image, gt_no ORDER BY iou DESC, score DESC, det_no) AS rn FROM {p}) WHERE rn = 1),
matched AS (SELECT d.* FROM by_det d JOIN by_gt g ON d.image = g.image AND d.det_no = g.det_no AND d.gt_no = g.gt_no {on})"""
_RATES = """n_match / greatest(n_gt, 1)::DOUBLE AS recall, n_match / greatest(n_det, 1)::DOUBLE AS precision,
       2.0::DOUBLE * n_match / greatest(n_det + n_gt, 1) AS hmean"""


def boxes(spark, sf):
    return D.detected_boxes(spark, sf), D.true_boxes(spark, sf)


@query("F2_above_score", f"""WITH {LINES}, {BOXES} SELECT image, det_no, score FROM det WHERE score > 0.3""")
def f2(spark, sf):
    return DT.above_score(D.detected_boxes(spark, sf), 0.3).select("image", "det_no", "score")


@query("J10_match_boxes", f"""WITH {LINES}, {BOXES}, {PAIRS}, {_MUTUAL.format(k='', p='pairs', on='')}
SELECT image, det_no, gt_no, round(iou, 6) AS iou FROM matched""")
def j10(spark, sf):
    det, gt = boxes(spark, sf)
    matches = DT.match_boxes(det, gt)
    return matches.select("image", "det_no", "gt_no", F.round("iou", 6).alias("iou"))


@query("O2_best_per_truth", f"""WITH {LINES}, {BOXES}, {PAIRS}
SELECT image, gt_no, det_no, round(iou, 6) AS iou FROM (
  SELECT *, row_number() OVER (PARTITION BY image, gt_no ORDER BY iou DESC, score DESC, det_no) AS rn
  FROM pairs) WHERE rn = 1""")
def o2(spark, sf):
    det, gt = boxes(spark, sf)
    return DT.best_per_truth(det, gt).select("image", "gt_no", "det_no", F.round("iou", 6).alias("iou"))


@query("A14_detection_scores", f"""WITH {LINES}, {BOXES}, {PAIRS},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, det_no ORDER BY iou DESC, iscrowd, gt_no) AS rn FROM pairs) WHERE rn = 1),
ignored AS (SELECT image, det_no FROM best WHERE iscrowd = 1),
valid AS (SELECT * FROM pairs ANTI JOIN ignored USING (image, det_no) WHERE iscrowd = 0),
{_MUTUAL.format(k='', p='valid', on='')},
n AS (SELECT (SELECT count(*) FROM matched) AS n_match, (SELECT count(*) FROM det) - (SELECT count(*) FROM ignored) AS n_det,
             (SELECT count(*) FROM gt WHERE iscrowd = 0) AS n_gt)
SELECT n_match, n_det, n_gt, {_RATES} FROM n""")
def a14(spark, sf):
    return DT.detection_scores(*boxes(spark, sf))


_THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_SWEEP = f"""WITH {LINES}, {BOXES}, {PAIRS},
thr AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE)' for t in _THRESHOLDS)}) AS t(threshold)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, det_no ORDER BY iou DESC, iscrowd, gt_no) AS rn FROM pairs) WHERE rn = 1),
ignored AS (SELECT image, det_no, score FROM best WHERE iscrowd = 1),
kept AS (SELECT * FROM pairs ANTI JOIN ignored USING (image, det_no) JOIN thr ON score > threshold WHERE iscrowd = 0),
{_MUTUAL.format(k='threshold,', p='kept', on='AND d.threshold = g.threshold')},
n AS (SELECT threshold, (SELECT count(*) FROM matched m WHERE m.threshold = thr.threshold) AS n_match,
             (SELECT count(*) FROM det WHERE score > thr.threshold) - (SELECT count(*) FROM ignored i WHERE i.score > thr.threshold) AS n_det,
             (SELECT count(*) FROM gt WHERE iscrowd = 0) AS n_gt FROM thr),
sweep AS (SELECT threshold, n_match, n_det, n_gt, {_RATES} FROM n)"""


@query("A17_threshold_sweep", f"{_SWEEP} SELECT * FROM sweep")
def a17(spark, sf):
    return DT.threshold_sweep(*boxes(spark, sf), _THRESHOLDS)


@query("A17_best_threshold", f"{_SWEEP} SELECT threshold, hmean FROM sweep ORDER BY hmean DESC, threshold LIMIT 1")
def a17_best(spark, sf):
    return DT.best_threshold(DT.threshold_sweep(*boxes(spark, sf), _THRESHOLDS))


@query("O3_top_per_image", f"""WITH {LINES}, {BOXES}
SELECT image, det_no, CAST(rank AS INTEGER) AS rank FROM (
  SELECT image, det_no, row_number() OVER (PARTITION BY image ORDER BY score DESC, det_no) AS rank FROM det) WHERE rank <= 100""")
def o3(spark, sf):
    return DT.top_per_image(D.detected_boxes(spark, sf), 100).select("image", "det_no", "rank")


@query("O5_suppress_overlaps", f"""WITH {LINES}, {BOXES},
ranked AS (
  SELECT image, list([{{'det_no': det_no, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, det_no) AS boxes
  FROM det GROUP BY image),
kept AS (
  SELECT image, unnest(list_reduce(boxes, lambda kept, b:
    CASE WHEN len(list_filter(kept, lambda k: {iou_sql("k", "(b[1])")} > 0.5)) > 0 THEN kept ELSE list_concat(kept, b) END)) AS k
  FROM ranked)
SELECT image, k.det_no AS det_no, k.score AS score FROM kept""")
def o5(spark, sf):
    return DT.suppress_overlaps(D.detected_boxes(spark, sf), 0.5)


# ---------------------------------------------------------------- text lines into cells


def cell_layout(spark, sf):
    """Per order an image with one column of cells, and text lines that slip out of them."""
    li = D.lines(spark, sf)
    top = F.col("l_linenumber") * 20
    cells = li.select(
        F.col("l_orderkey").alias("image"),
        F.col("l_linenumber").alias("cell_no"),
        F.array(F.lit(0), top, F.lit(100), top + 20).cast("array<double>").alias("box"),
    )
    left, y = F.col("l_partkey") % 120, top + F.col("qty") % 25
    texts = li.select(
        F.col("l_orderkey").alias("image"),
        F.col("l_linenumber").alias("line_no"),
        F.array(left, y, left + 30, y + 10).cast("array<double>").alias("box"),
        F.concat("l_returnflag", F.col("qty").cast("string")).alias("text"),
    )
    return texts, cells


_LAYOUT = f"""cell AS (SELECT l_orderkey AS image, l_linenumber AS cell_no, 0 AS x1, l_linenumber * 20 AS y1, 100 AS x2, l_linenumber * 20 + 20 AS y2 FROM lines),
txt AS (SELECT l_orderkey AS image, l_linenumber AS line_no, flag || qty AS text, l_partkey % 120 AS x1, l_linenumber * 20 + qty % 25 AS y1,
               l_partkey % 120 + 30 AS x2, l_linenumber * 20 + qty % 25 + 10 AS y2 FROM lines),
met AS (SELECT txt.image, line_no, cell_no, text, txt.x1 AS tx, txt.y1 AS ty, {iou_sql('txt', 'cell')} AS iou,
          (txt.x1 + txt.x2) / 2.0 >= cell.x1 AND (txt.x1 + txt.x2) / 2.0 < cell.x2
          AND (txt.y1 + txt.y2) / 2.0 >= cell.y1 AND (txt.y1 + txt.y2) / 2.0 < cell.y2 AS inside
        FROM txt JOIN cell ON txt.image = cell.image),
put AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, line_no ORDER BY inside DESC, iou DESC, cell_no) AS rn
        FROM met WHERE iou > 0) WHERE rn = 1)"""


@query("J9_lines_to_cells", f"""WITH {LINES}, {_LAYOUT}
SELECT image, line_no, cell_no, CASE WHEN inside THEN 'centre' ELSE 'overlap' END AS how FROM put""")
def j9(spark, sf):
    return LM.assign_lines(*cell_layout(spark, sf))


@query("J9_fill_cells", f"""WITH {LINES}, {_LAYOUT}
SELECT c.image, c.cell_no, coalesce(string_agg(text, ' ' ORDER BY ty, tx, line_no), '') AS text
FROM cell c LEFT JOIN put p ON c.image = p.image AND c.cell_no = p.cell_no GROUP BY c.image, c.cell_no""")
def j9_fill(spark, sf):
    return LM.fill_cells(*cell_layout(spark, sf)).select("image", "cell_no", "text")


# ---------------------------------------------------------------- recognised text

_PRED = "CASE WHEN p_size > 40 THEN replace(p_name, 'e', 'c') ELSE p_name END"
_LABELS = f"""pairs AS (SELECT 'word_' || p_partkey || '.png' AS image, p_name AS gt,
  CASE WHEN p_type = 'SMALL' THEN upper({_PRED}) ELSE {_PRED} END AS pred FROM part)"""


def label_pairs(spark, sf):
    rows = D.ocr_labels(spark, sf)
    return R.pair_labels(rows.select("image", "pred"), rows.select("image", "gt"))


@query("J8_pair_labels", f"WITH {_LABELS} SELECT image, pred, gt FROM pairs")
def j8(spark, sf):
    return label_pairs(spark, sf)


_NED = "1 - levenshtein(pred, gt) / greatest(length(pred), length(gt))::DOUBLE"


@query("A12_word_accuracy", f"""WITH {_LABELS}
SELECT count(*) AS n, round(avg((pred = gt)::INTEGER), 6) AS word_acc, round(avg((lower(pred) = lower(gt))::INTEGER), 6) AS word_acc_ignore_case,
       round(avg((lower(pred) = lower(gt))::INTEGER), 6) AS word_acc_ignore_case_symbol FROM pairs""")
def a12(spark, sf):
    scores = R.recognition_scores(label_pairs(spark, sf))
    names = ("word_acc", "word_acc_ignore_case", "word_acc_ignore_case_symbol")
    return scores.select("n", *[F.round(c, 6).alias(c) for c in names])


@query("A13_accuracy_and_ned", f"""WITH {_LABELS}
SELECT count(*) AS n, round(avg((pred = gt)::INTEGER), 6) AS word_acc, round(avg({_NED}), 6) AS ned FROM pairs""")
def a13(spark, sf):
    scores = R.recognition_scores(label_pairs(spark, sf))
    return scores.select("n", F.round("word_acc", 6).alias("word_acc"), F.round("ned", 6).alias("ned"))


@query("U_4_correct_and_wrong", f"""WITH {_LABELS}
SELECT 'correct' AS part, count(*) AS n FROM pairs WHERE pred = gt UNION ALL SELECT 'wrong', count(*) FROM pairs WHERE pred <> gt
UNION ALL SELECT 'rest', count(*) FROM pairs WHERE pred <> gt""")
def u_4(spark, sf):
    pairs = label_pairs(spark, sf)
    right, wrong = R.split_by_correctness(pairs)
    rest = pairs.exceptAll(right.select(*pairs.columns))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
              for name, df in (("correct", right), ("wrong", wrong), ("rest", rest))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ---------------------------------------------------------------- classes

_CLASSES = """c AS (SELECT event_type AS gt, CASE WHEN value < 3 THEN 'view' WHEN user_id < 10 THEN 'click' ELSE event_type END AS pred FROM events),
f AS (SELECT class, count(*) FILTER (WHERE gt = class AND pred = class) AS tp, count(*) FILTER (WHERE gt = class) AS n_gt,
             count(*) FILTER (WHERE pred = class) AS n_pred
      FROM c, (SELECT gt AS class FROM c UNION SELECT pred FROM c) GROUP BY class)"""


@query("A15_class_f1", f"""WITH {_CLASSES}
SELECT class, tp, n_gt, n_pred, round(2.0::DOUBLE * tp / (n_gt + n_pred), 6) AS f1 FROM f""")
def a15_class(spark, sf):
    return CL.class_f1(D.event_classes(spark, sf)).withColumn("f1", F.round("f1", 6))


@query("A15_macro_f1", f"""WITH {_CLASSES}
SELECT count(*) AS n_classes, round(avg(2.0::DOUBLE * tp / (n_gt + n_pred)), 6) AS macro_f1 FROM f WHERE class <> 'error'""")
def a15(spark, sf):
    return CL.macro_f1(D.event_classes(spark, sf), ("error",)).withColumn("macro_f1", F.round("macro_f1", 6))


@query("A20_best_run", """
SELECT run, acc FROM (SELECT o_orderpriority AS run, round(avg(o_totalprice), 6) AS acc FROM orders GROUP BY 1) ORDER BY acc DESC, run LIMIT 1""")
def a20(spark, sf):
    runs = D.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.round(F.avg("o_totalprice"), 6).alias("acc"))
    return CL.best_run(runs, "run", "acc")


@query("A21_alphabet", """
SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || p_brand, '')) AS symbol FROM part) GROUP BY symbol""")
def a21(spark, sf):
    texts = D.table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("t"))
    return CL.alphabet(texts, "t")


@query("A21_class_count", "SELECT count(DISTINCT event_type) AS n_classes FROM events")
def a21_classes(spark, sf):
    return D.table(spark, sf, "events").agg(F.countDistinct("event_type").alias("n_classes"))


# ---------------------------------------------------------------- entities

# spans follow from the sentence pattern of each part
_SPANS = """gt AS (
  SELECT p_partkey AS doc, 'name' AS category, 1 AS start, 2 AS stop FROM part
  UNION ALL SELECT p_partkey, 'company', 4, 4 FROM part UNION ALL SELECT p_partkey, 'position', 7, 7 FROM part),
pred AS (
  SELECT p_partkey AS doc, 'name' AS category, 1 AS start, CASE WHEN p_size > 40 THEN 1 WHEN p_size < 5 THEN 3 ELSE 2 END AS stop FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'position' ELSE 'company' END, 4, 4 FROM part
  UNION ALL SELECT p_partkey, 'position', 7, 7 FROM part)"""


@query("W6_bio_spans", f"WITH {_SPANS} SELECT doc, category, start, stop FROM pred")
def w6(spark, sf):
    return E.bio_spans(D.bio_tags(spark, sf)[1])


@query("A16_entity_scores", f"""WITH {_SPANS},
n AS (SELECT (SELECT count(*) FROM gt JOIN pred USING (doc, category, start, stop)) AS n_hit,
             (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM gt) AS n_gt)
SELECT n_hit, n_pred, n_gt, n_hit / n_pred::DOUBLE AS precision, n_hit / n_gt::DOUBLE AS recall,
       2.0::DOUBLE * n_hit / (n_pred + n_gt) AS f1 FROM n""")
def a16(spark, sf):
    true, pred = D.bio_tags(spark, sf)
    return E.entity_scores(E.bio_spans(pred), E.bio_spans(true))
