"""Nothing is lost or changed without a word: nulls, copies, line ends, repeated keys, many annotations."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridweft.functions import markup as M
from gridweft.operators import annotations as A
from gridweft.operators import datasets as DS
from gridweft.operators import detection as DT
from gridweft.operators import generation as G
from gridweft.operators import stemming as ST
from gridweft.operators import summaries as S
from gridweft.operators import text_scores as X
from gridweft.operators.overlap import overlap_pairs
from gridweft.sources import readers as RD
from gridweft.sources import writers as WR
from tests import test_tables as tables
from gridweft.operators.table_similarity import score_tables


@pytest.fixture(scope="module")
def two_sources(spark):
    return spark.createDataFrame([(s, k % 4) for s in ("a", "b") for k in range(4)], "source string, k int")


def test_mixing_keeps_equal_keys_apart(two_sources):
    rows = DS.mix_by_ratio(two_sources, "source", "k", {"a": 0.5, "b": 0.5}, mode=2)
    assert rows.count() == 8 and rows.filter("used").count() == 8
    rows = DS.mix_by_ratio(two_sources, "source", "k", {"a": 0.8, "b": 0.2}, mode=2)
    assert sorted((r.source, r.n) for r in rows.filter("used").groupBy("source").agg(F.count("*").alias("n")).collect()) == [("a", 4), ("b", 1)]
    assert rows.count() == 8


def test_mixing_with_repeated_keys_takes_the_quota(spark):
    rows = spark.createDataFrame([("a", 1)] * 6 + [("b", 1)] * 9, "source string, k int")
    got = DS.mix_by_ratio(rows, "source", "k", {"a": 0.6, "b": 0.4}).groupBy("source").count().collect()
    assert sorted(tuple(r) for r in got) == [("a", 6), ("b", 4)]


def test_mixing_without_leader_or_ratio(two_sources):
    ratios = {"gone": 0.5, "a": 0.25, "b": 0.25}
    for mode in (0, 1):
        assert DS.mix_by_ratio(two_sources, "source", "k", ratios, mode=mode).count() == 8
    only = {"a": 1.0}
    assert DS.mix_by_ratio(two_sources, "source", "k", only, mode=-1).count() == 8
    assert DS.mix_by_ratio(two_sources, "source", "k", only, mode=0).count() == 4
    marked = DS.mix_by_ratio(two_sources, "source", "k", only, mode=2)
    assert sorted((r.source, r.used) for r in marked.distinct().select("source", "used").distinct().collect()) == [("a", True), ("b", False)]


def test_lines_keep_order_line_ends_and_nulls(spark, tmp_path):
    texts = ["one", "two\nlines", None, "it's", "back\\slash\\n", "\r", "", "'quoted'"]
    rows = [(t, n, f"{x} {t}" if x is not None and n == 0 else x) for t in (3, 10) for n, x in enumerate(texts * 5)]
    frame = spark.createDataFrame(rows, "table_id int, variation int, input string").repartition(7)
    WR.write_linearized(frame, str(tmp_path / "src"))
    got = sorted(tuple(r) for r in RD.read_linearized(spark, str(tmp_path / "src")).collect())
    assert got == sorted(rows, key=lambda r: r[:2])


def test_parts_follow_one_another_by_number(spark, tmp_path):
    for n in (0, 99_999, 100_000, 100_001):
        (tmp_path / f"part-{n:05d}-x.txt").write_text(f"'{n}'\n")
    got = {r.line_no: r.gold for r in RD.read_gold(spark, str(tmp_path)).collect()}
    assert got == {0: "0", 1: "99999", 2: "100000", 3: "100001"}


def test_null_texts_score_nothing_and_stop_nothing(spark):
    pairs = spark.createDataFrame([("a b", None), (None, "a b"), (None, None), ("a b\nc", "a b\nc")], "prediction string, reference string")
    for stem in (True, False):
        scored = X.rouge(pairs, use_stemmer=stem).collect()
        assert [[r[f] for f in X.ROUGE_FIELDS] for r in scored] == [[0.0] * 4] * 3 + [[1.0] * 4]
    inputs = spark.createDataFrame([(1, "x | y"), (2, None)], "k int, input string")
    made = {r.k: r.prediction for r in G.generate(inputs, G.template_model).collect()}
    assert made[2] is None and made[1].startswith("The table")
    words = spark.createDataFrame([(None,), ("running",)], "word string")
    assert {r.word: r.stem for r in ST.stem_vocabulary(words).collect()} == {None: None, "running": "run"}


def boxes(spark, rows, extra):
    return spark.createDataFrame(rows, f"image int, {extra}, box array<double>")


def test_copies_of_a_true_box_all_get_their_best(spark):
    b, c = [0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 10.0, 9.0]
    det = boxes(spark, [(1, 1, 0.9, c), (1, 2, 0.5, b)], "det_no int, score double")
    gt = boxes(spark, [(1, 1, 0, b), (1, 2, 0, b), (1, 3, 0, [50.0, 50.0, 60.0, 60.0])], "gt_no int, iscrowd int")
    assert sorted((r.gt_no, r.det_no) for r in DT.best_per_truth(det, gt).collect()) == [(1, 2), (2, 2)]


def test_sweep_equals_scores_of_the_cut_detections(spark):
    b, c, d = [0.0, 0.0, 10.0, 10.0], [20.0, 0.0, 30.0, 10.0], [40.0, 0.0, 50.0, 10.0]
    rows = [(1, 1, 0.9, b), (1, 2, 0.3, b), (1, 3, 0.8, c), (1, 4, 0.2, c), (1, 5, 0.6, d), (2, 6, 0.7, b)]
    det = boxes(spark, rows, "det_no int, score double")
    gt = boxes(spark, [(1, 1, 0, b), (1, 2, 1, c), (1, 3, 1, d), (2, 4, 0, c)], "gt_no int, iscrowd int")
    swept = {r.threshold: (r.n_match, r.n_det, r.n_gt, r.hmean) for r in DT.threshold_sweep(det, gt, [0.0, 0.25, 0.65]).collect()}
    for t, got in swept.items():
        r = DT.detection_scores(DT.above_score(det, t), gt).first()
        assert got == (r.n_match, r.n_det, r.n_gt, r.hmean), t


def test_predictions_without_gold_stay(spark):
    frame = spark.createDataFrame([(1, "p"), (2, "q")], "table_id int, prediction string")
    ids = spark.createDataFrame([(0, 1)], "line_no int, table_id int")
    gold = spark.createDataFrame([(0, "g")], "line_no int, gold string")
    got = sorted((r.table_id, r.gold or "", r.has_gold) for r in S.attach_gold(frame, ids, gold).collect())
    assert got == [(1, "g", True), (2, "", False)]


def test_annotation_ids_do_not_meet(spark):
    images = spark.createDataFrame([(i, f"{i}.png", 5, 5, "") for i in (1, 2)], "image_id int, file_name string, height int, width int, segm_file string")
    annos = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("anno_no")).withColumn(
        "anno", A.annotation(F.array(*map(F.lit, (0, 0, 1, 0, 1, 1))))
    )
    nested = A.nest_annotations(images, annos, piece=3)
    assert sorted((r.image_id, r.first_no) for r in nested.collect()) == [(i, n) for i in (1, 2) for n in (0, 3, 6)]
    _, flat = A.coco_frames(A.coco_documents(nested, F.lit(0), F.lit("train")))
    assert sorted(r.id for r in flat.collect()) == [(i << 32) + n for i in (1, 2) for n in range(7)]


def test_long_numbers_in_markup(spark):
    html = '<tr><td colspan="0000000000002">a</td><td colspan="12345678901234">&#00000000000065;&#x0000000041;</td></tr>'
    cells = spark.createDataFrame([(html,)], "h string").select(M.table_sections("h").alias("s")).first().s[0].rows[0]
    assert [c.colspan for c in cells] == [2, 2**31 - 1]
    frame = spark.createDataFrame([(cells[1].norm,)], "n string")
    assert frame.select(M.cell_text("n")).first()[0] == "AA"


def test_touching_boxes_with_one_around_all(spark):
    left = spark.range(60).select(F.lit(1).alias("image"), F.col("id").alias("a"), F.expr("array(id * 10d, 0d, id * 10d + 8d, 8d)").alias("box"))
    left = left.union(spark.createDataFrame([(1, 1000, [0.0, 0.0, 600.0, 8.0])], left.schema))
    right = left.select("image", F.col("a").alias("b"), "box")
    want = {(i, i) for i in (*range(60), 1000)} | {(i, 1000) for i in range(60)} | {(1000, i) for i in range(60)}
    got = [(r.a, r.b) for r in overlap_pairs(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tree_distance_moves_section_borders(spark):
    head, body = "<tr><td>a</td><td>b</td></tr>", "<tr><td>c</td><td>d</td></tr>" * 6
    doc = "<html><body><table>{}</table></body></html>".format
    true = doc(f"<thead>{head}</thead><tbody>{body}</tbody>")
    preds = [doc(f"<tbody>{head}{body}</tbody>"), doc(head + body), true, ""]
    frame = spark.createDataFrame([(n, true, p) for n, p in enumerate(preds)], "n int, true_html string, pred_html string")
    rows = score_tables(frame, unrestricted=True).orderBy("n").collect()
    assert [r.score for r in rows[:2]] == [pytest.approx(20 / 23), pytest.approx(21 / 23)]
    assert (rows[2].score, rows[3].score) == (1.0, 0.0)


def test_tree_distance_equals_brute_force(spark):
    rng = random.Random(11)
    pairs = [(tables.random_table(rng), tables.random_table(rng)) for _ in range(60)]
    frame = spark.createDataFrame(
        [(i, tables.as_html(a), tables.as_html(b)) for i, (a, b) in enumerate(pairs)], "i int, true_html string, pred_html string"
    )
    got = {r.i: r.distance for r in score_tables(frame, unrestricted=True).collect()}
    assert got == {i: pytest.approx(tables.tree_distance(tables.as_forest(a), tables.as_forest(b))) for i, (a, b) in enumerate(pairs)}


def test_each_batch_has_the_shares(spark):
    rows = [("a", n) for n in range(600)] + [("b", n) for n in range(300)] + [("c", n) for n in range(150)] + [("c", 149), (None, 7)]
    frame = spark.createDataFrame(rows, "source string, k long")
    ratios = {"a": 0.5, "b": 0.35, "c": 0.15}
    got = DS.batches_by_ratio(frame, "source", "k", ratios, 20, seed=3).collect()
    assert sorted((r.source, r.k) for r in got) == sorted((r.source, r.k) for r in DS.mix_by_ratio(frame, "source", "k", ratios, 3).collect())
    counts = Counter((r.batch, r.source) for r in got)
    # 1,200 rows by the first source; b and c are too small and are used up
    assert max(r.batch for r in got) == 59
    assert all(counts[b, "a"] == 10 for b in range(60)) and all(counts[b, "b"] == 7 for b in range(42)) and counts[44, "b"] == 0
    assert all(counts[b, "c"] == 3 for b in range(50)) and sum(counts[b, "c"] for b in range(60)) == 151
    for wrong in ({"mode": 2}, {"mode": -1}):
        with pytest.raises(ValueError):
            DS.batches_by_ratio(frame, "source", "k", ratios, 20, **wrong)
    assert DS.batches_by_ratio(frame.limit(0), "source", "k", ratios, 20).collect() == []


def test_documents_are_parsed_once(spark):
    from gridweft.operators import cells as C

    docs = spark.createDataFrame([("a", "<html><body><table><tr><td>x</td></tr></table></body></html>"), ("b", "")], "file string, html string")
    parsed = C.parse_tables(docs)
    cells = C.explode_cells(parsed)
    filters = [line for line in cells._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any("</(?:" in line for line in filters)
    assert [(r.file, r.norm) for r in cells.collect()] == [("a", "x")]


def test_equal_ends_of_two_tables_are_not_parsed(spark):
    from pyspark.sql import functions as F

    from gridweft.functions import markup as M

    row = "<tr><td>{}</td></tr>".format
    head = "<thead><tr><th>h</th></tr></thead>"
    cases = [
        (head + "<tbody>" + row(1) + row(2) + row(3) + "</tbody>", head + "<tbody>" + row(1) + row(9) + row(3) + "</tbody>", [["2"]], [["9"]]),
        (row(1) + row(1) + row(1), row(1) + row(1), [["1"]], []),
        (head + row(1), row(1), [["h"]], None),
        ("<caption>c</caption>" + row(1), row(1), [], None),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "a string, b string").coalesce(1)
    found = [r[0] for r in df.select(M.differing_sections(F.col("a"), F.col("b"))).collect()]

    def texts(sections):
        return [[c["norm"] for c in r] for r in sections[0]["rows"]] if sections else None

    assert [(texts(f["t"]), texts(f["p"])) for f in found] == [(c[2], c[3]) for c in cases]
    assert found[3]["t"][0]["kids"] == ["caption"] or found[3]["t"][0]["section"] == "caption"


def test_boxes_are_entered_once_on_the_left(spark):
    from gridweft.operators.overlap import overlap_pairs

    left = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0], 1)], "image int, box array<double>, a int")
    right = spark.createDataFrame([(1, [1.0, 0.0, 11.0, 10.0], 2), (1, [40.0, 0.0, 50.0, 10.0], 3)], "image int, box array<double>, b int")
    pairs = overlap_pairs(left, right, min_iou=0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 4  # classes and columns of either axis, right side only
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
