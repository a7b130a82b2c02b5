"""Files, numbering, data sets, entities, classes, vocabulary and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from gridweft.functions import names as N
from gridweft.operators import annotations as A
from gridweft.operators import classification as CL
from gridweft.operators import datasets as DS
from gridweft.operators import entities as E
from gridweft.operators import recognition as R
from gridweft.operators import summaries as S
from gridweft.operators import vocabulary as V
from gridweft.operators.ordering import running_index
from gridweft.sources import readers as RD
from gridweft.sources import writers as WR
from gridweft.streaming.incremental import latest_scores, score_new_predictions


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(20000).select(F.concat(F.lit("'line "), F.col("id").cast("string"), F.lit("'")).alias("value")).repartitionByRange(3, "value").write.text(path)
    expected = [r["value"] for r in spark.read.text(path).withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()).orderBy("f", "i").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        got = [r["value"] for r in RD.read_numbered_lines(spark, path).orderBy("line_no").collect()]
        assert [r["gold"] for r in RD.read_gold(spark, path).orderBy("line_no").limit(2).collect()] == [e[1:-1] for e in expected[:2]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected


def test_line_numbers_do_not_depend_on_later_settings(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(5000).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value")).coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = RD.read_numbered_lines(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert all(r["value"] == f"line {r['line_no']}" for r in numbered.collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert numbered.filter("value = concat('line ', line_no)").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_id_map_keeps_the_last_line(spark, tmp_path):
    path = tmp_path / "map.txt"
    path.write_bytes(b"7\r\n8\r\n7\r\n")
    ids = RD.read_id_map(spark, str(path))
    assert {r["table_id"]: r["line_no"] for r in S.last_line_per_id(ids).collect()} == {7: 2, 8: 1}
    gold = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "line_no long, gold string")
    frame = spark.createDataFrame([(7, 0), (7, 1), (8, 0)], "table_id int, variation int")
    assert sorted((r["table_id"], r["gold"]) for r in S.attach_gold(frame, ids, gold).collect()) == [(7, "z"), (7, "z"), (8, "y")]


def test_linearized_files_under_both_names(spark, tmp_path):
    rows = spark.createDataFrame([(12, 0, "a | 1, 2 [SEP] "), (12, 1, "b | 3 [SEP] ")], "table_id int, variation int, input string")
    WR.write_linearized(rows, str(tmp_path / "folders"))
    (tmp_path / "12.src").write_text("'a | 1, 2 [SEP] '\n'b | 3 [SEP] '\n")
    for path in (tmp_path / "folders", tmp_path / "12.src"):
        got = sorted((r["table_id"], r["input"]) for r in RD.read_linearized(spark, str(path)).collect())
        assert got == [(12, "a | 1, 2 [SEP] "), (12, "b | 3 [SEP] ")]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_score_map_is_one_json_object(spark, tmp_path, n):
    path = tmp_path / "map"
    rows = [(f'f"{i}', i / 2) for i in range(n)]
    WR.write_score_map(spark.createDataFrame(rows, "file string, score double"), str(path))
    text = "\n".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert json.loads(text) == dict(rows)


def test_named_files_are_replaced_whole(spark, tmp_path):
    for content in ("one", "two"):
        df = spark.createDataFrame([("d/a.htm", content), ("b.htm", content)], "name string, content string")
        assert WR.write_named_files(df, str(tmp_path)) == 2
    assert (tmp_path / "d" / "a.htm").read_text() == "two"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.htm", "b.htm"]


@pytest.mark.parametrize("name, table, variation", [("X_Table00123_Variation004.htm", 123, 4), ("a/b_Table5_Variation020.htm", 5, 20), ("plain.htm", None, None)])
def test_table_ids(spark, name, table, variation):
    row = spark.createDataFrame([(name,)], "f string").select(N.table_id("f").alias("t"), N.variation("f").alias("v")).first()
    assert (row["t"], row["v"]) == (table, variation)


def test_label_lines(spark):
    df = spark.createDataFrame([("﻿695,885,866,888,867,1146,696,1143,###",), ("1,2,3,4,5,6,7,8,Latin,9",)], "l string")
    a, b = df.select(A.parse_quad_line("l").alias("a"), A.parse_quad_line("l", "quad2017").alias("b")).collect()
    assert a["a"]["coords"][0] == 695 and a["a"]["iscrowd"] == 1
    assert b["b"]["language"] == "Latin" and b["b"]["text"] == "9" and b["b"]["iscrowd"] == 0
    curve = ",".join(str(i) for i in range(28))
    df = spark.createDataFrame([(curve + ",####a,b",), (curve + ",x",)], "l string")
    c = [r["c"] for r in df.select(A.parse_curve_line("l").alias("c")).collect()]
    assert len(c[0]["coords"]) == 28 and c[0]["text"] == "a,b" and c[1] is None


def test_nesting_in_pieces(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    annos = spark.range(25).select(F.lit(1).cast("long").alias("image_id"), F.col("id").cast("int").alias("anno_no"), F.struct("id").alias("anno"))
    rows = A.nest_annotations(images, annos, piece=10).orderBy("image_id", "piece_no").collect()
    assert [(r["image_id"], r["piece_no"], len(r["annotations"])) for r in rows] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 0)]
    assert [a["id"] for r in rows for a in r["annotations"]] == list(range(25))


def test_running_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("hot"))
    got = running_index(df, ["hot", "k"], start=1).orderBy("index").collect()
    assert [(r["k"], r["index"]) for r in got] == [(i, i + 1) for i in range(1000)]


def test_mix_takes_exact_shares_of_a_large_source(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "big").when(F.col("id") < 2900, "mid").otherwise("small").alias("src"))
    out = DS.mix_by_ratio(df, "src", "id", {"mid": 0.5, "big": 0.4, "small": 0.1}, seed=3)
    assert {r["src"]: r["count"] for r in out.groupBy("src").count().collect()} == {"mid": 900, "big": 720, "small": 100}
    with pytest.raises(ValueError):
        DS.mix_by_ratio(df, "src", "id", {"big": 0.4})
    with pytest.raises(ValueError):
        DS.select_split(df.withColumn("split", F.lit("a")), "dev")


def test_entities(spark):
    rows = [(1, i, t) for i, t in enumerate(["B-name", "I-name", "I-book", "I-name", "B-name", "B-name", "O", "I-name"])]
    spans = E.bio_spans(spark.createDataFrame(rows, "doc int, pos int, tag string"))
    assert sorted((r["start"], r["stop"]) for r in spans.collect()) == [(0, 1), (4, 4), (5, 5)]
    row = E.entity_scores(spans.filter("start > 0"), spans).first()
    assert (row["n_hit"], row["precision"], row["recall"]) == (2, 1.0, pytest.approx(2 / 3))


def test_recognition_needs_all_labels(spark):
    pairs = spark.createDataFrame([("ab", "ab"), ("Ab!", "aB"), ("x", "yz")], "pred string, gt string")
    row = R.recognition_scores(pairs).first()
    assert (row["word_acc"], row["word_acc_ignore_case_symbol"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert R.recognition_scores(pairs.unionByName(spark.createDataFrame([("q", "")], "pred string, gt string"))).first()["word_acc"] is None


def test_macro_f1(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "gt int, pred int")
    assert CL.macro_f1(pairs, (2,)).first()["macro_f1"] == pytest.approx((2 / 3 + 1 / 2) / 2)


def test_vocabulary(spark):
    assert len(V.STRUCTURE_SYMBOLS) == 39
    df = spark.createDataFrame([(["a", "?", "b"],)], "t array<string>")
    assert df.select(V.encode("t", ("a", "b"), 7).alias("c")).first()["c"] == [3, 0, 2, 1, 4, 5, 5]
    assert df.select(V.encode("t", ("a", "b"), 4).alias("c")).first()["c"] == [3, 0, 2, 4]
    html = spark.createDataFrame([('<tr><td></td><td colspan="2">x</td></tr>',)], "h string")
    assert html.select(V.structure_tokens("h").alias("t")).first()["t"] == ["<tr>", "<td></td>", "<td", ' colspan="2"', ">", "</td>", "</tr>"]


def test_new_predictions_are_scored_once(spark, tmp_path):
    html = "<html><body><table><tr><td>1</td></tr></table></body></html>"
    truth = spark.createDataFrame([("a", html), ("b", html)], "file string, html string")
    pred, out, state = (str(tmp_path / d) for d in ("pred", "out", "state"))
    for file in ("a", "b"):
        spark.createDataFrame([(file, html)], "file string, html string").write.mode("append").parquet(pred)
        score_new_predictions(spark, truth, pred, out, state)
    score_new_predictions(spark, truth, pred, out, state)
    assert sorted((r["file"], r["score"]) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 1.0)]


@pytest.mark.parametrize("repeated", ["skip", "replace"])
def test_names_sent_twice_and_predictions_without_truth(spark, tmp_path, repeated):
    def html(cell):
        return f"<html><body><table><tr><td>{cell}</td></tr></table></body></html>"

    truths = [("a", html(1)), ("b", html(1)), ("late", html(1))]
    pred, out, state = (str(tmp_path / d) for d in ("pred", "out", "state"))
    batches = [
        [("a", html(1)), ("late", html(1)), ("stray", html(1)), ("null", None)],
        [("a", html(2)), ("b", html(3)), ("b", html(1)), ("b", html(1)), ("late", html(1))],  # b thrice in one batch
    ]
    for number, batch in enumerate(batches):
        truth = spark.createDataFrame(truths[: 2 + number], "file string, html string")
        spark.createDataFrame(batch, "file string, html string").coalesce(1).write.mode("append").parquet(pred)
        score_new_predictions(spark, truth, pred, out, state, repeated=repeated)
    rows = {r["file"]: r for r in latest_scores(spark, out).collect()}
    assert rows["a"]["score"] == (1.0 if repeated == "skip" else pytest.approx(1 - 1 / 2))
    assert (rows["b"]["score"], rows["late"]["score"], rows["late"]["flag"]) == (1.0, 1.0, "ok")
    assert [(rows[k]["score"], rows[k]["flag"]) for k in ("stray", "null")] == [(None, "no_truth")] * 2
    assert spark.read.parquet(out).filter("file = 'a'").count() == (1 if repeated == "skip" else 2)


def test_a_repeated_batch_replaces_its_first_attempt(spark, tmp_path):
    html = "<html><body><table><tr><td>1</td></tr></table></body></html>"
    truth = spark.createDataFrame([("a", html)], "file string, html string")
    pred, out, state = (str(tmp_path / d) for d in ("pred", "out", "state"))
    truth.write.parquet(pred)
    score_new_predictions(spark, truth, pred, out, state)
    # the commit of the batch is lost after its rows were written
    for commit in (tmp_path / "state" / "commits").iterdir():
        commit.unlink()
    score_new_predictions(spark, truth, pred, out, state)
    assert [(r["file"], r["batch"]) for r in spark.read.parquet(out).collect()] == [("a", 0)]


def test_unknown_rule_for_repeated_names(spark, tmp_path):
    with pytest.raises(ValueError):
        score_new_predictions(spark, None, "", "", "", repeated="sum")
