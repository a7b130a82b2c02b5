"""Documents that are read in blocks and written from pieces."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gridweft import schemas
from gridweft.operators import detection as DT
from gridweft.session import checkpoint_root, discard, materialize
from gridweft.sources import documents as DC
from gridweft.sources import readers as RD

TEXTS = ["", "a", 'say "x"', "back\\", '\\"', "\\\\", "{[", "]}", "é漢", '":', "],", "\n", '{"id": 1}', "\\" * 9 + '"']


def some_document(seed):
    r = random.Random(seed)
    objects = [
        {"id": i, "file_name": r.choice(TEXTS), r.choice(TEXTS): [r.choice(TEXTS), {"deep": [{"x": r.choice(TEXTS)}]}]} for i in range(r.randint(0, 5))
    ]
    return {
        "version": r.choice(TEXTS), r.choice(TEXTS) + "info": {"year": 1, "by": {"name": r.choice(TEXTS)}}, "images": objects[:3], "none": None,
        "annotations": objects[3:], 'odd "key\\': [1, "{}", [{"not": "an object two levels down"}], {"id": 9}],
    }


def by_hand(document):
    for key, value in document.items():
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            if isinstance(v, dict):
                yield key, v


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 10_000])
def test_contents_of_blocks_equal_the_parsed_document(tmp_path, block):
    """The steps of the reader, without Spark: any cut gives the records of the whole document."""
    from pyarrow import fs

    for seed in range(12):
        document = some_document(seed)
        for indent, ascii_only in ((None, True), (1, False)):
            target = tmp_path / f"{block}-{seed}-{indent}.json"
            target.write_text(json.dumps(document, indent=indent, ensure_ascii=ascii_only))
            quotes = depth = 0
            section, got = None, []
            with fs.LocalFileSystem().open_input_file(str(target)) as file:
                for start in range(0, file.size(), block):
                    end = min(start + block, file.size())
                    keys, found = DC._contents(file, start, end, quotes % 2, depth, True)
                    for at, record in found:
                        got.append(([k for p, k in keys if p < at] or [section])[-1:] + [json.loads(record)])
                    section = keys[-1][1] if keys else section
                    n, plain, quoted = DC._summary(file, start, end)
                    depth += quoted if quotes % 2 else plain
                    quotes += n
            assert depth == 0 and quotes % 2 == 0
            assert [tuple(g) for g in got] == list(by_hand(document))


def test_records_of_files(spark, tmp_path):
    want = []
    for seed in range(6):
        document = some_document(seed)
        (tmp_path / f"d {seed}+%.json").write_text(json.dumps(document))
        want += [(f"d {seed}+%.json", k, json.dumps(v, sort_keys=True)) for k, v in by_hand(document)]
    (tmp_path / "empty.json").write_text("")
    for block in (13, DC.BLOCK):
        rows = DC.read_json_records(spark, str(tmp_path), block=block).collect()
        rows.sort(key=lambda r: (r.file, r.offset))
        assert [(r.file.rsplit("/", 1)[1], r.section, json.dumps(json.loads(r.record), sort_keys=True)) for r in rows] == want


def test_no_documents(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    images, annotations = DC.read_coco_records(spark, str(tmp_path))
    assert images.collect() == [] and annotations.columns[:3] == ["file", "id", "image_id"]


def test_one_valid_document_per_split(spark, tmp_path):
    images = spark.range(3000).select(
        F.when(F.col("id") < 2990, "train").otherwise("a b+c").alias("split"), "id", F.concat(F.lit('n"\\'), F.col("id")).alias("file_name")
    )
    annos = spark.range(20_000).repartition(5).select(F.lit("train").alias("split"), "id", (F.col("id") % 2990).alias("image_id"))
    path = str(tmp_path / "out")
    assert DC.write_coco_documents(images, annos, path) == 2
    train = json.loads((tmp_path / "out" / "instances_train.json").read_text())
    assert [a["id"] for a in train["annotations"]] == list(range(20_000)) and [i["id"] for i in train["images"]] == list(range(2990))
    other = json.loads((tmp_path / "out" / "instances_a b+c.json").read_text())
    assert other["annotations"] == [] and other["images"][0] == {"id": 2990, "file_name": 'n"\\2990'}
    back, marks = DC.read_coco_records(spark, path, block=50_000)
    assert back.count() == 3000 and marks.agg(F.sum("image_id")).first()[0] == sum(i % 2990 for i in range(20_000))
    # a second run replaces whole files
    assert DC.write_coco_documents(images.filter("id = 0"), annos.filter("id < 0"), path) == 1
    assert json.loads((tmp_path / "out" / "instances_train.json").read_text()) == {"images": [{"id": 0, "file_name": 'n"\\0'}], "annotations": []}


def test_xml_elements_of_split_files(spark, tmp_path):
    box = '<box height="1" width="2" left="{}" top="4"><label>a&lt;é</label><segs>1,2</segs></box>'
    rows = spark.range(400).select(
        F.lit("all.xml").alias("name"), "id",
        F.concat(F.lit('<image\nfile="'), "id", F.lit('">'), F.repeat(F.lit(box.format(7)), (F.col("id") % 3).cast("int")), F.lit("</image>")).alias("xml"),
    )
    path = str(tmp_path / "xml")
    assert DC.write_xml_documents(rows, path, ["id"]) == 1
    want = sorted((r.image, r.box_no, tuple(r.bbox), r.label) for r in RD.read_polygon_xml(spark, path).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        elements = DC.read_xml_elements(spark, path, "image", schemas.POLYGON_XML)
        assert elements.rdd.getNumPartitions() > 5 and elements.count() == 400
        got = sorted((r.image, r.box_no, tuple(r.bbox), r.label) for r in RD.polygon_boxes(elements).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(got) == sum(i % 3 for i in range(400))
    assert isinstance(elements.schema["box"].dataType, ST.ArrayType)


def test_rounds_of_suppression_and_parts_are_deleted(spark, tmp_path):
    from pathlib import Path

    def folders():
        return {p.name for p in Path(checkpoint_root(spark)).iterdir()}

    before = folders()
    chain = [(1, i, 1.0 - i / 100, [6.0 * i, 0.0, 6.0 * i + 10, 10.0]) for i in range(30)]
    boxes = spark.createDataFrame(chain, "image int, det_no int, score double, box array<double>")
    kept = DT.suppress_overlaps(boxes, 0.2)
    assert sorted(r.det_no for r in kept.collect()) == list(range(0, 30, 2))
    DC.write_documents(spark.createDataFrame([("a.txt", 1, "x")], "name string, n int, value string"), str(tmp_path), ["n"])
    assert (tmp_path / "a.txt").read_text() == "x\n"
    left = {name.rsplit("-", 1)[0] for name in folders() - before}
    assert "nms-boxes" in left and not left & {"nms-waiting", "nms-tiles", "document-parts"}


def test_only_scratch_folders_are_deleted(spark, tmp_path):
    (tmp_path / "data").mkdir()
    with pytest.raises(ValueError):
        discard(spark, str(tmp_path / "data"))
    written = materialize(spark.range(3), "some")
    assert written.count() == 3
    discard(spark, written)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        written.count()
    assert (tmp_path / "data").exists()
