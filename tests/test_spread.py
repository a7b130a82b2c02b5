"""Costly work is spread over tasks and done once, whatever the layout of the inputs."""

import json

from pyspark.sql import functions as F

from gridweft.operators import cells as C
from gridweft.plans import derived as D
from gridweft.plans.catalog import QUERIES
from gridweft.sources import documents as DC
from gridweft.sources import writers as WR
from gridweft.streaming.incremental import pending


def test_sentences_of_one_small_file_are_scored_by_many_tasks(spark, tmp_path):
    accounts = [(k if k < 30 else None, f"C{k}", k % 2, float(k), "BUILDING") for k in range(40)] + [(1, "C1", 1, 1.0, "BUILDING")] * 2
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(accounts, schema).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    pairs = D.sentences(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(pairs) == 42 and sum(p["pair_id"] == 1 for p in pairs) == 3
    assert len({p["task"] for p in pairs}) > 1


def test_records_are_computed_once_for_the_writer(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return float(x)

    rows = spark.range(100).select((F.col("id") % 3).cast("int").alias("table_id"), F.col("id").alias("variation"))
    scored = rows.withColumn("score", F.udf(seen, "double")("variation"))
    WR.write_metric_records(scored, f"{tmp_path}/out")
    read = spark.read.schema("variation bigint, score double, table_id int").json(f"{tmp_path}/out")
    assert sorted(r["score"] for r in read.collect()) == [float(i) for i in range(100)]
    assert calls.value == 100


def counted(spark, value="id"):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    return calls, F.udf(seen, "bigint")(value)


def test_records_and_elements_are_computed_once_for_their_documents(spark, tmp_path):
    calls, value = counted(spark)
    annotations = spark.range(50).select("id", value.alias("area"), F.when(F.col("id") < 40, "a").otherwise("b").alias("split"))
    images = spark.createDataFrame([(1, "a"), (2, "c")], "id bigint, split string")
    assert DC.write_coco_documents(images, annotations, f"{tmp_path}/coco") == 3
    assert calls.value == 50
    read = {s: json.load(open(f"{tmp_path}/coco/instances_{s}.json")) for s in "abc"}
    assert [a["id"] for a in read["a"]["annotations"]] == list(range(40)) and read["a"]["images"] == [{"id": 1}]
    assert [a["area"] for a in read["b"]["annotations"]] == list(range(40, 50)) and read["b"]["images"] == [] and read["c"]["annotations"] == []

    calls, value = counted(spark)
    xml = F.concat(F.lit("<e>"), value.cast("string"), F.lit("</e>"))
    assert DC.write_xml_documents(spark.range(30).select(F.lit("d").alias("name"), "id", xml.alias("xml")), f"{tmp_path}/xml", ["id"]) == 1
    assert calls.value == 30


def test_images_and_counts_of_documents_do_not_pass_the_driver(spark, tmp_path):
    orders = [(k, k, "F", 1.0, "5-LOW") for k in range(20)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k % 10, k, k, k // 10, 3.0, 0.1, "A", "O") for k in range(30)]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["S6_coco"](spark, str(tmp_path))
    assert sorted((r["image_id"], r["n"]) for r in found.collect()) == [(k, 3 if k < 10 else 0) for k in range(20)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_headers_are_parsed_once_for_both_sides(spark):
    calls, low = counted(spark, F.lit(0).cast("bigint") + F.col("id"))
    rows = spark.range(8).select(
        F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("file"), F.floor(F.col("id") / 2).cast("int").alias("level"), F.lit(0).alias("h_no"),
        F.lit("n").alias("name"), (low * 0).alias("lo"), F.lit(1).alias("hi"),
    )
    found = C.child_parent(rows.repartition(3))
    assert sorted((r["file"], r["level"], r["parent_no"]) for r in found.collect()) == [(f, k, 0 if k else None) for f in ("f0", "f1") for k in range(4)]
    assert calls.value == 8


def test_names_that_are_done_do_not_pass_the_driver(spark):
    inputs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "file string")
    left = pending(inputs, spark.createDataFrame([("b",), (None,)], "file string"))
    assert sorted(str(r["file"]) for r in left.collect()) == ["None", "a", "a"]
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()


def test_text_of_rows_is_made_behind_the_shuffle(spark, tmp_path):
    lines = [(1, k, k, n, 3.0, 0.0, "A", "F") for k, n in enumerate((60, 2, 1, 2, None))]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = D.single_tables(spark, str(tmp_path))
    docs = {r["file"]: r["html"] for r in tables.collect()}
    assert sorted(docs) == ["T_Table1_Variation000.htm", "T_Table1_Variation004.htm"]
    assert docs["T_Table1_Variation000.htm"].endswith(
        "<tbody><tr><td>3</td><td><b>A</b></td><td>-</td><td>L&amp;1</td></tr><tr><td>3</td><td><b>A</b></td><td>-</td><td>L&amp;2</td></tr></tbody></table></body></html>"
    )
    plan = tables._jdf.queryExecution().executedPlan().toString()
    assert "<tr><td" not in plan[plan.index("Exchange"):]
