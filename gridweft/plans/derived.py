"""Input frames derived from the star-schema tables.

Everything here is deterministic and grows with the tables.  ``(l_orderkey, l_linenumber)`` repeats in
``lineitem``; ``lines`` reduces it to one row each.  Tables are cut into pages of fifty line
numbers, so no document grows with the number of rows of one order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.functions import markup as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    return (
        li.groupBy("l_orderkey", "l_linenumber")
        .agg(*[F.min(c).alias(c) for c in cols])
        .withColumn("qty", F.col("l_quantity").cast("int"))
        .withColumn("cents", F.round(F.col("l_discount") * 100).cast("int"))
        .drop("l_quantity", "l_discount")
    )


def _file(order: str, variation: str) -> Column:
    return F.format_string(f"T_Table%d_Variation%03d.htm", F.col(order), F.col(variation).cast("int"))


def _row(line: Column | None = None, flag: Column | None = None, qty_span: Column | None = None) -> Column:
    """A row of the table of an order; ``line`` is a struct of the columns, else they are columns of the frame."""
    c = F.col if line is None else lambda name: line[name]
    status = F.when(c("cents") == 0, "-").when(c("l_linestatus") == "O", "it's open").otherwise("done")
    return F.concat(
        F.lit("<tr><td"), F.lit("") if qty_span is None else qty_span, F.lit(">"), c("qty").cast("string"),
        F.lit("</td><td><b>"), c("l_returnflag") if flag is None else flag,
        F.lit("</b></td><td>"), status,
        F.lit("</td><td>L&amp;"), c("l_linenumber").cast("string"), F.lit("</td></tr>"),
    )


def _document(order: str, rows: Column) -> Column:
    head = F.concat(
        F.lit('<thead><tr><th colspan="4">Order '), F.col(order).cast("string"), F.lit("</th></tr>"),
        F.lit('<tr><th colspan="2">Amount</th><th colspan="2">State</th></tr>'),
        F.lit("<tr><th>qty</th><th>flag</th><th></th><th>line</th></tr></thead>"),
    )
    return M.wrap_document(F.concat(head, F.lit("<tbody>"), rows, F.lit("</tbody>")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_id, page, r``: the lines of each page in order.  Lines are sent as numbers, their text is made where the page is."""
    line = F.struct("l_linenumber", "qty", "cents", "l_returnflag", "l_linestatus")
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("order_id"), F.floor(F.col("l_linenumber") / 50).cast("int").alias("page"), line.alias("line"))
    # a fixed number of partitions: the documents are small but costly to parse later on
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "order_id", "page").groupBy("order_id", "page").agg(F.sort_array(F.collect_list("line")).alias("r"))


def _text(lines: Column, row: Callable[[Column], Column] = _row) -> Column:
    return F.array_join(F.transform(lines, lambda x: row(x)), "")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents per table: the true one and three damaged copies.

    Columns ``file, table_id, variation, true_html, pred_html``.  Variation 0 is correct; 1 has the
    flag replaced in rows with status ``O``; 2 misses the last row; 3 has a wrong span in the first
    cell of each row with flag ``R``.
    """
    r, v = F.col("r"), F.col("v")
    out = _pages(spark, sf_dir).withColumn("true_html", _document("order_id", _text(r)))
    out = out.withColumn("v", F.explode(F.array(*[F.lit(n) for n in range(4)])))

    def replaced(x: Column) -> Column:
        return _row(x, flag=F.when(x["l_linestatus"] == "O", F.lit("X")).otherwise(x["l_returnflag"]))

    def spanned(x: Column) -> Column:
        return _row(x, qty_span=F.when(x["l_returnflag"] == "R", F.lit(' colspan="2"')).otherwise(""))

    # each row builds its own document only
    pred = (
        F.when(v == 0, F.col("true_html"))
        .when(v == 1, _document("order_id", _text(r, replaced)))
        .when(v == 2, _document("order_id", _text(F.slice(r, 1, F.size(r) - 1))))
        .otherwise(_document("order_id", _text(r, spanned)))
    )
    out = out.withColumn("pred_html", pred)
    out = out.withColumn("variation", (F.col("page") * 4 + F.col("v")).cast("int"))
    return out.select(
        _file("order_id", "variation").alias("file"),
        F.col("order_id").cast("int").alias("table_id"),
        "variation",
        "true_html",
        "pred_html",
    )


def html_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables(spark, sf_dir).select("file", F.col("true_html").alias("html"))


def html_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions; pending orders of the lowest priority have none."""
    missing = (
        table(spark, sf_dir, "orders")
        .filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"))
        .select(F.col("o_orderkey").cast("int").alias("table_id"))
    )
    docs = html_tables(spark, sf_dir).select("file", "table_id", F.col("pred_html").alias("html"))
    return docs.join(missing, "table_id", "left_anti").select("file", "html")


def single_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the true document of each table."""
    docs = _pages(spark, sf_dir).filter("page IS NOT NULL").withColumn("variation", (F.col("page") * 4).cast("int"))
    return docs.select(_file("order_id", "variation").alias("file"), _document("order_id", _text(F.col("r"))).alias("html"))


def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True documents whose body begins with a row that holds a table in its first cell; predictions differ in one character of it."""

    def with_inner(value: str) -> Column:
        inner = f"<table><tr><td>p</td><td>{value}</td></tr></table>"
        return F.replace("true_html", F.lit("<tbody>"), F.lit(f"<tbody><tr><td>{inner}</td><td>-</td></tr>"))

    docs = html_tables(spark, sf_dir)
    return docs.select("file", with_inner("x").alias("true_html"), with_inner("y").alias("pred_html"))


def spanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True documents in which every other quantity spans two rows, and the flag of done lines spans the status too."""
    rows = lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("order_id"), F.floor(F.col("l_linenumber") / 50).cast("int").alias("page"),
        F.struct(F.col("l_linenumber").alias("n"), _row().alias("row")).alias("r"),
    )
    docs = rows.groupBy("order_id", "page").agg(F.sort_array(F.collect_list("r")).alias("r"))

    def spanned(r: Column, i: Column) -> Column:
        wide = F.regexp_replace(r["row"], "<td>(<b>.</b>)</td><td>done</td>", '<td colspan="2">$1</td>')
        below = F.regexp_replace(wide, "^<tr><td>[0-9]+</td>", "<tr>")
        above = F.regexp_replace(wide, "^<tr><td>", '<tr><td rowspan="2">')
        return F.when(i % 2 == 1, below).when(i < F.size("r") - 1, above).otherwise(wide)

    html = _document("order_id", F.array_join(F.transform("r", spanned), ""))
    docs = docs.withColumn("variation", F.col("page") * 4)
    return docs.select(_file("order_id", "variation").alias("file"), html.alias("html"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary pairs: per customer a generated and a true sentence in the style of a short report."""
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    whole = F.floor(F.col("c_acctbal")).cast("int").cast("string")
    gold = F.concat(
        F.lit("The balance of account "), F.col("c_custkey").cast("string"), F.lit(" in "), F.col("n_name"),
        F.lit(" is around "), whole, F.lit(" dollars . Orders are mostly from the "), F.lower("c_mktsegment"),
        F.lit(" segment ."),
    )
    cand = F.concat(
        F.lit("A balance near "), whole, F.lit(" dollars, mostly ordering from the "), F.lower("c_mktsegment"),
        F.when(F.col("c_acctbal") < 0, F.lit(" segment .")).otherwise(F.lit(" segments in ")),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("n_name")),
    )
    same = F.col("c_mktsegment") == "BUILDING"
    # customers are few bytes, often a single split, and each pair is costly to score later on
    return c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select(
        F.col("c_custkey").alias("pair_id"),
        F.when(same, gold).otherwise(cand).alias("prediction"),
        gold.alias("reference"),
    )


def customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small document per customer; the nation is the table id, the customer the variation."""
    c = table(spark, sf_dir, "customer")
    html = M.wrap_document(
        F.concat(
            F.lit("<thead><tr><th>name</th><th>segment</th><th>balance</th></tr></thead><tbody><tr><td>"),
            F.col("c_name"), F.lit("</td><td>"), F.lower("c_mktsegment"), F.lit("</td><td>"),
            F.when(F.col("c_acctbal") < 0, "--").otherwise(F.floor("c_acctbal").cast("string")),
            F.lit("</td></tr></tbody>"),
        )
    )
    return c.select(
        F.format_string("C_Table%d_Variation%d.htm", "c_nationkey", "c_custkey").alias("file"),
        F.col("c_nationkey").alias("table_id"),
        F.col("c_custkey").alias("variation"),
        html.alias("html"),
    )


def _box(line: DataFrame, shift: Column) -> Column:
    x, y = F.col("l_partkey") % 500 + shift, F.col("l_suppkey") % 500 + shift
    w, h = F.col("qty") + 10, F.col("l_linenumber") * 4 + 8
    return F.array(x, y, x + w, y + h).cast("array<double>")


def true_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, gt_no, box, iscrowd, text``: a box per order line on the image of its supplier."""
    li = lines(spark, sf_dir)
    return li.select(
        F.col("l_suppkey").alias("image"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gt_no"),
        _box(li, F.lit(0)).alias("box"),
        F.when(F.col("l_linenumber") == 3, 1).otherwise(0).alias("iscrowd"),
        F.when(F.col("l_linenumber") == 3, "###").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("text"),
    )


def detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, det_no, box, score``: the true boxes moved a little, without undiscounted open returns."""
    li = lines(spark, sf_dir).filter(
        ~((F.col("cents") == 0) & (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"))
    )
    return li.select(
        F.col("l_suppkey").alias("image"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("det_no"),
        _box(li, F.col("l_linenumber") % 4).alias("box"),
        ((F.col("cents") * 9 + 5) / 100).alias("score"),
    )


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, anno_no, coords, text``: a quad per order line on the image of its order."""
    li = lines(spark, sf_dir)
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 500
    w, h = F.col("qty") + 10, F.col("l_linenumber") * 4 + 8
    return li.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("anno_no"),
        F.array(x, y, x + w, y, x + w, y + h, x, y + h).cast("array<int>").alias("coords"),
        F.when(F.col("l_linenumber") == 3, "###").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("text"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, split, file_name, height, width, segm_file``: an image per order."""
    o = table(spark, sf_dir, "orders")
    split = F.when(F.col("o_orderstatus") == "F", "training").when(F.col("o_orderstatus") == "O", "test").otherwise("validation")
    number = F.col("o_orderkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("image_id"),
        split.alias("split"),
        F.concat(split, F.lit("/img_"), number, F.lit(".jpg")).alias("file_name"),
        F.lit(600).alias("height"),
        F.lit(800).alias("width"),
        F.concat(split, F.lit("/gt_img_"), number, F.lit(".txt")).alias("segm_file"),
    )


def ocr_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image, pred, gt``: part names, misread for sizes over 40 and in capitals for the type SMALL."""
    p = table(spark, sf_dir, "part")
    pred = F.when(F.col("p_size") > 40, F.replace("p_name", F.lit("e"), F.lit("c"))).otherwise(F.col("p_name"))
    pred = F.when(F.col("p_type") == "SMALL", F.upper(pred)).otherwise(pred)
    return p.select(
        F.concat(F.lit("word_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("image"),
        pred.alias("pred"),
        F.col("p_name").alias("gt"),
    )


def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gt, pred``: event types; small values are taken for views, users under ten for clicks."""
    e = table(spark, sf_dir, "events")
    pred = F.when(F.col("value") < 3, "view").when(F.col("user_id") < 10, "click").otherwise(F.col("event_type"))
    return e.select(F.col("event_type").alias("gt"), pred.alias("pred"))


def bio_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """True and predicted tags ``doc, pos, tag`` of part sentences.

    Sentence: ``the <adjective> <noun> by <brand> of type <type>``.  The two name words are a ``name``, the brand
    a ``company``, the type a ``position``.  The prediction cuts names of large parts and misses cheap brands.
    """
    p = table(spark, sf_dir, "part")
    true = ["O", "B-name", "I-name", "O", "B-company", "O", "O", "B-position"]
    pred = [
        F.lit("O"), F.lit("B-name"),
        F.when(F.col("p_size") > 40, "O").otherwise("I-name"),
        F.when(F.col("p_size") < 5, "I-name").otherwise("O"),
        F.when(F.col("p_type") == "PROMO", "B-position").otherwise("B-company"),
        F.lit("O"), F.when(F.col("p_size") == 20, "I-scene").otherwise("O"), F.lit("B-position"),
    ]

    def frame(tags: Column) -> DataFrame:
        return p.select(F.col("p_partkey").alias("doc"), F.posexplode(tags).alias("pos", "tag"))

    return frame(F.array(*[F.lit(t) for t in true])), frame(F.array(*pred))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, prediction, reference``: each assistant turn against the turn before it."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    now = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("prediction"))
    return now.join(before, ["conv_id", "turn"])
