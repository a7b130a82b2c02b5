"""Parsing, linearisation and table similarity on hand-made documents."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from gridweft.functions import markup as M
from gridweft.operators import cells as C
from gridweft.operators.linearize import linearize, with_prompt
from gridweft.operators.table_similarity import score_against_truth, score_tables, unmatched_predictions


def doc(rows):
    return f"<html><body><table>{rows}</table></body></html>"


def text_of(spark, html, **options):
    return linearize(spark.createDataFrame([(html,)], "html string"), **options).first()["input"]


HEAD = "<thead><tr><th>a</th><th>b</th></tr></thead>"

LINEARIZED = {
    "flat header": (HEAD + "<tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></tbody>",
                    "a | 1 [SEP] b | 2 [X_SEP] a | 3 [SEP] b | 4 [SEP] "),
    "row of ignored cells": (HEAD + "<tbody><tr><td>1</td><td>2</td></tr><tr><td>-</td><td>. .</td></tr><tr><td>--</td><td>4</td></tr></tbody>",
                             "a | 1 [SEP] b | 2 [X_SEP] b | 4 [SEP] "),
    "no header": ("<tbody><tr><td>1</td><td>2</td></tr></tbody>", "Unknown | 1 [SEP] Unknown | 2 [SEP] "),
    "header cell in the body": (HEAD + "<tbody><tr><th>x</th><td>1</td><td>2</td></tr></tbody>", "a | 1 [SEP] b | 2 [SEP] "),
    "two groups on a boundary": (
        '<thead><tr><th colspan="2">g</th><th colspan="2">h</th></tr><tr><th>a</th><th>b</th><th>c</th><th>d</th></tr></thead>'
        "<tbody><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></tbody>",
        "g a | 1 [SEP] g b | 2 [SEP] h c | 3 [SEP] h d | 4 [SEP] "),
    "three levels, one root": (
        '<thead><tr><th colspan="2">top</th></tr><tr><th colspan="2">mid</th></tr><tr><th>a</th><th>b</th></tr></thead>'
        "<tbody><tr><td>1</td><td>2</td></tr></tbody>", "mid a | 1 [SEP] mid b | 2 [SEP] "),
    "narrow last level": (
        '<thead><tr><th colspan="2">g</th><th>h</th></tr><tr><th>a</th><th>b</th></tr></thead>'
        "<tbody><tr><td>1</td><td>2</td><td>3</td></tr></tbody>", "g a | 1 [SEP] g b | 2 [SEP] h | 3 [SEP] "),
    "more cells than columns": (HEAD + "<tbody><tr><td>1</td><td>2</td><td>3</td></tr></tbody>", "a | 1 [SEP] b | 2 [SEP] "),
    "empty header cell": ("<thead><tr><th></th></tr></thead><tbody><tr><td>1</td></tr></tbody>", "Unknown | 1 [SEP] "),
    "quotes, entities, inline tags": (HEAD + "<tbody><tr><td>it's</td><td><b class='x'>A</b> &amp; &#66;&#x43;&nope;</td></tr></tbody>",
                                      'a | it"s [SEP] b | A & BC&nope; [SEP] '),
    "nothing kept": (HEAD + "<tbody><tr><td>-</td></tr></tbody>", ""),
    "missing end tags": ("<thead><tr><th>a<th>b<tbody><tr><td>1<td>2<tr><td>3<td>4", "a | 1 [SEP] b | 2 [X_SEP] a | 3 [SEP] b | 4 [SEP] "),
    "comments": (HEAD + "<tbody><tr><td>1<!-- <td>9</td> --></td><td>2</td></tr></tbody>", "a | 1 [SEP] b | 2 [SEP] "),
    "upper case": ("<THEAD><TR><TH>a</TH></TR></THEAD><TBODY><TR><TD>1</TD></TR></TBODY>", "a | 1 [SEP] "),
    "foot": (HEAD + "<tbody><tr><td>1</td><td>2</td></tr></tbody><tfoot><tr><td>5</td></tr></tfoot>", "a | 1 [SEP] b | 2 [X_SEP] a | 5 [SEP] "),
}


INNER = "<table class='i'><tr><td>x</td> <td>y</td></tr></table>"
NESTED = {
    # inner markup is content of its cell: (rows, text, nodes, content of the cells)
    "one": (HEAD + f"<tbody><tr><td>1{INNER}z</td><td>2</td></tr></tbody>", "a | 1xyz [SEP] b | 2 [SEP] ", 12,
            ["1<table><tr><td>x</td><td>y</td></tr></table>z", "2"]),
    "two in a cell": (HEAD + f"<tbody><tr><td>{INNER}{INNER}</td><td>2</td></tr></tbody>", "a | xyxy [SEP] b | 2 [SEP] ", 16,
                      ["<table><tr><td>x</td><td>y</td></tr></table>" * 2, "2"]),
    "three levels": (HEAD + f"<tbody><tr><td><table><tr><td>{INNER}</td></tr></table></td><td>2</td></tr><tr><td>3</td><td>4</td></tr></tbody>",
                     "a | xy [SEP] b | 2 [X_SEP] a | 3 [SEP] b | 4 [SEP] ", 18,
                     ["<table><tr><td><table><tr><td>x</td><td>y</td></tr></table></td></tr></table>", "2", "3", "4"]),
    "sections inside": (HEAD + "<tbody><tr><td><TABLE><thead><tr><th>h</th></tr></thead><tbody><tr><td>v</td></tr></tbody></TABLE></td><td>2</td></tr></tbody>",
                        "a | hv [SEP] b | 2 [SEP] ", 15,
                        ["<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>v</td></tr></tbody></table>", "2"]),
    "a table after it": (HEAD + f"<tbody><tr><td>{INNER}</td><td>2</td></tr></tbody></table><table><tr><td>9</td></tr>", "a | xy [SEP] b | 2 [SEP] ", 12,
                         ["<table><tr><td>x</td><td>y</td></tr></table>", "2"]),
}


def test_tables_in_cells(spark):
    docs = spark.createDataFrame([(k, doc(v[0])) for k, v in NESTED.items()], "file string, html string")
    assert {r["file"]: r["input"] for r in linearize(docs).collect()} == {k: v[1] for k, v in NESTED.items()}
    parsed = C.parse_tables(docs)
    assert {r["file"]: (r["status"], r["n_nodes"]) for r in parsed.collect()} == {k: ("ok", v[2]) for k, v in NESTED.items()}
    cells = C.explode_cells(parsed).filter("tag = 'td'").orderBy("row_no", "cell_no").collect()
    assert {k: [c["norm"] for c in cells if c["file"] == k] for k in NESTED} == {k: v[3] for k, v in NESTED.items()}
    # an inner tag counts as one symbol of the outer cell: nine tags and three characters, one of them another
    pair = [("p", doc("<tr><td>1" + INNER + "z</td></tr>"), doc("<tr><td>1" + INNER + "q</td></tr>"))]
    for unrestricted in (False, True):
        row = score_tables(spark.createDataFrame(pair, "file string, true_html string, pred_html string"), unrestricted=unrestricted).first()
        assert (row["n_true"], row["flag"]) == (6, "ok") and abs(row["distance"] - 1 / 12) < 1e-9
    same = [(k, doc(v[0]), doc(v[0])) for k, v in NESTED.items()]
    assert {r["score"] for r in score_tables(spark.createDataFrame(same, "file string, true_html string, pred_html string")).collect()} == {1.0}


GRIDS = {
    "plain": ('<tr><td>a</td><td>b</td></tr><tr><td>c</td></tr>', [[0, 1], [0]]),
    "rows": ('<tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr>', [[0, 1], [1], [0]]),
    "columns": ('<tr><td colspan="3">a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr>', [[0, 3], [0, 1]]),
    "a block between cells": ('<tr><td>a</td><td rowspan="3" colspan="2">b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr><tr></tr><tr><td>f</td><td>g</td></tr>',
                              [[0, 1, 3], [0, 3], [], [0, 1]]),
    "two spans side by side": ('<tr><td>a</td><td rowspan="2">b</td></tr><tr><td rowspan="2">c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr>',
                               [[0, 1], [0, 2], [1, 2]]),
    "to the end": ('<tr><td rowspan="0">a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr>', [[0, 1], [1], [1]]),
    "no width": ('<tr><td colspan="0">a</td><td>b</td></tr>', [[0, 1]]),
    "header cell": ('<tr><th rowspan="2">a</th><td>b</td></tr><tr><td>c</td></tr>', [[0, 1], [1]]),
    "very wide": ('<tr><td colspan="99999999999">a</td><td>b</td></tr>', [[0, 1000]]),
}


def test_grid_columns(spark):
    docs = spark.createDataFrame([(k, doc(f"<tbody>{v[0]}</tbody>")) for k, v in GRIDS.items()], "file string, html string")
    found = C.parse_tables(docs).select("file", C.grid_columns(F.get("sections", 0)["rows"]).alias("g")).collect()
    assert {r["file"]: r["g"] for r in found} == {k: v[1] for k, v in GRIDS.items()}
    cells = C.body_positions(C.explode_cells(C.parse_tables(docs), span_aware=True), span_aware=True).filter("file = 'header cell'")
    assert sorted((r["row_no"], r["cell_no"], r["pos"]) for r in cells.collect()) == [(0, 1, 1), (1, 0, 1)]


def test_texts_by_grid_column(spark):
    body = ('<tbody><tr><td rowspan="2">1</td><td>2</td></tr><tr><td>3</td></tr><tr><td colspan="2">4</td><td>5</td></tr></tbody>'
            "<tfoot><tr><td>6</td><td>7</td></tr></tfoot>")
    assert text_of(spark, doc(HEAD + body), span_aware=True) == "a | 1 [SEP] b | 2 [X_SEP] b | 3 [X_SEP] a | 4 [X_SEP] a | 6 [SEP] b | 7 [SEP] "
    # a leaf of two columns holds both cells below it
    wide = '<thead><tr><th colspan="2">g</th><th>h</th></tr></thead><tbody><tr><td>1</td><td>2</td><td>3</td></tr></tbody>'
    assert text_of(spark, doc(wide), span_aware=True) == "g | 1 [SEP] g | 2 [SEP] h | 3 [SEP] "
    assert text_of(spark, doc("<tr><td colspan='2'>1</td><td>2</td></tr>"), span_aware=True) == "Unknown | 1 [SEP] Unknown | 2 [SEP] "


def test_linearized_texts(spark):
    docs = spark.createDataFrame([(k, doc(v[0])) for k, v in LINEARIZED.items()], "file string, html string")
    got = {r["file"]: r["input"] for r in linearize(docs).collect()}
    assert got == {k: v[1] for k, v in LINEARIZED.items()}


def test_prompt_and_ignored_tags(spark):
    docs = spark.createDataFrame([(doc(HEAD + "<tbody><tr><td><i>1</i></td></tr></tbody>"),)], "html string")
    assert with_prompt(linearize(docs, ignore_tags=("i",))).first()["input"] == "Describe the following data: a | 1 [SEP] "


@pytest.mark.parametrize("html, status", [
    ("", "empty"), ("plain", "no_table"), ("<table><tr><td>1</td></tr></table>", "no_table"),
    ("<html><body><div><table></table></div></body></html>", "no_table"),
    ("<html><body><div>x</div><br><table></table></body></html>", "ok"),
    (doc("<tr><td><table></table></td></tr>"), "ok"),
    ("<!DOCTYPE html><html><head><title>t</title></head><body><p>x<table></table>", "ok"),
])
def test_status(spark, html, status):
    row = C.parse_tables(spark.createDataFrame([("f", html)], "file string, html string")).first()
    assert row["status"] == status
    assert linearize(spark.createDataFrame([(html,)], "html string")).first()["input"] == ("" if status == "ok" else None)


def test_tokens(spark):
    df = spark.createDataFrame([("x&#8364;<B class=\"q\">y&lt;</B><br>",)], "c string")
    row = df.select(M.cell_tokens(M.normalize_inline("c")).alias("t"), M.cell_text(M.normalize_inline("c")).alias("x")).first()
    assert row["t"] == ["x", "€", "<b>", "y", "<", "</b>", "<br>", "</br>"]


def test_linearize_needs_no_shuffle_and_reads_two_columns(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("f", doc(HEAD), 1)], "file string, html string, extra int").write.parquet(path)
    plan = linearize(spark.read.parquet(path)).select("file", "input")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "ReadSchema: struct<file:string,html:string>" in plan


def test_scoring_shuffles_once_per_side(spark):
    one = spark.createDataFrame([("f", doc(HEAD))], "file string, html string")
    plan = score_against_truth(one, one)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


# ---------------------------------------------------------------- similarity


def score(spark, true, pred, **options):
    pairs = spark.createDataFrame([(true, pred)], "true_html string, pred_html string")
    return score_tables(pairs, **options).first()


BASE = doc(HEAD + "<tbody><tr><td>ab</td><td>cd</td></tr><tr><td>ef</td><td>gh</td></tr></tbody>")


@pytest.mark.parametrize("change, distance", [
    (lambda h: h, 0.0),
    (lambda h: h.replace(">ab<", ">ax<"), 0.5),
    (lambda h: h.replace("<tr><td>ef</td><td>gh</td></tr>", ""), 3.0),
    (lambda h: h.replace("<td>cd</td>", "<td>cd</td><td>new</td>"), 1.0),
    (lambda h: h.replace("<td>ab</td>", '<td colspan="2">ab</td>'), 1.0),
    (lambda h: h.replace("<th>a</th>", "<th>zzz</th>"), 0.0),
    (lambda h: h.replace("<tbody>", "").replace("</tbody>", ""), 1.0),
    (lambda h: h.replace("<td>ab</td>", "<td><b>ab</b></td>"), 0.5),
    (lambda h: h.replace("<th>a</th>", "<th><b>a</b></th>"), 1.0),
])
def test_distances(spark, change, distance):
    row = score(spark, BASE, change(BASE))
    assert row["distance"] == pytest.approx(distance)
    assert row["score"] == pytest.approx(1 - distance / max(row["n_true"], row["n_pred"]))


def test_header_cells_as_cells(spark):
    changed = BASE.replace("<th>a</th>", "<th>z</th>")
    assert score(spark, BASE, changed, cell_tags=("td", "th"))["distance"] == pytest.approx(1.0)
    assert score(spark, BASE, BASE.replace(">ab<", ">zz<"), structure_only=True)["score"] == 1.0


@pytest.mark.parametrize("true, pred, flag", [
    (BASE, "", "ok/empty"), ("", BASE, "empty/ok"), (BASE, "<p>x</p>", "ok/no_table"), (doc(""), doc(""), "no_nodes"),
])
def test_unusable_pairs(spark, true, pred, flag):
    row = score(spark, true, pred)
    assert row["flag"] == flag
    assert row["score"] == (None if flag == "no_nodes" else 0.0)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def aligned(xs, ys, weight, cost):
    """Least cost over all ways to delete, insert and replace, without any band."""
    @lru_cache(None)
    def best(i, j):
        if i == len(xs) and j == len(ys):
            return 0.0
        ways = []
        if i < len(xs):
            ways.append(weight(xs[i]) + best(i + 1, j))
        if j < len(ys):
            ways.append(weight(ys[j]) + best(i, j + 1))
        if i < len(xs) and j < len(ys):
            ways.append(cost(xs[i], ys[j]) + best(i + 1, j + 1))
        return min(ways)
    return best(0, 0)


def cell_cost(a, b):
    if a[0] != b[0]:
        return 1.0
    return edit(a[1], b[1]) / max(len(a[1]), len(b[1])) if a[1] or b[1] else 0.0


def row_cost(a, b):
    return aligned(a, b, lambda c: 1, cell_cost)


def tree_distance(f, g):
    """Unrestricted ordered tree distance; a tree is (label, children), a forest a tuple of trees."""
    @lru_cache(None)
    def size(f):
        return sum(1 + size(t[1]) for t in f)

    def rename(a, b):
        if a[0] == b[0] == "td":
            return cell_cost(a[1:], b[1:])
        return 0.0 if a == b else 1.0

    @lru_cache(None)
    def dist(f, g):
        if not f or not g:
            return float(size(f) + size(g))
        (lf, kf), (lg, kg) = f[-1], g[-1]
        return min(
            dist(f[:-1] + kf, g) + 1,
            dist(f, g[:-1] + kg) + 1,
            dist(f[:-1], g[:-1]) + dist(kf, kg) + rename(lf, lg),
        )
    return dist(f, g)


def random_table(rng):
    return tuple(
        tuple((rng.choice((1, 1, 1, 2)), "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(1, 3)))
        for _ in range(rng.randint(1, 4))
    )


def as_html(table):
    rows = "".join("<tr>" + "".join(f'<td colspan="{s}">{t}</td>' for s, t in r) + "</tr>" for r in table)
    return doc(f"<tbody>{rows}</tbody>")


def as_forest(table):
    rows = tuple((("tr",), tuple((("td", s, t), ()) for s, t in r)) for r in table)
    return ((("table",), ((("tbody",), rows),)),)


def test_distance_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(random_table(rng), random_table(rng)) for _ in range(120)]
    frame = spark.createDataFrame([(i, as_html(a), as_html(b)) for i, (a, b) in enumerate(pairs)],
                                  "i int, true_html string, pred_html string").repartition(8)
    got = {r["i"]: r["distance"] for r in score_tables(frame).collect()}
    equal = 0
    for i, (a, b) in enumerate(pairs):
        expected = aligned(a, b, lambda r: 1 + len(r), row_cost)
        assert got[i] == pytest.approx(expected)
        general = tree_distance(as_forest(a), as_forest(b))
        assert got[i] >= general - 1e-9
        equal += abs(got[i] - general) < 1e-9
    assert equal > 60


def test_long_tables_use_growing_bands(spark):
    rng = random.Random(9)
    base = tuple(((1, str(rng.randint(0, 99))), (1, "x")) for _ in range(40))
    other = base[:5] + base[9:] + tuple(((1, "new"), (1, "y")) for _ in range(4))
    expected = aligned(base, other, lambda r: 1 + len(r), row_cost)
    assert score(spark, as_html(base), as_html(other))["distance"] == pytest.approx(expected)


def test_missing_and_surplus_predictions(spark):
    true = spark.createDataFrame([("a", BASE), ("b", BASE)], "file string, html string")
    pred = spark.createDataFrame([("a", BASE), ("c", BASE)], "file string, html string")
    assert {r["file"]: r["score"] for r in score_against_truth(true, pred).collect()} == {"a": 1.0, "b": 0.0}
    assert [r["file"] for r in score_against_truth(true, pred, how="inner").collect()] == ["a"]
    assert [r["file"] for r in unmatched_predictions(true, pred).collect()] == ["c"]


def test_cell_frames_agree_with_paths(spark):
    docs = spark.createDataFrame([("f", doc(LINEARIZED["two groups on a boundary"][0]))], "file string, html string")
    cells = C.explode_cells(C.parse_tables(docs))
    joined = C.attach_headers(C.body_positions(cells), C.header_ranges(cells))
    names = joined.groupBy("pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), " ").alias("p"))
    assert {r["pos"]: r["p"] for r in names.collect()} == {0: "g a", 1: "g b", 2: "h c", 3: "h d"}
