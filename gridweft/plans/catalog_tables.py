"""Queries over documents, cells and table scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.functions import markup as M
from gridweft.functions.names import table_id, variation
from gridweft.operators import cells as C
from gridweft.operators import linearize as L
from gridweft.operators import summaries as S
from gridweft.operators import table_similarity as TS
from gridweft.operators.edit_script import edit_script, table_distances
from gridweft.plans import derived as D
from gridweft.plans.registry import CELLS, HEADERS, LINES, ROWS, file_of, query
from gridweft.streaming.incremental import pending

# the text of the true table of each order
_ROW_TEXT = """concat_ws(' [SEP] ', 'Amount qty | ' || qty, 'Amount flag | ' || flag,
     CASE WHEN status <> '-' THEN 'State Unknown | ' || replace(status, '''', '"') END, 'State line | L&' || n)"""
_TEXTS = f"""texts AS (
  SELECT {file_of('k', 'page * 4')} AS file, k, string_agg({_ROW_TEXT}, ' [X_SEP] ' ORDER BY n) || ' [SEP] ' AS input
  FROM rows GROUP BY k, page)"""
_CUSTOMER_TEXT = """'name | ' || c_name || ' [SEP] segment | ' || lower(c_mktsegment)
   || CASE WHEN c_acctbal < 0 THEN '' ELSE ' [SEP] balance | ' || CAST(floor(c_acctbal) AS BIGINT) END || ' [SEP] '"""


def true_cells(spark, sf):
    return C.explode_cells(C.parse_tables(D.single_tables(spark, sf)))


@query("P1_table_id", """
SELECT printf('C_Table%d_Variation%d.htm', c_nationkey, c_custkey) AS file, c_nationkey AS table_id,
       CAST(c_custkey AS INTEGER) AS variation FROM customer""")
def p1(spark, sf):
    files = D.customer_tables(spark, sf).select("file")
    return files.select("file", table_id("file").alias("table_id"), variation("file").alias("variation"))


@query("P2_cell_rows", f"""
WITH {LINES}, {ROWS}, {CELLS}, {HEADERS}
SELECT file, 'tbody' AS section, CAST(i AS INTEGER) AS row_no, c AS cell_no, 'td' AS tag, 1 AS colspan, 1 AS rowspan, norm AS markup
FROM cells
UNION ALL SELECT file, 'thead', level, h_no, 'th', hi - lo, 1, CASE WHEN name = 'Unknown' THEN '' ELSE name END FROM headers""")
def p2(spark, sf):
    return true_cells(spark, sf).select(
        "file", "section", "row_no", "cell_no", "tag", "colspan", "rowspan", F.col("norm").alias("markup")
    )


@query("P3_cell_tokens", f"""
WITH {LINES}, {ROWS}, {CELLS}
SELECT file, CAST(i AS INTEGER) AS row_no, c AS cell_no,
       CASE WHEN c = 1 THEN '<b> ' || content || ' </b>'
            ELSE array_to_string(string_split(content, ''), ' ') END AS tokens,
       length(content) + CASE WHEN c = 1 THEN 2 ELSE 0 END AS n_tokens
FROM cells""")
def p3(spark, sf):
    cells = true_cells(spark, sf).filter("section = 'tbody'").withColumn("t", M.cell_tokens("norm"))
    return cells.select(
        "file", "row_no", "cell_no", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens")
    )


@query("P4_strip_tags", f"""
WITH {LINES}, {ROWS}, {CELLS} SELECT file, CAST(i AS INTEGER) AS row_no, c AS cell_no, content FROM cells""")
def p4(spark, sf):
    cells = C.with_text(true_cells(spark, sf)).filter("section = 'tbody'")
    return cells.select("file", "row_no", "cell_no", "content")


@query("P5_header_names", f"""
WITH {LINES}, {ROWS}, {HEADERS} SELECT file, level, h_no, name FROM headers""")
def p5(spark, sf):
    heads = true_cells(spark, sf).filter("section = 'thead'")
    return heads.select("file", F.col("row_no").alias("level"), F.col("cell_no").alias("h_no"), M.header_name("norm").alias("name"))


@query("P6_quotes", f"""
WITH {LINES}, {ROWS}, {_TEXTS}
SELECT file, length(input) - length(replace(input, '"', '')) AS n_double,
       length(input) - length(replace(input, '''', '')) AS n_single FROM texts""")
def p6(spark, sf):
    text = L.linearize(D.single_tables(spark, sf))

    def count(ch):
        return (F.length("input") - F.length(F.replace("input", F.lit(ch), F.lit("")))).cast("bigint")

    return text.select("file", count('"').alias("n_double"), count("'").alias("n_single"))


@query("P7_prompt", f"""
SELECT printf('C_Table%d_Variation%d.htm', c_nationkey, c_custkey) AS file,
       'Describe the following data: ' || {_CUSTOMER_TEXT} AS input FROM customer""")
def p7(spark, sf):
    return L.with_prompt(L.linearize(D.customer_tables(spark, sf))).select("file", "input")


@query("F1_ignored_cells", f"""
WITH {LINES}, {ROWS}, {CELLS}
SELECT file, CAST(i AS INTEGER) AS row_no, c AS cell_no, content FROM cells WHERE content <> '-'""")
def f1(spark, sf):
    cells = C.with_text(true_cells(spark, sf)).filter("section = 'tbody'")
    return cells.filter(L.is_kept(F.col("content"))).select("file", "row_no", "cell_no", "content")


@query("F8_ignore_tags", f"""
WITH {LINES}, {ROWS} SELECT {file_of('k', 'page * 4')} AS file, 12 + 5 * count(*) AS n_nodes,
  string_agg(flag, '' ORDER BY n) AS flags FROM rows GROUP BY k, page""")
def f8(spark, sf):
    parsed = C.parse_tables(D.single_tables(spark, sf), ignore_tags=("b", "i"))
    rows = F.flatten(F.transform(F.filter("sections", lambda s: s["section"] == "tbody"), lambda s: s["rows"]))
    flags = F.array_join(F.transform(rows, lambda r: F.get(r, 1)["norm"]), "")
    return parsed.select("file", F.col("n_nodes").cast("bigint").alias("n_nodes"), flags.alias("flags"))


@query("W1_header_ranges", f"""
WITH {LINES}, {ROWS}, {HEADERS} SELECT file, level, h_no, name, lo, hi FROM headers""")
def w1(spark, sf):
    return C.header_ranges(true_cells(spark, sf))


@query("W2_body_positions", f"""
WITH {LINES}, {ROWS}, {CELLS} SELECT file, CAST(i AS INTEGER) AS row_no, c AS cell_no, c AS pos FROM cells""")
def w2(spark, sf):
    return C.body_positions(true_cells(spark, sf)).select("file", "row_no", "cell_no", "pos")


@query("J4_cells_with_headers", f"""
WITH {LINES}, {ROWS}, {CELLS}, {HEADERS}
SELECT c.file, CAST(i AS INTEGER) AS row_no, c AS cell_no, level, h_no, name
FROM cells c JOIN headers h ON c.file = h.file AND h.lo <= c.c AND c.c < h.hi""")
def j4(spark, sf):
    cells = true_cells(spark, sf)
    joined = C.attach_headers(C.body_positions(cells), C.header_ranges(cells))
    return joined.select("file", "row_no", "cell_no", "level", "h_no", "name")


@query("J5_header_parents", f"""
WITH {LINES}, {ROWS}, {HEADERS}
SELECT file, 0 AS level, 0 AS h_no, 'Order ' || k AS name, CAST(NULL AS INTEGER) AS parent_no, CAST(NULL AS VARCHAR) AS parent_name FROM heads
UNION ALL SELECT file, level, h_no, name, parent_no, coalesce(parent_name, 'Order ' || k) FROM heads, (VALUES
  (1, 0, 'Amount', 0, NULL), (1, 1, 'State', 0, NULL), (2, 0, 'qty', 0, 'Amount'), (2, 1, 'flag', 0, 'Amount'),
  (2, 2, 'Unknown', 1, 'State'), (2, 3, 'line', 1, 'State')) AS h(level, h_no, name, parent_no, parent_name)""")
def j5(spark, sf):
    heads = C.child_parent(C.header_ranges(true_cells(spark, sf)))
    return heads.select("file", "level", "h_no", "name", "parent_no", "parent_name")


@query("A3_header_paths", f"""
WITH {LINES}, {ROWS}, {HEADERS}
SELECT file, leaf, path FROM heads, (VALUES
  (0, 'Amount qty'), (1, 'Amount flag'), (2, 'State Unknown'), (3, 'State line')) AS h(leaf, path)""")
def a3(spark, sf):
    parsed = C.parse_tables(D.single_tables(spark, sf))
    paths = parsed.select("file", C.header_paths(F.col("sections")).alias("paths"))
    # a plain posexplode would have the paths computed twice, see explode_cells
    return paths.select("file", F.posexplode_outer("paths").alias("leaf", "path")).filter("leaf IS NOT NULL")


@query("A2_linearize", f"""
WITH {LINES}, {ROWS}, {_TEXTS} SELECT file, input FROM texts""")
def a2(spark, sf):
    return L.linearize(D.single_tables(spark, sf)).select("file", "input")


@query("A1_files_by_table", """
SELECT c_nationkey AS table_id, count(*) AS n_files,
       min(printf('C_Table%d_Variation%d.htm', c_nationkey, c_custkey)) AS first_file,
       max(printf('C_Table%d_Variation%d.htm', c_nationkey, c_custkey)) AS last_file
FROM customer GROUP BY c_nationkey""")
def a1(spark, sf):
    files = D.customer_tables(spark, sf).select("file").withColumn("table_id", table_id("file"))
    return S.group_files(files)


@query("A1_file_lists", """
SELECT c_nationkey AS table_id, 0 AS piece_no, string_agg(file, ',' ORDER BY file) AS files FROM (
  SELECT c_nationkey, printf('C_Table%d_Variation%d.htm', c_nationkey, c_custkey) AS file FROM customer) GROUP BY c_nationkey""")
def a1_lists(spark, sf):
    files = D.customer_tables(spark, sf).select("file").withColumn("table_id", table_id("file"))
    return S.file_lists(files).select("table_id", "piece_no", F.array_join("files", ",").alias("files"))


@query("A6_node_count", f"""
WITH {LINES}, {ROWS} SELECT {file_of('k', 'page * 4')} AS file, CAST(12 + 6 * count(*) AS INTEGER) AS n_nodes
FROM rows GROUP BY k, page""")
def a6(spark, sf):
    return C.parse_tables(D.single_tables(spark, sf)).select("file", "n_nodes")


@query("A4_nested_tables", f"""
WITH {LINES}, {ROWS}, {_TEXTS},
sizes AS (SELECT {file_of('k', 'page * 4')} AS first, k, page, 19 + 6 * count(*) AS n_nodes FROM rows GROUP BY k, page)
SELECT {file_of('s.k', 's.page * 4 + v')} AS file, CAST(n_nodes AS INTEGER) AS n_nodes,
       'Amount qty | px [X_SEP] ' || input AS input, round(1 - 0.1::DOUBLE / n_nodes, 6) AS score
FROM sizes AS s JOIN texts ON texts.file = s.first, (VALUES (0), (1), (2), (3)) AS t(v)""")
def a4_nested(spark, sf):
    scored = TS.score_tables(D.nested_tables(spark, sf))
    text = L.linearize(scored, html="true_html")
    return text.select("file", F.col("n_true").alias("n_nodes"), "input", F.round("score", 6).alias("score"))


@query("F11_incomplete_tables", """
SELECT c_nationkey AS table_id, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) <> 20""")
def f11(spark, sf):
    return S.incomplete_tables(D.customer_tables(spark, sf))


# ---------------------------------------------------------------- pairs and scores

_MISSING = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"
_DAMAGE = f"""damage AS (
  SELECT k, page, v, {file_of('k', 'page * 4 + v')} AS file, m,
         12 + 6 * m AS n_true,
         CASE WHEN v = 2 THEN 12 + 6 * (m - 1) ELSE 12 + 6 * m END AS n_pred,
         CASE v WHEN 1 THEN n_open / 3.0::DOUBLE WHEN 2 THEN 5.0 WHEN 3 THEN n_ret ELSE 0.0 END AS distance,
         CASE v WHEN 2 THEN 5.0 WHEN 3 THEN n_ret ELSE 0.0 END AS struct_distance
  FROM (SELECT k, page, count(*) AS m, count(*) FILTER (WHERE ls = 'O') AS n_open,
               count(*) FILTER (WHERE flag = 'R') AS n_ret FROM rows GROUP BY k, page),
       (VALUES (0), (1), (2), (3)) AS d(v))"""


def all_pairs(spark, sf):
    return TS.pair_tables(D.html_true(spark, sf), D.html_pred(spark, sf))


@query("J1_pairs_from_truth", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, CASE WHEN k IN ({_MISSING}) THEN 0 ELSE 1 END AS has_prediction FROM damage""")
def j1(spark, sf):
    return all_pairs(spark, sf).select("file", F.when(F.col("pred_html") == "", 0).otherwise(1).alias("has_prediction"))


@query("J2_pairs_on_both_sides", f"""
WITH {LINES}, {ROWS}, {_DAMAGE} SELECT file FROM damage WHERE k NOT IN ({_MISSING})""")
def j2(spark, sf):
    return TS.pair_tables(D.html_true(spark, sf), D.html_pred(spark, sf), "inner").select("file")


@query("J2_unmatched", f"""
WITH {LINES}, {ROWS}, {_DAMAGE} SELECT file FROM damage WHERE k IN ({_MISSING})""")
def j2_unmatched(spark, sf):
    # roles exchanged: truth files without a prediction
    return TS.unmatched_predictions(D.html_pred(spark, sf), D.html_true(spark, sf))


@query("A4_table_similarity", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, CASE WHEN k IN ({_MISSING}) THEN 0.0 ELSE round(1 - distance / greatest(n_true, n_pred), 6) END AS teds_aligned
FROM damage""")
def a4(spark, sf):
    scored = TS.score_tables(all_pairs(spark, sf))
    return scored.select("file", F.round("score", 6).alias("teds_aligned"))


@query("A4_tree_similarity", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, CASE WHEN k IN ({_MISSING}) THEN 0.0 ELSE round(1 - distance / greatest(n_true, n_pred), 6) END AS teds
FROM damage""")
def a4_tree(spark, sf):
    scored = TS.score_tables(all_pairs(spark, sf), unrestricted=True)
    return scored.select("file", F.round("score", 6).alias("teds"))


@query("A4_table_similarity_th", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, CASE WHEN k IN ({_MISSING}) THEN 0.0 ELSE round(1 - distance / greatest(n_true, n_pred), 6) END AS teds_aligned
FROM damage""")
def a4_th(spark, sf):
    scored = TS.score_tables(all_pairs(spark, sf), cell_tags=("td", "th"))
    return scored.select("file", F.round("score", 6).alias("teds_aligned"))


@query("F7_structure_only", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, CASE WHEN k IN ({_MISSING}) THEN 0.0 ELSE round(1 - struct_distance / greatest(n_true, n_pred), 6) END AS teds_struct
FROM damage""")
def f7(spark, sf):
    scored = TS.score_tables(all_pairs(spark, sf), structure_only=True)
    return scored.select("file", F.round("score", 6).alias("teds_struct"))


@query("F10_unusable_pairs", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, 0.0::DOUBLE AS score, 'ok/empty' AS flag FROM damage WHERE k IN ({_MISSING})
UNION ALL SELECT 'page_' || page_id, 0.0, 'no_table/no_table' FROM pages""")
def f10(spark, sf):
    pages = D.table(spark, sf, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("file"),
        F.col("html").alias("true_html"),
        F.col("html").alias("pred_html"),
    )
    missing = all_pairs(spark, sf).filter("pred_html = ''").select("file", "true_html", "pred_html")
    return TS.score_tables(missing.unionByName(pages)).select("file", "score", "flag")


@query("F9_pending", f"""
WITH {LINES}, {ROWS}, {_DAMAGE} SELECT file FROM damage WHERE k IN ({_MISSING})""")
def f9(spark, sf):
    return pending(D.html_true(spark, sf).select("file"), D.html_pred(spark, sf))


_NO_PLACE = "-1"
_EDITS = f"""edits AS (
  SELECT {file_of('k', 'page * 4 + 1')} AS file, 'cell' AS level, 'change' AS op, 1 AS true_section, CAST(i AS INTEGER) AS true_row,
         1 AS true_cell, 1 AS pred_section, CAST(i AS INTEGER) AS pred_row, 1 AS pred_cell, round(1 / 3.0::DOUBLE, 6) AS cost
  FROM rows WHERE ls = 'O'
  UNION ALL SELECT {file_of('k', 'page * 4 + 2')}, 'row', 'delete', 1, CAST(i AS INTEGER), {_NO_PLACE}, {_NO_PLACE}, {_NO_PLACE},
         {_NO_PLACE}, 5.0 FROM rows WHERE i = m - 1
  UNION ALL SELECT {file_of('k', 'page * 4 + 3')}, 'cell', 'change', 1, CAST(i AS INTEGER), 0, 1, CAST(i AS INTEGER), 0, 1.0
  FROM rows WHERE flag = 'R')"""


@query("J12_changed_cells", f"""
WITH {LINES}, {ROWS}, {_EDITS} SELECT * FROM edits""")
def j12(spark, sf):
    return edit_script(D.html_tables(spark, sf)).withColumn("cost", F.round("cost", 6)).fillna(-1)


@query("A4_distance_by_blocks", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}
SELECT file, round(distance, 6) AS distance FROM damage WHERE distance > 0""")
def a4_blocks(spark, sf):
    return table_distances(D.html_tables(spark, sf)).withColumn("distance", F.round("distance", 6))


_SPANNED_TEXT = """concat_ws(' [SEP] ', CASE WHEN i % 2 = 0 THEN 'Amount qty | ' || qty END, 'Amount flag | ' || flag,
     CASE WHEN status NOT IN ('-', 'done') THEN 'State Unknown | ' || replace(status, '''', '"') END, 'State line | L&' || n)"""


@query("A2_linearize_spans", f"""
WITH {LINES}, {ROWS}
SELECT {file_of('k', 'page * 4')} AS file, string_agg({_SPANNED_TEXT}, ' [X_SEP] ' ORDER BY n) || ' [SEP] ' AS input
FROM rows GROUP BY k, page""")
def a2_spans(spark, sf):
    return L.linearize(D.spanned_tables(spark, sf), span_aware=True).select("file", "input")


@query("J4_grid_headers", f"""
WITH {LINES}, {ROWS}
SELECT {file_of('k', 'page * 4')} AS file, CAST(i AS INTEGER) AS row_no, CAST(cell_no AS INTEGER) AS cell_no, pos, name FROM (
  SELECT k, page, i, pos, name, row_number() OVER (PARTITION BY k, page, i ORDER BY pos) - 1 AS cell_no
  FROM rows, (VALUES (0, 'qty'), (1, 'flag'), (2, 'Unknown'), (3, 'line')) AS c(pos, name)
  WHERE NOT (pos = 0 AND i % 2 = 1) AND NOT (pos = 2 AND status = 'done'))""")
def j4_grid(spark, sf):
    cells = C.explode_cells(C.parse_tables(D.spanned_tables(spark, sf)), span_aware=True)
    found = C.attach_headers(C.body_positions(cells, span_aware=True), C.header_ranges(cells))
    return found.filter("level = 2").select("file", "row_no", "cell_no", "pos", "name")


@query("A5_edit_distance", """
SELECT p_partkey, levenshtein(p_name, p_brand) AS distance,
       round(levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand))::DOUBLE, 6) AS ratio FROM part""")
def a5(spark, sf):
    from gridweft.functions.alignment import edit_ratio

    p = D.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        F.levenshtein("p_name", "p_brand").cast("bigint").alias("distance"),
        F.round(edit_ratio(F.col("p_name"), F.col("p_brand")), 6).alias("ratio"),
    )


def system_scores(spark, sf):
    """Scores of the four kinds of damage as four systems."""
    scored = TS.score_tables(all_pairs(spark, sf))
    kind = F.concat(F.lit("system_"), (variation("file") % 4).cast("string"))
    return scored.select("file", kind.alias("system"), table_id("file").alias("table_id"), F.round("score", 6).alias("score"))


_SYSTEM = f"""scores AS (
  SELECT file, 'system_' || v AS system, CAST(k AS INTEGER) AS table_id,
         CASE WHEN k IN ({_MISSING}) THEN 0.0 ELSE round(1 - distance / greatest(n_true, n_pred), 6) END AS score FROM damage)"""


@query("A11_system_summary", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}, {_SYSTEM}
SELECT system, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max,
       quantile_disc(score, 0.5) AS median, count(score) AS n FROM scores GROUP BY system""")
def a11(spark, sf):
    return S.system_summary(system_scores(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("A11_drill_down", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}, {_SYSTEM}
SELECT system, table_id, round(avg(score), 6) AS mean, count(score) AS n FROM scores GROUP BY ROLLUP (system, table_id)""")
def a11_drill(spark, sf):
    return S.drill_down(system_scores(spark, sf), ["system", "table_id"]).withColumn("mean", F.round("mean", 6))


@query("O4_worst_tables", f"""
WITH {LINES}, {ROWS}, {_DAMAGE}, {_SYSTEM}
SELECT file, score FROM scores ORDER BY score, file LIMIT 25""")
def o4(spark, sf):
    scores = system_scores(spark, sf).select("file", "score")
    return S.extremes(scores, 25)


@query("O1_sorted_files", """
SELECT printf('C_Table%d_Variation%d.htm', c_nationkey, c_custkey) AS file, c_nationkey AS table_id FROM customer ORDER BY 1""")
def o1(spark, sf):
    return D.customer_tables(spark, sf).select("file", "table_id").orderBy("file")


@query("A18_row_count", "SELECT count(*) AS n FROM lineitem")
def a18(spark, sf):
    return D.table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))

