"""Tables as rows: parsing documents, exploded cells, header ranges and header paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweft.functions import markup as M
from gridweft.functions.bind import bind
from gridweft.session import materialize


def parse_tables(tables: DataFrame, html: str = "html", ignore_tags: tuple[str, ...] = ()) -> DataFrame:
    """Add ``status``, ``n_nodes`` and ``sections`` to a frame of documents, one document per row.

    A document that is no usable table keeps its row; its ``status`` says why and ``sections`` is null.
    """
    marked = with_markup(tables, html, ignore_tags)
    return marked.withColumn("sections", M.table_sections("_markup")).drop("_markup")


def with_markup(tables: DataFrame, html: str = "html", ignore_tags: tuple[str, ...] = ()) -> DataFrame:
    """Add ``status``, ``n_nodes`` and ``_markup``, the content of the table; null where there is no usable one."""
    cleaned = M.unwrap_tags(M.strip_comments(html), ignore_tags)
    marked = (
        tables.withColumn("_clean", cleaned)
        .withColumn("status", M.table_status("_clean"))
        .withColumn("_markup", F.when(F.col("status") == "ok", M.table_markup("_clean")))
        .withColumn("n_nodes", M.node_count("_markup"))
    )
    return marked.select(*tables.columns, "status", "n_nodes", "_markup")


def explode_cells(parsed: DataFrame, keys: tuple[str, ...] = ("file",), span_aware: bool = False) -> DataFrame:
    """One row per cell: ``keys, section_no, section, row_no, cell_no, tag, colspan, rowspan, norm``.

    With ``span_aware`` there is also ``grid_col``, the first column of the cell in the grid of its section.
    """
    k = list(keys)
    # for a plain posexplode Spark infers a filter on its input and pushes it down, and every document would be parsed twice
    sections = parsed.select(*k, F.posexplode_outer("sections").alias("section_no", "s")).filter("section_no IS NOT NULL")
    placed = F.arrays_zip(F.col("s.rows").alias("cells"), grid_columns(F.col("s.rows")).alias("starts")) if span_aware else F.col("s.rows")
    rows = sections.select(*k, "section_no", F.col("s.section").alias("section"), F.posexplode_outer(placed).alias("row_no", "r"))
    rows = rows.filter("row_no IS NOT NULL")
    cells = rows.select(*k, "section_no", "section", "row_no", "r", F.posexplode("r.cells" if span_aware else "r").alias("cell_no", "c"))
    columns = [*k, "section_no", "section", "row_no", "cell_no", "c.tag", "c.colspan", "c.rowspan", "c.norm"]
    return cells.select(*columns, *([F.get("r.starts", F.col("cell_no")).alias("grid_col")] if span_aware else []))


def grid_columns(rows: Column) -> Column:
    """The first column of every cell of the rows of a section, in order.

    A cell takes the first column that is free, behind the cell before it.  Columns are taken by cells above for as many rows as they
    span; 0 rows means all that follow.  A column span of 0 counts as 1, as browsers have it, and at most 1000 columns are spanned.
    Spans end with the section.
    """

    def place(taken: Column, at: Column) -> Column:
        # the parts taken by cells above are in order, so one walk over them finds the first free column
        return F.aggregate(taken, at, lambda c, t: F.when((t["lo"] <= c) & (c < t["hi"]), t["hi"]).otherwise(c))

    def next_row(state: Column, cells: Column) -> Column:
        taken = state["taken"]

        def next_cell(row: Column, cell: Column) -> Column:
            def put(lo: Column) -> Column:
                hi = lo + F.greatest(F.least(cell["colspan"], F.lit(1000)), F.lit(1))
                below = F.when(cell["rowspan"] == 0, F.lit(2**31 - 1)).otherwise(cell["rowspan"])
                part = F.struct(lo.alias("lo"), hi.alias("hi"), below.alias("rows"))
                # a cell of this row alone is of no use to the rows below
                parts = F.when(below > 1, F.concat(row["parts"], F.array(part))).otherwise(row["parts"])
                return F.struct(hi.alias("at"), F.concat(row["starts"], F.array(lo)).alias("starts"), parts.alias("parts"))

            return bind(place(taken, row["at"]), put)

        def below(row: Column) -> Column:
            left = F.transform(F.concat(taken, row["parts"]), lambda t: t.withField("rows", t["rows"] - 1))
            still = F.sort_array(F.filter(left, lambda t: t["rows"] > 0))
            return F.struct(still.alias("taken"), F.concat(state["starts"], F.array(row["starts"])).alias("starts"))

        start = F.struct(F.lit(0).alias("at"), no_starts.alias("starts"), no_parts.alias("parts"))
        return bind(F.aggregate(cells, start, next_cell), below)

    no_starts, no_parts = F.array().cast("array<int>"), F.array().cast("array<struct<lo:int,hi:int,rows:int>>")
    start = F.struct(no_parts.alias("taken"), F.array().cast("array<array<int>>").alias("starts"))
    plain = F.forall(rows, lambda r: F.forall(r, lambda c: (c["colspan"] == 1) & (c["rowspan"] == 1)))
    in_order = F.transform(rows, lambda r: F.transform(r, lambda c, i: i))
    return F.when(plain, in_order).otherwise(F.aggregate(rows, start, next_row, lambda s: s["starts"]))


def with_text(cells: DataFrame) -> DataFrame:
    return cells.withColumn("content", M.cell_text("norm"))


# ---------------------------------------------------------------- header ranges as a frame


def header_ranges(cells: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Half-open column range of every header cell: a running sum of the column spans before it."""
    w = (
        Window.partitionBy(*keys, "section_no", "row_no")
        .orderBy("cell_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cells.filter(F.col("section") == "thead")
        .withColumn("lo", F.coalesce(F.sum("colspan").over(w), F.lit(0)).cast("int"))
        .withColumn("hi", (F.col("lo") + F.col("colspan")).cast("int"))
        .select(
            *keys,
            F.col("row_no").alias("level"),
            F.col("cell_no").alias("h_no"),
            M.header_name("norm").alias("name"),
            "lo",
            "hi",
        )
    )


def body_positions(cells: DataFrame, keys: tuple[str, ...] = ("file",), span_aware: bool = False) -> DataFrame:
    """Data cells with their running position in the row; header cells in the body do not count.

    With ``span_aware`` the position is the column in the grid (``grid_col``), where header cells and cells that reach down from
    rows above take their columns too.
    """
    w = Window.partitionBy(*keys, "section_no", "row_no").orderBy("cell_no")
    body = cells.filter((F.col("section") != "thead") & (F.col("tag") == "td"))
    if span_aware:
        return body.withColumnRenamed("grid_col", "pos")
    return body.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def child_parent(headers: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Every header cell with the cell one level up whose range contains its first column."""
    headers = materialize(headers, "headers")  # either side of the join would parse the documents again
    on = [*keys, "level"]
    up = headers.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        (F.col("level") + 1).alias("_level"),
        F.col("h_no").alias("parent_no"),
        F.col("name").alias("parent_name"),
        F.col("lo").alias("_lo"),
        F.col("hi").alias("_hi"),
    )
    cond = (F.col("_lo") <= F.col("lo")) & (F.col("lo") < F.col("_hi"))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return headers.join(up, cond, "left").select(
        *keys, "level", "h_no", "name", "lo", "hi", "parent_no", "parent_name"
    )


def attach_headers(positions: DataFrame, headers: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Every data cell with each header cell above it, one row per level.

    The file key keeps this a hash or sort-merge join; the range is a residual condition.
    """
    cond = (headers["lo"] <= positions["pos"]) & (positions["pos"] < headers["hi"])
    for k in keys:
        cond = cond & (headers[k] == positions[k])
    return positions.join(headers, cond).select(
        *[positions[k] for k in keys], "section_no", "row_no", "cell_no", "pos", "level", "h_no", "name"
    )


# ---------------------------------------------------------------- header paths inside the row


def _header_levels(sections: Column) -> Column:
    """Header rows as arrays of ``(name, lo, hi)``."""
    rows = F.flatten(F.transform(F.filter(sections, lambda s: s["section"] == "thead"), lambda s: s["rows"]))

    def level(cells: Column) -> Column:
        spans = F.transform(cells, lambda c: c["colspan"])

        def ranged(c: Column, lo: Column) -> Column:
            return F.struct(
                M.header_name(c["norm"]).alias("name"), lo.alias("lo"), (lo + c["colspan"]).alias("hi")
            )

        def start(s: Column, i: Column) -> Column:
            return F.aggregate(F.slice(s, 1, i), F.lit(0), lambda a, x: a + x)

        return bind(spans, lambda s: F.transform(cells, lambda c, i: bind(start(s, i), lambda lo: ranged(c, lo))))

    return F.filter(F.transform(rows, level), lambda lv: F.size(lv) > 0)


def header_paths(sections: Column) -> Column:
    """Header path of every leaf column, from left to right.

    A leaf is the deepest header cell over a column, so a lower level that is narrower than the one
    above it is continued by the cells above.  A single root over the whole table is left out of
    longer paths.
    """
    return F.transform(header_leaves(sections), lambda leaf: leaf["path"])


def header_leaves(sections: Column) -> Column:
    """``lo, hi, path`` of every leaf column: the columns it covers, half-open, and its header path."""

    def build(env: Column) -> Column:
        levels, width = env["levels"], env["width"]

        def leaves_of(level: Column, i: Column) -> Column:
            def in_level(deeper: Column) -> Column:
                open_end = F.filter(level, lambda h: (h["hi"] > deeper) & (h["hi"] > h["lo"]))
                return F.transform(open_end, lambda h: F.greatest(h["lo"], deeper))

            return bind(F.coalesce(F.array_max(F.slice(width, i + 2, F.size(width))), F.lit(0)), in_level)

        leaves = F.flatten(F.reverse(F.transform(levels, leaves_of)))
        first = F.get(levels, 0)
        covered = F.array_max(width) <= F.get(first, 0)["hi"]
        # names start at the second one when a single root spans everything and is not alone
        one_root = F.coalesce((F.size(first) == 1) & covered, F.lit(False))

        def path_of(p: Column, one_root: Column) -> Column:
            names = F.flatten(
                F.transform(
                    levels,
                    lambda lv: F.transform(
                        F.filter(lv, lambda h: (h["lo"] <= p) & (p < h["hi"])), lambda h: h["name"]
                    ),
                )
            )
            cut = bind(names, lambda n: F.when(one_root & (F.size(n) > 1), F.slice(n, 2, F.size(n))).otherwise(n))
            return M.strip_tags(F.array_join(cut, " "))

        def leaf(all_starts: Column, root: Column) -> Column:
            return F.transform(
                all_starts,
                lambda p, i: F.struct(
                    p.alias("lo"),
                    F.coalesce(F.get(all_starts, i + 1), F.array_max(width)).alias("hi"),
                    path_of(p, root).alias("path"),
                ),
            )

        return bind(one_root, lambda root: bind(leaves, lambda starts: leaf(starts, root)))

    def with_width(levels: Column) -> Column:
        width = F.transform(levels, lambda lv: F.array_max(F.transform(lv, lambda h: h["hi"])))
        return bind(F.struct(levels.alias("levels"), width.alias("width")), build)

    return bind(_header_levels(sections), with_width)
