"""Column functions over HTML table text.

Every function maps Columns to Columns.  One document is one row, and a table is taken apart with
regular expressions and array functions inside that row, so parsing causes no shuffle.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweft.functions.bind import bind

SECTION_TAGS = ("thead", "tbody", "tfoot", "caption", "colgroup")
VOID_TAGS = ("area", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "wbr")

MARK = "\u0001"
HIDDEN = "\u0002"
"""Stands for ``<`` inside a table in a cell, so that only the tags of the outer table are cut at."""

_SECTIONS = "|".join(SECTION_TAGS)
_VOID = "|".join(VOID_TAGS)
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
_OPEN_TAG = r"<[A-Za-z][^>]*>"
_CELL_END = r"/t(?:[dhr]|head|body|foot)\s*>"
# runs without a way back (possessive), so each is found in one pass over the markup
_CELL = rf"(?i)<t[dh](?=[\s/>])(?:[^<]++|<(?!t[dh][\s/>]|{_CELL_END}))*+"
# the end tag of the section is left to no row, so that a row is the same text at the end and before it; it may end a broken start tag
_ROW = r"(?i)<tr(?=[\s/>])(?:[^<]++|<(?!tr[\s/>])(?!(?<=><)/t(?:head|body|foot)\s*>\z))*+"
_SECTION_END = rf"</(?:{_SECTIONS})\s*>"
_SECTION = rf"(?i){_SECTION_END}|(?:[^<]++|<)(?:[^<]++|<(?!(?:{_SECTIONS})[\s/>])(?!{_SECTION_END[1:]}))*+(?:{_SECTION_END})?"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---------------------------------------------------------------- documents


def strip_comments(html: Column | str) -> Column:
    """The document without comments and without the control characters that mark cuts and hidden tags."""
    html = _col(html)
    html = F.when(html.contains(MARK) | html.contains(HIDDEN), F.translate(html, MARK + HIDDEN, "")).otherwise(html)
    return F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?-->", "")).otherwise(html)


def wrap_document(rows_html: Column | str) -> Column:
    """Bare table content to a complete document."""
    return F.concat(F.lit("<html><body><table>"), _col(rows_html), F.lit("</table></body></html>"))


def table_markup(clean: Column | str) -> Column:
    """Text between the first ``<table>`` and its own end tag; the input has no comments.

    Tables inside it are content of the cell that holds them: each ``<`` from the start tag of an inner table to its end tag is
    ``HIDDEN``.  A table without an end tag goes on to the end of the document.
    """
    clean = _col(clean)
    # a possessive run up to the end tag: one look at each character, no way back
    single = F.regexp_extract(clean, r"(?i)<table(?:\s[^>]*)?>((?:[^<]++|<(?!/table\s*>))*+)", 1)
    return F.when(F.regexp_count(clean, F.lit(r"(?i)<table[\s>]")) > 1, bind(clean, _outer_markup)).otherwise(single)


def _outer_markup(clean: Column) -> Column:
    """The balanced scan: a running depth over the start and end tags of tables."""
    pieces = F.split(F.regexp_replace(clean, r"(?i)<(?=/?table[\s>])", MARK + "<"), MARK)
    hidden = lambda text: F.replace(text, F.lit("<"), F.lit(HIDDEN))

    def step(state: Column, piece: Column) -> Column:
        depth, ended = state["depth"], state["ended"]
        closes = piece.startswith("</")
        size = F.when(closes, F.instr(piece, ">")).otherwise(0)  # of the end tag, which belongs to the inner table
        tag, rest = F.substr(piece, F.lit(1), size), F.substr(piece, size + 1)
        inner = F.when(closes, F.concat(hidden(tag), F.when(depth > 2, hidden(rest)).otherwise(rest))).otherwise(hidden(piece))
        opened = F.regexp_replace(piece, r"(?s)\A<[^>]*>", "")
        added = F.when(closes, F.when(depth > 1, inner).otherwise("")).when(depth == 0, opened).otherwise(inner)
        after = F.struct(
            (depth + F.when(closes, -1).otherwise(1)).alias("depth"),
            (closes & (depth <= 1)).alias("ended"),
            F.concat(state["text"], added).alias("text"),
        )
        return F.when(ended | (closes & (depth == 0)), state).otherwise(after)

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("ended"), F.lit("").alias("text"))
    tables = F.slice(pieces, 2, F.size(pieces))
    return F.aggregate(tables, start, step, lambda state: state["text"])


def restored(text: Column | str) -> Column:
    """Content with the tags of inner tables; what follows an inner cell in its row belongs to no cell and goes."""
    text = _col(text)
    shown = F.regexp_replace(F.translate(text, HIDDEN, "<"), r"(?i)(</td\s*>)[^<]+", "$1")
    return F.when(text.contains(HIDDEN), shown).otherwise(text)


def table_status(clean: Column | str) -> Column:
    """``ok``, ``empty`` or ``no_table`` of a document.

    The table has to be a direct child of the body of a full document.  Before it, every element that
    was opened must have been closed again; a paragraph is closed by the table itself.
    """
    clean = _col(clean)
    lead = F.regexp_extract(clean, r"(?is)\A(.*?)<table[\s>]", 1)
    lead = F.regexp_replace(lead, r"(?is)\A.*<body(?:\s[^>]*)?>", "")
    lead = F.regexp_replace(lead, r"(?is)\A\s*<!doctype[^>]*>|<head[\s>].*?</head\s*>|<html(?:\s[^>]*)?>", "")
    lead = F.regexp_replace(lead, rf"(?is)<(?:script|style)[\s>].*?</(?:script|style)\s*>", "")
    lead = F.regexp_replace(lead, rf"(?i)</?(?:{_VOID}|p)(?:\s[^>]*|/)?>|<[^>]*/>", "")
    opened = F.regexp_count(lead, F.lit(_OPEN_TAG))
    closed = F.regexp_count(lead, F.lit(r"</[A-Za-z][^>]*>"))
    # nothing but the start tags of document and body before the table: no need to look at the rest
    bare = r"(?i)\A\s*<html(?:\s[^<>]*)?>\s*<body(?:\s[^<>]*)?>\s*<table[\s>]"
    return (
        F.when(clean.isNull() | (clean == ""), "empty")
        .when(clean.rlike(bare), "ok")
        .when(~clean.rlike(r"(?i)\A\s*<(?:html|!doctype)"), "no_table")
        .when(~clean.rlike(r"(?i)<table[\s>]"), "no_table")
        .when(opened != closed, "no_table")
        .otherwise("ok")
    )


def node_count(markup: Column | str) -> Column:
    """All elements below the table, inline elements and those of inner tables included."""
    return F.regexp_count(_col(markup), F.lit(f"[<{HIDDEN}][A-Za-z]"))


# ---------------------------------------------------------------- text


def _decode_entity(token: Column) -> Column:
    named = F.create_map(*[F.lit(x) for name, point in name2codepoint.items() for x in (name, chr(point))])
    digits = F.regexp_extract(token, r"\A&#[xX]?([0-9a-fA-F]+);\z", 1)
    point = (
        F.when(token.rlike(r"\A&#0*[0-9]{1,9};"), digits.cast("decimal(38,0)").cast("int"))
        .when(token.rlike(r"\A&#[xX]0*[0-9a-fA-F]{1,7};"), F.conv(F.right(digits, F.lit(7)), 16, 10).cast("int"))
        .otherwise(F.lit(0))
    )
    char = bind(
        point, lambda p: F.when(p.between(1, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    )
    by_name = F.try_element_at(named, F.substring(token, F.lit(2), F.length(token) - 2))
    return F.coalesce(F.when(token.startswith("&#"), char).otherwise(by_name), token)


def decode_entities(text: Column | str) -> Column:
    """Character references to characters; unknown names stay as they are."""
    text = _col(text)
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){_ENTITY}|[^&]+|&"), F.lit(0))
    decoded = F.transform(parts, lambda t: F.when(t.startswith("&"), _decode_entity(t)).otherwise(t))
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def normalize_inline(inner: Column | str) -> Column:
    """Inline tags in one spelling: lower case, no attributes, void elements with an end tag."""
    inner = _col(inner)
    bare = F.regexp_replace(inner, r"<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>", "<$1$2>")
    parts = F.regexp_extract_all(bare, F.lit(r"(?s)<[^>]*>|[^<]+|<"), F.lit(0))
    lowered = F.array_join(F.transform(parts, lambda t: F.when(t.startswith("<"), F.lower(t)).otherwise(t)), "")
    closed = F.regexp_replace(lowered, rf"<({_VOID})>(?:</\1>)?", "<$1></$1>")
    closed = F.regexp_replace(closed, r"</unk>", "")
    uncommon = rf"<(?!/?[a-z][a-z0-9]*>)|<(?:{_VOID})>|</unk>"
    return F.when(~inner.contains("<"), inner).when(~inner.rlike(uncommon), inner).otherwise(closed)


def cell_tokens(norm: Column | str) -> Column:
    """Cell content as single characters and whole inline tags, entities decoded."""
    raw = F.regexp_extract_all(_col(norm), F.lit(rf"(?s)<[^>]+>|{_ENTITY}|."), F.lit(0))
    return F.transform(raw, lambda t: F.when(t.rlike(rf"\A{_ENTITY}\z"), _decode_entity(t)).otherwise(t))


def strip_tags(text: Column | str) -> Column:
    """Remove everything from ``<`` to the next ``>`` on the same line."""
    return F.regexp_replace(_col(text), r"(?d)<.*?>", "")


def cell_text(norm: Column | str) -> Column:
    return strip_tags(decode_entities(norm))


def header_name(norm: Column | str) -> Column:
    """Text of a header cell; an empty cell is called ``Unknown``."""
    norm = _col(norm)
    return F.when(F.length(norm) == 0, F.lit("Unknown")).otherwise(cell_text(norm))


def unwrap_tags(text: Column | str, tags: list[str] | tuple[str, ...]) -> Column:
    """Drop the given inline tags and keep what they enclose."""
    if not tags:
        return _col(text)
    return F.regexp_replace(_col(text), rf"(?i)</?(?:{'|'.join(tags)})(?:\s[^>]*|/)?>", "")


# ---------------------------------------------------------------- structure


def _span(open_tag: Column, name: str) -> Column:
    value = F.regexp_extract(open_tag, rf"(?i)\s{name}\s*=\s*[\"']?\s*([0-9]+)", 1)
    # a number beyond all tables stands for the largest one
    number = F.coalesce(value.try_cast("int"), F.lit(2**31 - 1))
    return F.when(open_tag.rlike(rf"(?i)\s{name}\s*=\s*[\"']?\s*[0-9]"), number).otherwise(F.lit(1))


def _cells(row_markup: Column) -> Column:
    # a cell ends where the next one starts, so end tags may be missing
    def cell(c: Column) -> Column:
        end = F.instr(c, ">")  # of the start tag
        spans = [F.when(end > 4, _span(F.substr(c, F.lit(1), end), name)).otherwise(F.lit(1)).alias(name) for name in ("colspan", "rowspan")]
        norm = bind(restored(F.substr(c, end + 1)), normalize_inline)
        return F.struct(F.lower(F.substring(c, 2, 2)).alias("tag"), *spans, norm.alias("norm"))

    def cells(found: Column) -> Column:
        whole = F.forall(found, lambda c: c.contains(">"))
        return F.when(whole, F.transform(found, cell)).otherwise(_cells_of_broken_tags(row_markup))

    return bind(F.regexp_extract_all(row_markup, F.lit(_CELL), F.lit(0)), cells)


def _cells_of_broken_tags(row_markup: Column) -> Column:
    """The same for start tags that do not end, or not before an end tag."""
    chunks = F.filter(_cut_before(row_markup, "t[dh]"), lambda c: c.rlike(r"(?i)\A<t[dh][\s/>]"))
    split_up = F.transform(
        chunks,
        lambda c: F.struct(
            F.regexp_extract(c, r"\A<[^>]*>", 0).alias("open"),
            F.regexp_replace(c, rf"(?is)<{_CELL_END}.*\z", "").alias("text"),
        ),
    )
    one = F.lit(1)

    def cell(c: Column) -> Column:
        inner = F.substring(c["text"], F.length(c["open"]) + 1, F.length(c["text"]))
        return F.struct(
            F.lower(F.substring(c["open"], 2, 2)).alias("tag"),
            F.when(F.length(c["open"]) > 4, _span(c["open"], "colspan")).otherwise(one).alias("colspan"),
            F.when(F.length(c["open"]) > 4, _span(c["open"], "rowspan")).otherwise(one).alias("rowspan"),
            bind(restored(inner), normalize_inline).alias("norm"),
        )

    return F.transform(split_up, cell)


def _cut_before(markup: Column, names: str) -> Column:
    """Pieces that start at each opening tag of the given names; the first piece is what comes before.

    The tags are marked with a control character first.  Splitting at a look-ahead would test it at every
    character.
    """
    return F.split(F.regexp_replace(markup, rf"(?i)<(?=(?:{names})[\s/>])", MARK + "<"), MARK)


def table_sections(markup: Column | str) -> Column:
    """Nested arrays: sections, their rows and the cells of each row.

    ``ARRAY<STRUCT<section, kids, rows: ARRAY<ARRAY<STRUCT<tag, colspan, rowspan, norm>>>>>``.  Rows
    outside any section get the section name ``''``; ``kids`` are the tag names of parts without rows
    (caption, column groups).  The markup must not contain the control character ``MARK``.
    """
    return _with_cells(F.transform(_section_chunks(_col(markup)), _cut_section))


def differing_sections(a: Column, b: Column, tails: bool = True) -> Column:
    """``head, t, p, row_head, row_ends``: the sections of two tables without what has the same text at the head and the tail of both.

    Whole sections go first; where a single section is left on either side, equal rows at its head and tail go too.  What is left
    out is not taken apart, and a row with the text of the one at its place in the other table only once.  ``head`` and ``row_head``
    count the sections and rows left out before the others, ``row_ends`` all rows left out; without ``tails`` the tails of the
    sections stay.
    """

    def rows_cut(c: Column) -> Column:
        def one(s: Column, rows: Column) -> Column:
            return F.array(F.struct(s["section"].alias("section"), s["kids"].alias("kids"), rows.alias("rows")))

        t, p = F.get(c["t"], 0), F.get(c["p"], 0)
        cut = bind(
            differing(t["rows"], p["rows"]),
            lambda r: F.struct(
                c["head"].alias("head"), one(t, r["t"]).alias("t"), one(p, r["p"]).alias("p"), r["head"].alias("row_head"),
                (F.size(t["rows"]) - F.size(r["t"])).alias("row_ends"),
            ),
        )
        whole = c.withField("row_head", F.lit(0)).withField("row_ends", F.lit(0))
        return F.when((F.size(c["t"]) == 1) & (F.size(c["p"]) == 1), cut).otherwise(whole)

    def sections_cut(c: Column) -> Column:
        t, p = F.transform(c["t"], _cut_section), F.transform(c["p"], _cut_section)
        return F.struct(c["head"].alias("head"), t.alias("t"), p.alias("p"))

    def cells_cut(c: Column) -> Column:
        def both(t: Column) -> Column:
            def row(r: Column, s: Column, i: Column) -> Column:
                return F.when(r == F.get(F.get(c["t"], s)["rows"], i), F.get(F.get(t, s)["rows"], i)).otherwise(_cells(r))

            p = F.transform(c["p"], lambda x, s: x.withField("rows", F.transform(x["rows"], lambda r, i: row(r, s, i))))
            return c.withField("t", t).withField("p", p)

        return bind(_with_cells(c["t"]), both)

    chunks = differing(_section_chunks(a), _section_chunks(b), tails)
    return bind(bind(bind(chunks, sections_cut), rows_cut), cells_cut)


def differing(a: Column, b: Column, tails: bool = True) -> Column:
    """``head, t, p``: two arrays without their equal heads and tails, and how long the head was."""

    def cut(e: Column) -> Column:
        t, p, both = e["t"], e["p"], F.least(F.size(e["t"]), F.size(e["p"]))

        def equal(x: Column, y: Column) -> Column:
            first = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False).cast("int")
            return bind(first, lambda first: F.when(first == 0, both).otherwise(first - 1))

        def rest(n: Column) -> Column:
            kept = lambda x: F.slice(x, n["head"] + 1, F.size(x) - n["head"] - n["tail"])
            return F.struct(n["head"].alias("head"), kept(t).alias("t"), kept(p).alias("p"))

        tail = equal(F.reverse(t), F.reverse(p)) if tails else F.lit(0)
        ends = F.struct(equal(t, p).alias("head"), tail.alias("tail"))
        return bind(ends, lambda n: bind(n.withField("tail", F.least(n["tail"], both - n["head"])), rest))

    return bind(F.struct(a.alias("t"), b.alias("p")), cut)


def _section_chunks(markup: Column) -> Column:
    """Pieces that begin at a start tag of a section or behind an end tag, and hold elements."""
    return F.filter(F.regexp_extract_all(markup, F.lit(_SECTION), F.lit(0)), lambda c: c.rlike(r"<[A-Za-z]"))


def _cut_section(c: Column) -> Column:
    """Name, kids and the markup of each row."""
    below = F.regexp_replace(c, rf"(?i)\A\s*<(?:{_SECTIONS})(?:\s[^>]*|/)?>", "")
    names = F.regexp_extract_all(below, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    no_kids = F.array().cast("array<string>")
    return F.struct(
        F.lower(F.regexp_extract(c, rf"(?i)\A\s*<({_SECTIONS})[\s/>]", 1)).alias("section"),
        F.when(c.rlike(r"(?i)<tr[\s/>]"), no_kids).otherwise(F.transform(names, F.lower)).alias("kids"),
        F.regexp_extract_all(c, F.lit(_ROW), F.lit(0)).alias("rows"),
    )


def _with_cells(cut: Column) -> Column:
    return F.transform(cut, lambda s: s.withField("rows", F.transform(s["rows"], _cells)))
