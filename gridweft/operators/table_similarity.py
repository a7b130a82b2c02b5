"""Tree-edit similarity of a predicted and a true table.

The edit distance keeps levels: sections are aligned with sections, rows with rows, cells with cells.  It
is never below the unrestricted tree distance and equal to it whenever the best mapping
keeps the levels, so the score ``teds_aligned`` is a lower bound of the unrestricted score, which
``score_tables(..., unrestricted=True)`` computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.functions import markup as M
from gridweft.functions.alignment import edit_ratio
from gridweft.functions.bind import bind
from gridweft.operators.cells import with_markup
from gridweft.operators.pair_distance import distances


def pair_tables(true: DataFrame, pred: DataFrame, how: str = "left") -> DataFrame:
    """Truth and prediction side by side on ``file``; a missing prediction is an empty document.

    ``how='left'`` starts from the truth, ``how='inner'`` keeps files present on both sides.  Scoring costs
    far more time per byte than the join, so the join keeps all shuffle partitions; adaptive
    execution would merge them by size.
    """
    n = int(true.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = true.select("file", F.col("html").alias("true_html")).repartition(n, "file")
    p = pred.select("file", F.col("html").alias("pred_html")).repartition(n, "file")
    return t.join(p, "file", how).withColumn("pred_html", F.coalesce("pred_html", F.lit("")))


def unmatched_predictions(true: DataFrame, pred: DataFrame) -> DataFrame:
    return pred.join(true.select("file"), "file", "left_anti").select("file")


# ---------------------------------------------------------------- encoding


def _inline_tags(sections: Column) -> Column:
    """All inline tags of a table, opening and closing, plus tags of parts without rows."""
    rows = F.flatten(F.transform(sections, lambda s: s["rows"]))
    tagged = F.flatten(F.transform(rows, lambda r: F.filter(r["norm"], lambda n: n.contains("<"))))
    in_cells = F.flatten(
        F.transform(F.array_distinct(tagged), lambda n: F.regexp_extract_all(n, F.lit(r"</?[a-z][a-z0-9]*>"), F.lit(0)))
    )
    others = F.flatten(
        F.transform(sections, lambda s: F.transform(s["kids"], lambda k: F.concat(F.lit("<"), k, F.lit(">"))))
    )
    return F.concat(in_cells, others)


def _tag_codes(true_sections: Column, pred_sections: Column) -> Column:
    """One private-use character for each distinct tag of the pair, so that it counts as one symbol."""
    tags = F.array_distinct(F.concat(_inline_tags(true_sections), _inline_tags(pred_sections)))
    return F.transform(
        tags,
        lambda t, i: F.struct(
            t.alias("tag"), F.decode(F.unhex(F.lpad(F.hex(i + F.lit(0x100000)), 8, "0")), "UTF-32").alias("code")
        ),
    )


def _encode(text: Column, codes: Column) -> Column:
    swapped = lambda text: F.aggregate(codes, text, lambda s, c: F.replace(s, c["tag"], c["code"]))
    return bind(text, lambda text: F.when(text.contains("<"), swapped(text)).otherwise(text))


def _weighted(sections: Column, codes: Column, cell_tags: tuple[str, ...], structure_only: bool) -> Column:
    """The nested table with comparable cells and the number of nodes below each part."""
    nothing, one = F.lit(""), F.lit(1)

    def cell(c: Column) -> Column:
        def coded(colspan: Column, rowspan: Column, text: Column, kids: Column) -> Column:
            values = {"tag": c["tag"], "colspan": colspan, "rowspan": rowspan, "text": text, "kids": kids}
            return F.struct(*(v.alias(name) for name, v in values.items()))

        def plain(norm: Column) -> Column:
            return F.when(norm.contains("<") | norm.contains("&"), bind(_encode(norm, codes), M.decode_entities)).otherwise(norm)

        opened = F.array_join(F.regexp_extract_all(c["norm"], F.lit(r"<[a-z][a-z0-9]*>"), F.lit(0)), "")
        text = nothing if structure_only else plain(c["norm"])
        return F.when(c["tag"].isin(*cell_tags), coded(c["colspan"], c["rowspan"], text, nothing)).otherwise(
            coded(one, one, nothing, _encode(opened, codes))
        )

    def row(cells: Column) -> Column:
        weights = F.transform(cells, lambda c: F.lit(1.0) + F.length(c["kids"]))
        return F.struct(cells.alias("cells"), weights.alias("weights"))

    def with_row_weight(r: Column) -> Column:
        return F.lit(1.0) + F.aggregate(r["weights"], F.lit(0.0), lambda a, w: a + w)

    def section(s: Column) -> Column:
        kids = F.array_join(F.transform(s["kids"], lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "")
        rows = F.transform(F.transform(s["rows"], lambda r: F.transform(r, cell)), row)
        return F.struct(s["section"].alias("section"), _encode(kids, codes).alias("kids"), rows.alias("rows"))

    def section_weight(s: Column) -> Column:
        own = F.when(s["section"] == "", F.lit(0.0)).otherwise(F.lit(1.0))
        return own + F.length(s["kids"]) + F.aggregate(s["row_weights"], F.lit(0.0), lambda a, w: a + w)

    built = F.transform(F.transform(sections, section), lambda s: s.withField("row_weights", F.transform(s["rows"], with_row_weight)))
    return F.transform(built, lambda s: F.struct(s.alias("part"), section_weight(s).alias("weight")))


# ---------------------------------------------------------------- costs


def cell_cost(a: Column, b: Column) -> Column:
    """Replacing one cell: 1 if tag or span differ, else the normalised edit distance of the contents."""
    differs = (a["tag"] != b["tag"]) | (a["colspan"] != b["colspan"]) | (a["rowspan"] != b["rowspan"])
    own = F.when(differs, F.lit(1.0)).otherwise(edit_ratio(a["text"], b["text"]))
    return F.when(a == b, F.lit(0.0)).otherwise(own + F.levenshtein(a["kids"], b["kids"]))


def coded_sides(
    true_sections: Column,
    pred_sections: Column,
    cell_tags: tuple[str, ...] = ("td",),
    structure_only: bool = False,
) -> Column:
    """Both tables of a pair, ``t`` and ``p``, with comparable cells and weights."""
    return bind(
        _tag_codes(true_sections, pred_sections),
        lambda codes: F.struct(
            _weighted(true_sections, codes, cell_tags, structure_only).alias("t"),
            _weighted(pred_sections, codes, cell_tags, structure_only).alias("p"),
        ),
    )


# ---------------------------------------------------------------- scores


def score_tables(
    pairs: DataFrame,
    structure_only: bool = False,
    cell_tags: tuple[str, ...] = ("td",),
    ignore_tags: tuple[str, ...] = (),
    unrestricted: bool = False,
) -> DataFrame:
    """Add ``n_true, n_pred, distance, score, flag`` to pairs of documents.

    The distance keeps levels, or is the unrestricted tree distance (``unrestricted``), the one of published scores: there a row may
    also move between sections, so that a missing ``thead`` costs one node.

    An empty or unusable side scores 0.  A pair without any node has no score and the flag
    ``no_nodes``.  Each pair is one row; nothing is shuffled here.

    Parts with the same text at the head and the tail of both tables are not taken apart: replacing
    costs at least the difference of two weights, so pairing equal ends is never worse than leaving them open.
    """
    t = with_markup(pairs, "true_html", ignore_tags)
    t = t.withColumnsRenamed({"status": "t_status", "n_nodes": "n_true", "_markup": "t_markup"})
    # a prediction equal to the truth is not parsed again
    t = t.withColumn("_same", F.col("true_html") == F.col("pred_html"))
    t = t.withColumn("_other", F.when(F.col("_same"), F.lit("")).otherwise(F.col("pred_html")))
    both = with_markup(t, "_other", ignore_tags)
    both = both.withColumnsRenamed({"status": "_status", "n_nodes": "_nodes", "_markup": "p_markup"})
    both = both.withColumn("p_status", F.when(F.col("_same"), F.col("t_status")).otherwise(F.col("_status")))
    both = both.withColumn("n_pred", F.when(F.col("_same"), F.col("n_true")).otherwise(F.col("_nodes")))
    usable = (F.col("t_status") == "ok") & (F.col("p_status") == "ok")
    differ = usable & ~F.col("_same") & (F.col("t_markup") != F.col("p_markup"))
    # only pairs that differ are sent to Python
    sides = (F.when(differ, F.col(f"{side}_markup")) for side in ("t", "p"))
    both = both.withColumn("_distance", distances(*sides, cell_tags, structure_only, unrestricted))
    distance = F.coalesce("_distance", F.lit(0.0))
    out = both.withColumn("distance", F.when(usable, distance))
    nodes = F.greatest("n_true", "n_pred")
    score = F.when(~usable, F.lit(0.0)).when(nodes > 0, F.lit(1.0) - F.col("distance") / nodes)
    flag = F.when(~usable, F.concat_ws("/", "t_status", "p_status")).when(nodes == 0, "no_nodes").otherwise("ok")
    return out.withColumn("score", score).withColumn("flag", flag).drop(
        "t_markup", "p_markup", "t_status", "p_status", "_same", "_other", "_status", "_nodes", "_distance"
    )


def score_against_truth(true: DataFrame, pred: DataFrame, how: str = "left", **options) -> DataFrame:
    """Join both sides on the file name and score every pair."""
    return score_tables(pair_tables(true, pred, how), **options).drop("true_html", "pred_html")
