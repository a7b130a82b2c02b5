"""Repeated runs of lines, found by winnowing, with DataFrame operations only.

The lines of a document that hold anything but white space form its sequence; other lines are passed over and kept.  A run of them
that also starts earlier (in a document with a smaller id, or further up in the same document) is deleted when it has ``RUN`` lines or
more than ``WORDS`` words.  So a window is ``RUN`` lines of the sequence in a row, or fewer with more than ``WORDS`` words, and a line is deleted when it
lies in a window that also starts earlier.

Each window of ``RUN`` lines is represented by its fingerprint: the smallest hash among its ``WINDOW`` grams of ``GRAM`` lines, the first one on a
tie (``RUN = WINDOW + GRAM - 1``, so every repeated run of ``RUN`` lines shares a fingerprint for certain).  Windows of a document
with the same fingerprint at the same place follow one another, and together span a short stretch of lines around it.  Shorter windows
are compared as they are.

Positions are joined by fingerprint.  Where the whole stretch equals an earlier one, all its windows are repeats.  First stretches
that share a fingerprint with different stretches are extended both ways one window at a time.  No pairs inside a group of equal
fingerprints are formed; groups meet in aggregates that combine before they shuffle, so a line that a third of all documents share
costs one row a document.  Lines and windows are compared by 128 bits of hash.

Null texts stay null and empty ones empty; both have no lines.  Rows with the same id and text are one document, and all are edited
alike; rows with the same id and different texts are documents ordered by a hash of the text.  A row without an id is first in the
order and is never edited.  A document whose lines all go keeps its row with what is left of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.session import materialize

RUN = 3
GRAM = 2
WINDOW = RUN - GRAM + 1
WORDS = 50

BLANK = r"\A[ \t\x0b\f\r]*\z"
_DOC = ["doc_id", "version"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """Lines that are not blank, with their places."""
    placed = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    return F.filter(placed, lambda x: ~F.rlike(x["line"], F.lit(BLANK)))


def stretches(docs: DataFrame) -> DataFrame:
    """One row for each fingerprint of each document, with its stretch of windows; no shuffle.

    ``docs`` has ``doc_id``, ``version`` and ``text``.  A window has its start ``q`` (counting lines that are not blank, from 0) and its
    hashes ``h`` and ``k``.  Rows with a ``size`` below ``RUN`` are single windows of so many lines, without fingerprint or list.
    """
    held = docs.select(*_DOC, _filled(_lines(F.col("text"))).alias("lines")).filter(F.size("lines") > 0)
    hashed = held.select(
        *_DOC,
        # two hashes of each line, and its words
        F.transform(
            "lines",
            lambda x: F.struct(
                F.xxhash64(x["line"]).alias("h"),
                F.xxhash64(F.lit("second"), x["line"]).alias("k"),
                F.size(F.regexp_extract_all(x["line"], F.lit(r"[^ \t\x0b\f\r]+"), F.lit(0))).alias("words"),
            ),
        ).alias("hs"),
    )
    line = lambda i: F.get("hs", i)
    # a document with fewer lines has no windows of RUN lines
    starts = lambda size: F.when(F.size("hs") >= size, F.sequence(F.lit(0), F.size("hs") - size)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts(GRAM), lambda i: F.xxhash64(*(line(i + j)["h"] for j in range(GRAM))))
    grammed = hashed.select(*_DOC, "hs", grams.alias("grams"))
    # the smallest gram of a window; structs compare by hash, then by place
    least = lambda q: F.array_min(
        F.transform(F.slice("grams", q + 1, WINDOW), lambda g, j: F.struct(g.alias("gram"), (q + j).alias("place")))
    )
    windows = F.transform(
        starts(RUN),
        lambda q: F.struct(
            q.alias("q"),
            least(q).alias("least"),
            F.xxhash64(*(line(q + j)["h"] for j in range(RUN))).alias("h"),
            F.xxhash64(F.lit("second"), *(line(q + j)["k"] for j in range(RUN))).alias("k"),
        ),
    )
    short = F.concat(*(_short_windows(size) for size in range(1, RUN)))
    listed = grammed.select(*_DOC, windows.alias("ws"), short.alias("short"))
    window = lambda i: F.get("ws", i)
    # windows with the same fingerprint follow one another, at most WINDOW of them
    first = F.filter("ws", lambda w, i: (i == 0) | (window(i - 1)["least"] != w["least"]))
    same = lambda w: F.filter(F.slice("ws", w["q"] + 1, WINDOW), lambda x: x["least"] == w["least"])
    cut = F.transform(
        first,
        lambda w: F.struct(
            F.lit(RUN).alias("size"),
            w["least"]["gram"].alias("gram"),
            w["q"].alias("start"),
            F.transform(same(w), lambda x: x.dropFields("least")).alias("windows"),
            F.xxhash64(F.transform(same(w), lambda x: x["h"])).alias("h"),
            F.xxhash64(F.lit("second"), F.transform(same(w), lambda x: x["k"])).alias("k"),
        ),
    )
    return listed.select(*_DOC, F.explode(F.concat(cut, "short")).alias("s")).select(*_DOC, "s.*")


def _short_windows(size: int) -> Column:
    """Windows of ``size`` lines with more than ``WORDS`` words, as rows of ``stretches``.

    Those whose lines all have more are left out: such lines are windows of their own and repeat as often.
    """
    line = lambda i: F.get("hs", i)

    def wordy(q: Column) -> Column:
        words = line(q)["words"]
        for j in range(1, size):
            words = words + line(q + j)["words"]
        least = line(q)["words"] if size == 1 else F.least(*(line(q + j)["words"] for j in range(size)))
        return (q + size <= F.size("hs")) & (words > WORDS) & (least <= (WORDS if size > 1 else 2**31 - 1))

    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size("hs") - 1), wordy),
        lambda q: F.struct(
            F.lit(size).alias("size"),
            F.lit(None).cast("long").alias("gram"),
            q.alias("start"),
            F.lit(None).cast("array<struct<q: int, h: bigint, k: bigint>>").alias("windows"),
            F.xxhash64(F.lit(size), *(line(q + j)["h"] for j in range(size))).alias("h"),
            F.xxhash64(F.lit("second"), F.lit(size), *(line(q + j)["k"] for j in range(size))).alias("k"),
        ),
    )


def _later(windows: DataFrame) -> DataFrame:
    """Those of ``windows`` (``q``, ``size``, ``h``, ``k``) whose hashes stand earlier too."""
    oldest = windows.groupBy("h", "k").agg(F.min(F.struct(*_DOC, "q")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return windows.join(oldest, ["h", "k"]).filter(F.struct(*_DOC, "q") > F.col("first")).select(*_DOC, "q", "size")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``version``, start ``q`` and ``size`` of every window that starts earlier too."""
    every = materialize(stretches(docs), "line-stretches")
    short = every.filter(F.col("size") < RUN).select(*_DOC, F.col("start").alias("q"), "size", "h", "k")
    found = every.filter(F.col("size") == RUN).drop("size")
    key = ["gram", "h", "k"]
    place = [*_DOC, "start"]
    firsts = materialize(
        found.groupBy(*key).agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")), "line-first-stretches"
    )
    later = found.join(firsts.filter("n > 1").select(*key, "first"), key).filter(F.struct(*place) > F.col("first"))
    whole = later.select(*_DOC, F.explode("windows.q").alias("q"), F.lit(RUN).alias("size"))
    # fingerprints that stand in different stretches: the first ones are compared window by window
    mixed = firsts.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
    heads = firsts.join(mixed, "gram", "left_semi").select(*key, "first.*")
    ones = found.join(heads, [*key, *place], "left_semi").select(*_DOC, F.explode("windows").alias("w")).select(*_DOC, "w.*")
    return whole.union(_later(ones.withColumn("size", F.lit(RUN)))).union(_later(short))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with repeated runs deleted from ``text``, and ``n_lines`` (not blank), ``n_removed``
    and ``n_runs``.  All other columns stay; columns of those three names are replaced."""
    inputs = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    keyed = docs.select(*inputs, F.xxhash64("text").alias("__version"))
    repeated = repeated_windows(keyed.select("doc_id", F.col("__version").alias("version"), "text"))
    numbers = F.sequence("q", F.col("q") + F.col("size") - 1)
    by_document = repeated.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__version")).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(numbers)))).alias("__qs")
    )  # no longer than the document
    joined = keyed.withColumn("__id", F.col("doc_id")).join(by_document, ["__id", "__version"], "left")
    lines, qs = _lines(F.col("text")), F.col("__qs")
    joined = joined.withColumn("__at", F.when(qs.isNotNull(), F.transform(_filled(lines), lambda x: x["at"])))
    joined = joined.withColumn("__gone", F.transform(qs, lambda q: F.get("__at", q)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    breaks = F.filter(qs, lambda q, i: (i == 0) | (q > F.get(qs, i - 1) + 1))
    counted = joined.withColumns(
        {
            "n_lines": F.size(_filled(lines)).cast("long"),
            "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            "n_runs": F.coalesce(F.size(breaks), F.lit(0)).cast("long"),
        }
    )
    text = F.when(qs.isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return counted.withColumn("text", text).select(*inputs, "n_lines", "n_removed", "n_runs")
