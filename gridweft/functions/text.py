"""Column functions for tokens, n-grams and label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweft.functions.bind import bind


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def split_words(text: Column | str) -> Column:
    """Words between whitespace; an empty text has none."""
    return F.filter(F.split(_col(text), r"\s+"), lambda w: w != "")


def bleu_tokens(text: Column | str) -> Column:
    """The published ``13a`` tokenisation: punctuation apart, except inside numbers."""
    # The rewriting rules of the published tokeniser, in their order.
    rules = (
        (r"<skipped>", ""),
        (r"-\n", ""),
        (r"\n", " "),
        (r"&quot;", '"'),
        (r"&amp;", "&"),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
    )
    line = _col(text)
    for old, new in rules:
        line = F.replace(line, F.lit(old.replace(r"\n", "\n")), F.lit(new))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    line = F.regexp_replace(line, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    line = F.regexp_replace(line, r"([^0-9])([\.,])", "$1 $2 ")
    line = F.regexp_replace(line, r"([\.,])([^0-9])", " $1 $2")
    line = F.regexp_replace(line, r"([0-9])(-)", "$1 $2 ")
    return split_words(line)


def rouge_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(_col(text)), r"[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column | str, n: int) -> Column:
    tokens = _col(tokens)
    last = F.size(tokens) - n
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, n), "\u0001"))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def clipped_matches(left: Column, right: Column) -> Column:
    """Size of the common part of two multisets.

    Both arrays are tagged with their side and sorted together; one pass over the sorted array compares
    the counts of each run of equal elements.
    """

    def tagged(values: Column, side: int) -> Column:
        return F.transform(values, lambda g: F.struct(g.alias("g"), F.lit(side).alias("s")))

    def close(s: Column) -> Column:
        return s["total"] + F.least(s["l"], s["r"])

    def step(s: Column, e: Column) -> Column:
        same = e["g"].eqNullSafe(s["g"])
        base_l, base_r = F.when(same, s["l"]).otherwise(0), F.when(same, s["r"]).otherwise(0)
        return F.struct(
            e["g"].alias("g"),
            (base_l + (1 - e["s"])).alias("l"),
            (base_r + e["s"]).alias("r"),
            F.when(same, s["total"]).otherwise(close(s)).alias("total"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("g"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("total")
    )
    return F.aggregate(F.sort_array(F.concat(tagged(left, 0), tagged(right, 1))), start, step, close)


def common_ngrams(left: Column | str, right: Column | str, n: int) -> Column:
    return bind(
        F.struct(ngrams(left, n).alias("l"), ngrams(right, n).alias("r")),
        lambda p: clipped_matches(p["l"], p["r"]),
    )


def normalize_label(text: Column | str) -> Column:
    """Lower case, ASCII letters and digits only: the 36-symbol alphabet."""
    return F.regexp_replace(F.lower(_col(text)), r"[^0-9a-z]", "")


def missing_word(text: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(text), F.lit("")), F.lit("???"))
