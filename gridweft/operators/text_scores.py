"""BLEU and ROUGE of prediction/reference pairs.

A pair is one row and is scored inside that row, so scoring adds no shuffle whatever the key
distribution is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from gridweft.functions import text as T
from gridweft.operators.stemming import stem_tokens

BLEU_FIELDS = (
    "bleu", "precision_1", "precision_2", "precision_3", "precision_4", "brevity_penalty", "length_ratio",
    "translation_length", "reference_length",
)
ROUGE_FIELDS = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def bleu(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference", order: int = 4) -> DataFrame:
    """Unsmoothed BLEU with one reference per prediction (Papineni et al., 2002)."""
    out = pairs.withColumn("_p", T.bleu_tokens(prediction)).withColumn("_r", T.bleu_tokens(reference))
    out = out.withColumn("translation_length", F.size("_p")).withColumn("reference_length", F.size("_r"))
    for n in range(1, order + 1):
        possible = F.col("translation_length") - (n - 1)
        hits = T.common_ngrams("_p", "_r", n)
        out = out.withColumn(f"precision_{n}", F.when(possible > 0, hits / possible).otherwise(F.lit(0.0)))
    precisions = [F.col(f"precision_{n}") for n in range(1, order + 1)]
    ratio = F.when(
        F.col("reference_length") > 0, F.col("translation_length") / F.col("reference_length")
    )
    out = out.withColumn("length_ratio", ratio)
    penalty = (
        F.when(F.col("translation_length") == 0, F.lit(0.0))
        .when(F.col("translation_length") > F.col("reference_length"), F.lit(1.0))
        .otherwise(F.exp(1.0 - F.col("reference_length") / F.col("translation_length")))
    )
    out = out.withColumn("brevity_penalty", penalty)
    logs = sum((F.log(p) for p in precisions[1:]), F.log(precisions[0])) / order
    score = F.when(F.least(*precisions) > 0, F.exp(logs) * F.col("brevity_penalty")).otherwise(F.lit(0.0))
    return out.withColumn("bleu", score).drop("_p", "_r")


def _f1(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """Harmonic mean of hits over predicted and hits over reference items."""
    return F.when((n_pred > 0) & (n_ref > 0), 2.0 * hits / (n_pred + n_ref)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- longest common subsequence


def _positions(words: list) -> dict:
    masks: dict = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | (1 << i)
    return masks


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word of ``b`` at a time."""
    masks, full = _positions(b), (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def lcs_positions(ref: list, cand: list) -> set[int]:
    """Positions in ``ref`` of one longest common subsequence with ``cand``.

    The prefix rows are kept as bit sets.  Walking back, equal words are taken; on a tie the
    reference word is left out.
    """
    masks, full = _positions(cand), (1 << len(cand)) - 1
    rows = [full]
    for w in ref:
        hit = rows[-1] & masks.get(w, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    found, i, j = set(), len(ref), len(cand)
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(IntegerType())
def summary_hits(ref_sentences: pd.Series, pred_sentences: pd.Series) -> pd.Series:
    """Reference words covered by the union of per-sentence subsequences, clipped by word counts."""
    out = []
    for refs, preds in zip(ref_sentences, pred_sentences):
        if not len(refs) or not len(preds):
            out.append(0)
            continue
        preds = [list(p) for p in preds]
        left = Counter(w for p in preds for w in p)
        hits = 0
        for ref in (list(r) for r in refs):
            covered = set().union(*[lcs_positions(ref, p) for p in preds])
            for i in sorted(covered):
                if left.get(ref[i], 0) > 0:
                    left[ref[i]] -= 1
                    hits += 1
        out.append(hits)
    return pd.Series(out, dtype="int32")


def rouge(
    pairs: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    use_stemmer: bool = True,
    fields: tuple[str, ...] = ROUGE_FIELDS,
) -> DataFrame:
    """F1 of common words, word pairs and the longest common subsequence (Lin, 2004).  A null text scores 0.

    ``rougeLsum`` splits both texts into sentences at line ends; texts of one line have the same value
    as ``rougeL``, so only longer ones go through the union of subsequences.
    """
    stem = stem_tokens if use_stemmer else (lambda c: c)
    out = pairs.withColumn("_p", stem(T.rouge_tokens(prediction))).withColumn("_r", stem(T.rouge_tokens(reference)))
    n_p, n_r = F.size("_p"), F.size("_r")
    for n in (1, 2):
        if f"rouge{n}" in fields:
            hits = T.common_ngrams("_p", "_r", n)
            out = out.withColumn(f"rouge{n}", _f1(hits, n_p - (n - 1), n_r - (n - 1)))
    if "rougeL" in fields or "rougeLsum" in fields:
        out = out.withColumn("_lcs", lcs("_r", "_p")).withColumn("rougeL", _f1(F.col("_lcs"), n_p, n_r))
    if "rougeLsum" in fields:

        def sentences(text: str) -> Column:
            tokens = F.transform(F.split(F.col(text), "\n"), T.rouge_tokens)
            return F.filter(tokens, lambda s: F.size(s) > 0)

        many = F.coalesce(F.col(prediction).contains("\n") | F.col(reference).contains("\n"), F.lit(False))
        out = out.withColumn("_many", many)
        out = _with_sentence_hits(out, sentences(prediction), sentences(reference), use_stemmer)
        hits = F.when(F.col("_many"), F.col("_sum_hits")).otherwise(F.col("_lcs"))
        out = out.withColumn("rougeLsum", _f1(hits, n_p, n_r)).drop("_many", "_sum_hits")
    return out.drop("_p", "_r", "_lcs")


def _with_sentence_hits(df: DataFrame, pred: Column, ref: Column, use_stemmer: bool) -> DataFrame:
    """Sentence arrays travel to Python only for texts of several lines."""
    empty = F.array().cast("array<array<string>>")
    df = df.withColumn("_ps", F.when(F.col("_many"), pred).otherwise(empty))
    df = df.withColumn("_rs", F.when(F.col("_many"), ref).otherwise(empty))
    if use_stemmer:
        df = df.withColumn("_ps", _stem_sentences("_ps")).withColumn("_rs", _stem_sentences("_rs"))
    return df.withColumn("_sum_hits", summary_hits("_rs", "_ps")).drop("_ps", "_rs")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _stem_sentences(sentences: pd.Series) -> pd.Series:
    from gridweft.operators.stemming import porter_stem

    cache: dict[str, str] = {}

    def stem(w: str) -> str:
        if w not in cache:
            cache[w] = porter_stem(w) if len(w) > 3 else w
        return cache[w]

    return sentences.map(lambda rows: [[stem(w) for w in row] for row in rows])


# ---------------------------------------------------------------- by name, long form


METRICS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "bleu": (bleu, BLEU_FIELDS),
    "rouge": (rouge, ROUGE_FIELDS),
}


def score_text(pairs: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """All fields of the named metrics as further columns of the pairs."""
    out = pairs
    for name in names:
        if name not in METRICS:
            raise ValueError(f"unknown metric {name}; known: {', '.join(METRICS)}")
        out = METRICS[name][0](out)
    return out


def long_metrics(scored: DataFrame, names: list[str] | tuple[str, ...], keys: list[str]) -> DataFrame:
    """``keys, metric, value``: one row per metric field."""
    fields = [f for n in names for f in METRICS[n][1]]
    entries = F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).cast("double").alias("value")) for f in fields])
    return scored.select(*keys, F.explode(entries).alias("m")).select(*keys, "m.metric", "m.value")


def wide_metrics(metrics: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Back to one row per prediction; the field list keeps the pivot to one pass."""
    return metrics.groupBy(*keys).pivot("metric", fields).agg(F.max("value"))
