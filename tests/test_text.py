"""Text metrics, stems and generation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridweft.functions import text as T
from gridweft.operators import text_scores as X
from gridweft.operators.generation import generate, map_with_errors, template_model
from gridweft.operators.stemming import porter_stem


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "prediction string, reference string")


def test_bleu_of_identical_and_disjoint_text(spark):
    same, none = X.bleu(pairs(spark, ("a b c d e", "a b c d e"), ("x y z w", "a b c d"))).orderBy(F.desc("bleu")).collect()
    assert same["bleu"] == pytest.approx(1.0) and same["length_ratio"] == 1.0
    assert none["bleu"] == 0.0


def test_bleu_clips_and_penalises(spark):
    row = X.bleu(pairs(spark, ("the the the the", "the cat is on the mat"))).first()
    assert row["precision_1"] == pytest.approx(2 / 4)
    assert row["precision_2"] == 0.0 and row["bleu"] == 0.0
    assert row["brevity_penalty"] == pytest.approx(math.exp(1 - 6 / 4))


def test_bleu_tokens(spark):
    row = pairs(spark, ("Wind 7-14 mph, 3.5 in. (north)", "")).select(T.bleu_tokens("prediction").alias("t")).first()
    assert row["t"] == ["Wind", "7", "-", "14", "mph", ",", "3.5", "in", ".", "(", "north", ")"]


def test_empty_prediction(spark):
    row = X.score_text(pairs(spark, ("", "a b")), ["bleu", "rouge"]).first()
    assert row["bleu"] == 0.0 and row["rouge1"] == 0.0 and row["rougeLsum"] == 0.0


def test_rouge(spark):
    row = X.rouge(pairs(spark, ("police kill the gunman", "police killed the gunman")), use_stemmer=True).first()
    assert row["rouge1"] == row["rouge2"] == row["rougeL"] == 1.0
    row = X.rouge(pairs(spark, ("the gunman kill police", "police killed the gunman")), use_stemmer=False).first()
    assert row["rouge1"] == pytest.approx(0.75) and row["rouge2"] == pytest.approx(1 / 3) and row["rougeL"] == pytest.approx(0.5)


def test_rouge_lsum_takes_the_union(spark):
    # the published example: two candidate sentences cover four of five reference words
    row = X.rouge(pairs(spark, ("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5")), use_stemmer=False).first()
    assert row["rougeLsum"] == pytest.approx(2 * 4 / 15)


def test_lcs_against_brute_force():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert X.lcs_length(a, b) == brute(a, b) == len(X.lcs_positions(a, b))


def test_common_ngrams_against_counter(spark):
    from collections import Counter

    rng = random.Random(2)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>")
    got = df.select("l", "r", *[T.common_ngrams("l", "r", n).alias(f"n{n}") for n in (1, 2, 3)]).collect()
    for row in got:
        for n in (1, 2, 3):
            grams = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (row["l"], row["r"])]
            assert row[f"n{n}"] == sum((grams[0] & grams[1]).values())


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("rationally", "ration"), ("formalize", "formal"), ("hopefulness", "hope"),
    ("adjustment", "adjust"), ("probate", "probat"), ("controlled", "control"), ("mostly", "mostli"),
])
def test_stems(word, stem):
    assert porter_stem(word) == stem


def test_metric_names(spark):
    with pytest.raises(ValueError):
        X.score_text(pairs(spark, ("a", "b")), ["meteor"])
    long = X.long_metrics(X.score_text(pairs(spark, ("a b", "a b")), ["bleu", "rouge"]), ["bleu", "rouge"], ["reference"])
    assert long.count() == len(X.BLEU_FIELDS) + len(X.ROUGE_FIELDS)


def test_scoring_needs_no_shuffle(spark):
    plan = X.score_text(pairs(spark, ("a", "b")), ["bleu", "rouge"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_generate_and_errors(spark):
    inputs = spark.createDataFrame([(1, "a | 1 [SEP] b | 2 [X_SEP] a | 3 [SEP] ")], "id int, input string")
    assert generate(inputs, template_model).first()["prediction"] == "The table has 3 values in 2 rows ."
    rows = spark.createDataFrame([(1, 4), (2, 0)], "id int, d int")
    got = {r["key"]: (r["value"], r["error"]) for r in map_with_errors(rows, lambda r: 8 // r["d"], "id").collect()}
    assert got == {1: ("2", None), 2: (None, "ZeroDivisionError")}
