import pytest
from pyspark.sql import functions as F

from gridweft.llm import pii as P


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("write jane dot doe at corp dot com now", "email", "jane dot doe at corp dot com"),
        ("write jane dot q dot doe [at] corp [dot] com now", "email", "jane dot q dot doe [at] corp [dot] com"),
        ("jane at corp dot dev", "email", "jane at corp dot dev"),
        ("jane at firma dot pl, please", "email", "jane at firma dot pl"),
        ("jane at mail dot firma dot com dot pl", "email", "jane at mail dot firma dot com dot pl"),
        ("jane at corp (dot) dev", "email", "jane at corp (dot) dev"),
        ("the dot jane at corp dot dev", "email", "jane at corp dot dev"),
        ("plus vier neun eins fünf eins zwei drei vier fünf sechs", "phone", "plus vier neun eins fünf eins zwei drei vier fünf sechs"),
        ("plus trois trois un deux trois quatre cinq six sept huit", "phone", "plus trois trois un deux trois quatre cinq six sept huit"),
        ("plus tres cuatro seis uno dos tres cuatro cinco seis siete", "phone", "plus tres cuatro seis uno dos tres cuatro cinco seis siete"),
        ("un 4111 1111 one one one one 1111", "card", "4111 1111 one one one one 1111"),
    ],
)
def test_spoken_addresses_and_numbers(text, kind, want):
    base, spans = P.find(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, want)]


def test_words_stay_words():
    for text in ("look at the dot on", "point at each dot in turn", "look at it. Dot the i", "un deux trois", "meet at noon.Then go"):
        assert P.find(text) == ([], [])


@pytest.mark.parametrize(
    "text, plain, whole",
    [
        ("to jane dot doe@corp.com now", "doe@corp.com", "jane dot doe@corp.com"),
        ("to jаne@corp.com now", "ne@corp.com", "jаne@corp.com"),  # the second letter is Cyrillic
        ("to jane@corp.com dot pl", "jane@corp.com", "jane@corp.com dot pl"),
    ],
)
def test_a_span_that_holds_a_plain_one_is_added(spark, text, plain, whole):
    base, spans = P.find(text)
    assert [text[a:b] for _, a, b in base] == [plain]
    assert set(base) < set(spans) and sorted(text[a:b] for _, a, b in spans) == sorted([plain, whole])
    found = spark.createDataFrame([(text,)], "t string").withColumn("r", P.personal_data(F.col("t")))
    assert found.select(P.redact(F.col("t"), F.col("r.spans"))).first()[0] == text.replace(whole, "<email>")


def test_spans_that_cross_a_plain_one_are_not_added():
    base = [("email", 5, 20), ("phone", 8, 30)]
    for span, want in ((("email", 5, 20), False), (("card", 0, 6), False), (("card", 5, 30), True), (("card", 8, 30), False), (("card", 30, 40), True)):
        assert P._adds(span, base, [5, 8], [20, 30]) is want
