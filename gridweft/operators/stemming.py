"""Stems for a vocabulary, following the published suffix-stripping algorithm (Porter, 1980).

The common later departures are included: a list of irregular words, ``ies``/``ied`` after one letter,
``y`` after a consonant, and the suffixes ``bli``, ``alli``, ``fulli``, ``logi``.  Only words of more than
three letters are stemmed.  The work is done once per distinct word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Irregular words and their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix pairs of steps two and three, in their published order.
STEP_TWO = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_THREE = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_FOUR = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """Consonants as ``c``, vowels as ``v``; ``y`` is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    shape = _shape(stem)
    if len(stem) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and stem[-1] not in "wxy"


def _double_consonant(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _replace_first(word: str, pairs, minimum: int = 1) -> str:
    for suffix, new in pairs:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) >= minimum else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _participle(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem


def _step_two(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step_two(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace_first(word, STEP_TWO)


def _step_four(word: str) -> str:
    for suffix in STEP_FOUR:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                continue
            return stem if _measure(stem) > 1 else word
    return word


def porter_stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _participle(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _step_four(_replace_first(_step_two(word), STEP_THREE))
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def _stem_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(lambda w: porter_stem(w) if w is not None and len(w) > 3 else w)


def stem_vocabulary(words: DataFrame, column: str = "word") -> DataFrame:
    """Distinct words with their stem."""
    return words.select(F.col(column).alias("word")).distinct().withColumn("stem", _stem_words("word"))


@F.pandas_udf(ArrayType(StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    """Stems of token arrays; each distinct word of a batch is stemmed once."""
    words = {w for row in tokens if row is not None for w in row}
    stems = {w: porter_stem(w) if len(w) > 3 else w for w in words}
    return tokens.map(lambda row: None if row is None else [stems[w] for w in row])
