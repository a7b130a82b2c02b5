"""Personal data, also where it is disguised, as spans of the source text.

Plain detectors find e-mail addresses, IP addresses, card numbers and phone numbers.  Then transducers rewrite the text: characters
that look like ASCII ones become those, invisible ones go, spelled digits become digits, and ``[at]``, ``(dot)`` and the like become
signs.  Each transducer hands on, for every character that it writes, the span of the source that the character stands for, so
what the detectors find in the rewritten text is mapped back.  A span found only there is added when it overlaps no plain one, or holds
more than each plain one that it overlaps: plain ones stay, and ``redact`` takes what any span covers.

Spans are ``(kind, start, end)`` in code points, end exclusive.  Null and empty texts have none.  All patterns take time in
proportion to the text, so very long texts and long runs of digits or letters are scanned whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return spans


def addresses(text: str) -> list[Span]:
    fits = lambda part: len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(fits, m.groups()))]


def passes_luhn(digits: str) -> bool:
    values = list(map(int, reversed(digits)))
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    spans = []
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 37 else ""  # 19 digits with a sign between any two
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            spans.append(m.span())
    return spans


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


DETECTORS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def detect(text: str) -> list[tuple[str, int, int]]:
    found = [(kind, *span) for kind in KINDS for span in DETECTORS[kind](text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters of other scripts that look like ASCII letters, and the letters they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ℓ": "l", "﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
ARTICLES = ("un",)  # digits only beside other digit words


def plain_character(c: str) -> str:
    """What a character is rewritten to: itself, its ASCII likeness, its digit, or nothing."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff":  # wide and mathematical forms
        simple = unicodedata.normalize("NFKC", c)
        return simple if len(simple) == 1 and simple < "\x7f" else c
    if c > "\x7f" and unicodedata.decimal(c, None) is not None:
        return str(unicodedata.decimal(c))
    return c


_BEYOND = re.compile("[^\\x00-\\xac\\xae-\\u012f]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ALONE = "|".join(w for w in DIGIT_WORDS if w not in ARTICLES)
_SPELLED = re.compile(
    rf"(?<![{_LETTER}])(?:(?:{_WORDS})(?:[ ,-]{{1,2}}(?:{_WORDS}))+|(?<=[0-9][ .-])(?:{_ALONE})|(?:{_ALONE})(?=[ .-][0-9]))(?![{_LETTER}])",
    re.IGNORECASE,
)
_WORD = re.compile(_WORDS, re.IGNORECASE)
_PLUS = re.compile(r"(?<![A-Za-z0-9])plus[ ]?(?=[0-9])", re.IGNORECASE)
_BRACKETED_AT = re.compile(r"[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?", re.IGNORECASE)
_BRACKETED_DOT = re.compile(r"[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?", re.IGNORECASE)
# Ends of host names after which "at" is read as a sign where no dot is spoken.
HOST_ENDS = "com org net edu gov info io co uk de fr es it nl eu ch at us ca au".split()
# Words before "dot" that make it a word of its own, as in "look at the dot on".
DETERMINERS = "the a an this that these those every each any some one which his her its my your our their".split()
_SPOKEN = r"(?: dot |[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?)"
_LABEL = "[A-Za-z0-9-]{1,63}"
_LABELS = rf"{_LABEL}(?:(?:{_SPOKEN}|\.){_LABEL}){{0,4}}"
_SAID_AT = re.compile(
    rf"(?<=[A-Za-z0-9]) at (?={_LABELS}(?:{_SPOKEN}|\.)(?:{'|'.join(HOST_ENDS)})(?![A-Za-z0-9])"
    rf"|(?!(?:{'|'.join(DETERMINERS)}) dot ){_LABELS}{_SPOKEN}[A-Za-z]{{2,63}}(?![A-Za-z0-9-]))",
    re.IGNORECASE,
)
_SAID_DOT = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.IGNORECASE)
_REST_OF_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: dot [A-Za-z0-9._%+-]{1,64}){0,4}@", re.IGNORECASE)

Traced = tuple[str, np.ndarray, np.ndarray]


def rewrite(traced: Traced, pattern: re.Pattern, output) -> Traced:
    """One transducer: every match becomes ``output(match)``, each of whose characters stands for the whole match."""
    text, starts, ends = traced
    texts, first, last, done = [], [], [], 0
    for m in pattern.finditer(text):
        a, b, new = m.start(), m.end(), output(m)
        texts += [text[done:a], new]
        first += [starts[done:a], np.full(len(new), starts[a], np.int64)]
        last += [ends[done:a], np.full(len(new), ends[b - 1], np.int64)]
        done = b
    if not texts:
        return traced
    return "".join([*texts, text[done:]]), np.concatenate([*first, starts[done:]]), np.concatenate([*last, ends[done:]])


def normalize(text: str) -> Traced:
    """The rewritten text and the source span of each of its characters."""
    traced = (text, np.arange(len(text)), np.arange(1, len(text) + 1))
    if _BEYOND.search(text):
        traced = rewrite(traced, _BEYOND, lambda m: plain_character(m.group()))
    for pattern, output in (
        (_SPELLED, lambda m: "".join(DIGIT_WORDS[w.group().lower()] for w in _WORD.finditer(m.group()))),
        (_PLUS, lambda m: "+"),
        (_BRACKETED_AT, lambda m: "@"),
        (_SAID_AT, lambda m: "@"),
        (_BRACKETED_DOT, lambda m: "."),
    ):
        traced = rewrite(traced, pattern, output)
    # a spoken dot counts only beside a sign or digit that an address has; elsewhere it is a word
    return rewrite(traced, _SAID_DOT, lambda m: "." if _in_address(m) else m.group())


def _in_address(m: re.Match) -> bool:
    text, a, b = m.string, m.start(), m.end()
    before = text[max(0, a - 64) : a].rpartition(" ")[2]
    if "@" in before or before.isdigit() and text[b].isdigit() or " dot " in text[max(0, a - 40) : a].lower() and "@" in text[max(0, a - 128) : a]:
        return True
    return before.lower() not in DETERMINERS and _REST_OF_LOCAL.match(text, b) is not None


def _adds(span: tuple[str, int, int], base: list[tuple[str, int, int]], begins: list[int], reach: list[int]) -> bool:
    """Whether a span holds more than each plain one that it overlaps; ``reach`` is the largest end so far."""
    _, a, b = span
    i = bisect_left(begins, b) - 1
    while i >= 0 and reach[i] > a:
        _, start, end = base[i]
        if end > a and (start < a or end > b or (start, end) == (a, b)):
            return False
        i -= 1
    return True


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans."""
    base = detect(text)
    plain, starts, ends = normalize(text)
    if plain == text:
        return base, base
    known, begins = set(base), [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    added = []
    for kind, a, b in detect(plain):
        span = kind, int(starts[a]), int(ends[b - 1])
        if span not in known and _adds(span, base, begins, reach):
            added.append(span)
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(text: Column) -> Column:
    """``base`` (plain spans) and ``spans`` (all spans) of a text."""

    @F.arrow_udf(f"struct<base: {_SPANS}, spans: {_SPANS}>")
    def found(texts: pa.Array) -> pa.Array:
        both = [find(t.as_py() or "") for t in texts]
        rows = ([[{"kind": k, "start": a, "end": b} for k, a, b in pair[side]] for pair in both] for side in (0, 1))
        return pa.StructArray.from_arrays([pa.array(r, _SPANS_TYPE) for r in rows], ["base", "spans"])

    return found(text)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go as one, under the kind of the earliest."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("done"))

    def step(acc: Column, span: Column) -> Column:
        piece = F.concat(
            acc["out"], F.substr(text, acc["done"].cast("int") + 1, (span["start"] - acc["done"]).cast("int")),
            F.lit("<"), span["kind"], F.lit(">"),
        )
        return F.when(span["start"] >= acc["done"], F.struct(piece.alias("out"), span["end"].alias("done"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["done"], span["end"]).alias("done"))
        )

    return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["done"].cast("int") + 1)))
