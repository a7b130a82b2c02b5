"""Token counts of every prefix of a text, by dynamic programming, for the word BPE with word ends.

For one word the table holds, for each prefix, the last token of its encoding and the number of tokens.  The last token is the
one suffix that is in the vocabulary and that the merges leave apart from the last token before it; its count is one more than
the count at its start.  A prefix that ends the text ends a word, so the same step is done with the tokens that close a word.
Counts of words add up to the table of the whole text, and that table answers how many tokens a prefix has and where a budget
ends without encoding anything again.

Positions are code points of the text after the tokenizer's own normalising (composition and lower case); for Latin text that
is the text itself, position for position.  Strings of special tokens in a text count as one token each, as in the library.
Null and empty texts have no tokens and an empty table.  A table belongs to one whole text, however long.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweft.llm.byte_bpe import _lists, byte_characters, portions, view

WORDS_KEPT = 600_000
"""Words a task remembers; beyond that the table starts anew.  It changes speed and memory only."""

END = "</w>"
# any character that composition may join or that lower-casing may turn into several
_UNEVEN = re.compile("[^\\x00-\\u012f\\u0131-\\u024f\\u2010-\\u2027\\u2030-\\u203a\\u20ac]")


class PrefixCounter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            model = json.load(source)
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.rank = {(a, b): n for n, (a, b) in enumerate(merges)}
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        chars = byte_characters()
        self.spell = {b: c for b, c in enumerate(chars)}
        # the merge that makes each token, and its rank; single symbols have none
        self.parts = {a + b: (a, b) for a, b in self.rank}
        self.made = {a + b: n for (a, b), n in self.rank.items()}
        right = [t for t in model["model"]["vocab"] if self._encodes_itself(t)]
        self.ends = frozenset(t.removesuffix(END) for t in right if t.endswith(END))
        self.plain = frozenset(t for t in right if not t.endswith(END))
        self.longest = max(map(len, self.plain | self.ends))
        split = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split + r"|\s+").findall
        self.blank = regex.compile(r"\s+").fullmatch
        self.apart: dict[tuple[str, str, bool], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.lengths, self.totals = array("q"), array("q")
        self.full: dict[int, np.ndarray] = {}
        self.apart.clear()

    def _symbols(self, text: str, closes: bool) -> list[str]:
        """The merges applied to one short string: the definition that the table is checked against."""
        parts = list(text)
        if closes:
            parts[-1] += END
        while len(parts) > 1:
            best = min((self.rank.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _never_joined(self, left: str, right: str, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` crosses from ``left`` to ``right``.

        The merges that made the two are undone one by one, latest first; what crosses must not come before the one undone last.
        """
        rank, made, parts = self.rank, self.made, self.parts
        while True:
            crossing = rank.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            of_left, of_right = made.get(left, -1), made.get(right, -1)
            if of_left > of_right:
                limit, left = of_left, parts[left][1]
            elif of_right >= 0:  # among equal merges the one further left comes first
                limit, right = of_right + 1, parts[right][0]
            else:
                return True

    def _encodes_itself(self, token: str) -> bool:
        if token not in self.parts:
            return len(token.removesuffix(END)) == 1
        left, right = self.parts[token]
        return self._never_joined(left, right, self.made[token]) and self._encodes_itself(left) and self._encodes_itself(right)

    def _stay_apart(self, left: str, right: str, closes: bool) -> bool:
        key = (left, right, closes)
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self._never_joined(left, right + END if closes else right, 1 << 30)
        return known

    def word_table(self, word: str, every: bool = True) -> list[int]:
        """Tokens of each prefix of a word, by its characters; of the whole word alone if not ``every``."""
        raw = word.encode("utf-8", "surrogatepass")
        text = "".join(map(self.spell.__getitem__, raw))
        size = len(text)
        last, count, begin = [""], [0], 0
        counts = []
        plain, ends, longest, apart = self.plain, self.ends, self.longest, self._stay_apart
        for i in range(1, size + 1):
            low = i - longest if i > longest else 0
            begin = max(begin, low)
            # exactly one suffix is right, so the order is free: first the last token made longer, then shorter ones
            starts = (*range(begin, i), *range(begin - 1, low - 1, -1))
            if i == size or every and raw[i] & 0xC0 != 0x80:  # a character ends here
                for start in starts:
                    if text[start:i] in ends and (not start or apart(last[start], text[start:i], True)):
                        counts.append(count[start] + 1)
                        break
                else:
                    counts.append(len(self._symbols(text[:i], True)))
            if i < size:
                for start in starts:
                    if text[start:i] in plain and (not start or apart(last[start], text[start:i], False)):
                        last.append(text[start:i])
                        count.append(count[start] + 1)
                        begin = start
                        break
                else:
                    parts = self._symbols(text[:i], False)
                    last.append(parts[-1])
                    count.append(len(parts))
                    begin = i - len(parts[-1])
        return counts

    def _piece_table(self, piece: str, every: bool = True) -> list[int]:
        if self.blank(piece):
            return [0] * len(piece)
        if every and piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            # an ending such as 're is a word of its own only when complete; before that it is a mark and letters
            return [*range(1, len(piece)), self.word_table(piece, False)[-1]]
        return self.word_table(piece, every)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and where the pieces of each text begin."""
        pieces: list[str] = []
        bounds = [0]
        for text in texts:
            pieces += self.pieces(self.normalize(text) if _UNEVEN.search(text) else text.lower())
            bounds.append(len(pieces))
        new = set(pieces) - self.number.keys()
        if new and len(self.number) + len(new) > WORDS_KEPT:
            self._reset()
            new = set(pieces)
        for piece in new:
            self.number[piece] = len(self.names)
            self.names.append(piece)
            self.lengths.append(len(piece))
            self.totals.append(self._piece_table(piece, False)[-1])
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)), np.array(bounds)

    def _table_of(self, number: int) -> np.ndarray:
        table = self.full.get(number)
        if table is None:
            table = self.full[number] = np.array(self._piece_table(self.names[number]), np.int32)
        return table

    def _tables(self, numbers: np.ndarray) -> np.ndarray:
        """The table over a row of pieces."""
        each = view(self.totals)[numbers]
        before = np.repeat(np.cumsum(each) - each, view(self.lengths)[numbers]).astype(np.int32)
        return np.concatenate([np.zeros(0, np.int32), *map(self._table_of, numbers.tolist())]) + before

    def _fit(self, numbers: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix within the budget.

        Counts only grow from piece to piece, so the prefix ends in the last piece that starts within the budget, or, if not even
        its first character fits, in one before it.
        """
        each, lengths = view(self.totals)[numbers], view(self.lengths)[numbers]
        before, at = np.cumsum(each) - each, np.cumsum(lengths) - lengths
        for k in range(int(np.searchsorted(before, budget, side="right")) - 1, -1, -1):
            within = np.flatnonzero(self._table_of(int(numbers[k])) + before[k] <= budget)
            if len(within):
                return int(at[k] + within[-1]) + 1
        return 0

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        numbers, bounds = self._numbers(texts)
        return [self._tables(numbers[a:b]) for a, b in zip(bounds, bounds[1:])]

    def table(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text: entry k - 1 for the first k characters."""
        if self.special is None or not self.special.search(text):
            return self._plain([text])[0]
        split = self.special.split(text)
        # until its last character a special string is ordinary text that goes on from what stands before it
        texts = [split[i] + (split[i + 1][:-1] if i + 1 < len(split) else "") for i in range(0, len(split), 2)]
        parts, done = [], 0
        for i, here in enumerate(self._plain(texts)):
            parts.append(here + done)
            if 2 * i + 1 < len(split):
                alone = len(here) - len(split[2 * i + 1]) + 1
                done += 1 + (int(here[alone - 1]) if alone else 0)
                parts.append([done])
        return np.concatenate(parts).astype(np.int32)

    def report(self, texts: list[str], budget: int) -> tuple[list[int], list[int]]:
        """Tokens of each text, and characters of its longest prefix within the budget."""
        marked = [self.special is not None and bool(self.special.search(t)) for t in texts]
        plain = [i for i, m in enumerate(marked) if not m]
        tables = {i: self.table(texts[i]) for i, m in enumerate(marked) if m}
        numbers, bounds = self._numbers([texts[i] for i in plain])
        sums = np.append(0, np.cumsum(view(self.totals)[numbers]))[bounds]
        sizes = np.append(0, np.cumsum(view(self.lengths)[numbers]))[bounds]
        totals, fits = [0] * len(texts), [0] * len(texts)
        for k, i in enumerate(plain):
            totals[i], fits[i] = int(sums[k + 1] - sums[k]), int(sizes[k + 1] - sizes[k])
            if totals[i] > budget:
                fits[i] = self._fit(numbers[bounds[k] : bounds[k + 1]], budget)
        for i, table in tables.items():
            within = np.flatnonzero(table <= budget)
            totals[i], fits[i] = int(table[-1]), int(within[-1]) + 1 if len(within) else 0
        return totals, fits


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(text: Column, path: str) -> Column:
    """The whole table of a text, to be stored beside it."""

    @F.arrow_udf("array<int>")
    def tables(texts: pa.Array) -> pa.Array:
        count = counter(path)
        return _lists([count.table(t.as_py() or "") for t in texts])

    return tables(text)


def tokens_of_prefix(table: Column, length: Column) -> Column:
    """Tokens of the first ``length`` characters, from a stored table; lengths beyond the text mean the whole text."""
    at = F.least(length, F.size(table))
    return F.when(at <= 0, F.lit(0)).otherwise(F.element_at(table, F.greatest(at, F.lit(1)).cast("int")))


def longest_prefix(table: Column, budget: Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from a stored table."""
    fits = F.transform(table, lambda n, i: F.when(n <= budget, i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def token_report(text: Column, path: str, budget: int) -> Column:
    """``n_tokens`` and ``fits`` (characters of the longest prefix within the budget) of each text, for those who want the answers only.

    The tables stay in the task, and of most words only the last cell is filled: the sum of these is the count of the text, and the
    budget ends in one word, whose table is then filled.
    """

    @F.arrow_udf("struct<n_tokens: bigint, fits: bigint>")
    def report(texts: pa.Array) -> pa.Array:
        count, totals, fits = counter(path), [], []
        for some in portions(texts):
            for all_of, part in zip((totals, fits), count.report(some, budget)):
                all_of += part
        return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(fits, pa.int64())], ["n_tokens", "fits"])

    return report(text)
