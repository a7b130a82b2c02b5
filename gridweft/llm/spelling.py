"""Groups of spelling variants: a variable-length gram index over the words of a corpus.

**Words** are counted over all texts, with a combining aggregate.  **Dictionary:** grams of ``SHORTEST`` letters are always in it; a longer one
is kept where the gram that it extends is frequent and it is not itself rare, so the dictionary has a bounded size whatever the corpus.
**Decomposition:** at each place of a word (with a mark at both ends) stands the longest gram of the dictionary; grams inside an earlier
one are left out.  **Bounds:** for every place where one letter can be put in, left out or replaced, the grams are marked that the edit
may affect: those over it, those that a longer gram of the dictionary could take over, and those that one could swallow.  All others stand
in both words.

**Lists** are named by a gram and by the side of the word up to it, or from it on, that is the same in both words when the edit is on
the other side.  Of the lists that two near words share, they share the one with the longest side.  So the bound of a word is the longest
side that is left by its worst edit, and its lists with shorter sides, which are the long ones, are not merged at all.  Words that meet in a list are
verified by edit distance inside the join; no unverified pair leaves it.

A list of more than ``LIST`` words is not merged.  Near words that meet in no other list are then both in it.  All members of such lists, and
words for which an edit may affect every gram, are compared by what is left when one letter is taken out, where no key has more words than the
alphabet has letters.  So no pair is lost, and none is formed inside a group that grows with the corpus.

Null texts hold no words.  A null id is written as an empty string.  Repeated rows count as often as they stand there.  A corpus without
words that are frequent enough has no rows.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.session import materialize

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
SLIPS = 199
"""One in so many (document, word) pairs loses a letter."""
SHORTEST, LONGEST = 2, 4
FREQUENT, RARE = 1 << 10, 1 << 14
"""A gram is extended when it stands in more than one of ``FREQUENT`` words; an extension is kept unless it stands in less than one of
``RARE``.  Each word has a gram of each length at each letter, so a length has at most ``RARE`` times the mean length of words in grams."""
LIST = 256

LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough."""
    # a word is never longer than its run, so shorter runs are passed over by the pattern
    runs = F.regexp_extract_all(F.col("text"), F.lit(LETTERS + "{%d,}" % LEAST_LENGTH), F.lit(0))
    run = F.col("run")
    plain = F.octet_length(run) == F.length(run)
    lowered = F.when(plain, F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))
    found = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = found.select(lowered.alias("run"), "id").select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length(run)).cast("int")
    slipped = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    words = hashed.select(F.when(F.col("h") % SLIPS == 0, slipped).otherwise(run).alias("word"))
    counts = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def _marked(word: Column) -> Column:
    return F.concat(F.lit("^"), word, F.lit("$"))


class Grams:
    """A dictionary of grams longer than ``SHORTEST``, with the decomposition and the bounds that follow from it."""

    def __init__(self, grams: frozenset[str]) -> None:
        self.grams = grams
        self.heads = {g[:k] for g in grams for k in range(SHORTEST, len(g))}
        self.tails = {g[-k:] for g in grams for k in range(SHORTEST, len(g))}

    def decompose(self, marked: str) -> list[tuple[int, int]]:
        """Start and end of the word's grams; both grow from one to the next."""
        found, reach = [], 0
        for start in range(len(marked) - SHORTEST + 1):
            size = LONGEST
            while size > SHORTEST and (start + size > len(marked) or marked[start : start + size] not in self.grams):
                size -= 1
            if start + size > reach:
                reach = start + size
                found.append((start, reach))
        return found

    def unaffected(self, marked: str, grams: list[tuple[int, int]], left: int, right: int) -> int:
        """The longest side of a gram that stays whatever is put in place of ``marked[left:right]``; 0 where none stays."""
        first = next((p for p in range(max(0, left - LONGEST + 1), left - 1) if marked[p:left] in self.heads), left)
        last = next((e for e in range(min(len(marked), right + LONGEST - 1), right + 1, -1) if marked[right:e] in self.tails), right)
        before = max((end for start, end in grams if end <= left and start < first), default=0)
        after = max((len(marked) - start for start, end in grams if start >= right and end > last), default=0)
        return max(before, after)

    def lists(self, word: str) -> tuple[list[str], bool]:
        """Names of the lists to merge, and whether some edit may affect all grams."""
        marked = f"^{word}$"
        grams = self.decompose(marked)
        inside = range(1, len(marked) - 1)
        edits = [(i, i + 1) for i in inside] + [(i, i) for i in (*inside, len(marked) - 1)]
        bound = min(self.unaffected(marked, grams, *edit) for edit in edits)
        names = [f"L{end - start}{marked[:end]}" for start, end in grams if end >= bound]
        return names + [f"R{end - start}{marked[start:]}" for start, end in grams if len(marked) - start >= bound], not bound


def dictionary(words: DataFrame) -> Broadcast:
    """The frequency-pruned grams of ``words``.  The driver gets no rare ones, see ``RARE``."""
    marked = _marked(F.col("word"))
    starts = lambda size: F.sequence(F.lit(1), F.length("word") + 3 - size)
    every = F.concat(*(F.transform(starts(q), lambda p, q=q: F.substr(marked, p, F.lit(q))) for q in range(SHORTEST, LONGEST + 1)))
    counts = words.select(F.explode(every).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    total = words.count()
    found = {r.gram: r.n for r in counts.filter(F.col("n") * RARE >= total).toLocalIterator()}
    kept: set[str] = set()
    for gram in sorted(found, key=len):
        if len(gram) > SHORTEST and found.get(gram[:-1], 0) * FREQUENT > total and (len(gram) == SHORTEST + 1 or gram[:-1] in kept):
            kept.add(gram)
    return words.sparkSession.sparkContext.broadcast(frozenset(kept))


@functools.lru_cache(maxsize=2)
def _grams_of(held: frozenset[str]) -> Grams:
    return Grams(held)


def lists_of(word: Column, grams: Broadcast) -> Column:
    """``names`` of the lists of a word, and ``bare`` where an edit may affect all of its grams."""

    @F.arrow_udf("struct<names: array<string>, bare: boolean>")
    def named(words: pa.Array) -> pa.Array:
        index = _grams_of(grams.value)
        found = [index.lists(w.as_py()) for w in words]
        names = pa.array([f[0] for f in found], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([names, pa.array([f[1] for f in found], pa.bool_())], ["names", "bare"])

    return named(word)


def _without_a_letter(words: DataFrame) -> DataFrame:
    """Each word with each letter taken out, and the place of the letter."""
    left = F.transform(
        F.sequence(F.lit(0), F.length("word") - 1),
        lambda i: F.struct(i.alias("at"), F.concat(F.substr("word", F.lit(1), i), F.substr("word", i + 2)).alias("rest")),
    )
    return words.select("word", F.explode(left).alias("left")).select("word", "left.*")


def near_by_letters(words: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of words that are one letter apart.  As many words have the same rest as there are letters at most."""
    rests = materialize(_without_a_letter(words), "spelling-rests")
    x, y = rests.alias("x"), rests.alias("y")
    same = (F.col("x.rest") == F.col("y.rest")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.word") < F.col("y.word"))
    replaced = x.join(y, same).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))
    shorter = rests.join(words.select(F.col("word").alias("rest")), "rest").select("word", "rest")
    return replaced.union(shorter.select(F.least("word", "rest"), F.greatest("word", "rest"))).distinct()


def near_words(words: DataFrame, grams: Broadcast) -> DataFrame:
    """Pairs ``a`` < ``b`` of the distinct words of ``words`` that are one letter apart."""
    listed = materialize(words.select("word", lists_of(F.col("word"), grams).alias("l")).select("word", "l.*"), "spelling-lists")
    members = listed.select("word", F.explode("names").alias("name")).select("word", F.xxhash64("name").alias("list"))
    sizes = materialize(members.groupBy("list").agg(F.count("*").alias("n")).filter("n > 1"), "spelling-sizes")
    short = materialize(members.join(sizes.filter(F.col("n") <= LIST).select("list"), "list"), "spelling-members")
    x, y = short.alias("x"), short.alias("y")
    near = (F.col("x.word") < F.col("y.word")) & (F.levenshtein("x.word", "y.word", 1) == 1)
    merged = x.join(y, (F.col("x.list") == F.col("y.list")) & near).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))
    long = members.join(sizes.filter(F.col("n") > LIST).select("list"), "list", "left_semi").select("word")
    rest = materialize(listed.filter("bare").select("word").union(long).distinct(), "spelling-rest")
    return merged.union(near_by_letters(rest)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and the last of its forms.  Paths double each round; a form is ``RATIO`` times as frequent, so there are few rounds."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = state.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialize(joined, "spelling-roots")
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def variants(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of ``docs`` (``doc_id``, ``text``).

    The form of a word is the most frequent of the words one letter apart, the smallest on a tie, if it is ``RATIO`` times as frequent.
    """
    words = materialize(word_counts(docs), "spelling-words")
    pairs = materialize(near_words(words.select("word"), dictionary(words)), "spelling-pairs")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counted = links.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    )
    form_n = -F.col("best.less")
    found = words.join(best, "word", "left").withColumn("fits", F.coalesce(form_n >= RATIO * F.col("n"), F.lit(False)))
    formed = materialize(
        found.select(
            "word",
            F.when(F.col("fits"), F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("fits"), form_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    rooted = formed.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
