"""How filters act on one another, in every order: sorted posting lists, merged by galloping.

A filter fails some documents.  For each part (source) and filter the failing documents form a posting list in id order.  Applied in an
order, a filter removes its list less the union of the lists before it.  What comes before matters as a set only, so five filters
need 80 differences (a filter, and a set of the others), and all 120 orders are read off their sizes.

The lists are cut in ranges of ids: after the labels are joined, rows are sorted by part and id inside their partitions, and each Arrow
batch is merged for itself.  Unions are k-way merges of sorted runs (numpy's stable sort of the runs laid end to end, which merges
runs by galloping), differences search one sorted list in another.  Only sizes leave a task, and sizes add up, so no list is ever
whole anywhere.  Rows of one part, document and set of failures are counted before they are sent.

A null text is empty; a null source is the part ``''``.  Documents are rows: a repeated row counts as often as it stands there, and is
no duplicate of itself (only a smaller id makes one).  A row without an id has no smaller id and no labels, and makes no other row a duplicate.  Where
labels repeat an id, any row of it that says 1 counts.  Texts are compared by 128 bits of SHA-256.  A table without rows has no parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.session import materialize

FILTERS = "ABCDE"
HOT_SHARE = 1000
"""A text that more than one in so many rows has is looked up in a broadcast table; there are fewer such texts than this number."""

_SIZES = "part string, filter int, before int, removed bigint, good_lost bigint, toxic_lost bigint, gone bigint"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [n_words < 200, 100 * n_distinct < 50 * n_words, 100 * n_capitals > 2 * F.length(text), F.rlike(text, F.lit(r"[#$%&*|]"))]
    mask = F.lit(0)
    for bit, condition in enumerate(failed):
        mask = mask + F.when(condition, 1 << bit).otherwise(0)
    return mask


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` (one bit a filter) of every row of ``docs``, which has ``doc_id``, ``text`` and ``source``."""
    text = F.coalesce(docs["text"], F.lit(""))
    found = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.coalesce(docs["source"], F.lit("")).alias("part"),
        text_failures(text).alias("mask"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"),
    )
    rows = materialize(found, "audit-rows")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    repeated = materialize(groups.filter("n > 1"), "audit-repeated")
    total = rows.count()
    frequent = F.col("n") > total / HOT_SHARE
    hot = F.broadcast(repeated.filter(frequent).select("digest", "least"))  # fewer than HOT_SHARE rows
    cold = repeated.filter(~frequent).select("digest", "least")
    both = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left"), True)
    duplicate = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return both.select("doc_id", "part", (F.col("mask") + F.when(duplicate, 16).otherwise(0)).alias("mask"))


def _union(lists: list[np.ndarray]) -> np.ndarray:
    """A k-way merge: sorted runs end to end are merged by the stable sort, which gallops through them."""
    merged = np.sort(np.concatenate(lists), kind="stable")
    return merged[np.append(True, merged[1:] != merged[:-1])] if len(merged) else merged


def _difference(wanted: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What ``wanted`` has and ``other`` has not; both are sorted, so each search goes on from the last one."""
    if not len(other):
        return wanted
    at = np.searchsorted(other, wanted)
    return wanted[other[np.minimum(at, len(other) - 1)] != wanted]


def interactions(masks: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """For each filter and set of others: sums of ``weights`` (measures by rows) over what it removes after them, and over all that are
    gone then (first measure).  Rows are in id order."""
    lists = [np.flatnonzero(masks >> f & 1) for f in range(len(FILTERS))]
    sums = lambda places: [int(w) for w in weights[:, places].sum(axis=1)]
    found = []
    for size in range(len(FILTERS)):
        for others in combinations(range(len(FILTERS)), size):
            before = _union([np.zeros(0, np.int64), *(lists[o] for o in others)])
            gone = sums(before)[0]
            for f in set(range(len(FILTERS))) - set(others):
                removed = sums(_difference(lists[f], before))
                found.append((f, sum(1 << o for o in others), [*removed, gone + removed[0]]))
    return found


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes by part.  Rows arrive sorted by part and id; sums of a part are handed on when the next one begins."""
    names = [c.split()[0] for c in _SIZES.split(", ")]
    part, sums = None, {}

    def rows() -> pa.RecordBatch:
        keys = list(sums)
        columns = [pa.array([part] * len(keys)), *(pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns + [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(4)], names)

    for batch in batches:
        parts = np.array(batch.column("part").to_pylist(), object)
        starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, np.int64)
        masks = batch.column("mask").to_numpy()
        weights = np.stack([batch.column(c).to_numpy() for c in ("n", "n_good", "n_toxic")])
        for a, b in zip(starts, [*starts[1:], len(parts)]):
            if parts[a] != part:
                if sums:
                    yield rows()
                part, sums = parts[a], {}
            for f, before, measures in interactions(masks[a:b], weights[:, a:b]):
                sums[f, before] = [x + y for x, y in zip(sums.get((f, before), [0] * 4), measures)]
    if sums:
        yield rows()


def sizes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part with a failing row, filter and set of filters ``before`` it (bits): rows it removes, and all gone after it."""
    failing = rows.filter("mask > 0").groupBy("part", "doc_id", "mask").agg(F.count("*").alias("n"))
    known = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    of = lambda label: (F.col("n") * F.coalesce(F.col(label), F.lit(0))).alias(f"n_{label}")
    labelled = failing.join(known, "doc_id", "left").select("part", "doc_id", "mask", "n", of("good"), of("toxic"))
    ranges = labelled.sortWithinPartitions("part", "doc_id").select("part", "mask", "n", "n_good", "n_toxic")
    found = ranges.mapInArrow(_merge_ranges, _SIZES)
    measures = ("removed", "good_lost", "toxic_lost", "gone")
    return found.groupBy("part", "filter", "before").agg(*(F.sum(m).alias(m) for m in measures))


def _steps() -> Column:
    """All orders, step by step: 600 structs, whatever the data."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[o] for o in order)
        steps += [[name, step + 1, f, sum(1 << o for o in order[:step])] for step, f in enumerate(order)]
    fields = "filter_order string, step int, filter int, before int".split(", ")
    listed = [dict(zip((f.split()[0] for f in fields), step)) for step in steps]
    return F.from_json(F.lit(json.dumps(listed)), "array<struct<%s>>" % ", ".join(f.replace(" ", ": ") for f in fields))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step; ``shapley`` sums what the step's filter removes over all orders."""
    rows = materialize(judged(docs), "audit-judged")
    found = materialize(sizes(rows, labels), "audit-sizes")
    alone = F.expr(f"before + shiftleft(1, filter) = {(1 << len(FILTERS)) - 1}")
    of_filter = found.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        # a set of s filters comes before in s! (4 - s)! orders
        F.sum(F.col("removed") * F.factorial(F.bit_count("before")) * F.factorial(len(FILTERS) - 1 - F.bit_count("before"))).alias("shapley"),
    )
    spread = rows.groupBy("part").agg(F.count("*").alias("total")).select("part", "total", F.explode(_steps()).alias("s"))
    steps = spread.select("part", "total", "s.*").join(found, ["part", "filter", "before"], "left").join(of_filter, ["part", "filter"], "left")
    number = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - number("gone")).alias("kept"),
        number("removed").alias("removed"),
        (number("failing") - number("removed")).alias("redundant"),
        *(number(n).alias(n) for n in ("unique_fails", "good_lost", "toxic_lost", "shapley")),
    )
