"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are fitted on the driver, on the statistics of at most ``SAMPLE`` labelled documents: those with the smallest hash of their
id, a fixed random share.  Then the statistics of every whole text are computed and scored in one pass without a shuffle.  Each statistic is cut in at most ``BINS`` bins at its
quantiles; a tree grows level by level from sums of gradients in those bins.  The fitted trees are complete binary trees in flat
arrays, of a size that depends on ``TREES`` and ``DEPTH`` only, and all rows of a batch walk down all trees at once in numpy.

Null and empty texts have statistics of their own and get a score like others.  Labels other than 0 and 1 are left out; repeated
labels count repeatedly.  Without labels every score is 0.5, with one label it is near that label.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.llm.byte_bpe import portions
from gridweft.llm.compression_rules import SPACES, repeated_lines, words_in_repeated_windows

SAMPLE = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_WEIGHT = 2.0
THRESHOLD = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "symbol": b"#*$%&|<>~^=_\\/@+",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "bracket": b"()[]{}",
    "quote": b"\"'`",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_MASK = np.zeros((256, len(_CLASSES)))
for _n, _set in enumerate(_CLASSES.values()):
    _MASK[list(_set), _n] = 1

STATISTICS = (
    *(f"share_{name}" for name in _CLASSES),
    "log_bytes", "log_words", "mean_word", "sd_word", "log_longest_word", "distinct_words", "commonest_word", "repeated_windows",
    "same_word_again", "repeated_lines", "log_line", "entropy", "compression", "capital_words", "marked_words", "plain_ends",
)


def statistics(text: str, compressor: zstandard.ZstdCompressor) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    common = Counter(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    p = counts[counts > 0] / size
    return [
        *(counts @ _MASK / size),
        math.log1p(len(raw)),
        math.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        math.log1p(lengths.max()),
        len(common) / n,
        max(common.values(), default=0) / n,
        words_in_repeated_windows(words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        repeated_lines(text) / max(len(lines), 1),
        math.log1p(size / max(len(lines), 1)),
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        len(compressor.compress(raw)) / size,
        sum(k for w, k in common.items() if w.isupper()) / n,
        sum(k for w, k in common.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:") / n,
        sum(line.rstrip(SPACES)[-1] in ".!?\"')" for line in lines) / max(len(lines), 1),
    ]


def document_statistics(text: Column) -> Column:
    """All statistics of a text as an array of floats, in the order of ``STATISTICS``."""

    @F.arrow_udf("array<float>")
    def computed(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=1)
        rows = [statistics(t.as_py() or "", compressor) for t in texts]
        flat = pa.array(np.array(rows, np.float32).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), flat)

    return computed(text)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``; a value for each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        rows, trees = len(x), len(self.feature)
        if not trees:
            return np.full(rows, 1 / (1 + math.exp(-self.base)))
        node = np.zeros((rows, trees), np.int64)
        tree, row = np.arange(trees), np.arange(rows)[:, None]
        inner = self.feature.shape[1]
        while node.size and node[0, 0] < inner:
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        total = self.base + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Trees for log loss.  Gradients are summed by node, statistic and bin; the best cut of each node has the largest gain."""
    if not len(y):
        empty = np.zeros((0, 0))
        return Trees(0.0, empty.astype(np.int64), empty, empty)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(share / (1 - share))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for column in x.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1)
    n_features, inner = x.shape[1], (1 << depth) - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf, np.float32)
    value = np.zeros((trees, inner + 1))
    total = np.full(len(y), base)
    last = np.array([len(c) for c in cuts])
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            g, h = np.zeros((2, width, n_features, bins))
            for f in range(n_features):
                place = (node - first) * bins + binned[:, f]
                g[:, f] = np.bincount(place, gradient, width * bins).reshape(width, bins)
                h[:, f] = np.bincount(place, weight, width * bins).reshape(width, bins)
            gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(hl < LEAST_WEIGHT) | (ha - hl < LEAST_WEIGHT)] = 0
            gain[:, np.arange(bins) >= last[:, None]] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            splits = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for k in np.flatnonzero(splits):
                f, b = divmod(int(best[k]), bins)
                feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            chosen = feature[t, node]
            right = x[np.arange(len(y)), chosen] > threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        value[t] = rate * g / (h + 1)
        total += value[t, leaf]
    return Trees(base, feature, threshold, value)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Trees:
    """Trees from at most ``rows`` of the labels, chosen by a hash of the id and so alike on every run, and the texts they belong to.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``.
    """
    known = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    text = F.coalesce("text", F.lit(""))
    # ``rows`` pairs of numbers at most go to all tasks
    told = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text.alias("text"))
    table = told.select("doc_id", "quality", document_statistics(F.col("text")).alias("statistics")).toArrow()
    order = np.lexsort((table.column("quality").to_numpy(), table.column("doc_id").to_numpy()))
    x = np.array(table.column("statistics").to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    return fit(x[order], table.column("quality").to_numpy().astype(np.float64)[order])


def score(text: Column, trees: Trees) -> Column:
    """Score of each text.  A filter on it does not make Spark compute it twice."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=1)
        scores = [np.zeros(0)]
        for some in portions(texts):
            scores.append(trees.score(np.array([statistics(t, compressor) for t in some], np.float32)))
        return pa.array(np.concatenate(scores))

    return scored.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
