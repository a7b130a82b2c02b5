"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``SEED`` tokens.  A document keeps only its fragments: stretches of at least ``LEAST_TILE`` tokens all of whose
seeds may stand in a benchmark item.  A bit filter of fixed size, the only thing sent to all tasks, decides "may"; then seeds are
joined with those of the benchmark, which names the pairs of document and item.  Each pair is tiled: for falling lengths, the
longest matches between item and fragments that overlap nothing marked so far are found with rolling hashes and marked.  So
passages count in any order, each token once.  A document is contaminated by an item when tiles cover at least ``COVERAGE`` of the
item's tokens; an item of fewer than ``LEAST_TILE`` tokens must appear whole, as one run.

Tokens are runs of letters, digits and marks without ASCII white space, in lower case, without punctuation at their ends.  Fragments
of equal text are tiled once: documents share the result by the hash of their fragments.  Null and empty texts have no tokens, and
items without tokens contaminate nothing.  All texts are read whole; items repeated under several ids give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweft.llm import bit_filter
from gridweft.session import materialize

SEED = 5
LEAST_TILE = 8
COVERAGE = 0.5
FILTER_BITS = 1 << 24
"""Bits of the filter: 2 MB whatever the size of the benchmark.  A fuller filter passes more fragments and loses none."""

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: str) -> list[str]:
    return [t for t in (w.strip(PUNCTUATION) for w in text.lower().split()) if t]


def seed_hashes(words: list[str], size: int) -> np.ndarray:
    """Hash of every run of ``size`` tokens: a polynomial over the hashes of the tokens."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    codes = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(words) - size + 1 + i]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def greedy_tiles(item: list[str], fragments: list[list[str]], least: int) -> list[tuple[int, int, int, int]]:
    """Tiles ``(start in item, fragment, start in fragment, length)``, longest first.

    One pass looks for matches of a given length or longer with rolling hashes over unmarked stretches; the longest ones found are
    marked, and the length falls to the next that occurs.
    """
    number: dict[str, int] = {}
    codes = [number.setdefault(w, len(number)) for w in item]
    others = [[number.get(w, -1) for w in f] for f in fragments]
    free_item, free = [True] * len(codes), [[c >= 0 for c in f] for f in others]
    base, mod = 1_000_003, (1 << 61) - 1
    tiles = []

    def rolling(row: list[int], unmarked: list[bool], size: int) -> Iterator[tuple[int, int]]:
        drop, value, run = pow(base, size, mod), 0, 0
        for i, (code, open_) in enumerate(zip(row, unmarked)):
            if not open_:
                value = run = 0
                continue
            value = (value * base + code + 1) % mod
            run += 1
            if run > size:
                value = (value - (row[i - size] + 1) * drop) % mod
            if run >= size:
                yield i - size + 1, value

    def matches(size: int) -> list[tuple[int, int, int, int]]:
        table: dict[int, list[int]] = {}
        for start, value in rolling(codes, free_item, size):
            table.setdefault(value, []).append(start)
        found = []
        for n, row in enumerate(others):
            for start, value in rolling(row, free[n], size):
                for at in table.get(value, ()):
                    if at and start and free_item[at - 1] and free[n][start - 1] and codes[at - 1] == row[start - 1]:
                        continue  # part of a match that starts earlier
                    length = 0
                    while (
                        at + length < len(codes) and start + length < len(row) and free_item[at + length]
                        and free[n][start + length] and codes[at + length] == row[start + length]
                    ):
                        length += 1
                    if length >= size:
                        found.append((length, at, n, start))
        return found

    size = min(len(codes), max(map(len, others), default=0))
    while size >= least:
        found = matches(size)
        for length, at, n, start in sorted(found, key=lambda m: (-m[0], *m[1:])):
            if all(free_item[at : at + length]) and all(free[n][start : start + length]):
                free_item[at : at + length] = [False] * length
                free[n][start : start + length] = [False] * length
                tiles.append((at, n, start, length))
        if size == least and not found:
            break
        # what overlapped a longer tile may still match in part, at this length or below
        size = size if found else max(least, size // 2)
    return tiles


def _lengths(words: int) -> tuple[int, int]:
    """Seed and least tile for an item of so many tokens: short items are sought whole."""
    return (SEED, LEAST_TILE) if words >= LEAST_TILE else (words, words)


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``words``, ``size`` and the distinct ``seeds`` of each item with tokens, with the number of their ``places``."""

    @F.arrow_udf("struct<words: array<string>, seeds: array<bigint>, places: array<bigint>>")
    def split(texts: pa.Array) -> pa.Array:
        words = [tokens(t.as_py() or "") for t in texts]
        seeds = [np.unique(seed_hashes(w, max(_lengths(len(w))[0], 1)).view(np.int64), return_counts=True) for w in words]
        columns = [pa.array(words, pa.list_(pa.string())), *(pa.array([x[k] for x in seeds], pa.list_(pa.int64())) for k in (0, 1))]
        return pa.StructArray.from_arrays(columns, ["words", "seeds", "places"])

    found = materialize(benchmark.select("item_id", split("text").alias("t")), "benchmark-items")
    return found.select("item_id", "t.*", F.size("t.words").alias("size")).filter("size > 0")


_FRAGMENTS = "array<struct<at: int, words: array<string>>>"
_FRAGMENTS_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.list_(pa.string()))]))


def fragments(text: Column, spark_filter, size: int, least: int) -> Column:
    """``found``: stretches of at least ``least`` tokens whose runs of ``size`` tokens all pass the filter; ``seeds``: their hashes."""

    @F.arrow_udf(f"struct<found: {_FRAGMENTS}, seeds: array<bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        table = spark_filter.value
        rows, seeds = [], []
        for value in texts:
            words = tokens(value.as_py() or "")
            hashes = seed_hashes(words, size).view(np.int64)
            hit = bit_filter.passes(table, hashes)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a + size - 1 >= least]
            rows.append([{"at": a, "words": words[a : b + size - 1]} for a, b in spans])
            seeds.append(np.unique(np.concatenate([hashes[a:b] for a, b in spans])) if spans else [])
        return pa.StructArray.from_arrays([pa.array(rows, _FRAGMENTS_TYPE), pa.array(seeds, pa.list_(pa.int64()))], ["found", "seeds"])

    return cut(text)


def _covered(words: Column, found: Column, least: int) -> Column:
    @F.arrow_udf("struct<tiles: int, covered: int>")
    def tile(items: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for item, fragment in zip(items, lists):
            item = item.as_py()
            tiles = greedy_tiles(item, [f["words"] for f in fragment.as_py()], min(least, len(item)))
            rows.append({"tiles": len(tiles), "covered": sum(t[3] for t in tiles)})
        return pa.array(rows, pa.struct([("tiles", pa.int32()), ("covered", pa.int32())]))

    return tile(words, found)


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_tiles``, ``n_covered``, ``n_tokens`` (of the item) and ``coverage`` of each pair at or above the
    threshold.  ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``; other columns are left alone."""
    items = _items(benchmark)
    parts = []
    for size, least, some in _classes(items):
        seeds = some.select("item_id", F.explode(F.arrays_zip("seeds", "places")).alias("s"))
        seeds = seeds.select("item_id", F.col("s.seeds").alias("seed"), F.col("s.places").alias("places"))
        filled = bit_filter.build(seeds.select("seed"), FILTER_BITS)
        # written before anything is chosen from it, so that texts are cut once
        cut = docs.select("doc_id", fragments(F.coalesce("text", F.lit("")), filled, size, least).alias("t"))
        cut = materialize(cut.select("doc_id", "t.*"), "fragments").filter(F.size("found") > 0)
        cut = cut.withColumn("same", F.sha2(F.to_json("found"), 256))
        kinds = cut.groupBy("same").agg(F.any_value("found").alias("found"), F.any_value("seeds").alias("seeds"))
        hashed = kinds.select("same", F.explode("seeds").alias("seed"))
        pairs = hashed.join(seeds, "seed").groupBy("same", "item_id").agg(F.sum("places").alias("shared"))
        # a token under a tile lies in a shared seed, at one of the places that the seed has in the item
        joined = pairs.join(some, "item_id").filter((F.col("shared") * size) >= F.col("size") * coverage).join(kinds, "same")
        tiled = materialize(joined.select("same", "item_id", "size", _covered(F.col("words"), F.col("found"), least).alias("t")), "tiles")
        tiled = tiled.filter(F.col("t.covered") >= F.col("size") * coverage)
        parts.append(cut.select("doc_id", "same").join(tiled, "same"))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result.select(
        "doc_id",
        "item_id",
        F.col("t.tiles").cast("long").alias("n_tiles"),
        F.col("t.covered").cast("long").alias("n_covered"),
        F.col("size").cast("long").alias("n_tokens"),
        (F.col("t.covered") / F.col("size")).alias("coverage"),
    )


def _classes(items: DataFrame) -> list[tuple[int, int, DataFrame]]:
    """Seed, least tile and items: the usual ones, and one class for each smaller length that occurs (below ``LEAST_TILE`` of them)."""
    short = sorted(r["size"] for r in items.filter(F.col("size") < LEAST_TILE).select("size").distinct().collect())
    usual = (*_lengths(LEAST_TILE), items.filter(F.col("size") >= LEAST_TILE))
    return [usual, *((*_lengths(n), items.filter(F.col("size") == n)) for n in short)]
