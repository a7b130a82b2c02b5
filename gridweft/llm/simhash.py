"""SimHash near-duplicates: fingerprints, exact comparison of tiles, connected groups.

A fingerprint has 64 bits, each the majority over the hashes of the word shingles of a text.  Equal fingerprints are one node.
Two fingerprints that differ in at most ``RADIUS`` bits agree in one of ``RADIUS + 1`` blocks of bits, so only fingerprints with an
equal block are compared.  Those of a block value are ordered by their number of one bits and cut in tiles of bounded size; a pair
of tiles whose numbers of one bits differ by more than the radius cannot hold a link and is never formed, all others are compared
with exclusive-or and bit counts.  Of the links inside a pair of tiles, as many as join what belongs together are handed on (at most
one a fingerprint), and the groups follow from these.

No tile, task or block value has to hold a whole group: a frequent block value has many tiles, dealt out by pair.
Null and empty texts have fingerprint zero and are linked like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridweft.llm.components import components
from gridweft.session import materialize

RADIUS = 3
TILE = 1024


def fingerprint_of(text: str, size: int = 3, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII spaces part
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    line = b" ".join(words)
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    bounds = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in bounds), "<u8", len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a long (its 64 bits, so the sign is one of them)."""

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint_of(t.as_py() or "", size, seed) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return fingerprints(text)


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


_KEY = ("band", "value", "left", "right")


def _forest(fingerprints: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each fingerprint to the smallest that it is connected to inside its group.

    Rows are ordered by group and number of one bits.  Rows ``d`` apart are compared all at once, for growing ``d``, as long as the
    further one is in the same group and within the radius by its number of one bits.  In a pair of two tiles only rows of different
    tiles are compared; each tile is compared with itself in its own pair.
    """
    size = len(fingerprints)
    bits = np.bitwise_count(fingerprints).astype(np.int16)
    order = np.lexsort((fingerprints, bits, group))
    fingerprints, group, side, bits = fingerprints[order], group[order], side[order], bits[order]
    pair_of_two = np.zeros(size, bool)
    if size:
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        counts = np.diff(np.append(first, size))
        pair_of_two = np.repeat(np.maximum.reduceat(side, first) > 0, counts)
    rows = np.arange(size)
    ups, downs = [], []
    step = 1
    while True:
        rows = rows[rows + step < size]
        near = (group[rows + step] == group[rows]) & (bits[rows + step] - bits[rows] <= radius)
        rows = rows[near]
        if not len(rows):
            break
        other = rows + step
        linked = np.bitwise_count(fingerprints[rows] ^ fingerprints[other]) <= radius
        linked &= ~pair_of_two[rows] | (side[rows] != side[other])
        ups.append(rows[linked])
        downs.append(other[linked])
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ups, downs))
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, label[a], low)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(size))
    return fingerprints[moved], fingerprints[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles arrive one after the other; the last of a batch is held back, as it may go on in the next."""
    held: pa.Table | None = None

    def links(table: pa.Table) -> pa.RecordBatch:
        keys = np.stack([table.column(k).to_numpy() for k in _KEY])
        group = np.cumsum(np.append(False, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        fingerprints = table.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64)
        a, b = _forest(fingerprints, group, table.column("side").to_numpy(), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(k).to_numpy() for k in _KEY])
        starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        if len(starts):
            yield links(held.slice(0, int(starts[-1]) + 1))
            held = held.slice(int(starts[-1]) + 1)
    if held is not None:
        yield links(held)


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct ``fingerprint`` values of ``nodes`` exactly as all links within the radius do."""
    pieces = radius + 1
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    band = lambda i: F.shiftrightunsigned("fingerprint", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1)
    bands = nodes.select(
        "fingerprint",
        F.bit_count("fingerprint").alias("ones"),
        F.posexplode(F.array(*(band(i) for i in range(pieces)))).alias("band", "value"),
    )
    # at most 65 rows a block value: where each number of one bits begins
    classes = bands.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    before = Window.partitionBy("band", "value").orderBy("ones")
    whole = Window.partitionBy("band", "value")
    classes = classes.select(
        "band", "value", "ones", "n", (F.sum("n").over(before) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total")
    ).filter("total > 1")
    # rows of a class share its tiles evenly
    place = F.col("before") + F.pmod(F.xxhash64("fingerprint"), F.col("n"))
    members = bands.join(classes, ["band", "value", "ones"]).select(
        "band", "value", "ones", "fingerprint", "total", F.floor(place / tile).cast("int").alias("tile")
    )
    single = members.filter(F.col("total") <= tile).select(
        "band", "value", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("side"), "fingerprint"
    )
    several = members.filter(F.col("total") > tile)
    reach = several.groupBy("band", "value", "tile").agg(F.min("ones").alias("low"), F.max("ones").alias("high"))
    x, y = reach.alias("x"), reach.alias("y")
    near = (F.col("x.tile") <= F.col("y.tile")) & (F.col("y.low") - F.col("x.high") <= radius)
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value"))
    tiles = x.join(y, same & near).select("x.band", "x.value", F.col("x.tile").alias("left"), F.col("y.tile").alias("right"))
    sides = tiles.select(
        "*",
        F.explode(
            F.when(F.col("left") == F.col("right"), F.array(F.struct(F.col("left").alias("tile"), F.lit(0).alias("side")))).otherwise(
                F.array(
                    F.struct(F.col("left").alias("tile"), F.lit(0).alias("side")),
                    F.struct(F.col("right").alias("tile"), F.lit(1).alias("side")),
                )
            )
        ).alias("s"),
    ).select("band", "value", "left", "right", "s.*")
    paired = several.join(sides, ["band", "value", "tile"]).select("band", "value", "left", "right", "side", "fingerprint")
    dealt = single.union(paired).repartition(*_KEY).sortWithinPartitions(*_KEY)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return dealt.mapInArrow(lambda batches: _compare(batches, radius), schema)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (long) and ``component_id``, the smallest id of the documents that are connected.

    Ids are longs; a null id is a document of its own that joins no group by id.  Repeated rows of one document keep a row each.
    """
    text_column = F.coalesce(docs[text], F.lit(""))
    printed = materialize(docs.select(docs[key].alias("doc_id"), fingerprint(text_column, size).alias("fingerprint")), "simhash")
    nodes = materialize(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    groups = components(links(nodes.select("fingerprint"), radius), "simhash")
    labelled = nodes.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "component").select("fingerprint", "component_id")
    return printed.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
