"""Repeated strings of ``LENGTH`` bytes across all documents, and their removal.

A window is ``LENGTH`` bytes of one document.  A byte is removed when a window that covers it also starts earlier: in a document with
a smaller id, or further left in the same one.

To bring equal windows together without sending every suffix, each window is filed under one gram of ``GRAM`` bytes inside it, the
one with the smallest hash.  Equal windows have equal grams, and windows filed under one place follow one another: they form a
stretch.  Of equal stretches (by gram and hash, 121 bits) all but the first are repeats as a whole.  What is left is where the same
gram stands in different stretches that agree in part: a window they share holds one of ``CORES`` cores of ``CORE`` bytes around the
gram, so stretches with no core in common with another are closed.  These stretches are dealt into shards by gram; a shard sorts its
suffixes with Larsson-Sadakane refinement, takes common prefixes with Kasai's walk, and so finds its classes of equal windows.

A task first settles what repeats inside its own few megabytes, so a passage that a third of all documents share sends one row per
portion and not one per document.  A gram that stands in very many different stretches is found beforehand and dealt into several
parts by stretch; each of its shards then hands on its distinct windows of that gram, and equal ones of several shards meet in an
aggregate.  Which grams these are, and which stretches are wanted with their text, is told to all tasks by bit filters of fixed
size: when one is full it lets more through, and the result stays the same.

Documents are UTF-8 bytes and removal may part a character, so what is kept is binary.  Null and empty texts have no windows.  Rows
of the same id never count as earlier than one another; rows without an id keep their text and are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.llm import bit_filter
from gridweft.session import materialize

LENGTH = 100
GRAM = 32
CORES = 4
CORE_STEP = (LENGTH - GRAM) // CORES
CORE = LENGTH - CORE_STEP
SPAN = LENGTH - GRAM + 1
TASK_BYTES = 4 << 20
"""Bytes of text that are looked at together inside a task.  One longer document is looked at whole."""
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 1 << 20
HOT_STRETCHES = 32
"""A gram with more different stretches in one portion is dealt into ``HOT_PARTS`` shards by stretch."""
HOT_PARTS = 64

_EVEN, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _loads(raw: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    return np.ndarray((len(raw) - 7,), f"{order}u8", raw, strides=(1,))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every place on."""
    eight = _loads(raw, "<").astype(np.uint64)
    size = len(raw) - GRAM + 1
    total, factor = eight[:size] * _EVEN, _ODD
    for at in range(8, GRAM, 8):
        total ^= total >> np.uint64(31)
        total += eight[at : at + size]
        total *= factor
    total ^= total >> np.uint64(29)
    total *= _EVEN
    return total


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, reach = values, 1
    while 2 * reach <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def find_stretches(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``stretches_of`` over any number of texts, a few at a time so that the arrays stay small."""
    parts, some, first, total = [], [], 0, 0
    for number, text in enumerate(texts, 1):
        some.append(text)
        total += len(text)
        if total >= BLOCK_BYTES or number == len(texts):
            part = stretches_of(some)
            part["text"] = part["text"] + first
            parts.append(part)
            some, first, total = [], number, 0
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else stretches_of([])


def stretches_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Stretches of the texts: ``text`` (number), ``q`` and ``n`` (first window and number of windows), ``gram``, ``h``, and
    ``tied``, where the gram occurs again nearby so that a stretch may repeat itself."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    starts = np.cumsum(sizes) - sizes
    if len(raw) < LENGTH:
        none = np.zeros(0, np.int64)
        return {"text": none, "q": none, "n": none, "gram": none, "h": none, "meta": none, "tied": none.astype(bool)}
    hashes = gram_hashes(raw) & ~np.uint64(127)
    # equal hashes are told apart by their place, so that runs of one gram do not give a stretch for every byte
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    low = (place[: len(hashes)] & 127).astype(np.uint64)
    least = _sliding_least(hashes | low, SPAN) & np.uint64(127)
    most = _sliding_least(hashes | (np.uint64(127) - low), SPAN) & np.uint64(127)
    size = len(least)
    rows = np.flatnonzero(np.repeat(sizes, sizes)[:size] - place[:size] >= LENGTH)
    if not len(rows):
        return {k: np.zeros(0, bool if k == "tied" else np.int64) for k in ("text", "q", "n", "gram", "h", "tied", "meta")}
    chosen = rows + (least[rows].astype(np.int64) - place[rows]) % 128
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1] + 1))
    at = np.flatnonzero(new)
    begin, anchor = rows[at], chosen[at]
    count = np.diff(np.append(at, len(rows)))
    tied = np.logical_or.reduceat((least + most)[rows] != 127, at)
    text = np.searchsorted(starts, begin, side="right") - 1
    # a window that starts so far before its gram holds one of a few cores of bytes around the gram; some bits of a hash of each
    eight = _loads(raw, "<")
    nearest, farthest = anchor - begin - count + 1, anchor - begin
    meta = (count << 53) | (tied.astype(np.int64) << 52)
    for k in range(CORES):
        held = (farthest >= CORE_STEP * k) & (nearest <= CORE_STEP * (k + 1))
        place_of = np.where(held, anchor - CORE_STEP * k, 0)
        total = np.zeros(len(begin), np.uint64)
        for offset in (*range(0, CORE - 8, 8), CORE - 8):
            total = (total ^ eight[place_of + offset]) * _EVEN
            total ^= total >> np.uint64(29)
        bits = ((total * _ODD) >> np.uint64(52)).astype(np.int64)
        meta |= np.where(held, (bits << (12 * k)) | (1 << (48 + k)), 0)
    digest = xxhash.xxh3_64_intdigest
    ends = begin + count + LENGTH - 1
    h = np.fromiter((digest(joined[a:b]) for a, b in zip(begin.tolist(), ends.tolist())), np.uint64, len(begin)).view(np.int64)
    return {
        "text": text, "q": place[begin], "n": count, "gram": hashes[anchor].view(np.int64), "h": h, "tied": tied, "meta": meta,
    }


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    ids, texts, total = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("raw")):
            ids.append(key)
            texts.append(text.as_py())
            total += len(texts[-1])
            if total >= size:
                yield np.array(ids, np.int64), texts
                ids, texts, total = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def _own_repeats(found: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Stretches that equal an earlier one of the same portion."""
    key = ids[found["text"]]
    order = np.lexsort((found["q"], key, found["gram"], found["h"]))
    h, gram, key, q = found["h"][order], found["gram"][order], key[order], found["q"][order]
    new = np.append(True, (h[1:] != h[:-1]) | (gram[1:] != gram[:-1])) if len(h) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = np.zeros(len(h), bool)
    again[order] = (key > key[lead]) | (key == key[lead]) & (q > q[lead])
    return again


def _hot_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams that stand in many different stretches of one portion."""
    for ids, texts in _portions(batches, TASK_BYTES):
        found = find_stretches(texts)
        grams, n = np.unique(found["gram"][~_own_repeats(found, ids)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams[n > HOT_STRETCHES])], ["gram"])


_ROWS = ("doc_id", "q", "gram", "part", "h", "meta")
_ROWS_TYPE = ", ".join(f"{c} bigint" for c in _ROWS)


def _parts(found: dict[str, np.ndarray], hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the gram of each stretch is dealt out by stretch, and the part that the stretch goes to."""
    many = bit_filter.passes(hot, found["gram"])
    return many, np.where(many, found["h"] % HOT_PARTS, 0)


def _rows(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches that are first in their portion; the others, joined to ranges, whose length stands as a negative ``meta``."""
    for ids, texts in _portions(batches, TASK_BYTES):
        found = find_stretches(texts)
        again = _own_repeats(found, ids)
        many, part = _parts(found, hot)
        sent = ~again
        own = found["text"][again], found["q"][again], found["n"][again]
        new = np.append(True, (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1] + own[2][:-1]))[: len(own[0])]
        at = np.flatnonzero(new)
        length = np.add.reduceat(own[2], at) if len(at) else own[2]
        none = np.zeros(len(at), np.int64)
        columns = [
            (ids[found["text"][sent]], ids[own[0][at]]),
            (found["q"][sent], own[1][at]),
            # a range settled here only passes through: it may go anywhere
            (found["gram"][sent], own[1][at] * 1_000_003 + ids[own[0][at]] % 1_000_003),
            (part[sent], none),
            (found["h"][sent], none),
            ((found["meta"] | (many.astype(np.int64) << 60))[sent], -length),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], list(_ROWS))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by gram and part; out go repeats (``again``) and the stretches that others may agree with in part."""
    for table in _whole_groups(batches, ("gram", "part")):
        doc_id, q, gram, part, h, meta = (table.column(c).to_numpy() for c in _ROWS)
        settled = meta < 0
        out = [(doc_id[settled], q[settled], -meta[settled], np.ones(int(settled.sum()), bool))]
        order = np.lexsort((q, doc_id, h, part, gram))
        order = order[~settled[order]]
        doc_id, q, gram, part, h, meta = (c[order] for c in (doc_id, q, gram, part, h, meta))
        if len(q):
            next_group = np.append(True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))
            new = next_group | np.append(True, h[1:] != h[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
            later = (doc_id > doc_id[lead]) | (q > q[lead])
            group = np.cumsum(next_group)
            open_ = ((meta >> 52) & 1 == 1) | ((meta >> 60) & 1 == 1)
            for k in range(CORES):
                held = np.flatnonzero((meta >> (48 + k)) & 1)
                key = (group[held] << 12) | ((meta[held] >> (12 * k)) & 0xFFF)
                by_key = np.argsort(key, kind="stable")
                held, key = held[by_key], key[by_key]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                if len(at):
                    differ = np.minimum.reduceat(h[held], at) != np.maximum.reduceat(h[held], at)
                    open_[held] |= np.repeat(differ, np.diff(np.append(at, len(held))))
            sent = later | open_
            out.append((doc_id[sent], q[sent], (meta[sent] >> 53) & 127, later[sent]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["doc_id", "q", "n", "again"])


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that end where a group of the sorted rows ends: the last group of a batch is held back for the next."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.stack([table.column(c).to_numpy() for c in names])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        fresh = last is not None and (keys[:, 0] != last).any()
        if fresh:
            yield pa.concat_tables(held)
            held = []
        last = keys[:, -1]
        if len(cut):
            end = int(cut[-1]) + 1
            yield pa.concat_tables([*held, table.slice(0, end)])
            held = [table.slice(end)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def _mixed(doc_id: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A hash of a place."""
    mixed = (doc_id.astype(np.uint64) * _EVEN) ^ (q.astype(np.uint64) * _ODD)
    mixed ^= mixed >> np.uint64(32)
    mixed *= _EVEN
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = _mixed(batch.column("doc_id").to_numpy(), batch.column("q").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])


def _pieces(batches: Iterator[pa.RecordBatch], hot: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches whose place passes the filter, with their text.  One that passes by chance is compared needlessly, no more."""
    for ids, texts in _portions(batches, TASK_BYTES):
        found = find_stretches(texts)
        many, part = _parts(found, hot)
        key = ids[found["text"]]
        sent = bit_filter.passes(wanted, _mixed(key, found["q"]))
        rows = zip(found["text"][sent].tolist(), found["q"][sent].tolist(), found["n"][sent].tolist())
        piece = pa.array([texts[t][q : q + n + LENGTH - 1] for t, q, n in rows], pa.binary())
        numbers = [pa.array(c[sent].astype(np.int64)) for c in (key, found["q"], found["n"], found["gram"], part)]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array(many[sent]), piece], ["doc_id", "q", "n", "gram", "part", "hot", "piece"])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes, and the rank of each (equal prefixes share a rank).

    Larsson-Sadakane: suffixes are sorted by eight bytes; then, in groups that are not settled, by the rank of what follows as far
    as is known, so that the known length doubles each time.
    """
    size = len(text)
    padded = np.append(text, np.zeros(8, np.uint8))
    key = _loads(padded, ">")[:size].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(size + depth, np.int64) - 1
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    known = 8
    while known < depth:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        step = min(known, depth - known)
        group = order[places]
        both = rank[group] * (size + 1) + rank[group + step] + 1
        order[places] = group[np.argsort(both, kind="stable")]
        group = order[places]
        both = rank[group] * (size + 1) + rank[group + step] + 1
        fresh = np.append(True, both[1:] != both[:-1])
        new[places] = fresh
        rank[group] = np.maximum.accumulate(np.where(fresh, places, 0))
        known += step
    return order, rank[:size]


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, lane: int = 64) -> np.ndarray:
    """Bytes, up to ``cap``, that each suffix in order shares with the one before it.

    Kasai's walk goes through the text, keeping all but one of the bytes shared at the place before.  Many lanes walk at once, each
    over its own stretch of the text.  Suffixes are ordered by ``cap`` bytes only, so nothing is kept from a prefix that reached it.
    """
    size = len(text)
    before = np.full(size, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(size, np.int64)
    lanes = np.arange(0, size, lane)
    kept = np.zeros(len(lanes), np.int64)
    padded = np.concatenate([text.astype(np.int16), np.full(cap + 1, -1, np.int16)])
    eight = _loads(np.append(text, np.zeros(cap + 8, np.uint8)), "<")
    for step in range(lane):
        at = lanes + step
        live = np.flatnonzero(at < size)
        i, j = at[live], before[at[live]]
        h = np.maximum(np.where(kept[live] == cap, 0, kept[live]) - 1, 0)
        h[j < 0] = 0
        going = np.flatnonzero(j >= 0)
        while len(going):  # eight bytes at a time as long as they are inside the text
            a, b = i[going] + h[going], j[going] + h[going]
            going = going[(h[going] + 8 <= cap) & (np.maximum(a, b) + 8 <= size) & (eight[a] == eight[b])]
            h[going] += 8
        going = np.flatnonzero(j >= 0)
        while len(going):
            a, b = i[going] + h[going], j[going] + h[going]
            same = (h[going] < cap) & (padded[a] == padded[b]) & (padded[a] >= 0)
            going = going[same]
            h[going] += 1
        shared[i] = h
        kept[live] = h
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    result = np.empty(size, np.int64)
    result[place] = shared
    return result


def equal_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts: the text, the place in it, and the class of equal windows."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    order, _ = suffix_array(raw, LENGTH)
    classes = np.empty(len(raw), np.int64)
    classes[order] = np.cumsum(common_prefixes(raw, order, LENGTH) < LENGTH)
    starts = np.cumsum(sizes) - sizes
    every = np.arange(len(raw))
    text = np.searchsorted(starts, every, side="right") - 1
    valid = every - starts[text] + LENGTH <= sizes[text]
    return text[valid], (every - starts[text])[valid], classes[valid]


def _settle(rows: pa.Table) -> pa.RecordBatch:
    """A shard: its repeated windows as runs, and the distinct windows of grams that other shards hold too."""
    texts = [t.as_py() for t in rows.column("piece")]
    ids, q0 = rows.column("doc_id").to_numpy(), rows.column("q").to_numpy()
    spread = rows.column("hot").to_numpy()
    text, place, classes = equal_windows(texts)
    key, q = ids[text], q0[text] + place
    order = np.lexsort((q, key, classes))
    text, key, q, classes, place = text[order], key[order], q[order], classes[order], place[order]
    new = np.append(True, classes[1:] != classes[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    later = (key > key[lead]) | (q > q[lead])
    again = np.sort(_joint(text[later], place[later]))
    t, p = again >> 32, again & 0xFFFFFFFF
    fresh = np.append(True, again[1:] != again[:-1] + 1) if len(again) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    n = np.diff(np.append(at, len(again)))
    out = [(ids[t[at]], q0[t[at]] + p[at], n, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool))]
    kept = np.flatnonzero(~later & spread[text])
    if len(kept):
        digest = xxhash.xxh3_128_digest
        hashes = b"".join(digest(texts[t][p : p + LENGTH]) for t, p in zip(text[kept].tolist(), place[kept].tolist()))
        both = np.frombuffer(hashes, "<i8").reshape(-1, 2)
        out.append((key[kept], q[kept], np.ones(len(kept), np.int64), both[:, 0], both[:, 1], np.ones(len(kept), bool)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["doc_id", "q", "n", "h", "k", "ask"])


def _joint(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by gram and part; a shard takes whole parts until it is full."""
    held: list[pa.Table] = []
    total, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.stack([table.column("gram").to_numpy(), table.column("part").to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        sizes = np.append(0, np.cumsum(table.column("n").to_numpy() + LENGTH - 1))
        for a, b in zip(cuts, cuts[1:]):
            if total >= SHARD_BYTES and tuple(keys[:, a]) != last:
                yield _settle(pa.concat_tables(held))
                held, total = [], 0
            held.append(table.slice(a, b - a))
            total += int(sizes[b] - sizes[a])
            last = tuple(keys[:, a])
    if held:
        yield _settle(pa.concat_tables(held))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``q``, ``n``: windows ``q`` to ``q + n - 1`` of the document start earlier too.  Ranges may overlap.

    ``docs`` has ``doc_id`` (long) and ``raw`` (binary).
    """
    docs = docs.filter("doc_id is not null and length(raw) >= " + str(LENGTH))
    place = ["doc_id", "q"]
    hot = bit_filter.build(docs.mapInArrow(_hot_grams, "gram bigint"))

    # one exchange, by gram: first stretches, and grams that stand in different ones
    rows = docs.mapInArrow(lambda batches: _rows(batches, hot.value), _ROWS_TYPE)
    rows = rows.repartition("gram", "part").sortWithinPartitions("gram", "part")
    told = materialize(rows.mapInArrow(_classes, "doc_id bigint, q bigint, n bigint, again boolean"), "stretches")
    whole = told.filter("again").select(*place, "n")

    wanted = bit_filter.build(told.filter("not again").select(*place).mapInArrow(_places, "place bigint"))
    kinds = "doc_id bigint, q bigint, n bigint, gram bigint, part bigint, hot boolean, piece binary"
    cut = docs.mapInArrow(lambda batches: _pieces(batches, hot.value, wanted.value), kinds)
    dealt = cut.repartition("gram", "part").sortWithinPartitions("gram", "part")
    settled = materialize(dealt.mapInArrow(_shards, "doc_id bigint, q bigint, n bigint, h bigint, k bigint, ask boolean"), "settled")
    partly = settled.filter("not ask").select("doc_id", "q", "n")
    asks = settled.filter("ask")
    oldest = asks.groupBy("h", "k").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    across = asks.join(oldest, ["h", "k"]).filter(F.struct(*place) > F.col("first")).select("doc_id", "q", "n")
    return whole.union(partly).union(across)


def _cut(packed: pa.Array, ranges: pa.Array) -> pa.Array:
    kept, size, removed, spans = [], [], [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for raw, found in zip(packed, ranges):
        raw = np.frombuffer(unpack(raw.as_py()), np.uint8)
        change = np.zeros(len(raw) + 1, np.int64)
        if found.is_valid:
            at = np.array([(r["q"].as_py(), r["n"].as_py()) for r in found], np.int64).reshape(-1, 2)
            np.add.at(change, at[:, 0], 1)
            np.add.at(change, at[:, 0] + at[:, 1] + LENGTH - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept.append(raw[~gone].tobytes())
        size.append(len(raw))
        removed.append(int(gone.sum()))
        spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0)
    numbers = [pa.array(c, pa.int64()) for c in (size, removed, spans)]
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *numbers], ["kept", "n_bytes", "n_removed", "n_spans"])


def _pack(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``; other columns stay,
    but for those of the same names, which are replaced.  Texts go to their ranges packed."""
    made = ("kept", "n_bytes", "n_removed", "n_spans")
    inputs = [c for c in docs.columns if c not in made]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ranges = materialize(repeated_ranges(docs.select("doc_id", raw.alias("raw"))), "repeated-ranges")
    listed = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("q", "n")).alias("__ranges"))  # no more than the document has
    packed = docs.select(*inputs, F.arrow_udf(_pack, "binary")(F.col("text")).alias("__packed"))
    cut = F.arrow_udf(_cut, "struct<kept: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint>")
    joined = packed.join(listed, "doc_id", "left").withColumn("__cut", cut(F.col("__packed"), F.col("__ranges")))
    return joined.select(*inputs, "__cut.*")
