"""SentencePiece encoding that keeps offsets, and decoding.

A model file carries a compiled character map: a double array of keys and a block of replacements.  A text is normalised by its longest
prefixes: at each place the longest key that stands there gives way to its replacement, else the character stays.  Every byte of the
normalised text records the source bytes that it comes from, through the dummy prefix, removed and escaped spaces.  The pieces of the
normalised text come from the library, with the same vocabulary and no normalising of its own, and each is projected to the source
bytes of its first and last byte.

A byte that was copied stands for itself, so a character that is cut in bytes gives each its own byte; all bytes of a replacement stand
for the whole prefix that they replace.  The dummy prefix stands for nothing, and spaces that normalising removes belong to no piece.

Null and empty texts have no pieces (the end id only, where it is asked for) and decode to an empty text; null ids decode to null.  Texts
are normalised whole and encoded whole; where no piece of the vocabulary goes on past a word, long texts are handed to the library in
runs of whole words, which gives the same ids.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
"""Stands for a space inside pieces; fixed by the format."""
RUN = 1 << 16
"""Characters of a long text that the library gets at once.  It changes memory only."""

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces; fixed by the format
PORTION = 1 << 20
"""Characters of many texts whose pieces a task holds at once."""
ENCODED_FIELDS = "ids array<int>, starts array<int>, ends array<int>, spanned bigint"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 2: None, 5: 4}[key & 7]
        size = varint() if size is None else size
        yield key >> 3, message[at : at + size]
        at += size


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def character_map(compiled: bytes) -> dict[str, bytes]:
    """All keys of a compiled character map with their replacements: a walk over the double array."""
    if not compiled:
        return {}
    (size,) = struct.unpack_from("<I", compiled)
    units = np.frombuffer(compiled, "<u4", size // 4, 4)
    texts = compiled[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    steps = np.arange(1, 256)
    found = {}
    open_nodes = [(offset(int(units[0])), b"")]
    while open_nodes:
        node, key = open_nodes.pop()
        children = node ^ steps
        inside = children < len(units)
        for byte in steps[inside][units[children[inside]] & 0x800000FF == steps[inside]].tolist():
            unit = int(units[node ^ byte])
            below = node ^ byte ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[(key + bytes([byte])).decode()] = texts[start : texts.index(b"\0", start)]
            open_nodes.append((below, key + bytes([byte])))
    return found


class PieceModel:
    """A model with its character map, a library that takes normalised text, and the length of every piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        kinds, lengths, rules = [], [], b""
        crosses = False
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                kinds.append(kind)
                lengths.append({BYTE: 1, UNKNOWN: -1, CONTROL: 0}.get(kind, len(piece[1])))
                crosses |= kind != BYTE and SPACE in text.lstrip(SPACE)
            elif number == 2:
                self.suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                rules = value
        self.lengths = np.array(lengths, np.int64)
        self.cuts = not crosses and USER not in kinds and not self.suffix
        spec = dict(_fields(rules))
        self.prefix, self.trim, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.keys = character_map(spec.get(2, b""))
        if USER in kinds:  # texts of these pieces are left as they are
            pieces = [dict(_fields(value)) for number, value in _fields(model) if number == 1]
            self.keys |= {p[1].decode(): p[1] for p in pieces if p.get(3) == USER}
        self.longest: dict[str, int] = {}
        for key in self.keys:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))
        # the vocabulary without normalising: no map, no prefix, no trimming
        plain = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 1)
        others = b"".join(_field(number, value) for number, value in _fields(model) if number in (1, 2))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=others + _field(3, plain))
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = self.decoder.eos_id()

    def _replaced(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the character map, each with the start and end of its source bytes."""
        raw = np.frombuffer(text.encode(), np.uint8)
        here = np.arange(len(raw) + 1, dtype=np.int32)
        if not self.longest or self.longest.keys().isdisjoint(text):
            return raw, here[:-1], here[1:]
        places = np.append(0, np.cumsum([len(c.encode()) for c in text]))
        out, starts, ends = [], [], []
        at = copied = 0
        while at < len(text):
            size = min(self.longest.get(text[at], 0), len(text) - at)
            while size and text[at : at + size] not in self.keys:
                size -= 1
            if not size:
                at += 1
                continue
            a, b = places[copied], places[at]
            value = self.keys[text[at : at + size]]
            out += [raw[a:b], np.frombuffer(value, np.uint8)]
            starts += [here[a:b], np.full(len(value), places[at])]
            ends += [here[a:b] + 1, np.full(len(value), places[at + size])]
            at += size
            copied = at
        a = places[copied]
        return tuple(np.concatenate(x) for x in (out + [raw[a:]], starts + [here[a:-1]], ends + [here[a:-1] + 1]))

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and the start and end of the source bytes of each of its bytes."""
        out, starts, ends = self._replaced(text)
        if self.trim and len(out):  # of spaces that follow one another the first stays, at both ends none
            space = out == 32
            kept = ~(space & np.append(True, space[:-1]))
            last = np.flatnonzero(~space)
            kept[last[-1] + 1 if len(last) else 0 :] = False
            out, starts, ends = out[kept], starts[kept], ends[kept]
        if not len(out):
            return "", starts[:0], ends[:0]
        if self.prefix:
            side = (lambda x, v: np.append(x, v)) if self.suffix else (lambda x, v: np.append(v, x))
            at = ends[-1] if self.suffix else starts[0]
            out, starts, ends = side(out, np.uint8(32)), side(starts, at), side(ends, at)
        if not self.escape:
            return out.tobytes().decode(), starts, ends
        wide = np.where(out == 32, len(SPACE.encode()), 1)
        escaped = out.tobytes().replace(b" ", SPACE.encode()).decode()
        size = int(wide.sum())
        if self.trim and not self.suffix:  # signs of the source that stand for spaces go too
            size -= (len(escaped) - len(escaped.rstrip(SPACE))) * len(SPACE.encode())
            escaped = escaped.rstrip(SPACE)
        return escaped, np.repeat(starts, wide)[:size], np.repeat(ends, wide)[:size]

    def _runs(self, text: str) -> list[str]:
        """The text in runs that no piece crosses: cut where a word ends."""
        if not self.cuts or len(text) <= RUN:
            return [text]
        runs, start = [], 0
        while len(text) - start > RUN:
            cut = text.find(SPACE, start + RUN)
            while cut > 0 and text[cut - 1] == SPACE:
                cut = text.find(SPACE, cut + 1)
            if cut < 0:
                break
            runs.append(text[start:cut])
            start = cut
        return [*runs, text[start:]]

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and starts and ends in source bytes, of each text."""
        for text in texts:
            plain, starts, ends = self.normalise(text)
            runs = self._runs(plain)
            ids = np.concatenate([x.astype(np.int64) for x in self.library.encode(runs, num_threads=1, return_type="numpy")])
            sizes = self.lengths[ids]
            if (sizes < 0).any():  # unknown pieces have no length of their own
                found = [p for x in self.library.encode(runs, num_threads=1, return_type="proto") for p in x.pieces]
                ids, sizes = np.array([p.id for p in found], np.int64), np.array([len(p.piece.encode()) for p in found], np.int64)
            last = np.cumsum(sizes)
            if len(ids) and last[-1] != len(starts):
                raise ValueError("the pieces do not make up the normalised text")
            yield ids, starts[last - sizes], ends[last - 1]


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> PieceModel:
    return PieceModel(path)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)])))


def _encoded(texts: list[str], model: PieceModel, end: bool) -> pa.StructArray:
    columns: tuple[list, list, list] = ([], [], [])
    spanned = []
    for source, found in zip(texts, model.encode_all(texts)):
        _, starts, ends = found
        spanned.append(int(ends.sum() - starts.sum()))
        size = len(source.encode()) if end else 0
        for column, part, last in zip(columns, found, (model.end, size, size)):
            column.append((np.append(part, last) if end else part).astype(np.int32))
    return pa.StructArray.from_arrays([*map(_lists, columns), pa.array(spanned, pa.int64())], ["ids", "starts", "ends", "spanned"])


def encode(docs: DataFrame, path: str, text: str = "text", end: bool = False) -> DataFrame:
    """``docs`` with ``pieces``: ``ids``, ``starts`` and ``ends`` in UTF-8 bytes of the source, and their sum ``spanned``.

    ``end`` adds the end id, which spans nothing.  All other columns stay; a column named ``pieces`` is replaced.  Rows leave a task
    about ``PORTION`` characters at a time, so that its memory does not depend on the size of batches.
    """
    docs = docs.drop("pieces")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            column, start = batch.column(text), 0
            texts: list[str] = []
            size = 0
            for at, value in enumerate(column, 1):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= PORTION or at == batch.num_rows:
                    part = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, _encoded(texts, model, end)], [*part.schema.names, "pieces"])
                    texts, size, start = [], 0, at

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("pieces", T.StructType.fromDDL(ENCODED_FIELDS))]))


def decode(ids: Column, path: str) -> Column:
    """The text that the ids stand for, as the library gives it."""

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        library = pieces(path).decoder
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        rows = zip(offsets[:-1], offsets[1:], lists.is_valid().to_numpy(zero_copy_only=False))
        return pa.array([library.decode(values[a:b].tolist()) if valid else None for a, b, valid in rows], pa.string())

    return decoded(ids)
