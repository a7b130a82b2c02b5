"""Byte-level BPE: text to ids with offsets, and ids back to bytes and text.

The vocabulary is a rank file.  Its bytes are written with the usual table of 256 printable characters, all ways of joining
two known parts become merges in rank order, and the ``tokenizers`` library encodes with them.  A piece (one match of the
pattern) always has the same ids, so each task sends a piece to the library once and keeps a bounded table of pieces.

Results for odd input: null and empty text have no ids and decode to empty bytes; null ids decode to null; an id outside the
vocabulary is an error.  Very long texts are encoded whole; nothing is cut.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES_KEPT = 600_000
"""Pieces a task remembers; beyond that the table starts anew.  It changes speed and memory only."""


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def view(values: array) -> np.ndarray:
    """The array's memory as it is; it must be gone before the array grows again."""
    return np.frombuffer(values, np.dtype(values.typecode)) if values else np.zeros(0, np.int64)


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, about a million characters at a time, so that memory does not depend on the size of batches."""
    some, size = [], 0
    for value in texts:
        some.append(value.as_py() or "")
        size += len(some[-1])
        if size >= 1 << 20:
            yield some
            some, size = [], 0
    if some:
        yield some


class ByteBpe:
    """A vocabulary with the library's encoder, the piece table, and the bytes of every id in one array."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        spell = lambda token: "".join(chars[b] for b in token)
        merges = [
            (spell(token[:cut]), spell(token[cut:]))
            for token, _ in sorted(ranks.items(), key=lambda pair: pair[1])
            for cut in range(len(token) - 1, 0, -1)
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        vocab = {spell(token): rank for token, rank in ranks.items()}
        self.library = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = regex.compile(pattern).findall
        self.forget()
        # decoding: every id's characters are turned back by the reversed byte table and laid end to end
        byte_of = {c: b for b, c in enumerate(chars)}
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for word, rank in vocab.items():
            tokens[rank] = bytes(byte_of[c] for c in word)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def forget(self) -> None:
        """Start the table of pieces anew: the number of each piece, and the ids of all pieces end to end."""
        self.number: dict[str, int] = {}
        self.pool, self.firsts, self.sizes = array("i"), array("q"), array("q")

    def _learn(self, pieces: list[str]) -> None:
        for start in range(0, len(pieces), 10_000):
            part = pieces[start : start + 10_000]
            for piece, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                ids = found.ids
                self.number[piece] = len(self.number)
                self.firsts.append(len(self.pool))
                self.sizes.append(len(ids))
                self.pool.extend(ids)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        pieces: list[str] = []
        bounds = [0]
        for text in texts:
            pieces += self.pieces(text)
            bounds.append(len(pieces))
        new = set(pieces) - self.number.keys()
        if len(self.number) + len(new) > PIECES_KEPT and self.number:
            self.forget()
            new = set(pieces)
        self._learn(list(new))
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        sizes = view(self.sizes)[numbers]
        ends = np.cumsum(sizes)
        first = np.repeat(view(self.firsts)[numbers] - (ends - sizes), sizes)
        return view(self.pool)[first + np.arange(len(first))], np.diff(np.append(0, ends)[bounds])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        first = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.bytes[first + np.arange(len(first))]

    def character_spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every id in characters.  An id that holds part of a character spans that whole character."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))
        ends = np.cumsum(self.lengths[ids])
        return character[ends - self.lengths[ids]], character[ends - 1] + 1


@functools.lru_cache(maxsize=4)
def bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _list_array(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def _lists(parts: list) -> pa.ListArray:
    """List values from one array per row."""
    return _list_array(np.concatenate([*parts, np.zeros(0, np.int32)]), np.fromiter(map(len, parts), np.int64, len(parts)))


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        tokens = bpe(path, pattern)
        parts = [tokens.encode_all(some) for some in portions(texts)]
        none = np.zeros(0, np.int32)
        return _list_array(np.concatenate([none, *(p[0] for p in parts)]), np.concatenate([none, *(p[1] for p in parts)]))

    return ids(text)


def encode_with_offsets(text: Column, path: str, pattern: str) -> Column:
    """``ids``, ``starts`` and ``ends``; the last two are character positions (code points, end exclusive)."""

    @F.arrow_udf("struct<ids: array<int>, starts: array<int>, ends: array<int>>")
    def spans(texts: pa.Array) -> pa.Array:
        tokens = bpe(path, pattern)
        columns: tuple[list, list, list] = ([], [], [])
        for value in texts:
            t = value.as_py() or ""
            ids = np.array(tokens.encode(t), np.int64)
            for column, part in zip(columns, (ids, *tokens.character_spans(t, ids))):
                column.append(part)
        return pa.StructArray.from_arrays([_lists(c) for c in columns], ["ids", "starts", "ends"])

    return spans(text)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """``ids`` of a text, and ``decoded``: the bytes that these ids stand for.

    Where both are wanted, this encodes once: Spark puts a Python function of another's result beside it into one worker, which
    then calls the inner one twice.
    """

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        tokens = bpe(path, pattern)
        none = np.zeros(0, np.int32)
        ids, sizes, decoded, widths = [none], [none], [none.astype(np.uint8)], [none]
        for some in portions(texts):
            found, counts = tokens.encode_all(some)
            ids.append(found)
            sizes.append(counts)
            decoded.append(tokens.decode(found))
            widths.append(np.diff(np.append(0, np.cumsum(tokens.lengths[found]))[np.append(0, np.cumsum(counts))]))
        places = np.append(0, np.cumsum(np.concatenate(widths))).astype(np.int32)
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), pa.py_buffer(np.concatenate(decoded))])
        return pa.StructArray.from_arrays([_list_array(np.concatenate(ids), np.concatenate(sizes)), raw], ["ids", "decoded"])

    return both(text)


def decode_bytes(ids: Column, path: str, pattern: str) -> Column:
    """Bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        tokens = bpe(path, pattern)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        rows = zip(offsets[:-1], offsets[1:], lists.is_valid().to_numpy(zero_copy_only=False))
        return pa.array([tokens.decode(values[a:b]).tobytes() if valid else None for a, b, valid in rows], pa.binary())

    return raw(ids)


def decode_text(ids: Column, path: str, pattern: str) -> Column:
    """Text of the ids.  A character that is cut off at either end, or broken inside, becomes U+FFFD."""

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        tokens = bpe(path, pattern)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        rows = zip(offsets[:-1], offsets[1:], lists.is_valid().to_numpy(zero_copy_only=False))
        return pa.array(
            [tokens.decode(values[a:b]).tobytes().decode("utf-8", "replace") if valid else None for a, b, valid in rows],
            pa.string(),
        )

    return text(ids)
