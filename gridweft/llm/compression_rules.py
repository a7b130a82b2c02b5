"""Quality rules with compression bands.

A text is compressed whole and in chunks with zstandard.  Compressed size over size is low for repetitive text and high for random
text; each length has its own band, since short texts compress less.  Chunks have 4 kB, in shorter texts 256 bytes; what
remains at the end is a chunk too, so every byte lies in one chunk.  A text outside its band, or with more than a quarter of its
bytes in chunks outside the band of their length, is rejected.  So are texts of fewer than 50 words, and texts more than half
of whose words stand in repeated windows of three words.

Null and empty texts have no words and are rejected.  Texts of any length are compressed whole; memory is that of one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ((0, 0.0, 9.0), (256, 0.22, 0.88), (1024, 0.20, 0.76), (4096, 0.18, 0.70), (16384, 0.15, 0.66))
"""From so many bytes on: least and greatest ratio.  Running prose lies near 0.6 at 1 kB and near 0.4 at 50 kB."""
CHUNK = 4096
CHUNK_BAND = (0.18, 0.74)
SMALL_CHUNK_BANDS = ((0, 0.0, 9.0), (256, 0.30, 0.92), (1024, 0.25, 0.80), (CHUNK, *CHUNK_BAND))
"""By the length of a chunk.  In good documents chunks from 256 bytes on lie near 0.65, from 1 kB on near 0.53."""
LEAST_CHUNK = 256
CHUNK_SHARE = 0.25
LEVEL = 3
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FIELDS = (
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
    ("ratio", "double"), ("n_chunks", "bigint"), ("n_odd_chunks", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"),
)


def words_in_repeated_windows(words: list) -> int:
    """Words in three-word windows that the text has twice or more, the first one included."""
    if len(words) < 4:
        return 0
    number: dict = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = code[:-1] * len(number) + code[1:]
    if len(number) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
        number_of_pairs = len(words)
    else:
        number_of_pairs = len(number)
    window = pair[:-1] * number_of_pairs + code[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    twice = np.zeros(len(words), bool)
    for side in (order[:-1][same], order[1:][same]):
        for step in range(3):
            twice[side + step] = True
    return int(twice.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def chunks_of(size: int) -> list[tuple[int, int]]:
    """Bounds of the chunks, which cover all bytes; an end below ``LEAST_CHUNK`` belongs to the chunk before it."""
    step = CHUNK if size >= CHUNK else LEAST_CHUNK
    starts = list(range(0, size, step))
    if len(starts) > 1 and size - starts[-1] < LEAST_CHUNK:
        starts.pop()
    return list(zip(starts, [*starts[1:], size]))


def compression(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Ratio of the whole, number of chunks, how many of them lie outside their band, and the bytes of those."""
    if not raw:
        return 0.0, 0, 0, 0
    whole = len(compressor.compress(raw)) / len(raw)
    chunks, odd, odd_bytes = chunks_of(len(raw)), 0, 0
    for start, end in chunks:
        ratio = whole if len(chunks) == 1 else len(compressor.compress(raw[start:end])) / (end - start)
        _, low, high = max(band for band in SMALL_CHUNK_BANDS if band[0] <= end - start)
        if not low <= ratio <= high:
            odd, odd_bytes = odd + 1, odd_bytes + end - start
    return whole, len(chunks), odd, odd_bytes


def judge(text: str, compressor: zstandard.ZstdCompressor) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeated = words_in_repeated_windows(words)
    ratio, chunks, odd, odd_bytes = compression(raw, compressor)
    _, low, high = max(band for band in BANDS if band[0] <= len(raw))
    failed = len(words) < LEAST_WORDS or 100 * repeated > 50 * len(words)
    kept = not failed and low <= ratio <= high and odd_bytes <= CHUNK_SHARE * len(raw)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated,
        ratio, chunks, odd, failed, kept,
    )


def quality_rules(text: Column) -> Column:
    """The counts, the compression figures, ``base_failed`` and ``kept`` of a text."""

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {t}" for n, t in FIELDS) + ">")
    def judged(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        columns = list(zip(*(judge(t.as_py() or "", compressor) for t in texts))) or [()] * len(FIELDS)
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.StructArray.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS])

    return judged(text)
