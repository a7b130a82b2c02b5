import random

import zstandard

from gridweft.llm import compression_rules as R


def kept(text):
    return R.judge(text, zstandard.ZstdCompressor(level=R.LEVEL))[-1]


def prose(size):
    rng = random.Random(size)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(size // 4)]
    return " ".join(words)[: size - 1] + " "


def test_chunks_cover_every_byte_once():
    for size in (1, 255, 256, 700, 1023, 1024, 1200, 4095, 4096, 4097, 4352, 8191, 8192, 20_000):
        chunks = R.chunks_of(size)
        assert [b for _, b in chunks[:-1]] == [a for a, _ in chunks[1:]] and (chunks[0][0], chunks[-1][1]) == (0, size)
        assert len(chunks) == 1 or min(b - a for a, b in chunks) >= R.LEAST_CHUNK


def test_an_end_below_4_kb_is_tested():
    for filler in ("=" * 4095, ("-" * 72 + "\n") * 56):
        assert not kept(prose(4096) + filler)


def test_texts_below_4_kb_are_tested_in_parts():
    for size in (600, 1024, 2048):
        assert kept(prose(size)) and not kept(prose(size) + "=" * (size - 1))
