import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridweft.llm import byte_bpe as B
from gridweft.llm import queries as Q
from gridweft.llm import token_counts as C

WORDS, RANKS = P.path(Q.WORD_VOCABULARY), P.path(Q.BYTE_VOCABULARY)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def ranks():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def test_every_prefix_has_the_count_of_the_library(words):
    rng = random.Random(3)
    parts = ["it", "'ve", "'s", "!!", "hello", " ", "  ", "\n", "unbelievably", "é", "12", "ab", "<|endoftext|>", "<|startoftext|>", "aaaa", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for text in texts + ["internationalization's we'll!?", "''ve 'S", "x<|endoftext|"]:
        table = C.counter(WORDS).table(text)
        assert len(table) == len(text)
        found = words.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)
        assert table.tolist() == [len(e.ids) for e in found], text


def test_totals_where_normalising_changes_the_text(words):
    for text in ["İstanbul ΣΑΣ é 日本語 テスト ½", "a\x85b\x1cc​ d﻿", "ﬁ😀😀👍🏽", "가", "한국어", chr(0x3E808) * 2]:
        assert C.counter(WORDS).report([text], 5)[0] == [len(words.encode(text, add_special_tokens=False).ids)]


def test_word_table_forgets_and_goes_on(monkeypatch, words):
    monkeypatch.setattr(C, "WORDS_KEPT", 3)
    count = C.PrefixCounter(WORDS)
    for text in ("alpha beta gamma", "delta epsilon", "alpha zeta"):
        assert count.report([text], 99)[0] == [len(words.encode(text, add_special_tokens=False).ids)]


def test_stored_table_answers_questions(spark, words):
    text = "the quick brown fox jumps over antidisestablishmentarianism twice"
    frame = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", C.prefix_counts(F.col("t"), WORDS).alias("p"))
    row, empty, null = frame.select(
        C.tokens_of_prefix(F.col("p"), F.lit(12)).alias("n"), C.longest_prefix(F.col("p"), F.lit(4)).alias("k"), F.size("p").alias("s")
    ).collect()
    assert row["n"] == len(words.encode(text[:12], add_special_tokens=False).ids)
    assert max(k for k in range(len(text) + 1) if len(words.encode(text[:k], add_special_tokens=False).ids) <= 4) == row["k"]
    assert empty == null == (0, 0, 0)


def test_op2_equals_the_library(spark, words):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())
    for row in Q.op2_token_counts(spark, DATA).collect():
        n = len(words.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len(texts[row.doc_id].encode()), n > 2048)


def test_bpe_equals_ranks(ranks):
    rng = random.Random(5)
    parts = ["a", "aa", "-", "--", " ", "  ", "é", "\n", "ab", "日", "1", "==", "<|endoftext|>", "'ll", "😀", " ", "\x1c"]
    bpe = B.bpe(RANKS, P.PATTERN)
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = bpe.encode(text)
        assert ids == ranks.encode_ordinary(text)
        assert bpe.decode(np.array(ids, np.int64)).tobytes() == text.encode()


def test_offsets_and_split_characters(spark):
    text = "a 日本 😀!"
    frame = spark.createDataFrame([(text,), (None,)], "t string")
    spans, none = frame.select(B.encode_with_offsets(F.col("t"), RANKS, P.PATTERN).alias("s")).collect()
    assert none["s"]["ids"] == []
    tokens = B.bpe(RANKS, P.PATTERN)
    at = 0
    for i, a, b in zip(*spans["s"]):
        size = int(tokens.lengths[i])
        assert text.encode()[at : at + size] in text[a:b].encode()
        at += size
    whole = spark.createDataFrame([(spans["s"]["ids"],), (spans["s"]["ids"][:-2],), ([],), (None,)], "ids array<int>")
    back = [r[0] for r in whole.select(B.decode_text(F.col("ids"), RANKS, P.PATTERN)).collect()]
    assert back[0] == text and back[1].startswith("a 日本 ") and back[2:] == ["", None]
    with pytest.raises(ValueError):
        tokens.decode(np.array([1 << 20]))


def test_op3_round_trip(spark, ranks):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())
    for row in Q.op3_byte_bpe(spark, DATA).collect():
        ids = ranks.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_round_trip_is_encoding_and_decoding(odd):
    both = odd.select("text", B.round_trip(F.col("text"), RANKS, P.PATTERN).alias("r"), B.encode(F.col("text"), RANKS, P.PATTERN).alias("ids"))
    rows = both.select("text", "r.*", F.col("ids").alias("only")).collect()
    assert len(rows) == 10 and all(r.ids == r.only and bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert odd.limit(0).select(B.round_trip(F.col("text"), RANKS, P.PATTERN)).collect() == []


def test_odd_texts(odd):
    found = odd.select("doc_id", C.token_report(F.col("text"), WORDS, 9).alias("r"), B.encode(F.col("text"), RANKS, P.PATTERN).alias("i"))
    rows = found.collect()
    assert len(rows) == 10
    assert [r for r in rows if r.doc_id in (1, 2)] == [(1, (0, 0), []), (2, (0, 0), [])]
    assert odd.limit(0).select(C.token_report(F.col("text"), WORDS, 9)).collect() == []
