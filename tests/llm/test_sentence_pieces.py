import hashlib
import random

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridweft.llm import queries as Q
from gridweft.llm import sentence_pieces as S

MODEL = P.path(Q.PIECE_VOCABULARY)
DATA = "/root/testdata/sf0.001"
PARTS = ["a", " ", "  ", "\n", "\t", "▁", "é", "é", "ﬁ", "ｘ", "Ⅷ", "ガ", "日本", "😀", "﷽", "​", "\x00", "hello", "ｶﾞ", " ", "½", "</s>"]


def texts(seed, size=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(size)]


def with_rules(tmp_path, name, **flags):
    """The given vocabulary with another character map of the library."""
    with open(MODEL, "rb") as file:
        model = file.read()
    map_of = sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()
    rules = dict(S._fields(next(v for n, v in S._fields(map_of) if n == 3))) | {3: 1, 4: 0, 5: 1} | flags.get("fields", {})
    path = tmp_path / f"{name}.model"
    fields = b"".join(S._field(n, v) for n, v in rules.items() if n != 6)
    path.write_bytes(b"".join(S._field(n, v) for n, v in S._fields(model) if n != 3) + S._field(3, fields))
    return str(path)


def check(path, some):
    model, library = S.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text, (ids, starts, ends) in zip(some, model.encode_all(some)):
        assert ids.tolist() == library.encode(text), text
        assert model.normalise(text)[0] == library.normalize(text)
        raw = text.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(starts, ends)) and sorted(starts) == starts.tolist()
        for piece, a, b in zip(library.encode(text, return_type="proto").pieces, starts.tolist(), ends.tolist()):
            if piece.begin < piece.end and not library.is_byte(piece.id):  # there the last byte of a character gets all of it
                assert a == piece.begin or raw[piece.begin : a].isspace(), (text, piece.piece)
                if b > piece.end:  # the piece ends inside of a replacement, which stands for its whole source
                    assert raw[piece.end : b].decode() in model.keys, (text, piece.piece)
                else:  # the library adds spaces that it removed
                    assert not library.normalize(raw[b : piece.end].decode()).strip("▁"), (text, piece.piece)


def test_ids_and_spans_of_the_given_model():
    check(MODEL, texts(1))


@pytest.mark.parametrize("rules, trim", [("nmt_nfkc", 1), ("nfkc", 0)])
def test_longest_prefixes_of_compiled_maps(tmp_path, rules, trim):
    path = with_rules(tmp_path, rules, fields={4: trim})
    assert len(S.PieceModel(path).keys) > 1000
    check(path, texts(2, 200))


def test_spans_of_copied_and_replaced_bytes(tmp_path):
    model = S.PieceModel(MODEL)
    text = "Hi  日﷽!"
    ((ids, starts, ends),) = model.encode_all([text])
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw
    mapped = S.PieceModel(with_rules(tmp_path, "nfkc"))
    ((_, starts, ends),) = mapped.encode_all(["aⅧb"])
    assert {(a, b) for a, b in zip(starts.tolist(), ends.tolist())} <= {(0, 1), (0, 4), (1, 4), (4, 5), (1, 5), (0, 5)} and max(ends) == 5


def test_runs_of_a_long_text_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(S, "RUN", 7)
    check(MODEL, texts(3, 200) + ["word " * 50, "x" * 100, " " * 60])


def test_op11_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    source = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())
    rows = Q.op11_sentence_pieces(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(source)
    for row in rows:
        ids = library.encode(source[row.doc_id], add_eos=True)
        assert row.n_tokens == len(ids) and row.n_spanned == len(source[row.doc_id].encode())
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_texts(odd):
    frame = S.encode(odd.withColumn("pieces", F.lit("replaced")), MODEL, end=True)
    rows = frame.withColumn("back", S.decode(F.col("pieces.ids"), MODEL)).collect()
    assert len(rows) == 10 and frame.columns == [*odd.columns, "pieces"]
    assert [(r.pieces.ids, r.pieces.starts, r.back) for r in rows if r.doc_id in (1, 2)] == [([2], [0], "")] * 2
    assert next(r.back for r in rows if r.doc_id == 7).startswith("日本語 é ñ")
    assert all(r.pieces.spanned == len((r.text or "").encode()) for r in rows)
    assert S.encode(odd.limit(0), MODEL).collect() == []
    assert odd.select(S.decode(F.lit(None).cast("array<int>"), MODEL).alias("t")).first().t is None
