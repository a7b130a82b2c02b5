import hashlib

import duckdb
import pytest

import corpus_pipeline as P
from gridweft.llm import queries as Q
from tests.llm import test_duplicates as D

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out of it, over the small table."""
    docs, out = Q.table(spark, DATA, "documents"), []
    for name, stage in P.STAGES:
        found = P.materialize(stage(spark, docs, DATA), "test")
        out.append((name, {r.doc_id: r.asDict() for r in docs.collect()}, {r.doc_id: r.asDict() for r in found.collect()}))
        docs = found
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for _, before, after in stages[:-1]:
        assert {tuple(r) for r in after.values()} <= {P.COLUMNS} and set(after) <= set(before)


def test_quality_stage(spark, stages):
    kept = {r.doc_id for r in Q.op5_quality_model(spark, DATA).collect() if r.predicted}
    assert set(stages[0][2]) == kept and 0 < len(kept) < len(stages[0][1])


def test_line_stage(stages):
    _, before, after = stages[1]
    assert {i: r["text"] for i, r in after.items()} == D.lines_by_hand([(i, r["text"]) for i, r in before.items()])
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_near_copy_stage(stages):
    _, before, after = stages[2]
    label = D.groups_by_hand({i: D.fingerprint_by_hand(r["text"]) for i, r in before.items()})
    assert set(after) == {i for i in before if label[i] == i}


def test_decontamination_stage(stages):
    _, before, after = stages[3]
    items = [D.D.tokens(t) for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    words = {i: D.D.tokens(r["text"]) for i, r in before.items()}
    hit = {
        i for i, w in words.items() for item in items
        if sum(t[3] for t in D.D.greedy_tiles(item, [w], D.D.LEAST_TILE)) >= D.D.COVERAGE * len(item)
    }
    assert set(after) == set(before) - hit


def test_token_stage(spark, stages):
    _, before, after = stages[4]
    assert {i: r["decoded_sha256"] for i, r in after.items()} == {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in before.items()}
    assert {r.doc_id: r.n_tokens for r in P.run(spark, DATA).collect()} == {i: r["n_tokens"] for i, r in after.items()}


def test_odd_and_empty_documents(spark, docs_of, odd):
    for docs in (odd, docs_of([])):
        for _, stage in P.STAGES[1:]:
            docs = P.materialize(stage(spark, docs, DATA), "test")
            docs.collect()
