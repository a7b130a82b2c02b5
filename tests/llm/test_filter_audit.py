import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.llm import filter_audit as A
from gridweft.llm import queries as Q
from tests.test_queries import rows as sorted_rows

DATA = "/root/testdata/sf0.001"


def audit_by_hand(docs, labels):
    """Every order applied to the documents one filter after the other; ``docs`` are (id, text, source)."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    failed = []
    for i, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs),
        ]
        failed.append({f for f, t in zip("ABCDE", tests) if t})
    found = {}
    shapley = Counter()
    for part in {s or "" for *_, s in docs}:
        rows = [(i, f) for (i, _, s), f in zip(docs, failed) if (s or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[part, name] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in rows) - len(gone), sum(f == {name} for _, f in rows),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name,
                ]
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in found.items()}


def collected(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in frame.collect()}


def test_differences_equal_sets():
    rng = random.Random(4)
    for size in (0, 1, 50):
        masks = [rng.randrange(32) for _ in range(size)]
        found = A.interactions(np.array(masks, np.int32), np.ones((1, size), np.int64))
        assert len(found) == 80
        for f, before, (removed, gone) in found:
            assert removed == sum(m >> f & 1 and not m & before for m in masks)
            assert gone == sum(bool(m & (before | 1 << f)) for m in masks)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(6)
    rows = []
    for i in range(160):
        n = rng.choice([0, 10, 210])
        words = [rng.choice(["a", "B", "cc", "dd"]) if rng.random() < 0.3 else f"w{k}" for k in range(n)]
        text = " ".join(words) + rng.choice(["", "#", " XYZ" * 40])
        rows.append((rng.randrange(120), rng.choice([text, None, "same text"]), rng.choice(["s", "t", None, ""])))
    rows += [(None, "same text", "s"), (None, None, None), (7, "same text", "s"), (7, "same text", "s"), (500, "clean " + " ".join(map(str, range(300))), "alone")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("share", [1000, 20])
def test_audit_equals_filters_applied_in_turn(spark, monkeypatch, cases, share):
    monkeypatch.setattr(A, "HOT_SHARE", share)
    docs = spark.createDataFrame(cases[0], "doc_id long, text string, source string").withColumn("part", F.lit("x")).withColumn("mask", F.lit("y"))
    labels = spark.createDataFrame(cases[1], "doc_id long, quality int, toxic int")
    assert collected(A.audit(docs, labels)) == audit_by_hand(*cases)


def test_shapley_adds_up_to_what_all_remove(spark):
    for (part, order, step), v in collected(Q.op13_filter_audit(spark, DATA)).items():
        assert v[1] + v[2] >= v[3]


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    assert sorted_rows(Q.op13_filter_audit(spark, DATA).toPandas()) == sorted_rows(con.sql(Q.ORACLES["op13_filter_audit"]).df())


def test_empty_and_odd_tables(spark, odd, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert collected(A.audit(docs_of([]), labels)) == {}
    rows = collected(A.audit(odd, labels))
    assert len(rows) == 600 and rows["s", "ABCDE", 5][0] == 0 and all(r[4] == r[5] == 0 for r in rows.values())
