import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweft.llm import components as G
from gridweft.llm import decontamination as D
from gridweft.llm import line_dedup as L
from gridweft.llm import queries as Q
from gridweft.llm import simhash as H
from gridweft.llm import suffix_dedup as S
from tests.test_queries import rows as sorted_rows

DATA = "/root/testdata/sf0.001"


def lines_by_hand(rows):
    """Kept text, by id, for rows of distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        filled = [n for n, x in enumerate(lines) if x.strip(" \t\x0b\f\r")]
        gone = set()
        for q in range(len(filled)):
            for size in range(1, L.RUN + 1):
                window = tuple(lines[n] for n in filled[q : q + size])
                if len(window) < size or (size < L.RUN and sum(len(x.encode().split()) for x in window) <= L.WORDS):
                    continue
                if window in seen:
                    gone.update(filled[q : q + size])
                seen.add(window)
        out[i] = None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_line_runs_equal_brute_force(docs_of):
    rng = random.Random(1)
    rows = [(n, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randint(0, 40)))) for n in range(60)]
    rows += [(100, "\n".join(["p", "q", "r", "s", "t"])), (101, "x\np\nq\nr\ny"), (102, "p\nq\nr\ns\nt"), (103, None), (104, "")]
    got = {r.doc_id: r.text for r in L.dedup_lines(docs_of(rows)).collect()}
    assert got == lines_by_hand(rows)


def test_long_lines_count_alone_or_in_pairs(spark, docs_of):
    long, half = " ".join(f"w{n}" for n in range(80)), " ".join(f"h{n}" for n in range(26))
    rest = " ".join(f"r{n}" for n in range(26))
    rows = [
        (1, long), (2, "own start\n" + long + "\nown end"), (3, f"{half}\n{rest}"), (4, f"a\n\n{half}\n \n{rest}\nb"), (5, f"{half}\nc"),
        (6, long + "\n" + long), (7, f"{long}\nown end"), (8, " ".join(long.split()[:50])), (9, " ".join(long.split()[:50])), (10, f"{rest}\n{half}"),
    ]
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in L.dedup_lines(docs_of(rows)).collect()}
    assert {i: t for i, (t, *_) in got.items()} == lines_by_hand(rows)
    assert got[2] == ("own start\nown end", 1, 1) and got[4] == ("a\n\n \nb", 2, 1) and got[5][1] == got[9][1] == got[10][1] == 0
    assert got[6] == ("", 2, 1) and got[7] == ("", 2, 1)


def test_no_long_line_that_stands_earlier_is_kept(spark):
    seen = set()
    for row in L.dedup_lines(Q.table(spark, DATA, "documents")).orderBy("doc_id").collect():
        for line in (row.text or "").split("\n"):
            if len(line.encode().split()) > L.WORDS:
                assert line not in seen
                seen.add(line)


def test_lines_of_odd_rows(odd):
    found = L.dedup_lines(odd)
    assert found.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed", "n_runs"]
    assert sorted((r.doc_id or 0, r.n_removed) for r in found.collect()) == sorted((r.doc_id or 0, 0) for r in odd.collect())
    assert L.dedup_lines(odd.limit(0)).collect() == []


def test_op4_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted_rows(Q.op4_line_dedup(spark, DATA).toPandas()) == sorted_rows(con.execute(Q.OP4_SQL).df())


def bytes_by_hand(rows, length=S.LENGTH):
    seen, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for q in range(len(raw) - length + 1):
            window = raw[q : q + length]
            if seen.setdefault(window, (i, q)) < (i, q):
                cover[q : q + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if cover[k] and (not k or not cover[k - 1]))
        out[i] = (len(raw), sum(cover), spans, bytes(c for c, gone in zip(raw, cover) if not gone))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes_equal_brute_force(spark, docs_of, monkeypatch, hot):
    if hot:  # as if every gram were in very many stretches
        full = spark.sparkContext.broadcast(np.full(4, 0xFFFFFFFF, np.uint32))
        build = S.bit_filter.build
        monkeypatch.setattr(S.bit_filter, "build", lambda h: full if h.columns == ["gram"] else build(h))
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 260))) for _ in range(6)]
    rows = []
    for n in range(70):
        parts = [rng.choice(common)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 3))]
        parts.insert(0, "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 60))))
        rows.append((n, "".join(parts)))
    rows += [(90, "ab" * 300), (91, "a" * 500), (92, "a" * 99), (93, "abc" * 80), (94, None), (95, ""), (96, common[0] * 3)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup_substrings(docs_of(rows)).collect()}
    assert got == bytes_by_hand(rows)


def test_shard_sorts_and_classes():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 300))) for _ in range(12)] + [b"a" * 400, b"ab" * 150]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    order, _ = S.suffix_array(raw, S.LENGTH)
    whole = raw.tobytes()
    keys = [whole[i : i + S.LENGTH] for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(raw)))
    shared = S.common_prefixes(raw, order, S.LENGTH)
    for a, b, n in zip(keys, keys[1:], shared[1:]):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_bytes_of_odd_rows(odd):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in S.dedup_substrings(odd).collect()]
    removed = {i: n for i, _, n in got if n}
    assert len(got) == 10 and set(removed) == {5, 8} and removed[8] == 50_000 - 1
    assert S.dedup_substrings(odd.limit(0)).collect() == []


def test_op10_on_the_small_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in bytes_by_hand(rows).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op10_suffix_dedup(spark, DATA).collect()} == want


def fingerprint_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= H.RADIUS and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def test_op7_equals_brute_force(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    prints = {i: fingerprint_by_hand(t) for i, t in texts.items()}
    label = groups_by_hand(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op7_simhash(spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in texts}


def test_links_in_tiles_connect_as_all_links_do(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for c in centres for _ in range(25)}
    # one block value for all: every pair meets in the same bucket
    values |= {(v >> 16 << 16) & ((1 << 64) - 1) for v in values}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    nodes = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    want = groups_by_hand(signed)
    for tile in (8, 1024):
        found = {r.node: r.component for r in G.components(H.links(nodes, tile=tile), "test").collect()}
        assert {s: found.get(s, s) for s in signed} == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    found = {r.node: r.component for r in G.components(spark.createDataFrame(path + star, "a long, b long"), "test").collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{1000 + i: 1000 for i in range(1, 60)}}
    assert G.components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_near_duplicates_of_odd_rows(odd):
    got = {r.doc_id: r.component_id for r in H.near_duplicates(odd).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[6] == 4
    assert H.near_duplicates(odd.limit(0)).collect() == []


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_tiles_are_greedy_and_find_reordered_passages():
    item = ITEM.split()
    swapped = item[10:] + ["noise"] + item[:10]
    assert [(t[0], t[3]) for t in D.greedy_tiles(item, [swapped], 8)] == [(0, 10), (10, 10)]
    assert D.greedy_tiles(item, [item[:9] + ["x"] + item[:9]], 8) == [(0, 0, 0, 9)]
    assert D.greedy_tiles(["a"] * 20, [["a"] * 50], 8) == [(0, 0, 0, 20)]
    assert D.greedy_tiles(item, [], 8) == []


def test_contamination(spark, docs_of):
    words = ITEM.split()
    rows = [
        (1, "Before. " + ITEM.upper() + "! after"), (2, " ".join(words[10:] + ["noise"] + words[:10])), (3, " ".join(words[:9])),
        (4, None), (5, ""), (6, "tiny item here"), (7, "tiny item elsewhere"), (8, ITEM), (8, ITEM), (9, "other words " * 3000),
    ]
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, "Tiny item here.", "x"), (3, None, "x"), (4, "", "x"), (5, ITEM, "x")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.n_covered) for r in D.contamination(docs_of(rows), bench).collect())
    twice = [(i, k, 20) for i in (1, 2, 8, 8) for k in (1, 5)]
    assert got == sorted([*twice, (6, 2, 3)])
    assert D.contamination(docs_of([]), bench).collect() == []
    assert D.contamination(docs_of(rows), bench.limit(0)).collect() == []


def test_items_with_repeated_phrases(spark, docs_of):
    """A seed counts at each of its places in the item."""
    rng = random.Random(9)
    refrain = "refrain of the song goes on "
    items = [refrain * 12, "la la la la " * 9, (refrain + "then one more line of words ") * 4]
    items += [" ".join(rng.choice(["ba", "di", "ko"]) for _ in range(40)) for _ in range(4)]
    rows = [(n, t) for n, t in enumerate(items)] + [(n + 20, "words before " + t + " and after") for n, t in enumerate(items)]
    rows += [(n + 40, " ".join(t.split()[: len(t.split()) // 2 + k])) for n, t in enumerate(items) for k in (0,)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, text in rows:
        for k, item in enumerate(items):
            item = D.tokens(item)
            covered = sum(t[3] for t in D.greedy_tiles(item, [D.tokens(text)], D.LEAST_TILE))
            if covered >= D.COVERAGE * len(item):
                want.add((i, k, covered))
    got = {(r.doc_id, r.item_id, r.n_covered) for r in D.contamination(docs_of(rows), bench).collect()}
    assert got == want and {(0, 0, 72), (20, 0, 72), (1, 1, 36)} <= got


def test_op1_equals_tiling_of_all_pairs(spark):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    want = set()
    for i, text in docs:
        words = D.tokens(text)
        seeds = set(zip(*(words[k:] for k in range(D.LEAST_TILE))))
        for k, item in items:
            item = D.tokens(item)
            if seeds & set(zip(*(item[n:] for n in range(D.LEAST_TILE)))):
                covered = sum(t[3] for t in D.greedy_tiles(item, [words], D.LEAST_TILE))
                if covered >= D.COVERAGE * len(item):
                    want.add((i, k, covered))
    assert want
    assert {(r.doc_id, r.item_id, r.n_covered) for r in Q.op1_decontamination(spark, DATA).collect()} == want
