import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from gridweft.llm import queries as Q
from gridweft.llm import spelling as S

DATA = "/root/testdata/sf0.001"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(docs, least=5):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= least}


def near(a, b):
    """One letter put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def near_by_hand(words):
    """By rests: every word with a letter taken out; the rule itself decides."""
    rests = {}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            rests.setdefault(rest, []).append(w)
    return {(a, b) for group in rests.values() for a in group for b in group if a < b and near(a, b)}


def variants_by_hand(words):
    others = {w: [] for w in words}
    for a, b in near_by_hand(words):
        others[a].append(b)
        others[b].append(a)
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(others[w]), form[w] and words[form[w]]))
    return rows


def test_near():
    assert near("abc", "abd") and near("abc", "abcd") and near("xabc", "abc") and near("aab", "ab")
    assert not near("abc", "acb") and not near("abc", "abc") and not near("abc", "abcde") and not near("abc", "xbd")


def some_words(seed, size=1500):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc", "abcdéÀ", "aeiostr"])
    found = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(size)}
    for w in list(found)[:500]:
        k = rng.randrange(len(w))
        found.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]]))
    return sorted(w for w in found if len(w) >= 6)


def test_bounds_hold_for_every_near_pair():
    """Near words share a list that both of them merge, unless an edit may affect all grams of both."""
    rng = random.Random(8)
    for seed in range(6):
        words = some_words(seed)
        grams = {g for w in words for q in (3, 4) for p in range(len(w) + 3 - q) for g in [f"^{w}$"[p : p + q]] if rng.random() < (0, 0.1, 0.5, 1)[seed % 4]}
        index = S.Grams(frozenset(grams))
        lists = {w: index.lists(w) for w in words}
        for a, b in near_by_hand(words):
            assert lists[a][1] and lists[b][1] or set(lists[a][0]) & set(lists[b][0]), (a, b)
        if seed % 4 == 0:
            assert all(not bare for _, bare in lists.values())


def test_decomposition_leaves_out_what_an_earlier_gram_holds():
    index = S.Grams(frozenset({"^ab", "abcd", "bcd"}))
    assert [f"^abcdef$"[a:b] for a, b in index.decompose("^abcdef$")] == ["^ab", "abcd", "de", "ef", "f$"]


@pytest.mark.parametrize("size", [2, 8, 256])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_words_equal_all_pairs(spark, monkeypatch, size, seed):
    monkeypatch.setattr(S, "LIST", size)
    monkeypatch.setattr(S, "FREQUENT", 40)
    words = some_words(seed, 400)
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(r) for r in S.near_words(frame, S.dictionary(frame)).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_hand(words)


def test_op12_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    words = words_by_hand(docs)
    got = [tuple(r) for r in Q.op12_spelling_variants(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(words) > 500 and len(got) == len(words)
    assert set(got) == variants_by_hand(words)


def test_ties_chains_and_odd_texts(spark, docs_of, odd):
    text = "Gardens " * 3 + "gardenX " * 15 + "gardeny " * 15 + "gardenyz " * 90 + "ÀBCDEF " * 6 + "short " * 50 + "a1b2c3"
    rows = [(1, text), (2, "gardens\tgardens"), (None, "gardens"), (3, None), (4, ""), (2, "zzzzzz,zzzzzz zzzzzz"), (2, "zzzzzz,zzzzzz zzzzzz")]
    got = {tuple(r) for r in S.variants(docs_of(rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_by_hand(words_by_hand(rows))
    assert {r[0] for r in got} >= {"gardenx", "gardenyz", "Àbcdef", "zzzzzz"}
    assert S.variants(docs_of([])).collect() == []
    words = words_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert {r.word: r.n for r in S.variants(odd).collect()} == words
