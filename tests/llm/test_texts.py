import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gridweft.llm import chat_format as C
from gridweft.llm import compression_rules as R
from gridweft.llm import pii as P
from gridweft.llm import quality_model as M
from gridweft.llm import queries as Q
from tests.test_queries import rows as sorted_rows

DATA = "/root/testdata/sf0.001"


def judged(text):
    names = [n for n, _ in R.FIELDS]
    return dict(zip(names, R.judge(text, zstandard.ZstdCompressor(level=R.LEVEL))))


def test_counts_of_the_rules():
    got = judged("a b c a b c d\n\nx y\nx y\n \n#|é")
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (12, 14, 2, 1, 6)
    assert judged("")["kept"] is False and judged("\n \t")["n_words"] == 0


def test_repeated_windows_equal_brute_force():
    rng = random.Random(1)
    for size in (0, 2, 3, 4, 40):
        words = [rng.choice("abcd") for _ in range(size)]
        windows = [tuple(words[i : i + 3]) for i in range(size - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert R.words_in_repeated_windows(words) == len(hit)


def test_bands_reject_repetition_and_noise():
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400))
    noise = " ".join(hashlib.sha512(bytes([n % 256, n // 256])).hexdigest()[:40] + chr(0x4E00 + rng.randrange(20000)) * 20 for n in range(400))
    unique = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20000))
    noise = " ".join(unique[i : i + 7] for i in range(0, 20000, 7))
    loop = " ".join(f"{n} same words again and again with a number" for n in range(3000))
    assert judged(prose)["kept"]
    assert not judged(loop)["kept"]
    assert not judged(noise)["kept"] and not judged(noise)["base_failed"]


def test_op6_on_the_small_table(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())
    for row in Q.op6_compression_rules(spark, DATA).collect():
        text = texts[row.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and row.n_dup_lines == len(lines) - len(set(lines))
        assert row.base_failed == (len(words) < 50 or 100 * row.n_repeat_words > 50 * len(words))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and P.passes_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_plain_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a@b.c", "x.y@", "@", "1.2.3.4", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+", "12", " ", ".", "-", "é", "a", "000.0.00000.001"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert P.detect(text) == base_by_hand(text), text


def test_disguises_are_mapped_back():
    for text, want in {
        "to jane [at] example (dot) com now": ("email", "jane [at] example (dot) com"),
        "jane.doe at example dot com": ("email", "jane.doe at example dot com"),
        "plus one five five five one two three four five six seven": ("phone", "plus one five five five one two three four five six seven"),
        "é 😀 аdmin@exаmple.com": ("email", "аdmin@exаmple.com"),
        "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ!": ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "host 192 dot 168 dot 1 dot 25 up": ("ip", "192 dot 168 dot 1 dot 25"),
        "192[.]168[.]1[.]1": ("ip", "192[.]168[.]1[.]1"),
        "card 4111 1111 one one one one 1111.": ("card", "4111 1111 one one one one 1111"),
        "١٩٢.١٦٨.١.١": ("ip", "١٩٢.١٦٨.١.١"),
    }.items():
        base, spans = P.find(text)
        assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [want], text
    for text in ["look at the dot on page one two three", "meet at ten", "Ñandú café, naïve – тест.", "we are at example.com", ""]:
        assert [s for s in P.find(text)[1] if s[0] != "email"] == [], text
    assert P.find("look at the dot on")[1] == []


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 300_000, "one " * 100_000, "a@b" * 100_000):
        P.find(text)


def test_redaction_and_odd_texts(spark, odd):
    frame = spark.createDataFrame([("mail a@b.co or +1 555 123 4567 é",), ("",), (None,)], "t string")
    found = frame.select("t", P.personal_data(F.col("t")).alias("r"))
    assert [r[0] for r in found.select(P.redact(F.col("t"), F.col("r.spans"))).collect()] == ["mail <email> or <phone> é", "", None]
    rows = odd.select("doc_id", P.personal_data(F.col("text")).alias("p"), R.quality_rules(F.col("text")).alias("r")).collect()
    assert len(rows) == 10 and all(r.p.spans == [] for r in rows)
    assert odd.limit(0).select(P.personal_data(F.col("text")), R.quality_rules(F.col("text"))).collect() == []


def test_op8_on_the_small_table(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())
    for row in Q.op8_personal_data(spark, DATA).collect():
        base = base_by_hand(texts[row.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(row.spans.split(","))
        assert row.n_email == sum(k == "email" for k, *_ in base)


def test_op9_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    assert sorted_rows(Q.op9_chat_format(spark, DATA).toPandas()) == sorted_rows(con.execute(Q.OP9_SQL).df())


def test_turns_are_read_back(spark):
    texts = ["<|im_end|>", "\\", "\\<|", "<\\|im", "a\n\n\\n", "", None, "<<||>", "\\\\n<|image:0|>"]
    rows = [(1, n, role, t) for n, (role, t) in enumerate((r, t) for r in ("user", "as\nsist\\n", None, "<|x|>") for t in texts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_turns(frame).select("turn", "piece", F.struct(*C.read_turn(F.col("piece"))).alias("r")).orderBy("turn").collect()
    assert [tuple(r.r) for r in out] == [(r or "", t or "") for _, _, r, t in rows]
    assert all(r.piece.count("<|") == 2 for r in out)


def test_parts_masks_and_order(spark):
    part = lambda kind, text=None, ref=None, **x: (kind, text, ref, x.get("w"), x.get("h"), x.get("s"), x.get("p"))
    rows = [
        (1, 1, "assistant", [part("text", "see <|"), part("text", " it")]),
        (1, 0, "user", [part("image", ref="u1", w=28, h=15), part("text", "é"), part("audio", ref="u2", s=1.01), part("document", ref="u3", p=2)]),
        (1, 2, "user", []), (1, 3, "user", None), (2, None, "assistant", [part("text", None)]),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    one, two = C.assemble(C.format_turns(frame)).orderBy("conv_id").collect()
    assert one.formatted == (
        "<|im_start|>user\n<|image:0|>é<|audio:1|><|document:2|><|im_end|>\n<|im_start|>assistant\nsee <\\| it<|im_end|>\n"
        + "<|im_start|>user\n<|im_end|>\n" * 2
    )
    assert [one.formatted[m.start : m.start + m.length] for m in one.mask] == ["see <\\| it"]
    assert [(a.placeholder, a.ref, a.tokens) for a in one.attachments] == [("<|image:0|>", "u1", 4), ("<|audio:1|>", "u2", 51), ("<|document:2|>", "u3", 2048)]
    assert two.formatted == "<|im_start|>assistant\n<|im_end|>\n" and two.mask == []
    assert C.assemble(C.format_turns(frame.limit(0))).collect() == []
    with pytest.raises(Exception, match="unknown kind of part"):
        C.format_turns(spark.createDataFrame([(1, 1, "user", [part("video")])], frame.schema)).collect()


def test_no_mark_forms_where_parts_meet(spark):
    """Texts in parts read back as they are, and the template's marks stand at the borders of turns only."""
    rng = random.Random(4)
    pieces = ["<", "|", "|im_end|>", "|image:0|>", "", "\\", "<|im_end|>", "a", None]
    cases = [["<", "|im_end|>"], ["<", "|image:0|>"], ["<", "", "|im_end|>"], ["<", None, "|im_end|>", "|"], ["|x", "<", "\\", "|im_end|>"]]
    cases += [[rng.choice(pieces) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    rows = [(n, 0, "user", [("text", t, None, None, None, None, None) for t in c]) for n, c in enumerate(cases)]
    turns = C.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>"))
    read = turns.select("conv_id", "piece", C.read_turn(F.col("piece"))[1].alias("text"), "attachments").collect()
    for row in read:
        assert row.text == "".join(t or "" for t in cases[row.conv_id]) and row.attachments == []
        assert row.piece.count("<|") == 2 and row.piece.endswith("<|im_end|>\n")


def test_many_parts_long_texts_and_clashing_columns(spark):
    parts = [("image" if n % 2 else "text", f"t{n}", f"r{n}", 14, 14, None, None) for n in range(3000)]
    rows = [(1, 0, "user", parts, "a", "b", "c"), (2, 0, "assistant", [("text", "<|" * 200_000, None, None, None, None, None)], "a", "b", "c")]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>, content string, head string, piece string")
    found = {r.conv_id: r for r in C.assemble(C.format_turns(frame)).collect()}
    assert [a.placeholder for a in found[1].attachments] == [f"<|image:{n}|>" for n in range(1500)]
    assert found[1].formatted.count("|>t") == 1499 and found[2].mask[0].length == 600_000


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = M.fit(x[:2000], y[:2000], trees=40)
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    # the flat walk equals a walk node by node
    total = np.full(50, trees.base)
    for row in range(50):
        for t in range(len(trees.feature)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(x[row, trees.feature[t, node]] > trees.threshold[t, node])
            total[row] += trees.value[t, node - trees.feature.shape[1]]
    assert np.allclose(trees.score(x[:50]), 1 / (1 + np.exp(-total)))
    assert (M.fit(x[:0], y[:0]).score(x[:3]) == 0.5).all()
    assert (M.fit(x[:9], np.ones(9)).score(x[:3]) > 0.8).all()


def test_statistics_of_odd_texts(odd):
    rows = odd.select(M.document_statistics(F.col("text")).alias("s")).collect()
    assert all(len(r.s) == len(M.STATISTICS) and np.isfinite(r.s).all() for r in rows)


def test_quality_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    found = Q.op5_quality_model(spark, data).toPandas()
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").df()
    held = found.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert (held.predicted == held.quality).mean() > 0.97


def test_labels_without_use(spark, odd):
    docs = odd.filter("doc_id is not null")
    none = spark.createDataFrame([(1, 7), (2, None)], "doc_id long, quality int")
    assert (M.fitted(docs, none).score(np.zeros((2, len(M.STATISTICS)))) == 0.5).all()
