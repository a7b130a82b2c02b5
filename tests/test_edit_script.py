"""Edit scripts of table pairs against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.functions import markup as M
from gridweft.operators import edit_script as E
from gridweft.operators.table_similarity import score_tables
from tests.test_tables import BASE, aligned, as_html, doc, random_table, row_cost

PAIRS = "file string, true_html string, pred_html string"


SECOND = "<tr><td>ef</td><td>gh</td></tr>"
SCRIPTS = {
    "equal": (BASE, BASE, []),
    "changed cell": (BASE, BASE.replace(">ab<", ">ax<"), [("cell", "change", 1, 0, 0, 1, 0, 0, 0.5)]),
    "deleted row": (BASE, BASE.replace(SECOND, ""), [("row", "delete", 1, 1, None, None, None, None, 3.0)]),
    "inserted row": (BASE.replace(SECOND, ""), BASE, [("row", "insert", None, None, None, 1, 1, None, 3.0)]),
    "inserted cell": (BASE, BASE.replace("<td>cd</td>", "<td>cd</td><td>n</td>"), [("cell", "insert", 1, 0, None, 1, 0, 2, 1.0)]),
    "other section": (BASE, BASE.replace("tbody", "tfoot"), [("section", "change", 1, None, None, 1, None, None, 1.0)]),
    "inserted section": (BASE, BASE.replace("</table>", "<tfoot><tr><td>z</td></tr></tfoot></table>"),
                         [("section", "insert", None, None, None, 2, None, None, 3.0)]),
}


def test_kinds_of_operations(spark):
    frame = spark.createDataFrame([(k, t, p) for k, (t, p, _) in SCRIPTS.items()], PAIRS)
    got = E.edit_script(frame).collect()
    assert {k: [tuple(r)[1:] for r in got if r["file"] == k] for k in SCRIPTS} == {k: v[2] for k, v in SCRIPTS.items()}
    assert {r["file"] for r in E.edit_script(frame, structure_only=True).collect()} == set(SCRIPTS) - {"equal", "changed cell"}


def test_odd_documents(spark):
    odd = [("empty", BASE, ""), ("null", None, BASE), ("no table", "<p>x</p>", BASE), ("bare", doc(""), BASE), ("both", doc(""), doc("")),
           ("row without cells", doc("<tr></tr>"), doc("<tr></tr><tr><td>1</td></tr>"))]
    frame = spark.createDataFrame(odd, PAIRS)
    got = {r["file"]: r["distance"] for r in E.table_distances(frame).collect()}
    expected = {r["file"]: r["distance"] for r in score_tables(frame).collect() if r["distance"]}
    assert got == expected and set(got) == {"bare", "row without cells"}
    assert E.edit_script(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 16])
def test_scripts_add_up_to_the_distance(spark, block):
    rng = random.Random(block)
    pairs = [(random_table(rng), random_table(rng)) for _ in range(60)]
    for _ in range(20):  # a table with rows left out, moved and changed
        base = [((1, str(rng.randint(0, 30))), (1, rng.choice("xy"))) for _ in range(rng.randint(5, 40))]
        other = [r for r in base if rng.random() > 0.2]
        other[2:2] = [base[-1], ((2, "new"),)]
        pairs.append((tuple(base), tuple(other)))
    frame = spark.createDataFrame([(str(i), as_html(a), as_html(b)) for i, (a, b) in enumerate(pairs)], PAIRS).repartition(4)
    ops = E.edit_script(frame, block=block).collect()
    for i, (a, b) in enumerate(pairs):
        mine = [r for r in ops if r["file"] == str(i)]
        assert sum(r["cost"] for r in mine) == pytest.approx(aligned(a, b, lambda r: 1 + len(r), row_cost))
        # the listed parts can be taken out or put in: as many rows are left on both sides
        rows = [r["op"] for r in mine if r["level"] == "row"]
        assert len(a) - rows.count("delete") == len(b) - rows.count("insert")


def _random_pairs(rng):
    """Tables with few different rows and cells, so that many scripts cost the same, and rows left out, moved and repeated."""
    pairs = [(random_table(rng), random_table(rng)) for _ in range(40)]
    for _ in range(20):
        base = [tuple((1, rng.choice("ab")) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 14))]
        other = [r for r in base if rng.random() > 0.3]
        other[1:1] = [base[-1], ((2, "new"),)]
        pairs.append((tuple(base), tuple(other)))
    docs = [(as_html(a), as_html(b)) for a, b in pairs]
    foot = "<tfoot><tr><td>%s</td></tr></tfoot></table>"
    docs += [(a.replace("</table>", foot % "x"), b.replace("</table>", foot % rng.choice("xy") + "")) for a, b in docs[:20]]
    return docs + [(a, b.replace("tbody", "tfoot")) for a, b in docs[20:40]]


def test_pairs_settled_in_their_row_have_the_script_of_the_blocks(spark, monkeypatch):
    rows = [(str(i), a, b) for i, (a, b) in enumerate(_random_pairs(random.Random(7)))]
    frame = spark.createDataFrame(rows, PAIRS).repartition(3)
    with monkeypatch.context() as patch:
        patch.setattr(E, "_script_by_blocks", None)  # not needed for small pairs
        in_row = sorted(map(str, E.edit_script(frame).collect()))
    monkeypatch.setattr(E, "_fits", lambda t, p, block: F.lit(False))
    assert in_row == sorted(map(str, E.edit_script(frame).collect())) and len(in_row) > 100


def test_small_pairs_are_not_shuffled(spark):
    frame = spark.createDataFrame([(k, t, p) for k, (t, p, _) in SCRIPTS.items()], PAIRS)
    plan = E.edit_script(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_alignments_together_are_those_one_by_one():
    rng = np.random.default_rng(2)
    nx, ny = rng.integers(0, 5, 60), rng.integers(0, 5, 60)
    x, y = rng.integers(1, 4, nx.sum()).astype(float), rng.integers(1, 4, ny.sum()).astype(float)
    costs = rng.integers(0, 7, (nx * ny).sum()) / 2
    starts = [np.cumsum(n) - n for n in (nx, ny, nx * ny)]
    together = E.Alignments(x, y, starts[0], starts[1], nx, ny, costs, starts[2], ny)
    found = sorted(zip(*(v.tolist() for v in together.ops(np.arange(60) % 3 > 0))))
    expected = []
    for k, (i, j, c) in enumerate(zip(*starts)):
        one = E.Alignment(x[i:i + nx[k]], y[j:j + ny[k]])
        one.feed(costs[c:c + nx[k] * ny[k]].reshape(nx[k], ny[k]))
        cost, ops = one.finish()
        assert together.cost[k] == pytest.approx(cost)
        expected += [(k, E._OPS_BY_MOVE.index(op), *rest) for op, *rest in ops if k % 3]
    assert found == sorted(expected)


def test_cells_compared_together_cost_what_spark_computes(spark):
    rng = random.Random(4)
    words = ["", "a", "ab", "ba", "it's open", "é\U00100000b", "\U0001F600\U0001F600", "x" * 300, "x" * 299 + "y"]
    rows = [(rng.choice(["td", "th"]), rng.randint(1, 2), rng.choice([1, 1, 3]), rng.choice(words), rng.choice(["", "", "\U00100000\U00100001"])) for _ in range(60)]
    schema = "tag string, colspan int, rowspan int, text string, kids string"
    listed = spark.createDataFrame([(rows,)], f"c array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    expected = listed.select(E._cell_costs(F.col("c"), F.col("c"))).first()[0]
    cells = E.Cells(listed.toArrow().column("c").combine_chunks().flatten())
    a, b = np.divmod(np.arange(len(rows) ** 2), len(rows))
    assert cells.costs(a, b).tolist() == expected and cells.weights.tolist() == [1.0 + len(r[4]) for r in rows]
    assert cells.costs(a[:0], b[:0]).tolist() == [] and E.edit_distances([], a[:0], b[:0]).tolist() == []


def test_small_pairs_send_cells_not_costs(spark):
    frame = spark.createDataFrame([(k, t, p) for k, (t, p, _) in SCRIPTS.items()], PAIRS)
    coded = E._coded(frame, "file", ("td",), (), False)
    work = coded.select(E._work(F.col("t"), F.col("p")).alias("w")).select("w.*")
    assert "costs" not in work.columns and {"x", "y"} <= set(work.columns)


def test_long_texts_are_no_small_pair(spark):
    texts = ["ab" * 12000, "ba" * 12000]
    frame = spark.createDataFrame([("long", *(as_html([[(1, t)]]) for t in texts)), ("short", *(as_html([[(1, t[:9])]]) for t in texts))], PAIRS)
    coded = E._coded(frame, "file", ("td",), (), False)
    assert {r["_key"]: r["f"] for r in coded.select("_key", E._fits(F.col("t"), F.col("p"), 16).alias("f")).collect()} == {"long": False, "short": True}
    got = {r["file"]: r["cost"] for r in E.edit_script(frame).collect()}
    assert got == {"long": pytest.approx(2 / 24000), "short": pytest.approx(2 / 9)}


def test_equal_rows_at_both_ends_are_not_parsed(spark):
    def table(changed, n=9):
        return as_html([[(1, "x" if i in changed else str(i))] for i in range(n)])

    pairs = [("middle", table([]), table([4, 6])), ("deleted", table([], 10), table([], 9)), ("same text", table(range(9), 9), table(range(8), 8))]
    frame = spark.createDataFrame(pairs, PAIRS)
    kept = {r["_key"]: (len(r["t"][0]["part"]["rows"]), len(r["p"][0]["part"]["rows"])) for r in E._coded(frame, "file", ("td",), (), False).collect()}
    assert kept == {"middle": (3, 3), "deleted": (1, 0), "same text": (1, 0)}
    got = [tuple(r)[:9] for r in E.edit_script(frame).collect()]
    cells = [("middle", "cell", "change", 0, i, 0, 0, i, 0) for i in (4, 6)]
    rows = [("deleted", "row", "delete", 0, 9, None, None, None, None), ("same text", "row", "delete", 0, 8, None, None, None, None)]
    assert sorted(got, key=str) == sorted(cells + rows, key=str)


def test_blocks_out_of_reach_are_not_made():
    rows, sizes = list(range(320)), [4] * 320
    other = rows[:100] + [-1] + rows[101:200] + [-2] + rows[201:]
    head, tail, blocks = E._needed(rows, other, [5.0] * 320, [5.0] * 320, sizes, sizes, 16)
    assert (head, tail) == (100, 119) and len(blocks) < 3 * 7
    # nothing alike: changing all costs 64, so a row pairs with the 16 places (4 each) before and behind its own at most
    assert len(E._needed([1] * 64, [2] * 64, [2.0] * 64, [2.0] * 64, [1] * 64, [1] * 64, 16)[2]) == 10


def test_many_different_rows(spark):
    rng = random.Random(3)
    tables = [[[f"{rng.randint(0, 999)}" for _ in range(3)] for _ in range(800)] for _ in range(2)]
    started = time.time()
    pair = spark.createDataFrame([("f", *(as_html([[(1, c) for c in r] for r in t]) for t in tables))], PAIRS)
    got = E.table_distances(pair).first()["distance"]
    took = time.time() - started
    memo = {}

    def cost(x, y):
        if (x, y) not in memo:
            line = list(range(len(y) + 1))
            for i, a in enumerate(x, 1):
                last, line = line, [i]
                for j, b in enumerate(y, 1):
                    line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (a != b)))
            memo[x, y] = line[-1] / max(len(x), len(y))
        return memo[x, y]

    def row(x, y):
        line = [0.0, 1.0, 2.0, 3.0]
        for i, a in enumerate(x, 1):
            last, line = line, [float(i)]
            for j, b in enumerate(y, 1):
                line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + cost(a, b)))
        return line[-1]

    line = [4.0 * j for j in range(801)]
    for i, x in enumerate(tables[0], 1):
        last, line = line, [4.0 * i]
        for j, y in enumerate(tables[1], 1):
            near = abs(i - j) <= 300  # 2 * 300 rows of weight 4 are as much as changing all cells
            line.append(min(last[j] + 4, line[-1] + 4, last[j - 1] + (row(x, y) if near else 3.0)))
    assert got == pytest.approx(line[-1])
    print(f"800 x 800 rows in {took:.1f} s")


def test_end_of_a_section_may_end_a_broken_start_tag(spark):
    markup = spark.createDataFrame([("<tbody><tr><td>q</td><td colspan=2 </tbody>",), ("<tbody><tr><td>q</td></tr></tbody>",)], "m string")
    found = [[(c["tag"], c["colspan"], c["norm"]) for c in r[0][0]["rows"][0]] for r in markup.select(M.table_sections("m")).collect()]
    assert found == [[("td", 1, "q"), ("td", 2, "")], [("td", 1, "q")]]
