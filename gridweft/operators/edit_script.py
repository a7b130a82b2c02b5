"""What has to change to turn one table into the other: deleted, inserted and changed sections, rows and cells.

The distance is the one of ``score_tables`` (levels are kept), but the rows of a pair of tables are compared by many tasks: the cost
matrix of a pair of sections is cut into blocks, and a block is a row of Spark.  Three things keep the work small without
changing the result:

* Equal sections at the head of two tables, and equal rows at the head and at the tail of two sections, are matched and not compared.  Two rows weigh apart by no more than it costs to
  change one into the other, so some best alignment matches them.
* Rows that are equal and stand once on either side are anchors.  The longest chain of them gives an alignment, hence a bound.  A block
  that no path within that bound can reach is not made.  Anchors need not be matched in the end, so the result stays exact.
* Costs of cells are computed where the block is; only costs of rows leave it, and the table of costs is read strip by strip, in order.

A pair of tables that is no larger than one block is settled in the row that holds it, and nothing of it is shuffled; the alignments of
many such pairs are computed together.  Sections with the same text at the head of both tables, and rows at the head and the tail, are
not parsed; where rows differ in markup but not in content this may decide which of several scripts with the least cost is given.

Rows are taken for equal when 64 bits of hash agree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from gridweft.functions import markup as M
from gridweft.functions.bind import bind
from gridweft.operators.cells import with_markup
from gridweft.operators.table_similarity import cell_cost, coded_sides
from gridweft.session import materialize

BLOCK = 16
"""Rows of either side in a block of the cost matrix, unless the caller says otherwise."""
CELLS_PER_ROW = 4
"""A pair of tables whose rows have up to so many cells on average is settled in its row if its rows fit into one block."""
CHARS_PER_CELL = 256
"""The same for the characters of the cells: their texts are sent to the task that settles the pair."""
CELL_PAIRS = 2**20
"""Pairs of cells, or of characters, that are looked at together; bounds the memory."""

_OP = StructType().add("op", StringType()).add("i", IntegerType()).add("j", IntegerType()).add("cost", DoubleType())
_OPS = ArrayType(_OP)
_BLOCK = StructType().add("bi", IntegerType()).add("bj", IntegerType())
_PLAN = StructType().add("head", IntegerType()).add("tail", IntegerType()).add("blocks", ArrayType(_BLOCK))
_PAIR = [StructField("pair", LongType()), *(StructField(n, IntegerType()) for n in ("ts", "ps", "tr", "pr"))]
_CELL_OPS = StructType(_PAIR + _OP.fields)
_COSTS = "pair long, ts int, ps int, bi int, bj int, costs array<double>"
_ALIGNED = (
    StructType().add("pair", LongType()).add("ts", IntegerType()).add("ps", IntegerType()).add("cost", DoubleType()).add("ops", _OPS)
)
_PLACES = ("true_section", "true_row", "true_cell", "pred_section", "pred_row", "pred_cell")
_LEVELS, _OPS_BY_MOVE = ("section", "row", "cell"), ("change", "delete", "insert")
_FOUND = StructType(
    [StructField("level", StringType()), StructField("op", StringType()), *(StructField(n, IntegerType()) for n in _PLACES), StructField("cost", DoubleType())]
)
_EPS = 1e-9


# ---------------------------------------------------------------- alignment by strips of the cost matrix


class Alignment:
    """Least cost of turning a list into another, fed with the costs of replacing, some rows of the matrix at a time.

    ``x_weights`` and ``y_weights`` are the costs of deleting and inserting.  One byte for each pair is kept to find the way back.
    """

    def __init__(self, x_weights, y_weights):
        self.x, self.y = np.asarray(x_weights, float), np.asarray(y_weights, float)
        self.inserted = np.concatenate(([0.0], np.cumsum(self.y)))
        self.row = self.inserted.copy()
        self.moves: list[np.ndarray] = []
        self.changes: list[tuple[np.ndarray, np.ndarray]] = []  # places and costs of the best replacements

    def feed(self, costs: np.ndarray) -> None:
        for cost in costs:
            delete = self.row + self.x[len(self.moves)]
            best = delete.copy()
            np.minimum(best[1:], self.row[:-1] + cost, out=best[1:])
            self.row = np.minimum.accumulate(best - self.inserted) + self.inserted
            move = np.where(best < delete - _EPS, 0, 1).astype(np.uint8)  # replace, delete, insert
            move[self.row < best - _EPS] = 2
            self.moves.append(move)
            replaced = np.flatnonzero(move[1:] == 0)
            self.changes.append((replaced, cost[replaced]))

    def finish(self) -> tuple[float, list[tuple[str, int, int, float]]]:
        """The cost, and every operation that costs something: name, place on either side (-1: none), cost."""
        while len(self.moves) < len(self.x):  # rows that no block was made for
            self.feed(np.full((1, len(self.y)), np.inf))
        i, j, ops = len(self.x), len(self.y), []
        while i or j:
            move = 2 if i == 0 else self.moves[i - 1][j]
            if move == 0:
                at, costs = self.changes[i - 1]
                cost = float(costs[np.searchsorted(at, j - 1)])
                i, j = i - 1, j - 1
                if cost > 0:
                    ops.append(("change", i, j, cost))
            elif move == 1:
                i -= 1
                ops.append(("delete", i, -1, float(self.x[i])))
            else:
                j -= 1
                ops.append(("insert", -1, j, float(self.y[j])))
        return float(self.row[-1]), ops[::-1]


def _script(costs, x_weights, y_weights) -> list[tuple[str, int, int, float]]:
    alignment = Alignment(x_weights, y_weights)
    alignment.feed(np.asarray(costs, float).reshape(len(x_weights), len(y_weights)))
    return alignment.finish()[1]


@F.pandas_udf(_OPS)
def _scripts(costs: pd.Series, x_weights: pd.Series, y_weights: pd.Series) -> pd.Series:
    found = (_script(*args) for args in zip(costs, x_weights, y_weights))
    return pd.Series([[dict(zip(("op", "i", "j", "cost"), op)) for op in ops] for ops in found], dtype=object)


def _cell_scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = batch.itertuples(index=False, name=None)
        yield pd.DataFrame([(*row[:5], *op) for row in rows for op in _script(*row[5:])], columns=_CELL_OPS.names)


# ---------------------------------------------------------------- many small alignments at once


def _by_shape(nx: np.ndarray, ny: np.ndarray) -> list[np.ndarray]:
    """The places at which both lengths are the same, for each two lengths that occur."""
    order = np.lexsort((ny, nx))
    cuts = np.flatnonzero((np.diff(nx[order]) != 0) | (np.diff(ny[order]) != 0)) + 1
    return np.split(order, cuts) if len(order) else []


class Alignments:
    """The same as ``Alignment`` for many pairs of lists, those of one shape together.

    ``x`` and ``y`` hold the weights of all lists one behind the other, list k begins at ``x_at[k]`` and has ``nx[k]`` elements.  The cost
    of replacing its element i by j is ``costs[at[k] + i * stride[k] + j]``.
    """

    def __init__(self, x, y, x_at, y_at, nx, ny, costs, at, stride):
        self.cost, self.shapes = np.zeros(len(nx)), []
        for which in _by_shape(nx, ny):
            m, n = np.arange(nx[which[0]]), np.arange(ny[which[0]])
            xs, ys = x[x_at[which][:, None] + m], y[y_at[which][:, None] + n]
            replace = costs[at[which][:, None, None] + stride[which][:, None, None] * m[:, None] + n]
            inserted = np.concatenate((np.zeros((len(which), 1)), np.cumsum(ys, axis=1)), axis=1)
            row, moves = inserted, np.zeros((len(which), len(m), len(n) + 1), np.uint8)
            for i in m:
                delete = row + xs[:, i:i + 1]
                best = delete.copy()
                np.minimum(best[:, 1:], row[:, :-1] + replace[:, i], out=best[:, 1:])
                row = np.minimum.accumulate(best - inserted, axis=1) + inserted
                moves[:, i] = np.where(row < best - _EPS, 2, np.where(best < delete - _EPS, 0, 1))
            self.cost[which] = row[:, -1]
            self.shapes.append((which, xs, ys, replace, moves))

    def ops(self, chosen: np.ndarray) -> list[np.ndarray]:
        """``k, move, i, j, cost`` of the operations of the chosen pairs that cost something; a place that a side does not have is -1."""
        found = [(np.zeros(0, int),) * 4 + (np.zeros(0),)]
        for which, xs, ys, replace, moves in self.shapes:
            k = np.flatnonzero(chosen[which]) if moves.shape[1] or moves.shape[2] > 1 else np.zeros(0, int)
            i, j = np.full(len(k), xs.shape[1]), np.full(len(k), ys.shape[1])
            while len(k):
                move = np.full(len(k), 2)
                inside = i > 0
                move[inside] = moves[k[inside], i[inside] - 1, j[inside]]
                i, j = i - (move < 2), j - (move != 1)
                cost = np.zeros(len(k))
                for kind, values, place in ((0, replace, (i, j)), (1, xs, (i,)), (2, ys, (j,))):
                    mine = move == kind
                    cost[mine] = values[(k[mine], *(p[mine] for p in place))]
                named = (move > 0) | (cost > 0)
                places = np.where(move < 2, i, -1), np.where(move != 1, j, -1)
                found.append(tuple(v[named] for v in (which[k], move, *places, cost)))
                left = (i > 0) | (j > 0)
                k, i, j = k[left], i[left], j[left]
        return [np.concatenate(v) for v in zip(*found)]


def edit_distances(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of ``texts[a[k]]`` and ``texts[b[k]]``, those of two lengths together."""
    length = np.array([len(t) for t in texts], int)
    at, points = np.cumsum(length) - length, np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    a, b = np.where(length[a] <= length[b], (a, b), (b, a))  # a step for each character of the shorter one
    out = np.zeros(len(a))
    for which in _by_shape(length[a], length[b]):
        m, steps = length[a[which[0]]], np.arange(length[b[which[0]]] + 1)
        at_once = max(CELL_PAIRS // len(steps), 1)
        for some in (which[k:k + at_once] for k in range(0, len(which), at_once)):
            xs, ys = points[at[a[some]][:, None] + np.arange(m)], points[at[b[some]][:, None] + steps[:-1]]
            row = np.tile(steps, (len(some), 1))
            for i in range(m):
                best = row + 1
                np.minimum(best[:, 1:], row[:, :-1] + (ys != xs[:, i:i + 1]), out=best[:, 1:])
                row = np.minimum.accumulate(best - steps, axis=1) + steps
            out[some] = row[:, -1]
    return out


class Cells:
    """Coded cells of many pairs of tables; equal ones have the same number, so that two of them are compared once.

    ``weights`` are the costs of deleting or inserting each.
    """

    def __init__(self, cells: pa.StructArray):
        columns = dict(zip((f.name for f in cells.type), cells.flatten()))
        self.weights = 1.0 + pc.utf8_length(columns["kids"]).to_numpy()
        numbers = {}
        for name, values in columns.items():
            coded = pc.dictionary_encode(values)
            numbers[name] = coded.indices.to_numpy().astype(int)
            columns[name] = coded.dictionary.to_pylist()
        self.texts, self.kids = columns["text"], columns["kids"]
        _, shape = _distinct(*(numbers[name] for name in ("tag", "colspan", "rowspan")))
        first, self.number = _distinct(shape, numbers["text"], numbers["kids"])
        self.shape, self.text, self.below = shape[first], numbers["text"][first], numbers["kids"][first]

    def costs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What ``cell_cost`` gives for the cells at the places ``a`` and ``b``."""
        first, pair = _distinct(self.number[a], self.number[b])
        a, b = self.number[a[first]], self.number[b[first]]
        costs = (self.shape[a] != self.shape[b]).astype(float)
        for names, texts, k in (
            (self.text, self.texts, np.flatnonzero((costs == 0) & (self.text[a] != self.text[b]))),
            (self.below, self.kids, np.flatnonzero(self.below[a] != self.below[b])),
        ):
            x, y = names[a[k]], names[b[k]]
            distance = edit_distances(texts, x, y)
            if names is self.text:
                length = np.array([len(t) for t in texts], int)
                distance /= np.maximum(length[x], length[y])
            costs[k] += distance
        return costs[pair]


def _distinct(*numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each combination of numbers, and the combination that stands at each place."""
    key, *others = numbers
    for k, n in enumerate(others):
        if k:  # no more than there are places, so that a product of two stays small
            key = np.unique(key, return_inverse=True)[1]
        key = key * (int(n.max(initial=0)) + 1) + n
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    return first, place


def _lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins in its values, with the end of the last one, and the values."""
    offsets = lists.offsets.to_numpy().astype(int)
    return offsets - offsets[0], lists.flatten().to_numpy()


def _found(work: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each operation's pair of tables (see ``_work``), and the fields of all operations."""
    (wx_at, wx), (wy_at, wy) = _lists(work.column("wx")), _lists(work.column("wy"))
    own, head = (_lists(work.column(name))[1] for name in ("own", "skipped"))
    x_cells, y_cells = (work.column(side).flatten() for side in ("x", "y"))
    both, sides = Cells(pa.concat_arrays([x_cells, y_cells])), []
    for side, weights in (("x", both.weights[:len(x_cells)]), ("y", both.weights[len(x_cells):])):
        n_rows, n_cells = (_lists(work.column(f"{side}_{name}"))[1] for name in ("rows", "cells"))
        rows_at, cells_at, total = (np.concatenate(([0], np.cumsum(n))) for n in (n_rows, n_cells, weights))
        sides.append((rows_at, cells_at, weights, 1.0 + np.diff(total[cells_at])))
    (xr, xc, xw, x_rows), (yr, yc, yw, y_rows) = sides
    nx, ny = np.diff(wx_at), np.diff(wy_at)
    first = np.concatenate(([0], np.cumsum(nx * ny)))

    # every row of a section against every one of the other section
    mx, my = np.diff(xr), np.diff(yr)
    start = np.concatenate(([0], np.cumsum(mx * my)))
    of = np.repeat(np.arange(len(mx)), mx * my)
    i, j = np.divmod(np.arange(start[-1]) - start[of], my[of])
    i, j = xr[of] + i, yr[of] + j
    width = yc[yr[1:]] - yc[yr[:-1]]
    n_costs = (xc[xr[1:]] - xc[xr[:-1]]) * width
    costs_at = np.concatenate(([0], np.cumsum(n_costs)))
    section = np.repeat(np.arange(len(mx)), n_costs)
    a, b = np.divmod(np.arange(costs_at[-1]) - costs_at[section], width[section])
    costs = both.costs(xc[xr[section]] + a, len(x_cells) + yc[yr[section]] + b)
    at = costs_at[of] + (xc[i] - xc[xr[of]]) * width[of] + yc[j] - yc[yr[of]]
    cells = Alignments(xw, yw, xc[i], yc[j], np.diff(xc)[i], np.diff(yc)[j], costs, at, width[of])
    rows = Alignments(x_rows, y_rows, xr[:-1], yr[:-1], mx, my, cells.cost, start[:-1], my)
    whole = Alignments(wx, wy, wx_at[:-1], wy_at[:-1], nx, ny, rows.cost + own, first[:-1], ny)

    pair_of = np.repeat(np.arange(len(nx)), nx * ny)
    ts, ps = np.divmod(np.arange(len(pair_of)) - first[pair_of], ny[pair_of])
    out = []

    def listed(level, pairs, move, true_places, pred_places, cost):
        none = np.full(len(pairs), -1)
        places = [*true_places, none, none][:3] + [*pred_places, none, none][:3]
        out.append((pairs, np.full(len(pairs), level), move, *places, cost))

    k, move, s, t, cost = whole.ops(np.ones(len(nx), bool))
    one_sided = move > 0
    listed(0, k[one_sided], move[one_sided], (s[one_sided],), (t[one_sided],), cost[one_sided])
    matched = np.zeros(len(own), bool)
    matched[(first[k] + s * ny[k] + t)[~one_sided]] = True
    named = np.flatnonzero(matched & (own > 0))
    listed(0, pair_of[named], np.zeros(len(named), int), (ts[named],), (ps[named],), own[named])

    def inside(sections, move):
        # only the side that has the part names a section
        return np.where(move < 2, ts[sections], -1), np.where(move != 1, ps[sections], -1)

    k, move, i, j, cost = rows.ops(matched)
    one_sided = move > 0
    changed = np.zeros(len(of), bool)
    changed[(start[k] + i * my[k] + j)[~one_sided]] = True
    k, move, cost = k[one_sided], move[one_sided], cost[one_sided]
    t, p = inside(k, move)
    i, j = (np.where(n >= 0, n + head[k], -1) for n in (i[one_sided], j[one_sided]))
    listed(1, pair_of[k], move, (t, i), (p, j), cost)
    k, move, c, d, cost = cells.ops(changed)
    s = of[k]
    i, j = np.divmod(k - start[s], my[s])
    listed(2, pair_of[s], move, (ts[s], i + head[s], c), (ps[s], j + head[s], d), cost)

    pairs, *fields = (np.concatenate(v) for v in zip(*out))
    return pairs, fields


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_key, head, row_head`` and the operations of pairs of small tables."""
    for batch in batches:
        n_cells = [np.diff(batch.column(side).offsets.to_numpy()).astype(int) for side in ("x", "y")]
        share = np.cumsum((1 + n_cells[0]) * (1 + n_cells[1])) // CELL_PAIRS
        cuts = np.flatnonzero(np.diff(share, prepend=-1, append=-1))
        for start, end in zip(cuts, cuts[1:]):
            work = batch.slice(start, end - start)
            pairs, (level, move, *places, cost) = _found(work)
            keys = [work.column(name).take(pa.array(pairs)) for name in ("_key", "head", "row_head")]
            places = [pa.array(p, pa.int32(), mask=p < 0) for p in places]
            named = [pa.array(names).take(pa.array(codes)) for names, codes in ((_LEVELS, level), (_OPS_BY_MOVE, move))]
            yield pa.RecordBatch.from_arrays([*keys, *named, *places, pa.array(cost)], ["_key", "head", "row_head", *_FOUND.names])


# ---------------------------------------------------------------- which blocks are needed


def _chain(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The longest chain of pairs of equal values that stand once on either side."""
    nx, ny = Counter(x), Counter(y)
    place = {v: j for j, v in enumerate(y) if ny[v] == 1}
    ends: list[int] = []
    last: list[tuple | None] = []
    for i, v in enumerate(x):
        if nx[v] == 1 and v in place:
            at = bisect_left(ends, place[v])
            link = (i, place[v], last[at - 1] if at else None)
            ends[at:at + 1], last[at:at + 1] = [place[v]], [link]
    node, links = last[-1] if last else None, []
    while node:
        links.append(node[:2])
        node = node[2]
    return links[::-1]


def _bound(x, y, wx, wy, sizes_x, sizes_y) -> float:
    """Cost of an alignment that matches the chain, and the rows between two links one by one."""
    total, i, j = 0.0, 0, 0
    for a, b in [*_chain(x, y), (len(x), len(y))]:
        n = min(a - i, b - j)
        for k in range(n):
            bare = wx[i + k] == 1 + sizes_x[i + k] and wy[j + k] == 1 + sizes_y[j + k]
            # cells without inner elements cost at most one each
            change = max(wx[i + k], wy[j + k]) - 1 if bare else wx[i + k] + wy[j + k]
            total += 0.0 if x[i + k] == y[j + k] else change
        total += float(np.sum(wx[i + n:a])) + float(np.sum(wy[j + n:b]))
        i, j = a + 1, b + 1
    return total


def _needed(x, y, wx, wy, sizes_x, sizes_y, block: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Equal rows at the head, at the tail, and the blocks of what is between that a path within the bound can touch."""
    x, y = [int(v) for v in x], [int(v) for v in y]
    shorter, head, tail = min(len(x), len(y)), 0, 0
    while head < shorter and x[head] == y[head]:
        head += 1
    while tail < shorter - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    m, n = len(x) - head - tail, len(y) - head - tail
    if not m or not n:
        return head, tail, []
    cut = slice(head, head + m), slice(head, head + n)
    bound = _bound(x[cut[0]], y[cut[1]], wx[cut[0]], wy[cut[1]], sizes_x[cut[0]], sizes_y[cut[1]])
    least = min(float(np.min(wx[cut[0]])), float(np.min(wy[cut[1]])))
    blocks = []
    for bi in range(0, m, block):
        for bj in range(0, n, block):
            # before a pair and behind it, rows on one side only have to be deleted or inserted
            low, high = bj - (min(bi + block, m) - 1), min(bj + block, n) - 1 - bi
            away = min(abs(d) + abs((n - m) - d) for d in {low, high, *(d for d in (0, n - m) if low <= d <= high)})
            if away * least <= bound + _EPS:
                blocks.append((bi // block, bj // block))
    return head, tail, blocks


@F.pandas_udf(_PLAN)
def _plan(sides: pd.DataFrame) -> pd.DataFrame:
    found = [_needed(*row) for row in sides.itertuples(index=False, name=None)]
    return pd.DataFrame(
        {
            "head": [f[0] for f in found],
            "tail": [f[1] for f in found],
            "blocks": [[{"bi": i, "bj": j} for i, j in f[2]] for f in found],
        }
    )


# ---------------------------------------------------------------- costs of rows


def _cell_costs(xs: Column, ys: Column) -> Column:
    """Costs of replacing each cell by each other, row by row of the matrix."""
    return bind(ys, lambda ys: F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: cell_cost(a, b)))))


def _cells(rows: Column) -> Column:
    return F.flatten(F.transform(rows, lambda r: r["cells"]))


def _own_cost(x: Column, y: Column) -> Column:
    """What two sections differ by, without their rows."""
    return F.when(x["section"] == y["section"], 0.0).otherwise(1.0) + F.levenshtein(x["kids"], y["kids"])


def _work(t: Column, p: Column) -> Column:
    """What ``_settle`` needs of a pair, in flat lists: weights of the sections (``wx, wy``) and, for every two of them, what they differ by
    without their rows (``own``), how many rows and cells they have, and the cells (``x, y``).

    Equal rows at the head and the tail of two sections are left out, ``skipped`` counts the first ones.
    """

    def two(x: Column, y: Column) -> Column:
        def numbers(d: Column) -> Column:
            return F.struct(_own_cost(x, y).alias("own"), d["head"].alias("head"), d["t"].alias("x"), d["p"].alias("y"))

        return bind(M.differing(x["rows"], y["rows"]), numbers)

    def side(m: Column, name: str) -> list[Column]:
        rows = F.flatten(F.transform(m, lambda s: s[name]))
        return [
            F.transform(m, lambda s: F.size(s[name])).alias(f"{name}_rows"),
            F.transform(rows, lambda r: F.size(r["cells"])).alias(f"{name}_cells"),
            _cells(rows).alias(name),
        ]

    def lists(m: Column) -> Column:
        return F.struct(
            F.transform(t, lambda s: s["weight"]).alias("wx"), F.transform(p, lambda s: s["weight"]).alias("wy"),
            F.transform(m, lambda s: s["own"]).alias("own"), F.transform(m, lambda s: s["head"]).alias("skipped"),
            *side(m, "x"), *side(m, "y"),
        )

    return bind(F.flatten(F.transform(t, lambda a: F.transform(p, lambda b: two(a["part"], b["part"])))), lists)


def _fits(t: Column, p: Column, block: int) -> Column:
    """Whether a pair of tables is no larger than one block."""

    def rows(side: Column) -> Column:
        return F.flatten(F.transform(side, lambda s: s["part"]["rows"]))

    def chars(side: Column) -> Column:
        return F.length(F.array_join(F.transform(_cells(rows(side)), lambda c: F.concat(c["text"], c["kids"])), ""))

    def together(number: Callable[[Column], Column], most: int) -> Column:
        return number(t).cast("bigint") * number(p) <= most

    return (
        together(F.size, block * block)
        & together(lambda side: F.size(rows(side)), block * block)
        & together(lambda side: F.size(_cells(rows(side))), (CELLS_PER_ROW * block) ** 2)
        & together(chars, (CHARS_PER_CELL * CELLS_PER_ROW * block) ** 2)
    )


def _row_costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["costs"] = [_block_costs(*b) for b in zip(batch.pop("c"), batch.pop("x"), batch.pop("y"))]
        yield batch


def _block_costs(costs, x_weights, y_weights) -> np.ndarray:
    """Cost of changing each row of a block into each other; cells of all pairs of rows are aligned at the same time."""
    xw, yw = list(map(np.asarray, x_weights)), list(map(np.asarray, y_weights))
    nx, ny = np.array([len(w) for w in xw]), np.array([len(w) for w in yw])
    first_x, first_y = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    table = np.asarray(costs, float).reshape(int(nx.sum()), int(ny.sum()))

    def padded(weights, longest):
        out = np.zeros((len(weights), longest))
        for k, w in enumerate(weights):
            out[k, :len(w)] = w
        return out

    px, py = padded(xw, int(nx.max())), padded(yw, int(ny.max()))
    shape = (len(xw), len(yw))
    result = np.zeros(shape)
    before = [np.zeros(shape)]
    for j in range(int(ny.max())):
        before.append(before[-1] + py[:, j])
    for i in range(int(nx.max()) + 1):
        if i:
            row = [before[0] + px[:, i - 1][:, None]]
            rows_at = np.minimum(first_x + i - 1, len(table) - 1) if len(table) else None
            for j in range(int(ny.max())):
                columns_at = np.minimum(first_y + j, table.shape[1] - 1)
                replaced = before[j] + table[rows_at[:, None], columns_at]
                row.append(np.minimum(np.minimum(before[j + 1] + px[:, i - 1][:, None], row[j] + py[:, j]), replaced))
            before = row
        stacked = np.stack(before, axis=2)
        ends = np.take_along_axis(stacked, np.broadcast_to(ny, shape)[:, :, None], axis=2)[:, :, 0]
        result = np.where((nx == i)[:, None], ends, result)
    return result.ravel()


# ---------------------------------------------------------------- costs of sections


def _align_rows(block: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of ``pair, ts, ps, bi, bj``: a header with the weights, then the blocks of one matrix, strip by strip."""
    matrix: _Matrix | None = None
    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            if row.bi < 0:
                if matrix:
                    done.append(matrix.result())
                matrix = _Matrix(row, block)
            else:
                matrix.take(row.bi, row.bj, row.costs)
        if done:
            yield pd.DataFrame(done, columns=["pair", "ts", "ps", "cost", "ops"])
    if matrix:
        yield pd.DataFrame([matrix.result()], columns=["pair", "ts", "ps", "cost", "ops"])


class _Matrix:
    """Collects the blocks of one strip of a cost matrix, then hands the strip on."""

    def __init__(self, header, block: int):
        self.key, self.head, self.own, self.block = (header.pair, header.ts, header.ps), int(header.head), header.own, block
        self.alignment = Alignment(header.x_weights, header.y_weights)
        self.strip_no, self.strip = -1, None

    def _flush(self) -> None:
        if self.strip is not None:
            self.alignment.feed(self.strip)

    def take(self, bi: int, bj: int, costs) -> None:
        n = len(self.alignment.y)
        if bi != self.strip_no:
            self._flush()
            height = min(self.block, len(self.alignment.x) - bi * self.block)
            self.strip_no, self.strip = bi, np.full((height, n), np.inf)
        start, end = bj * self.block, min((bj + 1) * self.block, n)
        self.strip[:, start:end] = np.asarray(costs, float).reshape(len(self.strip), end - start)

    def result(self) -> tuple:
        self._flush()
        cost, ops = self.alignment.finish()
        shift = lambda at: at + self.head if at >= 0 else -1
        named = [{"op": op, "i": shift(i), "j": shift(j), "cost": c} for op, i, j, c in ops]
        return (*self.key, cost + self.own, named)


def _sections(coded: DataFrame, block: int) -> DataFrame:
    """``pair, ts, ps, cost, own, ops``: every section of the truth against every one of the prediction."""
    both = coded.select("pair", F.posexplode("t").alias("ts", "a"), "p").select("pair", "ts", "a", F.posexplode("p").alias("ps", "b"))
    x, y = F.col("a.part"), F.col("b.part")
    both = both.select("pair", "ts", "ps", x.alias("x"), y.alias("y"), _own_cost(x, y).alias("own"))

    def sizes(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.size(r["cells"]))

    def hashes(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.xxhash64(r["cells"]))

    plan = _plan(
        F.struct(
            hashes(F.col("x.rows")).alias("x"), hashes(F.col("y.rows")).alias("y"),
            F.col("x.row_weights").alias("wx"), F.col("y.row_weights").alias("wy"),
            sizes(F.col("x.rows")).alias("sx"), sizes(F.col("y.rows")).alias("sy"), F.lit(block).alias("block"),
        )
    )
    planned = materialize(both.withColumn("plan", plan), "edit-sections")

    def middle(values: str) -> Column:
        rest = F.size(values) - F.col("plan.head") - F.col("plan.tail")
        return F.slice(values, F.col("plan.head") + 1, rest)

    none = F.lit(None)
    headers = planned.select(
        "pair", "ts", "ps", F.lit(-1).alias("bi"), F.lit(-1).alias("bj"), F.col("plan.head").alias("head"), "own",
        middle("x.row_weights").alias("x_weights"), middle("y.row_weights").alias("y_weights"), none.cast("array<double>").alias("costs"),
    )

    def piece(side: str, number: str) -> Column:
        # the last block ends where the equal tail begins
        start = F.col("head") + F.col(number) * block
        return F.slice(f"{side}.rows", start + 1, F.least(F.lit(block), F.size(f"{side}.rows") - F.col("tail") - start))

    open_blocks = planned.select("pair", "ts", "ps", "x", "y", "plan.head", "plan.tail", F.explode("plan.blocks").alias("k"))
    blocks = open_blocks.select("pair", "ts", "ps", "k.bi", "k.bj", "x", "y", "head", "tail")
    blocks = blocks.select("pair", "ts", "ps", "bi", "bj", piece("x", "bi").alias("x"), piece("y", "bj").alias("y"))
    spread = blocks.repartition("pair", "ts", "ps", "bi", "bj")

    place = ["pair", "ts", "ps", "bi", "bj"]
    compared = spread.select(
        *place, _cell_costs(_cells(F.col("x")), _cells(F.col("y"))).alias("c"), F.col("x.weights").alias("x"), F.col("y.weights").alias("y")
    )
    filled = compared.mapInPandas(_row_costs, _COSTS).withColumns({"head": none.cast("int"), "own": none.cast("double")})
    filled = filled.withColumns({"x_weights": none.cast("array<double>"), "y_weights": none.cast("array<double>")})
    lists = headers.unionByName(filled).repartition("pair", "ts", "ps").sortWithinPartitions("pair", "ts", "ps", "bi", "bj")
    aligned = materialize(lists.mapInPandas(partial(_align_rows, block), _ALIGNED), "edit-rows")
    return aligned.join(planned.select("pair", "ts", "ps", "own"), ["pair", "ts", "ps"])


def _section_ops(coded: DataFrame, sections: DataFrame) -> DataFrame:
    """``pair, op``: deleted, inserted and matched sections (matched ones that cost something)."""
    costs = sections.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("ts", "ps", "cost"))).alias("c"))
    weights = lambda side: F.transform(side, lambda s: s["weight"])
    sides = coded.select("pair", weights("t").alias("wx"), weights("p").alias("wy")).join(costs, "pair", "left")
    matrix = F.coalesce(F.transform("c", lambda s: s["cost"]), F.array().cast("array<double>"))
    return sides.select("pair", F.explode(_scripts(matrix, "wx", "wy")).alias("op")).select("pair", "op.*")


# ---------------------------------------------------------------- the whole


def _coded(pairs: DataFrame, key: str, cell_tags: tuple[str, ...], ignore_tags: tuple[str, ...], structure_only: bool) -> DataFrame:
    """``pair`` (a number), the key, and both tables with comparable cells from the first section that differs, of the pairs that differ.

    ``head`` sections are left out on either side and, if there is one section left, rows at the ends of it, ``row_head`` of them at the
    head; the weight of that section counts them by the least that a row weighs, which is all it takes to match the sections.
    """
    # equal documents are not parsed
    differ = F.col("true_html") != F.col("pred_html")
    both = pairs.select(F.col(key).alias("_key"), *(F.when(differ, F.col(side)).alias(side) for side in ("true_html", "pred_html")))
    for side, name in (("true_html", "_t"), ("pred_html", "_p")):
        both = with_markup(both, side, ignore_tags).withColumnRenamed("_markup", name).drop("status", "n_nodes")

    def coded(s: Column) -> Column:
        sides = coded_sides(s["t"], s["p"], cell_tags, structure_only)
        return F.struct(s["head"].alias("head"), s["row_head"].alias("row_head"), s["row_ends"].alias("row_ends"), sides.alias("c"))

    def rest(s: Column) -> Column:
        t, p, n = s["c"]["t"], s["c"]["p"], s["row_ends"]

        def cut(side: Column, equal: Column) -> Column:
            kept = F.slice(side, equal + 1, F.size(side))
            return F.when(n > 0, F.transform(kept, lambda x: x.withField("weight", x["weight"] + n))).otherwise(kept)

        def open_part(equal: Column) -> Column:
            return F.struct((s["head"] + equal).alias("head"), s["row_head"].alias("row_head"), cut(t, equal).alias("t"), cut(p, equal).alias("p"))

        return F.when(t != p, bind(_equal_head(t, p), open_part))

    parsed = bind(M.differing_sections(F.col("_t"), F.col("_p"), tails=False), lambda s: bind(coded(s), rest))
    both = both.withColumn("c", F.when(F.col("_t") != F.col("_p"), parsed)).withColumn("pair", F.monotonically_increasing_id())
    return both.select("pair", "_key", "c").filter("c IS NOT NULL").select("pair", "_key", "c.*")


def _equal_head(xs: Column, ys: Column) -> Column:
    """How many sections at the head of two tables that differ are equal; they are matched, as equal rows are."""
    first = F.array_position(F.zip_with(xs, ys, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int") - 1
    return F.when(F.least(F.size(xs), F.size(ys)) == 1, F.when(F.get(xs, 0) == F.get(ys, 0), 1).otherwise(0)).otherwise(first)


def edit_script(
    pairs: DataFrame,
    key: str = "file",
    cell_tags: tuple[str, ...] = ("td",),
    ignore_tags: tuple[str, ...] = (),
    structure_only: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """``key, level, op, true_section, true_row, true_cell, pred_section, pred_row, pred_cell, cost`` of pairs of documents.

    ``pairs`` has the key, ``true_html`` and ``pred_html``.  ``level`` is ``section``, ``row`` or ``cell``, ``op`` is ``delete`` (only
    in the truth), ``insert`` (only in the prediction) or ``change``.  Places count from 0 and are null on the side that has none, and
    below the level of the row.  What agrees is not listed, what lies in a deleted or inserted part is counted in the cost of that
    part, so the costs of a pair add up to the ``distance`` of ``score_tables``.  Equal and unusable pairs have no rows.  Of several
    scripts with the least cost one is given, always the same.
    """
    t, p, small = F.col("t"), F.col("p"), F.col("small")
    coded = _coded(pairs, key, cell_tags, ignore_tags, structure_only).withColumn("small", _fits(t, p, block))
    large = (F.when(~small, side).alias(name) for name, side in (("t", t), ("p", p)))
    # not in one selection: a name inside a lambda function would be taken for the new column
    coded = coded.withColumn("work", F.when(small, _work(t, p))).select("pair", "_key", "head", "row_head", "small", "work", *large)
    coded = materialize(coded, "edit-pairs")
    schema = StructType([*(coded.schema[n] for n in ("_key", "head", "row_head")), *_FOUND])
    found = coded.filter("small").select("_key", "head", "row_head", "work.*").mapInArrow(_settle, schema)
    coded = coded.filter("NOT small").select("pair", "_key", "head", "row_head", "t", "p")
    if not coded.isEmpty():
        found = found.unionByName(_script_by_blocks(coded, block))

    def moved(name: str) -> Column:
        by = {"section": F.col("head"), "row": F.col("row_head")}.get(name.split("_")[1], F.lit(0))
        return (F.col(name) + by).cast("int").alias(name)

    return found.select(F.col("_key").alias(key), "level", "op", *map(moved, _PLACES), "cost")


def _script_by_blocks(coded: DataFrame, block: int) -> DataFrame:
    """``_key, head, row_head`` and the operations of large pairs."""
    sections = _sections(coded, block)
    section_ops = materialize(_section_ops(coded, sections), "edit-section-ops")
    matched = section_ops.filter("op = 'change'").select("pair", F.col("i").alias("ts"), F.col("j").alias("ps"))
    inside = sections.join(matched, ["pair", "ts", "ps"])
    row_ops = inside.select("pair", "ts", "ps", F.explode("ops").alias("o")).select("pair", "ts", "ps", "o.*")

    def rows_of(side: str, section: str, number: str, name: str) -> DataFrame:
        listed = coded.select("pair", F.posexplode(side).alias(section, "s"))
        return listed.select("pair", section, F.posexplode("s.part.rows").alias(number, name))

    changed = row_ops.filter("op = 'change'").select("pair", "ts", "ps", "i", "j")
    changed = changed.join(rows_of("t", "ts", "i", "x"), ["pair", "ts", "i"]).join(rows_of("p", "ps", "j", "y"), ["pair", "ps", "j"])
    compared = changed.select(
        "pair", "ts", "ps", F.col("i").alias("tr"), F.col("j").alias("pr"), _cell_costs(F.col("x.cells"), F.col("y.cells")).alias("c"),
        F.col("x.weights").alias("x"), F.col("y.weights").alias("y"),
    )
    cells = compared.mapInPandas(_cell_scripts, _CELL_OPS)

    def at(column: str) -> Column:
        return F.when(F.col(column) >= 0, F.col(column)).cast("int")

    def listed(df: DataFrame, level: str, places: tuple[Column | None, ...]) -> DataFrame:
        columns = [(F.lit(None).cast("int") if c is None else c).alias(n) for c, n in zip(places, _PLACES)]
        return df.select("pair", F.lit(level).alias("level"), "op", *columns, "cost")

    # a matched pair of sections costs its own difference here, its rows are listed below
    own = inside.filter("own > 0").select("pair", F.lit("change").alias("op"), F.col("ts").alias("i"), F.col("ps").alias("j"), F.col("own").alias("cost"))
    of_sections = section_ops.filter("op <> 'change'").unionByName(own)
    one_sided = row_ops.filter("op <> 'change'")
    # only the side that has the part names a section
    true_side, pred_side = F.when(F.col("op") != "insert", F.col("ts")), F.when(F.col("op") != "delete", F.col("ps"))
    out = (
        listed(of_sections, "section", (at("i"), None, None, at("j"), None, None))
        .unionByName(listed(one_sided, "row", (true_side, at("i"), None, pred_side, at("j"), None)))
        .unionByName(listed(cells, "cell", (F.col("ts"), F.col("tr"), at("i"), F.col("ps"), F.col("pr"), at("j"))))
    )
    return coded.select("pair", "_key", "head", "row_head").join(out, "pair").drop("pair")


def table_distances(pairs: DataFrame, key: str = "file", **options) -> DataFrame:
    """``key, distance`` of pairs that differ, as ``score_tables`` gives it, for tables too large for one task each."""
    script = edit_script(pairs, key, **options)
    return script.groupBy(key).agg(F.sum("cost").alias("distance"))
