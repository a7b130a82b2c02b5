"""Boxes of images that fit into a task, compared in NumPy.

A grid join sends every box several times and every pair of boxes once or twice more.  Here the boxes of an image are sent once, to one task,
and what a query wants of their pairs (best partners, counts, kept boxes) is found there.  Images with more than ``IMAGE_BOXES`` boxes
do not come here: ``split`` tells them apart, and ``overlap.overlap_pairs`` spreads each of them over many tasks.

Boxes are compared in a sweep: those of the right side are ordered by their centres, on the axis that leaves fewer candidates in
the image, and a left box looks at the centres that an overlap of ``min_iou`` allows.  Pairs come in blocks, so memory does not grow with
their number.

Values are compared as Spark does: NaN is the largest number, null is smaller than all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from gridweft.session import materialize

IMAGE_BOXES = 30_000
"""Boxes of both sides in an image that is compared in one task, at most."""
CHUNK_BOXES = 100_000
"""Boxes of several images that are worked on at a time, about."""
BLOCK_PAIRS = 1_000_000
"""Candidates that are compared at a time, about."""
EDGES = ("x1", "y1", "x2", "y2")
_NONE = np.iinfo(np.int64).min


def box_rows(detections: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Both sides as one written frame: ``image, x1, y1, x2, y2, det_no, score, gt_no, iscrowd, is_gt``.

    ``iscrowd`` is 0 where the truth does not have it.  Boxes that are read several times are made once.
    """
    edges = [F.get("box", i).alias(e) for i, e in enumerate(EDGES)]
    rows = detections.select("image", *edges, "det_no", "score", F.lit(False).alias("is_gt"))
    if truth is not None:
        crowd = F.col("iscrowd") if "iscrowd" in truth.columns else F.lit(0).alias("iscrowd")
        rows = rows.unionByName(truth.select("image", *edges, "gt_no", crowd, F.lit(True).alias("is_gt")), allowMissingColumns=True)
    return materialize(rows, "nms-boxes" if truth is None else "boxes")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of images that are compared whole, and those of larger images (``None`` if there are none).

    Rows without an image or an edge overlap nothing; they are in neither part.
    """
    usable = rows.dropna(subset=["image", *EDGES])
    large = materialize(usable.groupBy("image").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > IMAGE_BOXES).select("image"), "large-images")
    if large.isEmpty():
        return usable, None
    return usable.join(large, "image", "left_anti"), usable.join(large, "image", "left_semi")


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections and true boxes of ``box_rows`` as they were given."""
    box = F.array(*EDGES).alias("box")
    det, gt = rows.filter(~F.col("is_gt")), rows.filter("is_gt")
    return det.select("image", box, "det_no", "score"), gt.select("image", box, *[c for c in ("gt_no", "iscrowd") if c in rows.columns])


def per_image(rows: DataFrame, work: Callable[[Images], dict[str, pa.Array]], fields: dict[str, DataType]) -> DataFrame:
    """The rows that ``work`` makes of whole images, some of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            found = work(Images(table))
            schema = pa.schema([(n, t) for n, t in arrow.items()])
            arrays = [found[n].cast(t) for n, t in arrow.items()]
            for batch in pa.table(arrays, schema).combine_chunks().to_batches(max_chunksize=20_000):
                yield batch

    arrow = {n: to_arrow_type(t) for n, t in fields.items()}
    dealt = rows.repartition("image").sortWithinPartitions("image")
    return dealt.mapInArrow(run, StructType([StructField(n, t) for n, t in fields.items()]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole images, from batches in order of the image."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < CHUNK_BOXES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table["image"])
        if len(starts) > 1:
            yield table.slice(0, starts[-1])
            table = table.slice(starts[-1])
        held, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _starts(image: pa.ChunkedArray) -> np.ndarray:
    """Places where another image begins."""
    image = image.combine_chunks()
    new = pc.fill_null(pc.not_equal(image.slice(1), image.slice(0, len(image) - 1)), True)
    return np.concatenate(([0], 1 + np.flatnonzero(np.asarray(new))))


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, in the order of the values; null has -1."""
    there = np.asarray(column.is_valid())
    out = np.full(len(column), -1, np.int64)
    out[there] = np.unique(column.drop_null().to_numpy(), return_inverse=True)[1]
    return out


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles and where they are null."""
    column = column.combine_chunks()
    return np.asarray(pc.fill_null(column.cast(pa.float64()), 0.0)), np.asarray(column.is_null())


class Images:
    """Boxes of some images: ``det`` and ``gt``."""

    def __init__(self, table: pa.Table):
        self.table = table
        starts = _starts(table["image"])
        group = np.zeros(table.num_rows, np.int64)
        group[starts[1:]] = 1
        is_gt = np.asarray(table["is_gt"])
        edges = np.column_stack([_numbers(table[e])[0] for e in EDGES])
        group = np.cumsum(group)
        self.det = Boxes(table, np.flatnonzero(~is_gt), group, edges, "det_no")
        if "gt_no" in table.column_names:
            self.gt = Boxes(table, np.flatnonzero(is_gt), group, edges, "gt_no")

    def taken(self, name: str, rows: np.ndarray) -> pa.Array:
        return self.table[name].combine_chunks().take(pa.array(rows))


class Boxes:
    """Boxes of one side, in order of their images.

    ``rows`` are places in the table; ``key`` is a number for each different image and number of a box, ``no`` the rank of the number.
    """

    def __init__(self, table: pa.Table, rows: np.ndarray, group: np.ndarray, edges: np.ndarray, number: str):
        part = table.select([c for c in (number, "score", "iscrowd") if c in table.column_names]).take(pa.array(rows))
        self.rows, self.group, self.edges = rows, group[rows], edges[rows]
        self.no = _ranks(part[number])
        pairs = self.group * (int(self.no.max(initial=0)) + 2) + self.no + 1
        self.key = np.unique(pairs, return_inverse=True)[1]
        self.table = part

    def __len__(self) -> int:
        return len(self.rows)

    def at(self, places: np.ndarray) -> Boxes:
        out = object.__new__(Boxes)
        out.rows, out.group, out.edges = self.rows[places], self.group[places], self.edges[places]
        out.no, out.key, out.table = self.no[places], self.key[places], self.table.take(pa.array(places))
        return out

    def first_copies(self, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of one box for each different one, the first by ``order``; and for each box the place of its own in that list."""
        by = np.lexsort((*reversed(order), *self.edges.T[::-1], self.group))
        group, edges = self.group[by], self.edges[by]
        new = np.ones(len(by), bool)
        new[1:] = (group[1:] != group[:-1]) | (edges[1:] != edges[:-1]).any(axis=1)
        own = np.empty(len(by), np.int64)
        own[by] = np.cumsum(new) - 1
        return by[new], own


def best_first(det: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """Copies of detections: the highest score, then the lowest number; null comes first, NaN last."""
    score, null = _numbers(det.table["score"])
    place = np.where(np.isnan(score), np.inf, -score)
    # infinite scores keep their order among the others by the flag
    return det.first_copies(np.where(null, 0, np.where(np.isnan(score), 2, 1)), place, det.no)


def crowd_first(gt: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """Copies of true boxes: the lowest ``iscrowd``, then the lowest number; null comes first."""
    crowd, null = _numbers(gt.table["iscrowd"])
    return gt.first_copies(np.where(null, -np.inf, crowd), gt.no)


def lowest_first(gt: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """Copies of true boxes: the lowest number, null last."""
    return gt.first_copies(np.where(gt.no < 0, -_NONE - 1, gt.no))


def crowd(gt: Boxes) -> np.ndarray:
    """``iscrowd`` as doubles, null as NaN."""
    values, null = _numbers(gt.table["iscrowd"])
    return np.where(null, np.nan, values)


def _bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, after: bool) -> np.ndarray:
    """For each ``x`` the place in its own stretch of ``values`` before, or behind, equal ones."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        there = values[np.minimum(mid, len(values) - 1)]
        right = open_ & ((there <= x) if after else (there < x))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def pairs(
    left: Boxes, right: Boxes, min_iou: float, order: np.ndarray | None = None, alive: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of pairs of at least ``min_iou``: places of both boxes, and the overlap.

    All pairs of left boxes with one key are in one block; with ``order`` left boxes are taken one by one in that order instead, those
    left out that are no longer ``alive`` when their block begins.  ``w`` and ``W`` being two extents, at least ``t * max(w, W)`` is common, so the
    centres are at most ``(w + W) / 2 - t * max(w, W)`` apart, and ``W`` is at most ``w / t``.
    """
    if not len(left) or not len(right):
        return
    n = max(left.group[-1], right.group[-1]) + 1
    first = np.searchsorted(right.group, np.arange(n + 1))
    found = []
    for a in (0, 1):
        def middle(b: Boxes) -> np.ndarray:
            return b.edges[:, a] / 2 + b.edges[:, a + 2] / 2

        by = np.lexsort((middle(right), right.group))
        centres, own = middle(right)[by], middle(left)
        extent = np.maximum(left.edges[:, a + 2] - left.edges[:, a], 0.0)
        reach = extent / 2 + (extent / min_iou if min_iou < 0.5 else extent) * (0.5 - min_iou)
        # for rounding
        reach = reach + 1e-9 * (extent + np.abs(left.edges[:, a]) + np.abs(left.edges[:, a + 2]))
        lo, hi = first[left.group], first[left.group + 1]
        start = _bisect(centres, lo, hi, own - reach, False)
        found.append((by, start, np.maximum(_bisect(centres, lo, hi, own + reach, True) - start, 0)))
    fewer = np.bincount(left.group, found[1][2], n) < np.bincount(left.group, found[0][2], n)
    axis = fewer[left.group].astype(np.int64)
    key = left.key
    if order is None:
        order = np.argsort(key, kind="stable")
    else:
        key = np.arange(len(left))[np.argsort(order)]
    by = np.concatenate((found[0][0], found[1][0]))
    start = np.where(axis, found[1][1] + len(right), found[0][1])[order]
    count = np.where(axis, found[1][2], found[0][2])[order]
    key = key[order]
    ends = np.concatenate((np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    total = np.concatenate(([0], np.cumsum(count)))
    done = 0
    while done < len(order):
        # up to the last key that fits, one key at least
        fit = np.searchsorted(total[ends], total[done] + BLOCK_PAIRS, "right")
        following = np.searchsorted(ends, done, "right")
        end = int(ends[min(max(fit - 1, following), len(ends) - 1)])
        c = count[done:end] if alive is None else np.where(alive[order[done:end]], count[done:end], 0)
        offset = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        l = np.repeat(order[done:end], c)
        r = by[np.repeat(start[done:end], c) + offset]
        p, q = left.edges[l], right.edges[r]
        near = (np.minimum(p[:, 3], q[:, 3]) > np.maximum(p[:, 1], q[:, 1])) & (np.minimum(p[:, 2], q[:, 2]) > np.maximum(p[:, 0], q[:, 0]))
        l, r, p, q = l[near], r[near], p[near], q[near]
        both = (np.minimum(p[:, 2], q[:, 2]) - np.maximum(p[:, 0], q[:, 0])) * (np.minimum(p[:, 3], q[:, 3]) - np.maximum(p[:, 1], q[:, 1]))
        union = (p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1]) + (q[:, 2] - q[:, 0]) * (q[:, 3] - q[:, 1]) - both
        iou = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        enough = iou >= min_iou
        yield l[enough], r[enough], iou[enough]
        done = end


def last_of(code: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each code the place of the row with the largest keys, in order of the codes."""
    by = np.lexsort((*reversed(keys), code))
    ordered = code[by]
    return by[np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))] if len(by) else by


class Best:
    """The row with the largest keys for each code, over several blocks."""

    def __init__(self, columns: int):
        self.code, self.columns = np.empty(0, np.int64), [np.empty(0)] * columns

    def add(self, code: np.ndarray, *columns: np.ndarray) -> None:
        code = np.concatenate((self.code, code))
        columns = [np.concatenate(c) if len(c[0]) else c[1] for c in zip(self.columns, columns, strict=True)]
        kept = last_of(code, *columns)
        self.code, self.columns = code[kept], [c[kept] for c in columns]


def smaller_first(no: np.ndarray) -> np.ndarray:
    """A key that is larger for a smaller number, and least for null."""
    return np.where(no < 0, _NONE, -no)


def scores(det: Boxes) -> np.ndarray:
    """Ranks of the scores, -1 for null."""
    return _ranks(det.table["score"])


def levels(det: Boxes, thresholds: np.ndarray) -> np.ndarray:
    """How many of the sorted thresholds are below the score."""
    score, null = _numbers(det.table["score"])
    return np.where(null, 0, np.searchsorted(thresholds, score, "left"))


class Mutual:
    """Mutual best partners among pairs that come in blocks, at each of some levels.

    A pair counts at the levels below its own ``level`` (1 or more).
    """

    def __init__(self, det: Boxes, gt: Boxes, levels: int = 1):
        self.det, self.gt, self.levels, self.score = det, gt, levels, scores(det)
        self.by_det, self.by_gt = Best(3), Best(4)

    def add(self, d: np.ndarray, g: np.ndarray, iou: np.ndarray, level: np.ndarray | int = 1) -> None:
        det, gt, level = self.det, self.gt, np.broadcast_to(level, d.shape)
        self.by_det.add(det.key[d] * self.levels + level - 1, iou, smaller_first(gt.no[g]), g)
        self.by_gt.add(gt.key[g] * self.levels + level - 1, iou, self.score[d], smaller_first(det.no[d]), d)

    def found(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level, from the highest: its number from 0, places of detections and true boxes, and overlaps."""
        now_det, now_gt = Best(3), Best(4)
        for level in range(self.levels - 1, -1, -1):
            for now, all_ in ((now_det, self.by_det), (now_gt, self.by_gt)):
                here = all_.code % self.levels == level
                now.add(all_.code[here] // self.levels, *[c[here] for c in all_.columns])
            # places are doubles where nothing was found
            g, d = now_det.columns[2].astype(np.int64), now_gt.columns[3].astype(np.int64)
            iou, key = now_det.columns[0], now_det.code
            at = np.searchsorted(now_gt.code, self.gt.key[g])
            mutual = (self.det.key[d[at]] == key) if len(g) else np.zeros(0, bool)
            mutual &= self.gt.no[g] >= 0
            if len(g):
                mutual &= self.det.no[d[at]] >= 0
                yield level, d[at][mutual], g[mutual], iou[mutual]


def kept_boxes(images: Images, min_iou: float) -> np.ndarray:
    """Places in the table of the boxes that greedy suppression keeps, one of several copies.

    Blocks follow the rank (score, then lower number), so the boxes of a block that better ones drop are known before it; memory does
    not grow with the number of overlaps.  Boxes without a number drop nothing and are not kept.
    """
    det = images.det
    flat = (det.edges[:, 2] - det.edges[:, 0]) * (det.edges[:, 3] - det.edges[:, 1]) <= 0
    solid = np.flatnonzero(~flat)
    first = best_first(det.at(solid))[0]
    # boxes without area overlap nothing, not even their copies
    det = det.at(np.sort(np.concatenate((solid[first], np.flatnonzero(flat)))))
    det = det.at(np.flatnonzero(det.no >= 0))
    score, no, node = scores(det), det.no, det.key
    order = np.lexsort((no, -score))
    dropped, kept = np.zeros(node.max(initial=-1) + 1, bool), np.zeros(node.max(initial=-1) + 1, bool)
    alive = np.ones(len(det), bool)
    for l, r, iou in pairs(det, det, min_iou, order, alive):
        worse = (score[r] < score[l]) | ((score[r] == score[l]) & (no[r] > no[l]))
        edge = (iou > min_iou) & worse & (score[r] >= 0) & (score[l] >= 0)
        l, r = l[edge], node[r[edge]]
        starts = np.flatnonzero(np.append(True, l[1:] != l[:-1])) if len(l) else l
        for box, a, b in zip(l[starts].tolist(), starts.tolist(), np.append(starts[1:], len(l)).tolist()):
            if not dropped[node[box]]:
                kept[node[box]] = True
                dropped[r[a:b]] = ~kept[r[a:b]]
        np.logical_not(dropped[node], out=alive)
    return det.rows[alive]
