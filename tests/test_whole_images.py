"""Boxes compared image by image against the grid join, on odd rows too."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gridweft.operators import detection as DT
from gridweft.operators import whole_images as W

DET = "image int, box array<double>, det_no int, score double"
GT = "image int, box array<double>, gt_no int, iscrowd int"


def odd_rows(rng, n=150):
    """Copies, repeated and missing numbers, scores and images, boxes without area."""
    det, gt = [], []
    for k in range(n):
        x, y, w, h = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(3, 20), rng.uniform(3, 20)
        image, box = rng.choice((0, 0, 1, 2, None)), [x, y, x + w, y + h]
        moved = [v + rng.choice((0.0, 0.5, 1.0)) for v in box]
        gt.append((image, box, rng.choice((k, k, k, k // 2, None)), rng.choice((0, 0, 0, 1, None))))
        det.append((image, moved, rng.choice((k, k, k, k // 2, None)), rng.choice((0.2, 0.5, 0.5, 0.9, None, float("nan")))))
    det += [(0, det[0][1], 900, 0.9), (0, det[0][1], 901, None), (1, [3.0, 3.0, 3.0, 9.0], 902, 0.5), (1, None, 903, 0.5), (2, [1.0, None, 2.0, 3.0], 904, 0.5)]
    gt += [gt[0], (0, gt[0][1], 905, 1), (1, None, 906, 0)]
    return det, gt


def both_ways(spark, monkeypatch, query):
    out = []
    for limit in (W.IMAGE_BOXES, 0, 80):
        monkeypatch.setattr(W, "IMAGE_BOXES", limit)
        out.append(sorted(map(str, query().collect())))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_images_give_the_rows_of_the_grid_join(spark, monkeypatch, seed):
    rows = odd_rows(random.Random(seed))
    det, gt = spark.createDataFrame(rows[0], DET), spark.createDataFrame(rows[1], GT)
    queries = [
        lambda: DT.match_boxes(det, gt), lambda: DT.best_per_truth(det, gt), lambda: DT.detection_scores(det, gt),
        lambda: DT.threshold_sweep(det, gt, [0.0, 0.3, 0.5, 0.95], 0.3),
    ]
    for query in queries:
        whole, spread, mixed = both_ways(spark, monkeypatch, query)
        assert whole == spread == mixed and whole


def test_suppression_in_whole_images_gives_the_rows_of_the_tiles(spark, monkeypatch):
    det = [(i, b, k, s) for k, (i, b, _, s) in enumerate(odd_rows(random.Random(5))[0])]
    frame = spark.createDataFrame(det, DET)
    whole, spread, mixed = both_ways(spark, monkeypatch, lambda: DT.suppress_overlaps(frame, 0.3))
    assert whole == spread == mixed and whole


def test_small_images_are_not_sent_to_the_grid(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("grid join")

    monkeypatch.setattr(DT, "overlap_pairs", refused)
    det = spark.createDataFrame([(0, [0.0, 0.0, 9.0, 9.0], 1, 0.9), (0, [1.0, 0.0, 9.0, 9.0], 2, 0.8)], DET)
    gt = spark.createDataFrame([(0, [0.0, 0.0, 9.0, 8.0], 7, 0)], GT)
    assert [(r.det_no, r.gt_no) for r in DT.match_boxes(det, gt).collect()] == [(1, 7)]
    assert [r.det_no for r in DT.best_per_truth(det, gt).collect()] == [1]
    assert DT.detection_scores(det, gt).first()[:3] == (1, 2, 1)
    swept = sorted(r[:4] for r in DT.threshold_sweep(det, gt, [0.95, 0.0, 0.85]).collect())
    assert swept == [(0.0, 1, 2, 1), (0.85, 1, 1, 1), (0.95, 0, 0, 1)]
    assert DT.best_threshold(DT.threshold_sweep(det, gt, [0.0, 0.85])).first()[:1] == (0.85,)
    assert [r.det_no for r in DT.suppress_overlaps(det).collect()] == [1]


def iou(p, q):
    both = max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
    union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both
    return both / union if union > 0 else 0.0


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.9, 1.0])
def test_blocks_of_pairs_are_whole(monkeypatch, threshold):
    monkeypatch.setattr(W, "BLOCK_PAIRS", 7)
    rng = np.random.default_rng(3)
    n = 120
    low, size = rng.uniform(-40, 40, (n, 2)), rng.uniform(0.5, 3, (n, 2)) * rng.choice((1, 8, 40), (n, 1))
    edges = np.concatenate((low, low + size), axis=1)
    edges[::9] = edges[1::9][: len(edges[::9])]
    table = pa.table({
        "image": np.sort(rng.integers(0, 4, n)), "is_gt": rng.random(n) < 0.5, **dict(zip(W.EDGES, edges.T)),
        "det_no": np.arange(n) // 2, "gt_no": np.arange(n), "score": rng.random(n), "iscrowd": np.zeros(n),
    })
    images = W.Images(table)
    blocks = list(W.pairs(images.det, images.gt, threshold))
    got = sorted((images.det.rows[a], images.gt.rows[b]) for l, r, _ in blocks for a, b in zip(l, r))
    image, is_gt = np.asarray(table["image"]), np.asarray(table["is_gt"])
    want = [(i, j) for i in range(n) for j in range(n)
            if not is_gt[i] and is_gt[j] and image[i] == image[j] and iou(edges[i], edges[j]) >= threshold]
    assert got == want and (len(blocks) > 1 or threshold == 1.0)
    keys = [set(images.det.key[l]) for l, _, _ in blocks]
    assert sum(map(len, keys)) == len(set().union(*keys))  # the pairs of a detection are in one block


def test_images_are_cut_at_their_borders(monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BOXES", 4)
    image = [0, 0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3]
    batches = pa.table({"image": image}).to_batches(max_chunksize=3)
    parts = [t["image"].to_pylist() for t in W._whole(iter(batches))]
    assert sum(parts, []) == image and len(parts) > 1
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
