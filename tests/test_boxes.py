"""Overlap joins, matching, suppression and top boxes against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gridweft.functions import geometry as G
from gridweft.operators import detection as DT
from gridweft.operators.layout_merge import assign_lines, fill_cells
from gridweft.operators.overlap import overlap_pairs


def iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def boxes(rng, n, image=0):
    out = []
    for _ in range(n):
        x, y = rng.uniform(-50, 100), rng.uniform(-50, 100)
        scale = rng.choice((1, 4, 16, 64))
        out.append((image, [float(x), float(y), x + rng.uniform(0.5, 3) * scale, y + rng.uniform(0.5, 3) * scale]))
    # copies, a power of two, and a box without area
    out += [out[0], out[0], out[1], (image, [0.0, 0.0, 8.0, 8.0]), (image, [0.0, 0.0, 4.0, 8.0]), (image, [5.0, 5.0, 5.0, 9.0])]
    return out


@pytest.mark.parametrize("threshold", [None, 0.1, 0.3, 0.5, 0.9, 1.0])
def test_pairs(spark, threshold):
    rng = random.Random(3)
    left = [(*b, i) for i, b in enumerate(boxes(rng, 60) + boxes(rng, 30, 1))]
    right = [(*b, i) for i, b in enumerate(boxes(rng, 60) + boxes(rng, 30, 1) + [x[:2] for x in left[:20]])]
    l = spark.createDataFrame(left, "image int, box array<double>, a int")
    r = spark.createDataFrame(right, "image int, box array<double>, b int")
    got = sorted((x["a"], x["b"]) for x in overlap_pairs(l, r, min_iou=threshold).collect())
    want = sorted(
        (a, b) for i, p, a in left for j, q, b in right
        if i == j and (iou(p, q) > 0 if threshold is None else iou(p, q) >= threshold)
    )
    assert got == want


def detections(rng, n=80):
    rows = boxes(rng, n) + boxes(rng, n // 2, 1)
    return [(i, b, k, rng.choice((0.2, 0.5, 0.5, 0.9, 0.95))) for k, (i, b) in enumerate(rows)]


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_suppression_equals_greedy_walk(spark, threshold):
    rows = detections(random.Random(4))
    # a chain of boxes, each overlapping only its neighbours
    rows += [(2, [float(3 * i), 0.0, 3.0 * i + 10, 10.0], 1000 + i, 0.9 - i / 100) for i in range(12)]
    got = {r["det_no"] for r in DT.suppress_overlaps(
        spark.createDataFrame(rows, "image int, box array<double>, det_no int, score double"), threshold).collect()}
    kept = []
    for row in sorted(rows, key=lambda r: (-r[3], r[2])):
        if all(k[0] != row[0] or iou(k[1], row[1]) <= threshold for k in kept):
            kept.append(row)
    assert got == {k[2] for k in kept}


@pytest.mark.parametrize("limit", [1, 7, 2000])
def test_long_chains_are_settled_in_few_rounds(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(DT, "TILE_BOXES", limit)
    monkeypatch.setattr(DT, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    n = {1: 10, 7: 25, 2000: 1000}[limit]
    rows = [(0, [3.0 * i, 0.0, 3.0 * i + 10, 10.0], i, 0.9 - i / 2000) for i in range(n)]
    frame = spark.createDataFrame(rows, "image int, box array<double>, det_no int, score double")
    # every second box overlaps a kept one by more than half of it
    assert {r["det_no"] for r in DT.suppress_overlaps(frame, 0.5).collect()} == set(range(0, n, 2))
    if limit == 2000:
        assert len(list(tmp_path.iterdir())) <= 1 + 2  # boxes free from the start, then two rounds


def test_tiles_hold_no_more_than_their_limit(spark, monkeypatch):
    monkeypatch.setattr(DT, "TILE_BOXES", 10)
    rng = random.Random(8)
    places = [(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(300)] + [(rng.uniform(0, 9000), 0.0) for _ in range(300)]
    frame = spark.createDataFrame([(0, i, 0.5, x, y, 10.0) for i, (x, y) in enumerate(places)],
                                  "image int, det_no int, score double, cx double, cy double, unit double")
    sizes = [r["count"] for r in DT._tiles(frame, 16.0).groupBy("tile").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 25  # dealt by hash, so a share may be somewhat above 10


def test_match_and_scores_against_brute_force(spark):
    rng = random.Random(6)
    gt = [(i, b, k, int(rng.random() < 0.2)) for k, (i, b) in enumerate(boxes(rng, 50) + boxes(rng, 20, 1))]
    det = [(i, [v + rng.uniform(0, 0.2) for v in b], k, rng.random()) for i, b, k, _ in gt]
    d = spark.createDataFrame(det, "image int, box array<double>, det_no int, score double")
    g = spark.createDataFrame(gt, "image int, box array<double>, gt_no int, iscrowd int")

    def mutual(det, gt):
        pairs = [(iou(p, q), s, a, b) for i, p, a, s in det for j, q, b, _ in gt if i == j and iou(p, q) >= 0.5]
        best_d, best_g = {}, {}
        for v, s, a, b in pairs:
            best_d[a] = max(best_d.get(a, (-1, 0)), (v, -b))
            best_g[b] = max(best_g.get(b, (-1, 0, 0)), (v, s, -a))
        return {(a, b) for v, s, a, b in pairs if best_d[a][1] == -b and best_g[b][2] == -a}, best_d

    got = {(r["det_no"], r["gt_no"]) for r in DT.match_boxes(d, g).collect()}
    assert got == mutual(det, gt)[0]

    crowd = {k for _, _, k, c in gt if c}
    pairs_best = {}
    for i, p, a, s in det:
        for j, q, b, c in gt:
            if i == j and iou(p, q) >= 0.5:
                pairs_best[a] = max(pairs_best.get(a, (-1,)), (iou(p, q), -c, -b))
    ignored = {a for a, v in pairs_best.items() if v[1] < 0}
    left = [x for x in det if x[2] not in ignored]
    real = [x for x in gt if x[2] not in crowd]
    n = len(mutual(left, real)[0])
    row = DT.detection_scores(d, g).first()
    assert (row["n_match"], row["n_det"], row["n_gt"]) == (n, len(left), len(real))
    assert row["hmean"] == pytest.approx(2 * n / (len(left) + len(real)))


def test_published_rates_agree(spark):
    # recall and precision of a published detector, and its harmonic mean
    n_det, n_gt, hits = 731 * 1000, 871 * 1000, 731 * 871
    row = spark.createDataFrame([(hits, n_det, n_gt)], "h long, d long, g long").select(
        *DT._rates(F.col("h"), F.col("d"), F.col("g"))).first()
    assert row["precision"] == pytest.approx(0.871) and row["recall"] == pytest.approx(0.731)
    assert row["hmean"] == pytest.approx(0.795, abs=1e-3)


def test_top_per_image_of_one_large_image(spark):
    df = spark.range(5000).select(F.lit(1).alias("image"), F.col("id").alias("det_no"), (F.col("id") % 977 / 977).alias("score"))
    got = [r["det_no"] for r in DT.top_per_image(df, 50, salts=4).orderBy("rank").collect()]
    assert got == sorted(range(5000), key=lambda i: (-(i % 977) / 977, i))[:50]


def test_lines_to_cells(spark):
    cells = spark.createDataFrame([(0, [0.0, 0.0, 10.0, 10.0], 0), (0, [10.0, 0.0, 20.0, 10.0], 1), (0, [0.0, 0.0, 10.0, 10.0], 7)],
                                  "image int, box array<double>, cell_no int")
    lines = spark.createDataFrame([(0, [1.0, 1.0, 4.0, 3.0], 0, "a"), (0, [8.0, 5.0, 40.0, 8.0], 1, "b"), (0, [90.0, 90.0, 95.0, 95.0], 2, "c"),
                                   (0, [1.0, 5.0, 3.0, 6.0], 3, "d")], "image int, box array<double>, line_no int, text string")
    got = {r["line_no"]: (r["cell_no"], r["how"]) for r in assign_lines(lines, cells).collect()}
    assert got == {0: (0, "centre"), 1: (1, "overlap"), 3: (0, "centre")}
    assert {r["cell_no"]: r["text"] for r in fill_cells(lines, cells).collect()} == {0: "a d", 1: "b", 7: ""}


def test_polygon_functions(spark):
    df = spark.createDataFrame([([0, 0, 4, 0, 4, 3], [[0.0, 0.0, 2.0, 0.0, 2.0, 5.0, 0.0, 5.0], [3.0, 0.0, 5.0, 0.0, 5.0, 5.0, 3.0, 5.0]])], "c array<int>, q array<array<double>>")
    row = df.select(G.polygon_area("c").alias("a"), G.bounds_xywh("c").alias("b"), G.word_outline("q").alias("o"),
                    G.box_to_quad(F.array(*[F.lit(i) for i in range(4)])).alias("quad"),
                    G.clamp_box(F.array(*[F.lit(v) for v in (1, 0, 9, 9)]), F.lit(10), F.lit(10), (1, 1, 3, 3)).alias("clamp")).first()
    assert row["a"] == 6.0 and row["b"] == [0, 0, 4, 3]
    assert row["o"] == [0, 0, 2, 0, 3, 0, 5, 0, 5, 5, 3, 5, 2, 5, 0, 5]
    assert row["quad"] == [0, 1, 2, 1, 2, 3, 0, 3] and row["clamp"] == [0, 0, 10, 10]
