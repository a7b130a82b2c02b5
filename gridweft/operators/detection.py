"""Detections against true boxes: matching, scores, threshold sweep, suppression, top boxes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from gridweft.functions import geometry as G
from gridweft.operators import whole_images as W
from gridweft.operators.overlap import overlap_pairs, representatives
from gridweft.session import discard, materialize, scratch_path


def above_score(detections: DataFrame, threshold: float = 0.3) -> DataFrame:
    return detections.filter(F.col("score") > threshold)


def candidate_pairs(detections: DataFrame, truth: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """``image, det_no, gt_no, score, iou`` of all pairs that reach the overlap.

    Copies of a box are compared once, through the copy that would win anyway: the highest score, then
    the lowest number, for detections; the lowest number for true boxes.
    """
    det = representatives(
        detections.select("image", "box", "det_no", "score"), "det_no", order=F.struct(-F.col("score"), "det_no")
    )
    gt = representatives(truth.select("image", "box", "gt_no"), "gt_no")
    return overlap_pairs(det, gt, min_iou=min_iou).select("image", "det_no", "gt_no", "score", "iou")


def _mutual(pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    keys = [*extra, "image"]
    by_det = pairs.groupBy(*keys, "det_no").agg(
        F.max(F.struct("iou", (-F.col("gt_no")).alias("g"))).alias("b")
    ).select(*keys, "det_no", (-F.col("b.g")).alias("gt_no"), F.col("b.iou").alias("iou"))
    by_gt = pairs.groupBy(*keys, "gt_no").agg(
        F.max(F.struct("iou", "score", (-F.col("det_no")).alias("d"))).alias("b")
    ).select(*keys, "gt_no", (-F.col("b.d")).alias("det_no"))
    return by_det.join(by_gt, [*keys, "det_no", "gt_no"])


def match_boxes(detections: DataFrame, truth: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """One-to-one matches ``image, det_no, gt_no, iou``: each is the other's best partner.

    Ties go to the lower number of a true box, and to the higher score and then the lower number of a
    detection.  Large images go through the grid join; its pairs are read twice, so they are written to the checkpoint folder first.
    """

    def work(images: W.Images) -> dict[str, pa.Array]:
        det, gt = images.det.at(W.best_first(images.det)[0]), images.gt.at(W.lowest_first(images.gt)[0])
        mutual = W.Mutual(det, gt)
        for d, g, iou in W.pairs(det, gt, min_iou):
            mutual.add(d, g, iou)
        empty = np.zeros(0, np.int64)
        _, d, g, iou = next(mutual.found(), (0, empty, empty, np.zeros(0)))
        number = images.taken("image", det.rows[d]), images.taken("det_no", det.rows[d]), images.taken("gt_no", gt.rows[g])
        return dict(zip(fields, (*number, pa.array(iou)), strict=True))

    rows = W.box_rows(detections, truth)
    small, large = W.split(rows)
    fields = {n: rows.schema[n].dataType for n in ("image", "det_no", "gt_no")} | {"iou": DoubleType()}
    out = W.per_image(small, work, fields)
    if large is None:
        return out
    return out.unionByName(_mutual(materialize(candidate_pairs(*W.sides(large), min_iou), "pairs")))


def best_per_truth(detections: DataFrame, truth: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """The detection that overlaps each true box most.  Copies of a true box have the same one, a row each."""

    def work(images: W.Images) -> dict[str, pa.Array]:
        det, (first, own) = images.det.at(W.best_first(images.det)[0]), W.lowest_first(images.gt)
        gt, score, best = images.gt.at(first), W.scores(det), W.Best(4)
        for d, g, iou in W.pairs(det, gt, min_iou):
            best.add(g, iou, score[d], W.smaller_first(det.no[d]), d)
        there = np.isin(own, best.code)
        at = np.searchsorted(best.code, own[there])
        d, g = best.columns[3][at].astype(np.int64), images.gt.rows[there]
        number = images.taken("image", g), images.taken("gt_no", g), images.taken("det_no", det.rows[d])
        return dict(zip(fields, (*number, pa.array(best.columns[0][at])), strict=True))

    rows = W.box_rows(detections, truth)
    small, large = W.split(rows)
    fields = {n: rows.schema[n].dataType for n in ("image", "gt_no", "det_no")} | {"iou": DoubleType()}
    out = W.per_image(small, work, fields)
    return out if large is None else out.unionByName(_best_per_truth_spread(*W.sides(large), min_iou))


def _best_per_truth_spread(detections: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    det = representatives(
        detections.select("image", "box", "det_no", "score"), "det_no", order=F.struct(-F.col("score"), "det_no")
    )
    gt = representatives(truth.select("image", "box", "gt_no"), "gt_no")
    pairs = overlap_pairs(det, gt, min_iou=min_iou)
    best = pairs.groupBy("image", F.col("r_box").alias("box")).agg(
        F.max(F.struct("iou", "score", (-F.col("det_no")).alias("d"))).alias("b")
    )
    copies = truth.select("image", "box", "gt_no").join(best, ["image", "box"])
    return copies.select("image", "gt_no", (-F.col("b.d")).alias("det_no"), F.col("b.iou").alias("iou"))


def _rates(hits: Column, n_det: Column, n_gt: Column) -> list[Column]:
    recall = F.when(n_gt > 0, hits / n_gt).otherwise(F.lit(0.0))
    precision = F.when(n_det > 0, hits / n_det).otherwise(F.lit(0.0))
    total = n_det + n_gt
    hmean = F.when(total > 0, 2.0 * hits / total).otherwise(F.lit(0.0))
    return [recall.alias("recall"), precision.alias("precision"), hmean.alias("hmean")]


def detection_scores(detections: DataFrame, truth: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Recall, precision and their harmonic mean over all images.

    Ignored boxes (``iscrowd = 1``) count on neither side: they are no true boxes, and a detection whose best
    true box is ignored, together with its copies, is no detection.
    """

    def work(images: W.Images) -> dict[str, pa.Array]:
        (first, own), second = W.best_first(images.det), W.crowd_first(images.gt)[0]
        det, gt, copies = images.det.at(first), images.gt.at(second), np.bincount(own, minlength=len(first))
        crowd, mutual, n_match, n_ignored = W.crowd(gt), W.Mutual(det, gt), 0, 0
        for d, g, iou in W.pairs(det, gt, min_iou):
            counted = np.where(np.isnan(crowd[g]), -np.inf, -crowd[g])
            best = W.last_of(det.key[d], iou, counted, copies[d])
            best = best[crowd[g[best]] > 0]
            n_ignored += int(copies[d[best]].sum())
            # one without a number equals no other
            valid = (crowd[g] == 0) & ~(np.isin(det.key[d], det.key[d[best]]) & (det.no[d] >= 0))
            mutual.add(d[valid], g[valid], iou[valid])
        for _, d, _, _ in mutual.found():
            n_match += len(d)
        return {"n_match": pa.array([n_match]), "n_ignored": pa.array([n_ignored])}

    rows = W.box_rows(detections, truth)
    small, large = W.split(rows)
    found = W.per_image(small, work, {"n_match": LongType(), "n_ignored": LongType()})
    if large is not None:
        found = found.unionByName(_scores_spread(*W.sides(large), min_iou))
    # two frames of one row each
    found = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_match", "n_ignored")])
    counts = found.join(rows.agg(F.count_if(~F.col("is_gt")).alias("n_all"), F.count_if(F.col("is_gt") & (F.col("iscrowd") == 0)).alias("n_gt")))
    counts = counts.withColumn("n_det", F.col("n_all") - F.col("n_ignored"))
    return counts.select("n_match", "n_det", "n_gt", *_rates(F.col("n_match"), F.col("n_det"), F.col("n_gt")))


def _scores_spread(detections: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    """``n_match, n_ignored``."""
    det = representatives(detections, "det_no", order=F.struct(-F.col("score"), "det_no"), copies="copies")
    gt = representatives(truth, "gt_no", order=F.struct("iscrowd", "gt_no"))
    pairs = overlap_pairs(det, gt, min_iou=min_iou).drop("l_box", "r_box")
    # read four times below; writing the result costs less than repeating the join
    pairs = materialize(pairs, "pairs")
    best = pairs.groupBy("image", "det_no").agg(
        F.max(F.struct("iou", (-F.col("iscrowd")).alias("counted"), "copies")).alias("b")
    )
    ignored = best.filter(F.col("b.counted") < 0).select("image", "det_no", F.col("b.copies").alias("copies"))
    valid = pairs.filter(F.col("iscrowd") == 0).join(ignored, ["image", "det_no"], "left_anti")
    n_match = _mutual(valid).agg(F.count(F.lit(1)).alias("n_match"))
    return n_match.join(ignored.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_ignored")))


def threshold_sweep(
    detections: DataFrame, truth: DataFrame, thresholds: list[float], min_iou: float = 0.5
) -> DataFrame:
    """Detection scores for each score threshold, ignored boxes treated as in ``detection_scores``.

    The boxes are compared once.  Copies of a
    box are represented by their highest score, which is the last to be cut off.  Whether a detection's best true box
    is ignored does not depend on the threshold; how many copies of it pass does.
    """
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    steps = np.unique(np.array(thresholds, float))

    def passing(df: DataFrame) -> DataFrame:
        return df.withColumn("threshold", F.explode(F.filter(grid, lambda t: t < F.col("score"))))

    def work(images: W.Images) -> dict[str, pa.Array]:
        (first, own), second = W.best_first(images.det), W.crowd_first(images.gt)[0]
        det, gt = images.det.at(first), images.gt.at(second)
        level, crowd, mutual, ignored = W.levels(det, steps), W.crowd(gt), W.Mutual(det, gt, len(steps)), np.zeros(len(first), bool)
        for d, g, iou in W.pairs(det, gt, min_iou):
            best = W.last_of(d, iou, np.where(np.isnan(crowd[g]), -np.inf, -crowd[g]))
            best = best[crowd[g[best]] > 0]
            ignored[d[best]] = True
            # one without a number equals no other
            valid = (crowd[g] == 0) & (level[d] > 0) & ~(np.isin(det.key[d], det.key[d[best]]) & (det.no[d] >= 0))
            mutual.add(d[valid], g[valid], iou[valid], level[d[valid]])
        n_match = np.zeros(len(steps), np.int64)
        for step, d, _, _ in mutual.found():
            n_match[step] = len(d)
        passed = np.bincount(W.levels(images.det, steps)[ignored[own]], minlength=len(steps) + 1)[1:]
        n_ignored = np.cumsum(passed[::-1])[::-1]
        return {"threshold": pa.array(steps), "n_match": pa.array(n_match), "n_ignored": pa.array(n_ignored)}

    rows = W.box_rows(detections, truth)
    small, large = W.split(rows)
    found = W.per_image(small, work, {"threshold": DoubleType(), "n_match": LongType(), "n_ignored": LongType()})
    if large is not None:
        found = found.unionByName(_sweep_spread(*W.sides(large), min_iou, passing))
    found = found.groupBy("threshold").agg(F.sum("n_match").alias("n_match"), F.sum("n_ignored").alias("n_ignored"))
    n_all = passing(rows.filter(~F.col("is_gt")).select("score")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_all"))
    n_gt = rows.agg(F.count_if(F.col("is_gt") & (F.col("iscrowd") == 0)).alias("n_gt")).withColumn("threshold", F.explode(grid))
    out = n_gt.join(n_all, "threshold", "left").join(found, "threshold", "left").na.fill(0, ["n_all", "n_match", "n_ignored"])
    out = out.withColumn("n_det", F.col("n_all") - F.col("n_ignored"))
    return out.select(
        "threshold", "n_match", "n_det", "n_gt", *_rates(F.col("n_match"), F.col("n_det"), F.col("n_gt"))
    )


def _sweep_spread(
    detections: DataFrame, truth: DataFrame, min_iou: float, passing: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``threshold, n_match, n_ignored``; a pair is repeated for the thresholds below its score."""
    det = representatives(detections, "det_no", order=F.struct(-F.col("score"), "det_no"))
    gt = representatives(truth, "gt_no", order=F.struct("iscrowd", "gt_no"))
    pairs = materialize(overlap_pairs(det, gt, min_iou=min_iou).drop("r_box"), "pairs")
    best = pairs.groupBy("image", F.col("l_box").alias("box"), "det_no").agg(
        F.max(F.struct("iou", (-F.col("iscrowd")).alias("counted"))).alias("b")
    )
    ignored = best.filter(F.col("b.counted") < 0).select("image", "box", "det_no")
    valid = pairs.filter(F.col("iscrowd") == 0).join(ignored, ["image", "det_no"], "left_anti")
    hits = _mutual(passing(valid.drop("l_box")), ("threshold",)).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_match"))
    left_out = detections.select("image", "box", "score").join(ignored, ["image", "box"], "left_semi")
    n_ignored = passing(left_out.select("score")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_ignored"))
    return hits.unionByName(n_ignored, allowMissingColumns=True).na.fill(0, ["n_match", "n_ignored"])


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the highest harmonic mean."""
    best = sweep.agg(F.max(F.struct("hmean", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.hmean").alias("hmean"))


def top_per_image(detections: DataFrame, k: int = 1000, salts: int = 32) -> DataFrame:
    """The ``k`` highest scores of each image.

    Each image is first cut to its best ``k`` within a number of shares, so that one image with very many
    boxes is sorted by several tasks; at most ``k * salts`` rows of an image reach the last step.
    """
    order = [F.col("score").desc(), F.col("det_no")]
    share = Window.partitionBy("image", "_share").orderBy(*order)
    whole = Window.partitionBy("image").orderBy(*order)
    cut = (
        detections.withColumn("_share", F.pmod(F.xxhash64("det_no", "score"), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(share))
        .filter(F.col("_rank") <= k)
        .drop("_rank", "_share")
    )
    return cut.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


TILE_BOXES = 2000
"""Undecided boxes that are walked through by one task, at most."""


def suppress_overlaps(detections: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression: ``image, det_no, score`` of the kept boxes.

    A box is kept when no kept box of higher rank (score, then lower number) overlaps it by more than ``min_iou``.  An image is walked
    through in that order, a large one in tiles.
    """

    def work(images: W.Images) -> dict[str, pa.Array]:
        kept = W.kept_boxes(images, min_iou)
        return {n: images.taken(n, kept) for n in fields}

    rows = W.box_rows(detections)
    small, large = W.split(rows)
    fields = {n: rows.schema[n].dataType for n in ("image", "det_no", "score")}
    out = W.per_image(small, work, fields)
    return out if large is None else out.unionByName(_suppress_in_tiles(W.sides(large)[0], min_iou))


def _suppress_in_tiles(detections: DataFrame, min_iou: float) -> DataFrame:
    """Suppression in large images.

    Instead of walking through an image in order, all tiles of all images are walked through at the same time.  Inside a tile a box is dropped if a
    better neighbour is kept, kept if all of them are dropped, and left for the next round if that depends on an undecided box of
    another tile.  The tiles of the next round are larger, so a chain of boxes that goes through many tiles is soon settled inside
    one; a tile with too many undecided boxes is cut into smaller ones.  How boxes are dealt into tiles changes the number of rounds,
    not the result.

    Each round is written to the checkpoint folder, so lost executors do not restart the loop.  Copies of a box are
    represented by the best one, since all others are dropped by it.
    """
    flat = G.box_area(F.col("box")) <= 0
    columns = detections.select("image", "box", "det_no", "score")
    boxes = representatives(columns.filter(~flat), "det_no", order=F.struct(-F.col("score"), "det_no"))
    # boxes without area overlap nothing, not even their copies
    boxes = materialize(boxes.unionByName(columns.filter(flat)), "nms-boxes")
    better = boxes.select("image", "box", F.col("det_no").alias("by_no"), F.col("score").alias("by_score"))
    edges = overlap_pairs(boxes, better, min_iou=min_iou).filter(
        (F.col("iou") > min_iou)
        & ((F.col("by_score") > F.col("score")) | ((F.col("by_score") == F.col("score")) & (F.col("by_no") < F.col("det_no"))))
    )
    edges = materialize(edges.select("image", "det_no", "by_no", F.lit(False).alias("hit")), "nms-edges")
    spark, paths = detections.sparkSession, []
    number = ["image", "det_no"]

    def decided(found: DataFrame) -> DataFrame:
        # a folder for each round; all are read as one at the end, so plans do not grow with the rounds
        paths.append(scratch_path(spark, "nms-decided"))
        found.write.parquet(paths[-1])
        return spark.read.schema(found.schema).parquet(paths[-1])

    # boxes without a better neighbour are kept at once; only the others take part in the rounds
    newest = decided(boxes.join(edges.select(number), number, "left_anti").select(*number, F.lit(True).alias("kept")))
    low, high = (lambda a: F.get("box", a)), (lambda a: F.get("box", a + 2))
    waiting = boxes.join(newest.select(number), number, "left_anti").select(
        *number, "score", *[((low(a) + high(a)) / 2).alias(n) for a, n in ((0, "cx"), (1, "cy"))],
        F.greatest(high(0) - low(0), high(1) - low(1)).alias("extent"),
    )
    first = materialize(waiting, "nms-waiting")
    size = first.groupBy("image").agg(F.max("extent").alias("unit"))
    waiting = materialize(first.drop("extent").join(size, "image"), "nms-waiting")
    discard(spark, first)
    reach, last_edges = 256.0, edges
    while not waiting.isEmpty():
        before = newest.select("image", F.col("det_no").alias("by_no"), "kept")
        edges = last_edges.join(newest.select(number), number, "left_anti").drop("hit").join(before, ["image", "by_no"], "left")
        # an edge to a dropped box blocks nobody, one to a kept box decides
        open_edges = edges.filter("kept IS NULL OR kept").select(*number, "by_no", F.col("kept").isNotNull().alias("hit"))
        open_edges = materialize(open_edges, "nms-edges")
        tiles = materialize(_tiles(waiting, reach), "nms-tiles")
        newest = decided(_settled(tiles, open_edges))
        left = materialize(waiting.join(newest.select(number), number, "left_anti"), "nms-waiting")
        discard(spark, last_edges, tiles, waiting)
        last_edges, waiting = open_edges, left
        reach *= 16
    discard(spark, last_edges, waiting)
    everything = spark.read.schema(newest.schema).parquet(*paths)
    return boxes.join(everything.filter("kept"), number, "left_semi").select("image", "det_no", "score")


def _tiles(waiting: DataFrame, reach: float) -> DataFrame:
    """``image, det_no, score, tile``: squares of ``reach`` times the largest box, smaller ones where they hold too many boxes.

    Where even the smallest squares hold too many, their boxes are dealt out by number.
    """

    def square(level: int) -> Column:
        side = F.col("unit") * (reach / 8**level)
        return F.struct(F.lit(level).alias("level"), *[F.floor(F.col(c) / side).alias(c) for c in ("cx", "cy")])

    parts = F.lit(1).cast("long")
    tile = square(2)
    for level in (2, 1, 0):
        counts = waiting.groupBy("image", square(level).alias(f"s{level}")).agg(F.count(F.lit(1)).alias(f"n{level}"))
        waiting = waiting.withColumn(f"s{level}", square(level)).join(counts, ["image", f"s{level}"])
        few = F.col(f"n{level}") <= TILE_BOXES
        tile = F.when(few, F.col(f"s{level}")).otherwise(tile if level < 2 else F.col("s2"))
        crowded = F.ceil(F.col("n2") / TILE_BOXES)
        parts = F.when(few, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("det_no"), crowded) if level == 2 else parts)
    return waiting.select("image", "det_no", "score", F.struct(tile.alias("square"), parts.alias("part")).alias("tile"))


def _settled(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """``image, det_no, kept`` of the boxes that can be decided inside their tile.

    Only the edges inside a tile travel as a list, of at most ``TILE_BOXES`` numbers; all others are two flags.
    """
    own = tiles.select("image", "det_no", "tile")
    theirs = tiles.select("image", F.col("det_no").alias("by_no"), F.col("tile").alias("by_tile"))
    placed = edges.join(own, ["image", "det_no"]).join(theirs, ["image", "by_no"], "left")
    inside = F.col("tile") == F.col("by_tile")
    flags = placed.groupBy("image", "det_no").agg(
        F.max("hit").alias("hit"),
        F.max(~F.col("hit") & ~inside).alias("outside"),
        F.collect_list(F.when(~F.col("hit") & inside, F.col("by_no"))).alias("by"),
    )
    grouped = tiles.join(flags, ["image", "det_no"], "left").groupBy("image", "tile")
    fields = {f.name: f for f in tiles.schema.fields}
    schema = StructType([fields["image"], fields["det_no"], StructField("kept", BooleanType())])
    return grouped.applyInPandas(_walk, schema)


def _walk(tile: pd.DataFrame) -> pd.DataFrame:
    """Boxes of a tile from the best to the worst; those that depend on an undecided box stay undecided."""
    state: dict = {}
    tile = tile.sort_values(["score", "det_no"], ascending=[False, True])
    for number, hit, outside, by in zip(tile["det_no"], tile["hit"].eq(True), tile["outside"].eq(True), tile["by"]):
        above = [state[b] for b in by] if by is not None else []
        if hit or True in above:
            state[number] = False
        else:
            state[number] = None if outside or None in above else True
    kept = tile["det_no"].map(state)
    return pd.DataFrame({"image": tile["image"], "det_no": tile["det_no"], "kept": kept})[kept.notna()]
