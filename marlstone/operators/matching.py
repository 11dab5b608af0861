"""Greedy one-to-one matching of detections to truths, as folds over arrays.

Candidates are the overlapping pairs of a key (image, or image and class). Each detection carries its candidates in order of
preference; detections are folded in order of score. A group is one image, whose size the data model bounds, so that the
fold's state stays small; images spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import coco
from marlstone.operators.joins import pairs_in

_EDGES = "CAST(array() AS array<struct<det_id:bigint,ann_id:bigint,iou:double>>)"


def candidates(det: DataFrame, truth: DataFrame, on: list[str], carry: list[str] | None = None) -> DataFrame:
    """Overlapping pairs: the key, det_id, score, ann_id, iou."""
    pairs = pairs_in(det, truth, on).withColumn("iou", g.iou(g.box("l_"), g.box("r_"))).where("iou > 0")
    return pairs.select(*on, *[F.col("l_" + c).alias(c) for c in carry or []], F.col("l_det_id").alias("det_id"), F.col("l_score").alias("score"), F.col("r_ann_id").alias("ann_id"), "iou")


def greedy(pairs: DataFrame, group: list[str], threshold: float, *, last_of_equal: bool = False) -> DataFrame:
    """Edges of a greedy matching: the group, det_id, ann_id, iou.

    Detections go by (score desc, det_id). Each looks at its free candidates by IoU, of equal ones the first truth (or
    the last, with ``last_of_equal``); the best is taken if its IoU reaches ``threshold``. A truth is free until taken.
    """
    tie = -F.col("ann_id") if last_of_equal else F.col("ann_id")
    # a candidate under the threshold is never taken, nor is one behind it in its detection's order, so only the others are grouped
    option = F.struct((-F.col("score")).alias("s"), "det_id", (-F.col("iou")).alias("o"), tie.alias("t"), "ann_id", "iou")
    rows = pairs.where(F.col("iou") >= threshold).groupBy(*group).agg(F.sort_array(F.collect_list(option)).alias("options"))

    def step(edges: Column, o: Column) -> Column:
        edge = F.struct(o["det_id"].alias("det_id"), o["ann_id"].alias("ann_id"), o["iou"].alias("iou"))
        return F.when(F.exists(edges, lambda e: (e["det_id"] == o["det_id"]) | (e["ann_id"] == o["ann_id"])), edges).otherwise(F.concat(edges, F.array(edge)))

    one = F.transform("options", lambda o: F.struct(o["det_id"].alias("det_id"), o["ann_id"].alias("ann_id"), o["iou"].alias("iou")))
    edges = F.when(F.size("options") == 1, one).otherwise(F.aggregate("options", F.expr(_EDGES), step))
    return rows.select(*group, F.explode(edges).alias("e")).select(*group, "e.det_id", "e.ann_id", "e.iou")


def greedy_pairs(pairs: DataFrame, group: list[str], threshold: float, left: str = "det_id", right: str = "ann_id") -> DataFrame:
    """Global greedy matching by (IoU desc, left, right): a pair is taken if both its ends are free."""
    rows = pairs.where(F.col("iou") >= threshold).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("o"), F.col(left).alias("det_id"), F.col(right).alias("ann_id"), "iou"))).alias("pairs"))

    def step(edges: Column, p: Column) -> Column:
        edge = F.struct(p["det_id"].alias("det_id"), p["ann_id"].alias("ann_id"), p["iou"].alias("iou"))
        return F.when(F.exists(edges, lambda e: (e["det_id"] == p["det_id"]) | (e["ann_id"] == p["ann_id"])), edges).otherwise(F.concat(edges, F.array(edge)))

    out = rows.select(*group, F.explode(F.aggregate("pairs", F.expr(_EDGES), step)).alias("e"))
    return out.select(*group, F.col("e.det_id").alias(left), F.col("e.ann_id").alias(right), "e.iou")


def outcomes(det: DataFrame, truth: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """tp, fp and fn by ``group``; groups of either side are there."""
    d = det.join(edges.select("det_id", F.lit(1).alias("hit")), "det_id", "left").groupBy(*group).agg(F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fp"))
    t = truth.join(edges.select("ann_id", F.lit(1).alias("hit")), "ann_id", "left").groupBy(*group).agg(F.count_if(F.col("hit").isNull()).alias("fn"))
    return d.join(t, group, "full").na.fill(0, ["tp", "fp", "fn"])


def error_types(det: DataFrame, truth: DataFrame, edges: DataFrame, *, localised: float = 0.1) -> DataFrame:
    """det_id, error for each unmatched detection: empty_gt, duplicate, localization, semantic or background.

    empty_gt: its image has no truth; duplicate: it reaches 0.5 with a truth of its class; localization: ``localised``
    with one of its class; semantic: ``localised`` with one of another class.
    """
    wrong = det.join(edges, "det_id", "left_anti")
    pairs = pairs_in(wrong, truth, ["image_id"]).withColumn("iou", g.iou(g.box("l_"), g.box("r_")))
    same = F.col("l_cls") == F.col("r_cls")
    best = pairs.groupBy(F.col("l_det_id").alias("det_id")).agg(F.max(F.when(same, F.col("iou"))).alias("own"), F.max(F.when(~same, F.col("iou"))).alias("other"))
    return wrong.select("det_id").join(best.withColumn("known", F.lit(True)), "det_id", "left").select(
        "det_id",
        F.when(F.col("known").isNull(), "empty_gt").when(F.col("own") >= 0.5, "duplicate").when(F.col("own") >= localised, "localization").when(F.col("other") >= localised, "semantic").otherwise("background").alias("error"),
    )


def sweep(det: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score: threshold, tp, fp, n_truth.

    Detections are matched in order of score, so the matches over a threshold are those of a run with only the detections
    over it: one matching serves all thresholds, and cumulative counts do the rest.
    """
    from marlstone.operators.aggregates import running_sums

    marked = det.join(edges.select("det_id", F.lit(1).alias("hit")), "det_id", "left")
    by_score = marked.groupBy("score").agg(F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fp")).withColumn("__order", -F.col("score"))
    summed = running_sums(by_score, {"tp": "__tp", "fp": "__fp"}, ["__order"], [])
    n = truth.agg(F.count("*").alias("n_truth"))
    return summed.crossJoin(F.broadcast(n)).select(F.col("score").alias("threshold"), (F.col("__tp") + F.col("tp")).alias("tp"), (F.col("__fp") + F.col("fp")).alias("fp"), "n_truth")


def _unmatched(first: int, second: int, threshold: float):
    def unmatched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The images of a batch go side by side."""
        for batch in batches:
            boxes = batch.column("boxes")
            flat = boxes.flatten()
            column = lambda c, null: pc.fill_null(flat.field(c), null).to_numpy(zero_copy_only=False)
            image = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False))
            is_truth, arm, ids, score = np.asarray(pc.is_null(flat.field("arm"))), column("arm", 0), column("id", 0), column("score", np.inf)
            xywh = np.stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xywh"], axis=1)
            code = pc.fill_null(flat.field("cls").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            # nothing is alike in a class or an image that isn't known
            known = (code >= 0) & ~np.asarray(pc.is_null(batch.column("image_id")))[image]
            group = image * (code.max(initial=0) + 2) + code + 1
            truth, det = np.flatnonzero(is_truth & known), np.flatnonzero(~is_truth & ((arm == first) | (arm == second)))
            truth = truth[np.lexsort((-ids[truth], group[truth]))]  # the last of equals is taken, which is the first by id
            det = det[np.lexsort((ids[det], -score[det], arm[det], group[det]))]
            if not len(det):
                continue

            def met(of: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                begin, end = (np.searchsorted(group[others], group[of], side) for side in ("left", "right"))
                return begin, np.where(known[of], end - begin, 0)

            run = np.cumsum(np.r_[True, (group[det][1:] != group[det][:-1]) | (arm[det][1:] != arm[det][:-1])]) - 1
            hit, _ = coco.matched(xywh[det], run, xywh[truth], np.zeros(len(truth), bool), *met(det, truth), [threshold], [(-np.inf, np.inf)])
            wrong = det[hit[0] == 0]
            left, right = (wrong[(arm[wrong] == a) & known[wrong]] for a in (first, second))
            l, r, overlap = coco.near(xywh[left], xywh[right], np.zeros(len(right), bool), *met(left, right), threshold)
            l, r = left[l], right[r]
            order = np.lexsort((ids[r], ids[l], -overlap, group[l]))
            l, r = l[order], r[order]
            step = np.arange(len(l)) - coco.starts(group[l])
            order, begin, paired = np.argsort(step, kind="stable"), 0, np.zeros(len(ids), bool)
            for end in np.cumsum(np.bincount(step)).tolist():  # the k-th pairs of all images and classes
                a, b = l[order[begin:end]], r[order[begin:end]]
                free = ~paired[a] & ~paired[b]
                paired[a[free]] = paired[b[free]] = True
                begin = end
            outcome = np.where(paired[wrong], 0, 2) + (arm[wrong] != first)
            own = [flat.field(c).take(pa.array(wrong)) for c in ("arm", "id", "cls")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(["shared_fp", "second_of_shared", "fixed_fp", "new_fp"]).take(pa.array(outcome))], ["arm", "det_id", "cls", "outcome"])

    return unmatched


def false_positive_outcomes(scenes: DataFrame, first: int, second: int, threshold: float) -> DataFrame:
    """arm, det_id, cls, outcome of two arms' unmatched detections.

    ``scenes`` has a row for each image, with its ``boxes``: structs of arm (null for a truth), id, cls, x, y, w, h, score. Each arm's
    detections are matched to truths of their class as by ``greedy``. The unmatched ones of one image and class are paired greedily by
    overlap, as by ``greedy_pairs``: shared_fp and second_of_shared are the two of a pair, fixed_fp is the first arm's alone,
    new_fp the second's. All of it is done where the image lies.
    """
    box = scenes.schema["boxes"].dataType.elementType
    return scenes.select("image_id", "boxes").mapInArrow(_unmatched(first, second, threshold), f"arm {box['arm'].dataType.simpleString()}, det_id {box['id'].dataType.simpleString()}, cls string, outcome string")
