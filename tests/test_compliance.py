"""Verdict modes and the sweep over thresholds against a loop that recomputes each threshold."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import compliance


def iou(d, t):
    w, h = min(d[0] + d[2], t[0] + t[2]) - max(d[0], t[0]), min(d[1] + d[3], t[1] + t[3]) - max(d[1], t[1])
    return w * h / (d[2] * d[3] + t[2] * t[3] - w * h) if w > 0 and h > 0 else 0.0


def worn(h, t):
    return abs((t[0] + t[2] / 2 - h[0] - h[2] / 2) / h[2]) <= 0.6 and -1 <= (t[1] + t[3] / 2 - h[1] - h[3] / 2) / h[3] <= 0.4 and 0.4 <= t[2] / h[2] <= 2.5


def recomputed(dets, truths, mode, threshold):
    """n_compliant, n_non_compliant, true_compliant, matched_bare_heads of one arm at one threshold."""
    kept, of, out = defaultdict(list), defaultdict(list), [0, 0, 0, 0]
    for i, image, cls, box, score in dets:
        if cls != "person" and score >= threshold:
            kept[image].append((i, cls, box, score))
    for a, image, cls, box in sorted(truths):
        of[image].append((cls, box))
    for image, own in kept.items():
        if mode == "class_direct":
            v = [(d, d[1] == "helmet") for d in own]
        else:
            v = [(d, any(t[1] == "helmet" and worn(d[2], t[2]) for t in own)) for d in own if d[1] == "head"]
        for k, (ok, cls) in enumerate(((True, "helmet"), (False, "head"))):
            targets, taken = [b for c, b in of[image] if c == cls], set()
            mine = sorted((d for d, o in v if o == ok), key=lambda d: (-d[3], d[1], d[2], d[0]))
            out[k] += len(mine)
            for d in mine:
                best, at = 0.5, -1
                for j, t in enumerate(targets):
                    if j not in taken and iou(d[2], t) >= best:
                        best, at = iou(d[2], t), j
                if at >= 0:
                    taken.add(at)
                    out[2 + k] += 1
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(6)
    truths, dets = [], []
    for image in range(30):
        for _ in range(rng.randrange(1, 6)):
            cls, box = rng.choice(["helmet", "head", "head", "person"]), (rng.randrange(40), rng.randrange(40), rng.randrange(10, 30), rng.randrange(10, 30))
            truths.append((len(truths), image, cls, box))
            for _ in range(rng.randrange(4)):
                dets.append((rng.randrange(2), len(dets), image, rng.choice([cls, "helmet", "head"]), (box[0] + rng.randrange(5), box[1] - rng.randrange(8), box[2], box[3]), rng.randrange(12) / 12))
    det = spark.createDataFrame([(a, i, m, c, *b, s) for a, i, m, c, b, s in dets], "arm int, det_id long, image_id long, cls string, x int, y int, w int, h int, score double")
    truth = spark.createDataFrame([(i, m, c, *b) for i, m, c, b in truths], "ann_id long, image_id long, cls string, x int, y int, w int, h int")
    return dets, truths, det, truth


@pytest.mark.parametrize("mode", ["class_direct", "geometric_pairing"])
@pytest.mark.parametrize("thresholds", [None, [0.0, 0.3, 0.5, 0.95, 2.0]])
def test_sweep_against_recomputing_every_threshold(case, mode, thresholds):
    dets, truths, det, truth = case
    got = compliance.sweep(det, truth, mode, split="val", thresholds=thresholds).collect()
    heads = sum(c == "head" for _, _, c, _ in truths)
    assert len(got) == sum(len({d[5] for d in dets if d[0] == a}) if thresholds is None else len(thresholds) for a in (0, 1))
    for r in got:
        want = recomputed([d[1:] for d in dets if d[0] == r.arm], truths, mode, r.threshold)
        assert [r.n_compliant, r.n_non_compliant, r.true_compliant, r.matched_bare_heads] == want
        assert r.n_bare_heads == heads and r.bare_head_recall == pytest.approx(want[3] / heads)
        assert r.compliance_precision == (pytest.approx(want[2] / want[0]) if want[0] else None)


def test_a_worn_helmet_vouches_only_over_the_threshold(spark):
    det = spark.createDataFrame([(1, 1, "head", 10, 10, 20, 20, 0.9), (2, 1, "helmet", 10, 5, 20, 12, 0.4), (3, 1, "person", 0, 0, 90, 90, 0.99)], "det_id long, image_id long, cls string, x int, y int, w int, h int, score double")
    status = lambda t: [(r.det_id, r.status) for r in compliance.at_threshold(det, "geometric_pairing", t, "image_id").collect()]
    assert status(0.4) == [(1, "compliant")] and status(0.41) == [(1, "non_compliant")] and status(0.95) == []
    assert {(r.det_id, r.status) for r in compliance.at_threshold(det, "class_direct", 0.1, "image_id").collect()} == {(1, "non_compliant"), (2, "compliant")}


def test_modes_are_pluggable_and_guards_raise(case):
    _, _, det, truth = case

    @compliance.mode("strict")
    def strict(dets):
        return F.transform(F.filter(dets, lambda d: d["cls"] == "helmet"), lambda d: compliance.verdict(d, compliance.COMPLIANT, F.lit(0.5), d["score"]))

    try:
        v = compliance.at_threshold(det, "strict", 0.4, "arm", "image_id")
        assert v.count() == 0 and compliance.at_threshold(det, "strict", 0.6, "arm", "image_id").count() == det.where("cls = 'helmet' and score >= 0.6").count()
    finally:
        del compliance.MODES["strict"]
    with pytest.raises(ValueError, match="unknown mode"):
        compliance.judged(det, "strict", "image_id")
    with pytest.raises(ValueError, match="test split"):
        compliance.sweep(det, truth, "class_direct", split=" Test ")
    with pytest.raises(ValueError, match="no truth"):
        compliance.sweep(det.withColumn("image_id", F.lit(-1).cast("long")), truth, "class_direct", split="val")
