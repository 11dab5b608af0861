"""Hand-worked cases of the detection operators."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.functions import hashing as h
from marlstone.functions import vectors as v
from marlstone.operators import aggregates as agg
from marlstone.operators import allocate, audit, bootstrap, coco, context, graph, joins, matching, rules, sampling, text_audit
from marlstone.streaming import health

BOX = "x int, y int, w int, h int"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lit(*values):
    return g.Box(*map(F.lit, values))


def test_iou_and_touching_boxes(spark):
    a = lit(0, 0, 10, 10)
    got = one(spark, g.iou(a, lit(5, 5, 10, 10)), g.iou(a, lit(10, 0, 5, 5)), g.iou(a, lit(0, 0, 0, 0)), g.io_min(a, lit(0, 0, 2, 2)), g.io_min(a, lit(0, 0, 0, 0), None))
    assert got[0] == pytest.approx(25 / 175) and got[1:] == (0.0, 0.0, 1.0, 0.0)


def test_buckets_half_open_and_closed(spark):
    ranges = [("small", 0, 1024), ("medium", 1024, 9216), ("large", 9216, 10**6)]
    values = spark.createDataFrame([(1023,), (1024,), (9216,)], "v int")
    assert [r[0] for r in values.select(g.bucket_half_open(F.col("v"), ranges)).collect()] == ["small", "medium", "large"]
    closed = agg.in_ranges(values, F.col("v")).groupBy("v").agg(F.sort_array(F.collect_list("bucket"))).orderBy("v").collect()
    assert [r[1] for r in closed] == [["all", "small"], ["all", "medium", "small"], ["all", "large", "medium"]]
    with pytest.raises(ValueError):
        g.bucket_half_open(F.col("v"), ranges[:1] + ranges[2:])


def test_hamming_and_components(spark):
    hexes = spark.createDataFrame([(0, "0" * 16), (1, "0" * 15 + "1"), (2, "f" * 16)], "item_id long, h string").select("item_id", h.hex_to_long(F.col("h")).alias("hash"))
    got = {(r.a, r.b): r.hamming for r in joins.near_hash_pairs(hexes, 64).collect()}
    assert got == {(0, 1): 1, (0, 2): 64, (1, 2): 63}
    assert {(r.a, r.b) for r in joins.near_hash_pairs(hexes, 3).collect()} == {(0, 1)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (85, 90)], "a long, b long")
    assert {r.node: r.label for r in graph.components(chain).collect()} == {**{i: 0 for i in range(41)}, 80: 80, 85: 80, 90: 80}


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_components_against_a_walk(spark, kind, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_NODES", 7)
    rng, nodes = random.Random(kind), range(90)
    name = {"long": int, "string": lambda i: f"é{i}", "binary": lambda i: bytes([i, 255 - i])}[kind]
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(45)] + [(7, 8), (7, 8), (8, 7)] + [(89, i) for i in range(50, 70)]
    near = {i: {i} | {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in nodes}
    while (grown := {i: set().union(*[near[k] for k in near[i]]) for i in nodes}) != near:
        near = grown
    met = {x for a, b in pairs if a != b for x in (a, b)}
    want = {name(i): min(map(name, near[i])) for i in met}
    rows = [(name(a), name(b)) for a, b in pairs] + [(None, name(3)), (name(3), None), (None, None)]
    got = graph.components(spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(6)).collect()
    plain = lambda x: bytes(x) if kind == "binary" else x
    assert len(got) == len(want) and {plain(r.node): plain(r.label) for r in got} == want
    assert graph.components(spark.createDataFrame([], f"a {kind}, b {kind}")).count() == 0


def test_banded_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    hashes += [x ^ (1 << rng.randrange(60)) for x in hashes]
    items = spark.createDataFrame(list(enumerate(hashes)), "item_id long, hash long")
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1") <= 5}
    assert {(r.a, r.b) for r in joins.near_hash_pairs(items, 5).collect()} == want


def plain_greedy(dets, truths, threshold):
    def iou(a, b):
        w, k = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        i = w * k if w > 0 and k > 0 else 0
        return i / (a[2] * a[3] + b[2] * b[3] - i) if i else 0.0

    used, edges = set(), set()
    for d in sorted(dets, key=lambda d: (-d[1], d[0])):
        best, at = 0.0, None
        for t in sorted(truths):
            if t[0] not in used and iou(d[2:], t[1:]) > best:
                best, at = iou(d[2:], t[1:]), t[0]
        if at is not None and best >= threshold:
            used.add(at)
            edges.add((d[0], at))
    return edges


def test_greedy_matching_against_a_loop(spark):
    rng = random.Random(4)
    box = lambda: (rng.randrange(30), rng.randrange(30), rng.randrange(5, 25), rng.randrange(5, 25))
    dets, truths = [(i, rng.randrange(5) / 4, *box()) for i in range(40)], [(i, *box()) for i in range(30)]
    d = spark.createDataFrame([(1, *x) for x in dets], f"image_id long, det_id long, score double, {BOX}")
    t = spark.createDataFrame([(1, *x) for x in truths], f"image_id long, ann_id long, {BOX}")
    got = {(r.det_id, r.ann_id) for r in matching.greedy(matching.candidates(d, t, ["image_id"]), ["image_id"], 0.3).collect()}
    assert got == plain_greedy(dets, truths, 0.3)


def test_average_precision_by_hand(spark):
    """Each case is a class: hits of its detections by score, number of truths, expected AP."""
    cases = [([1], 2, 51 / 101), ([1, 1], 3, 67 / 101), ([1], 3, 34 / 101), ([1, 1, 1], 3, 1.0), ([0, 1], 1, 0.5), ([], 2, 0.0)]
    truths, dets = [], []
    for c, (hits, n_truth, _) in enumerate(cases):
        truths += [(100 * c + i, i, f"c{c}", 0, 0, 20, 20) for i in range(n_truth)]
        n = 0
        for k, hit in enumerate(hits):
            dets.append((0, 100 * c + k, n if hit else 500, f"c{c}", 0, 0, 20, 20, 1.0 - k / 10))
            n += hit
    t = spark.createDataFrame(truths, f"ann_id long, image_id long, cls string, {BOX}")
    d = spark.createDataFrame(dets, f"arm int, det_id long, image_id long, cls string, {BOX}, score double")
    got = {(r.cls, r.bucket): r.ap for r in coco.average_precision(d, t).collect()}
    for c, (_, _, want) in enumerate(cases):
        assert got[f"c{c}", "all"] == pytest.approx(want, abs=1e-6)
        assert got[f"c{c}", "small"] == got[f"c{c}", "all"] and got[f"c{c}", "large"] == -1.0


def test_area_ranges_ignore_truths_and_detections(spark):
    t = spark.createDataFrame([(0, 0, "a", 0, 0, 20, 20), (1, 0, "a", 100, 100, 50, 50)], f"ann_id long, image_id long, cls string, {BOX}")
    d = spark.createDataFrame([(0, 0, 0, "a", 100, 100, 50, 50, 0.9), (0, 1, 0, "a", 0, 0, 20, 20, 0.8)], f"arm int, det_id long, image_id long, cls string, {BOX}, score double")
    assert {r.bucket: r.ap for r in coco.average_precision(d, t).collect()} == {"all": 1.0, "small": 1.0, "medium": 1.0, "large": -1.0}


def test_rules_keep_first_seen_order(spark):
    inst = "id long, cls string, x int, y int, w int, h int, kept boolean, visible double, coverage double, luma double"
    rows = [([(1, "head", 0, 0, 40, 40, None, 0.9, None, 100.0), (2, "head", 2, 2, 40, 40, True, 0.05, 0.01, 100.0), (3, "person", -400, 0, 10, 10, False, 0.0, 0.0, 0.0)], 416, 416), ([], 416, 416)]
    got = rules.judged(spark.createDataFrame(rows, f"instances array<struct<{inst.replace(' ', ':').replace(',:', ',')}>>, width int, height int")).collect()
    assert got[0].reject_reasons == ["LOW_VISIBILITY", "OVERLAP", "LOW_COVERAGE", "CLIPPED"] and got[0].first_reason == "LOW_VISIBILITY" and not got[0].passed
    assert got[1].reject_reasons == [] and got[1].first_reason is None and got[1].passed


def test_splits_of_equal_groups(spark):
    groups = spark.createDataFrame([(i, 10) for i in range(100)], "group_id long, size long")
    got = {r.split: r.n for r in allocate.allocate(groups, {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert got == {"train": 700, "val": 150, "test": 150}


def test_running_sums_ranks_and_tiles(spark):
    rng = random.Random(8)
    values = [(i, rng.randrange(7)) for i in range(50)]
    df = spark.createDataFrame(values, "id long, v int")
    got = {r.id: r.rank for r in sampling.global_rank(df, ["v", "id"]).collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(values, key=lambda x: (x[1], x[0])))}
    sizes = [r["count"] for r in sampling.tiles(df.limit(10), ["id"], 4).groupBy("tile").count().orderBy("tile").collect()]
    assert sizes == [3, 3, 2, 2]
    assert sampling.settled_quotas({"a": 5, "b": 3, "c": 2}, 5) == {"a": 2, "b": 2, "c": 1}
    assert sampling.settled_quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_sums_over_many_parts(spark, adaptive):
    """Wide rows, several parts, groups that span parts, null groups: branches of the plan that read other columns must agree."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 200_000
        df = spark.range(n).select("id", F.when(F.col("id") % 1000 > 0, F.col("id") % 3).alias("g"), (F.hash("id") % 5000).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("a"), F.sha2((-F.col("id")).cast("string"), 256).alias("b"))
        ranks = sampling.global_rank(df, ["a", "id"])
        assert ranks.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first() == (n, n, 1, n)
        got = agg.running_sums(df.withColumn("one", F.lit(1)), {"one": "before", "v": "total"}, ["v", "id"], ["g"])
        w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
        want = df.select("id", F.count("*").over(w).alias("wn"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("wt"))
        met = got.join(want, "id")
        assert met.count() == n and met.where("before <> wn or total <> wt").count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_auc_with_ties_and_missing_labels(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (None, 0.3)], "y int, s double")
    assert agg.roc_auc(df, "y", "s").first().auc == pytest.approx(3.5 / 4)
    assert agg.roc_auc(df.where("y = 1"), "y", "s").first().auc is None


def test_strict_lookup_and_drift(spark):
    facts, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, n string")
    with pytest.raises(ValueError, match="no k 2"):
        joins.lookup(facts, dim, "k")
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, d string"), spark.createDataFrame([(2, "z"), (3, "q")], "k int, d string")
    assert {r.k: r.state for r in audit.drift(a, b, "k", "d").collect()} == {1: "missing", 2: "changed", 3: "new"}


def test_bootstrap_interval_holds_the_value(spark):
    df = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("p"), F.lit(1).alias("w"))
    r = bootstrap.rate_interval(df, "id", "p", "w", draws=200).first()
    assert r.value == 0.25 and 0.18 < r.ci_low < 0.25 < r.ci_high < 0.32 and r.n_draws == 200 and r.n_undefined == 0


def test_vectors(spark):
    r = one(spark, v.norm(F.array(F.lit(3.0), F.lit(4.0))), v.cosine(v.normalised(F.array(F.lit(1.0), F.lit(0.0))), v.normalised(F.array(F.lit(0.0), F.lit(0.0)))))
    assert r[0] == 5.0 and r[1] == 0.0


def test_markdown_scan_skips_fences(spark):
    text = "[a](x%20y.md#top)\n```\n[b](no.md)\n```\n| k | v |\n|---|---|\n| a | 1.50 |"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r.line_no, r.target) for r in text_audit.markdown_links(df, "id", "text").collect()] == [(1, "x y.md")]
    assert [r.cells for r in text_audit.table_rows(df, "id", "text").collect()] == [["k", "v"], ["a", "1.50"]]


def test_sequential_acceptance(spark):
    items = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 7), (0, 4, 3), (1, 1, 1)], "pool int, n int, hash long")
    got = {(r.pool, r.n): r.accepted for r in health.accepted_in_order(items, "pool", "n", "hash", 1).collect()}
    assert got == {(0, 1): True, (0, 2): False, (0, 3): True, (0, 4): False, (1, 1): True}


def test_measured_rules(spark):
    kind = "id:long,cls:string,x:int,y:int,w:int,h:int,kept:boolean,visible:double,coverage:double,luma:double,kind:string,mask_ok:boolean,retries_exhausted:boolean,behind:boolean,poke:double,seam:double,annotation_iou:double"
    base = (True, 1.0, 0.5, 99.0)
    person = (1, "person", 0, 0, 100, 300, *base, "pasted", True, False, False, 0.0, 1.0, 0.0)
    head = lambda y=0, w=40, coverage=0.5, kind="pasted", ok=True, out=False, behind=False, poke=0.1, seam=1.0, iou=0.5: (2, "head", 5, y, w, 50, True, 1.0, coverage, 99.0, kind, ok, out, behind, poke, seam, iou)
    wanted = [
        (head(), []), (head(coverage=0.96), ["BAD_MASK_COVERAGE"]), (head(ok=False), ["SAM2_MASK_REJECTED"]), (head(ok=False, kind="existing"), []), (head(out=True), ["PLACEMENT_RETRIES_EXHAUSTED"]),
        (head(y=160), ["BAD_SIZE_RATIO"]), (head(w=12), ["BAD_SIZE_RATIO"]), (head(behind=True), ["POKES_THROUGH"]), (head(behind=True, poke=0.3), []), (head(seam=6.5), ["SEAM_ARTIFACT"]),
        (head(kind="hard_negative"), ["HARD_NEGATIVE_OVERLAPS_ANNOTATION"]), (head(kind="hard_negative", iou=0.02, w=12, ok=False), []), (head(coverage=None, kind=None, ok=None, out=None, behind=None, poke=None, seam=None, iou=None), []),
    ]
    df = spark.createDataFrame([(n, [person, i], 416, 416) for n, (i, _) in enumerate(wanted)], f"n int, instances array<struct<{kind}>>, width int, height int")
    assert {r.n: r.reject_reasons for r in rules.judged_measured(df).collect()} == {n: w for n, (_, w) in enumerate(wanted)}
    plain = df.withColumn("instances", F.transform("instances", lambda i: i.dropFields(*rules.MEASURED_FIELDS)))
    assert {r.n: r.reject_reasons for r in rules.judged_measured(plain).where("n in (0, 6, 9)").collect()} == {0: [], 6: ["BAD_SIZE_RATIO"], 9: []}


def test_mask_gate_and_unit_reasons(spark):
    names = ["iou_score", "object_score_logit", "outside_box_ratio", "second_component_ratio", "hole_fill_ratio", "mask_to_box_coverage", "solidity", "mask_area_px", "edge_touch_top", "edge_touch_side"]
    gate = lambda cls, *values: rules.mask_failures(F.struct(*[F.lit(x).alias(n) for n, x in zip(names, values)]), F.lit(cls))
    bad = (0.7, 17.0, 0.2, 0.3, 1.4, 0.9, 0.1, 200, 0.9, 0.9)
    got = one(spark, gate("head", 0.8, 18.0, 0.15, 0.25, 1.3, 0.85, 0.7, 300, 0.4, 0.9), gate("head", *bad), gate("person", *bad))
    assert got.c0 == [] and got.c1 == names[:-1] and got.c2 == names[:-2] + names[-1:]
    st = lambda **k: F.struct(*[F.lit(x).alias(n) for n, x in k.items()])
    good = dict(cls="person", split="train", preferred=True, truncated=False, difficult=False, x=10, y=100, w=100, h=200, touch_top=0.1, touch_side=0.1)
    worst = dict(cls="head", split="val", preferred=False, truncated=False, difficult=True, x=10, y=0, w=100, h=50, touch_top=0.2, touch_side=0.2)
    got = one(spark, rules.unit_reasons(st(**good), st(x=20, y=110, w=50, h=50), F.lit(400)), rules.unit_reasons(st(**worst), st(x=-90, y=60, w=90, h=20), F.lit(400)), rules.unit_reasons(st(**good | {"preferred": False}), st(x=20, y=110, w=50, h=50), F.lit(400), {"preferred": False}))
    assert got.c0 == [] and got.c2 == [] and got.c1 == ["NOT_PERSON", "NOT_TRAIN", "NOT_PREFERRED_TIER", "VOC_FLAGGED", "PERSON_TOO_SMALL", "SOURCE_PERSON_TOO_HIGH", "PERSON_TOO_HORIZONTAL", "HEAD_TOO_LOW", "HEAD_TOO_WIDE", "INVALID_HEAD_BOX", "MASK_TOUCHES_TOP", "MASK_TOUCHES_SIDE"]


def test_registered_interval_has_the_default_draws(spark):
    from marlstone.plans import registry

    r = registry.queries()["bootstrap_interval"](spark, "/root/testdata/sf0.001").first()
    assert r.n_draws + r.n_undefined == 1000 and r.ci_low <= r.value <= r.ci_high


def test_union_area_counts_overlaps_once(spark):
    rng = random.Random(5)
    cases = []
    for n in (0, 1, 2, 5, 9):
        found = []
        for _ in range(n):
            left, top = rng.randrange(20), rng.randrange(20)
            found.append((left, top, left + rng.randrange(1, 15), top + rng.randrange(1, 15)))
        cases.append(found + found[:1])
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<struct<l int, t int, r int, b int>>")
    want = [len({(x, y) for left, t, r, b in c for x in range(left, r) for y in range(t, b)}) for c in cases]
    assert [r[0] for r in rows.orderBy("i").select(context.union_area(F.col("c"))).collect()] == want


def test_merge_of_maps(spark):
    row = spark.sql("select map('a', map('x', '1', 'y', '2'), 'b', map('z', '3')) base, map('a', map('y', cast(null as string), 'w', '4'), 'c', map('q', '5')) over")
    got = row.select(context.deep_merge(F.col("base"), F.col("over"), 2)).first()[0]
    assert got == {"a": {"x": "1", "y": None, "w": "4"}, "b": {"z": "3"}, "c": {"q": "5"}}


def test_targeting_verdicts(spark):
    shares = spark.createDataFrame([("rain", 0.4), ("night", 0.3), ("fog", 0.3)], "scenario string, share double")
    slices = spark.createDataFrame([("night", "dark"), ("fog", "grey")], "scenario string, slice string")
    deltas = spark.createDataFrame([("up", "grey", 0.3), ("up", "dark", 0.2), ("even", "grey", 0.1), ("even", "dark", 0.1), ("down", "grey", 0.0), ("none", "dark", 0.4), ("alone", "grey", 0.1)], "metric string, slice string, delta double")
    got = {r.metric: r for r in context.targeting_verdict(shares, slices, deltas).collect()}
    assert {(r.leader, r.tested, r.target) for r in got.values()} == {("rain", "fog", "grey")}
    assert {m: r.verdict for m, r in got.items()} == {"up": "targeted", "even": "more_data_not_targeted", "down": "target_slice_did_not_improve", "none": "target_slice_unmeasurable", "alone": "targeted"}
    assert {r.verdict for r in context.targeting_verdict(shares, slices.where("scenario = 'snow'"), deltas).collect()} == {"budget_leader_has_no_slice"}


def test_surroundings_and_records(spark):
    boxes = spark.createDataFrame([(1, 1, "helmet", 10, 10, 8, 8), (2, 1, "head", 10, 18, 8, 8), (3, 2, "helmet", 10, 10, 8, 8), (4, 2, "head", 60, 18, 8, 8)], "ann_id long, image_id long, cls string, " + BOX)
    assert {r.ann_id: r.below for r in context.something_below(boxes.where("cls = 'helmet'"), boxes, "image_id", "ann_id").collect()} == {1: True, 3: False}
    a = spark.createDataFrame([(1, 1, None), (2, 1, 2), (3, 1, 1)], "k long, n long, m long")
    b = spark.createDataFrame([(1, 1, None), (2, 2, None), (4, 1, 1)], "k long, n long, m long")
    assert {r.k: r.status for r in context.record_consistency(a, b, "k", ["n", "m"]).collect()} == {1: "equal", 2: "n,m", 3: "not_derived", 4: "not_recorded"}
    with pytest.raises(ValueError):
        context.statistic("mode", "v")
