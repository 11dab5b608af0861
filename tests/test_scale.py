"""Plans and steps that must not grow faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import rle
from marlstone.operators import bootstrap, coco, matching, rules
from marlstone.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().toString()


class Seen(Exception):
    pass


def test_resample_counts_are_never_broadcast(spark, monkeypatch):
    """A row of counts has two bytes a resample: too many for one table in each task and in the driver."""

    def seen(rows, *_):
        raise Seen(plan_of(rows))

    monkeypatch.setattr(coco, "curves", seen)
    det = spark.createDataFrame([(0, 1, 1, "head", 0, 0, 9, 9, 0.5)], "arm int, det_id long, image_id long, cls string, x int, y int, w int, h int, score double")
    truth = det.select(F.col("det_id").alias("ann_id"), "image_id", "cls", *"xywh")
    with pytest.raises(Seen) as found:
        bootstrap.ap_interval(det, truth, spark.range(4).withColumnRenamed("id", "image_id"), draws=7)
    physical = str(found.value).split("== Physical Plan ==")[1]
    assert "SortMergeJoin [image_id" in physical and "BroadcastHashJoin [image_id" not in physical


def test_sensitivity_against_each_variant(spark):
    """Each variant judged by itself, missing fields included; rows don't multiply with the variants."""
    rng = random.Random(6)
    some = lambda x: None if rng.random() < 0.15 else x
    rows = []
    for image in range(150):
        own = [(j, some(rng.choice(["head", "helmet", "person"])), rng.randrange(-20, 90), rng.randrange(-20, 90), rng.randrange(0, 60), rng.randrange(0, 60), some(rng.random() < 0.8), some(rng.random()), some(rng.random()), some(rng.random() * 250)) for j in range(rng.randrange(5))]
        rows.append((image, 100, 100, own if image else None))
    df = spark.createDataFrame(rows, "image_id int, width int, height int, instances array<struct<id:int,cls:string,x:int,y:int,w:int,h:int,kept:boolean,visible:double,coverage:double,luma:double>>")
    loose = {k: v / 2 if k.split(".")[1].startswith("min") or k.startswith("luma") else v * 1.5 for k, v in rules.DEFAULTS.items()}
    found = rules.sensitivity(df, loose, (0.3, 2.5))
    got = {(r.path, r.factor): (r.n, r.n_passed) for r in found.collect()}
    variants = rules.variants(loose, (0.3, 2.5))
    assert len(got) == len(variants) == 29 and len(set(got.values())) > 5
    for path, factor in [("baseline", 1.0), *[(p, f) for p in sorted(loose)[::3] for f in (0.3, 2.5)]]:
        own = loose | ({path: loose[path] * factor} if path in loose else {})
        assert got[path, factor] == (150, rules.judged(df, rules.literal_thresholds(own)).where("passed").count()), (path, factor)
    assert plan_of(found).split("== Physical Plan ==")[1].index("Generate inline") < plan_of(found).split("== Physical Plan ==")[1].index("HashAggregate")
    assert rules.sensitivity(df.limit(0)).collect() == []


def test_mask_counts_are_made_once(spark):
    """The function of one number names no other counts, which would be made anew for each number."""
    df = spark.createDataFrame([("0110",)], "m string").select(rle.encode(rle.from_pixels(F.col("m"))).alias("code"))
    assert "get(" not in plan_of(df).split("== Analyzed Logical Plan ==")[1].split("==")[0]
    long = [0, 5, 2**33, 1, 2**20, 700, 3]
    row = spark.range(1).select(rle.decode(rle.encode(F.array(*[F.lit(x).cast("long") for x in long]))).alias("c")).first()
    assert row.c == long


def test_pairs_of_blocks_shuffle_blocks(spark, monkeypatch):
    """Blocks of any number give the pairs of a plain loop, and a forest connects what they connect."""
    import numpy as np

    from marlstone.operators import graph, joins

    rng = np.random.default_rng(2)
    monkeypatch.setattr(joins, "TILE", 16)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 40)
    monkeypatch.setattr(joins, "HASH_ROWS", 40)
    vec = rng.normal(size=(150, 64))
    bits = vec >= 0
    packed = [int(np.packbits(b, bitorder="little").view("<i8")[0]) for b in bits]
    items = spark.createDataFrame([(i * 3, h, v.tolist()) for i, (h, v) in enumerate(zip(packed, vec))] + [(1, None, None)], "item_id long, hash long, vec array<double>")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    cos, ham = unit @ unit.T, (bits[:, None] != bits[None]).sum(axis=2)
    upper = [(i, j) for i in range(150) for j in range(i + 1, 150)]
    found = joins.cosine_pairs(items, 0.2)
    assert "Join Inner" not in plan_of(found).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert {(r.a, r.b) for r in found.collect()} == {(3 * i, 3 * j) for i, j in upper if cos[i, j] >= 0.2}
    assert {(r.a, r.b, r.hamming) for r in joins.near_hash_pairs(items, 26).collect()} == {(3 * i, 3 * j, ham[i, j]) for i, j in upper if ham[i, j] <= 26}
    want = {(3 * i, 3 * j) for i, j in upper if ham[i, j] <= 20 or ham[i, j] <= 24 and cos[i, j] >= 0.35}
    whole = joins.guarded_pairs(items, 20, 24, 0.35)
    assert {(r.a, r.b) for r in whole.collect()} == want and want
    few = joins.guarded_pairs(items, 20, 24, 0.35, forest=True)
    labels = lambda edges: {tuple(r) for r in graph.grouped(items, edges).collect()}
    assert labels(few) == labels(whole)
    least = {r.item_id: r.distance for r in joins.nearest_hash(items, items).collect()}
    assert least == {3 * i: min(ham[i, j] for j in range(150) if j != i) for i in range(150)}


def test_greedy_groups_only_what_can_be_taken(spark):
    """Candidates under the threshold don't reach the groups."""
    from marlstone.operators import matching

    rows = spark.createDataFrame([(1, 10, 0.9, 5, 0.49), (1, 10, 0.9, 6, 0.6), (1, 11, 0.8, 6, 0.9), (1, 11, 0.8, 7, 0.5), (2, 12, 0.1, 8, 0.3)], "image_id long, det_id long, score double, ann_id long, iou double")
    out = matching.greedy(rows, ["image_id"], 0.5)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 10, 6, 0.6), (1, 11, 7, 0.5)]
    assert plan_of(out).split("== Optimized Logical Plan ==")[1].split("==")[0].count("collect_list") == 1


def test_flags_stand_in_one_row_a_detection(spark):
    """A detection is one row whatever the ranges, and groups that span Arrow batches match as in a plain loop."""
    rng = random.Random(9)
    box = lambda: (rng.randrange(30), rng.randrange(30), rng.randrange(8, 40), rng.randrange(8, 40))
    dets = [(rng.choice([0, 1, None]), n, rng.randrange(4), rng.choice(["a", "b", None]), *box(), rng.randrange(5) / 4) for n in range(400)]
    dets += [(0, 1000 + n, 9, "a", 0, 0, 20, 20, 1.0 - n / 1000) for n in range(130)]
    truths = [(n, rng.randrange(4), rng.choice(["a", "b", None]), *box(), rng.choice([True, False, False, None])) for n in range(60)] + [(n, 9, "a", 0, 0, 20, 20, False) for n in (100, 101)]
    det = spark.createDataFrame(dets, "arm int, det_id long, image_id int, cls string, x int, y int, w int, h int, score double")
    truth = spark.createDataFrame(truths, "ann_id long, image_id int, cls string, x int, y int, w int, h int, crowd boolean")
    ranges, thresholds = [("all", 0, 10**8), ("small", 0, 400)], (0.3, 0.5, 0.7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = coco.flagged(det, truth, "arm", thresholds, ranges).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({r.det_id for r in got}) == 500
    found = {(r.det_id, i): (r[f"hit_{i}"], r[f"skip_{i}"]) for r in got for i in (0, 1)}
    want = {}

    def overlap(d, t, crowd):
        w, h = (min(d[i] + d[i + 2], t[i] + t[i + 2]) - max(d[i], t[i]) for i in (0, 1))
        return w * h / (d[2] * d[3] if crowd else d[2] * d[3] + t[2] * t[3] - w * h) if w > 0 and h > 0 else 0.0

    for group in {(d[0], d[2], d[3]) for d in dets}:
        own = sorted((d for d in dets if (d[0], d[2], d[3]) == group), key=lambda d: (-d[-1], d[1]))[: coco.MAX_DETS]
        near = [t for t in truths if t[1:3] == group[1:] and t[2] is not None]
        for i, (_, low, high) in enumerate(ranges):
            for bit, level in enumerate(thresholds):
                used = set()
                for d in own:
                    able = [(overlap(d[4:8], t[3:7], t[7]), t) for t in near if t[7] or t[0] not in used]
                    able = [(not (t[7] or not low <= t[5] * t[6] <= high), o, t[0]) for o, t in able if o >= level]
                    hit, _, taken = max(able, default=(False, 0, None))
                    used.add(taken)
                    skip = not hit and (taken is not None or not low <= d[6] * d[7] <= high)
                    before = want.get((d[1], i), (0, 0))
                    want[d[1], i] = (before[0] | hit << bit, before[1] | skip << bit)
    assert found == want


def test_lookup_leaves_facts_in_place(spark):
    """A small dimension goes to the facts; by its unknown size Spark would broadcast the facts, or shuffle them to a task a key."""
    from marlstone.operators import joins

    facts = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"))
    found = joins.lookup(facts, spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k")
    physical = plan_of(found).split("== Physical Plan ==")[1]
    assert "BuildRight" in physical and "BuildLeft" not in physical and "Exchange hashpartitioning(k" not in physical
    assert sorted((r.id, r.v) for r in found.collect()) == [(i, 1 + i % 2) for i in range(100)]


def test_reasons_are_judged_once(spark):
    """Counting reasons judges no record a second time, and no rule filters instances anew within its function."""
    from marlstone.plans import registry

    for name in ("measured_reason_counts", "record_filter"):
        optimized = plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001")).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert optimized.count("OUT_OF_BOUNDS") == optimized.count("ILLEGIBLE") == 1
        assert optimized.count(".kept, true)") == 1


def test_grouped_percentiles_hold_no_group(spark):
    """Percentiles come from counts of equal values, as Spark's own would, null groups and values included."""
    from marlstone.operators import aggregates as agg
    from marlstone.plans import registry

    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, *range(9)])) for _ in range(200)] + [("c", None), ("d", 4)], "g string, v int").withColumn("v", F.col("v").cast("double"))
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)
    rows = lambda out: sorted(map(str, out.collect()))
    assert rows(agg.grouped_percentiles(df, "v", ["g"], *shares)) == rows(df.groupBy("g").agg(*agg.percentiles("v", *shares)))
    assert "percentile(" not in plan_of(registry.queries()["strata_metric_percentiles"](spark, "/root/testdata/sf0.001"))


def test_shared_pixels_of_runs_made_once(spark, monkeypatch):
    """Column of edges against the overlap of two masks; a query on pairs makes no runs for a pair."""
    from marlstone.plans import registry

    rng = random.Random(5)
    texts = ["".join(rng.choice("01") for _ in range(rng.choice([0, 1, 9, 40]))) for _ in range(60)] + ["1" * 40, "0" * 40]
    df = spark.createDataFrame([(rng.choice(texts), rng.choice(texts)) for _ in range(200)], "a string, b string")
    each = df.select(*[rle.from_pixels(F.col(c)).alias(c) for c in "ab"]).select(rle.overlap(F.col("a"), F.col("b")).alias("n"), rle.edges(F.col("a")).alias("a"), rle.edges(F.col("b")).alias("b")).toArrow().combine_chunks()
    for most in (1 << 20, 7):
        monkeypatch.setattr(rle, "RUN_PAIRS", most)
        a, b = (each.column(c).combine_chunks() for c in "ab")
        assert rle.shared_pixels(a, b).tolist() == each.column("n").to_pylist()
    optimized = plan_of(registry.queries()["mask_overlaps"](spark, "/root/testdata/sf0.001")).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "aggregate(" not in optimized.split("Join Inner")[0]


def test_a_head_looks_for_its_helmets_once(spark):
    """The end of a verdict's interval is named many times and made once."""
    from marlstone.operators import compliance

    det = spark.createDataFrame([(1, 1, "head", 0.9, 0, 0, 20, 20), (1, 2, "helmet", 0.6, 0, -4, 20, 20), (1, 3, "head", 0.5, 200, 0, 20, 20)], "image_id long, det_id long, cls string, score double, x int, y int, w int, h int")
    out = compliance.judged(det, "geometric_pairing", "image_id")
    assert plan_of(out).split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0].count("= helmet)") == 1
    assert sorted((v.det_id, v.status, v.low, v.high) for v in out.first().verdicts) == [(1, "compliant", None, 0.6), (1, "non_compliant", 0.6, 0.9), (3, "non_compliant", None, 0.5)]


def test_a_helmet_looks_for_its_person_once(spark):
    """The first person is named many times and found once, and a helmet that no person touches is not judged by one, empty or not."""
    instances = [(1, "helmet", 5, 5, 0, 9), (2, "helmet", 50, 50, 10, 10), (3, "helmet", 0, 0, 10, 10), (4, "person", 8, 0, 20, 20), (5, "person", 0, 0, 20, 20), (6, "person", 60, 50, 9, 9)]
    rows = [(1, 100, 100, [(*i, None, None, None, None) for i in instances])]
    df = spark.createDataFrame(rows, "image_id int, width int, height int, instances array<struct<id:int,cls:string,x:int,y:int,w:int,h:int,kept:boolean,visible:double,coverage:double,luma:double>>")
    found = lambda own: rules.with_kept(own, "instances").select(rules.contained(F.col("__helmets"), F.col("__persons"), rules.literal_thresholds()).alias("r"))
    out = found(df)
    assert plan_of(out).split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0].count("filter(__persons") == 1
    assert out.first().r == ["NOT_CONTAINED"]
    assert found(df.withColumn("instances", F.filter("instances", lambda i: i["id"] != 3))).first().r == []


def test_rows_give_the_reasons_of_arrays(spark):
    """Records judged in rows of instances and pairs: missing fields, arrays and elements, thresholds that boxes apart break, and every bound a class may have."""
    rng = random.Random(13)
    some = lambda x: None if rng.random() < 0.1 else x
    side = lambda: some(rng.choice([0, 1, 8, 20, 30, 60]))

    def instance(j):
        place = (some(rng.randrange(-20, 70)), some(rng.randrange(-20, 70)), side(), side())
        measured = (some(rng.choice(["pasted", "existing", "hard_negative"])), some(rng.random() < 0.8), some(rng.random() < 0.1), some(rng.random() < 0.5), some(rng.random() / 2), some(rng.random() * 7), some(rng.random() / 15))
        return (some(rng.choice([j, j, 9 - j])), some(rng.choice(["head", "helmet", "person", "person", "dog"])), *place, some(rng.random() < 0.9), some(rng.random()), some(rng.random()), some(rng.random() * 250), *measured)

    arrays = [None, [], [None], *[[some(instance(j)) for j in range(rng.randrange(1, 7))] for _ in range(400)]]
    rows = [(n, n % 7, 100, some(90), own) for n, own in enumerate(arrays)]
    fields = "id:int,cls:string,x:int,y:int,w:int,h:int,kept:boolean,visible:double,coverage:double,luma:double"
    df = spark.createDataFrame(rows, f"n int, k int, width int, height int, instances array<struct<{fields},kind:string,mask_ok:boolean,retries_exhausted:boolean,behind:boolean,poke:double,seam:double,annotation_iou:double>>").repartition(3)
    plain = df.withColumn("instances", F.transform("instances", lambda i: i.dropFields(*rules.MEASURED_FIELDS)))
    loose = rules.literal_thresholds({k: v / 2 if k.split(".")[1].startswith("min") or k.startswith("luma") else v * 1.3 for k, v in rules.DEFAULTS.items()})
    below = rules.literal_thresholds({"overlap.max_iou": -0.5})
    odd = {"containment": 0.0, "over_person": {"head": (0.02, 0.4), "person": (1.5, 2.0)}}
    rows_of = lambda out: {(r.n, r.k): (r.reject_reasons, r.first_reason, r.passed) for r in out.collect()}
    found = set()
    for data, t, measured in ((plain, loose, None), (df, below, None), (plain, loose, {}), (df, loose, {}), (df, below, odd)):
        arrays = rows_of(rules.judged(data, t) if measured is None else rules.judged_measured(data, t, measured))
        assert rows_of(rules.judged_by_key(data, ["n", "k"], t, measured)) == arrays and len(arrays) == 403
        given = [r for reasons, *_ in arrays.values() for r in reasons or []]
        found |= set(given)
    assert {tuple(r) for r in rules.reason_counts(data, ["n", "k"], t, measured).collect()} == {(r, given.count(r)) for r in given}
    assert found == {*rules.REASONS, *rules.MEASURED_REASONS}
    assert rules.reason_counts(df.limit(0), ["n"]).collect() == []


def test_records_are_spread_once_and_judged_in_rows(spark):
    """Annotations reach their image's group by one exchange, and the only function over an array asks for an earlier person, of pairs that would be rejected."""
    from marlstone.plans import registry

    for name, earlier in (("measured_reason_counts", 2), ("measured_record_filter", 2), ("record_filter", 1)):
        parts = plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001")).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")
        assert parts[0].count("exists(") == earlier and "transform(" not in parts[0]
        assert parts[1].count("Exchange hashpartitioning") == 1, parts[1]


def test_false_positives_of_images_in_one_exchange(spark):
    """As matching by arms and joins have it, with ties, unknown classes, scores, images and boxes; the tables are spread once."""
    rng = random.Random(12)
    some = lambda x, p=0.03: None if rng.random() < p else x
    scenes = []
    for image in range(400):
        boxes = []
        for j in range(rng.randrange(16)):
            arm = rng.choice([None, 0, 1, 1, 2])
            boxes.append((arm, len(scenes) * 100 + j, some(rng.choice(["head", "helmet"])), some(rng.randrange(4) * 4), rng.randrange(3) * 4, rng.choice([8, 12]), rng.choice([8, 12]), None if arm is None else some(rng.randrange(4) / 4)))
        scenes.append((image if image else None, boxes))
    scenes.append((400, []))
    df = spark.createDataFrame(scenes, "image_id long, boxes array<struct<arm:int,id:long,cls:string,x:int,y:int,w:int,h:int,score:double>>")
    rows = df.select("image_id", F.inline("boxes"))
    det, truth = rows.where("arm in (0, 1)").withColumnRenamed("id", "det_id"), rows.where("arm is null").withColumnRenamed("id", "ann_id")
    edges = matching.greedy(matching.candidates(det, truth, ["image_id", "cls"], ["arm"]), ["arm", "image_id", "cls"], 0.5)
    wrong = det.join(edges.select("arm", "det_id"), ["arm", "det_id"], "left_anti")
    pairs = matching.greedy_pairs(matching.candidates(wrong.where("arm = 0"), wrong.where("arm = 1").withColumnRenamed("det_id", "ann_id"), ["image_id", "cls"]), ["image_id"], 0.5).collect()
    ends = {(0, p.det_id) for p in pairs} | {(1, p.ann_id) for p in pairs}
    name = {(0, True): "shared_fp", (1, True): "second_of_shared", (0, False): "fixed_fp", (1, False): "new_fp"}
    expected = [(r.arm, r.det_id, r.cls, name[r.arm, (r.arm, r.det_id) in ends]) for r in wrong.collect()]
    got = [tuple(r) for r in matching.false_positive_outcomes(df, 0, 1, 0.5).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(pairs) > 50 and edges.count() > 50
    assert matching.false_positive_outcomes(df.where("image_id = 400"), 0, 1, 0.5).collect() == []
    plan = plan_of(registry.queries()["false_positive_difference"](spark, "/root/testdata/sf0.001")).split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning(image_id") == 1 and "Join" not in plan
