"""Joins: regions, pairing, hashes, containers, components, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import assign, allocate, graph, joins
from marlstone.plans.fixtures import PRIMARY, annotations, detections, images, sql, table, vectors
from marlstone.plans.registry import query

_INTER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
BASE, GUARD, COSINE = 18, 22, 0.35

#: Hashes and edges for the oracle.
VEC = r"""
hh AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS vec, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END::HUGEINT)), lambda s, x: s * 2 + x) AS hash FROM embeddings),
edge AS (
  SELECT a.item_id AS a, b.item_id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS hamming, list_cosine_similarity(a.vec, b.vec) AS cosine FROM hh a JOIN hh b ON a.item_id < b.item_id),
good AS (SELECT a, b, hamming, cosine FROM edge WHERE hamming <= 18 OR hamming <= 22 AND cosine >= 0.35)"""


@query(sql("SELECT o_orderkey AS image_id, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"))
def dimension_lookup(spark, sf_dir):
    """Equi lookup; the planner picks the build side by its size."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("image_id"), "c_mktsegment")


@query(sql(f"""
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE {_INTER} > 0 AND {_INTER} / (a.w * a.h + b.w * b.h - {_INTER}) > 0.05) AS n_over FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.cls = 'head' AND b.cls = 'helmet'"""))
def cross_class_pairs(spark, sf_dir):
    """All head-helmet pairs of an image, and those over (not at) an IoU."""
    ann = annotations(spark, sf_dir)
    return joins.pair_counts(ann.where("cls = 'head'"), ann.where("cls = 'helmet'"), ["image_id"], 0.05)


@query("""
WITH n AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) AS key, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part),
a AS (SELECT key, string_agg(DISTINCT name, ',' ORDER BY name) AS in_train FROM n WHERE p_partkey % 3 <> 0 GROUP BY key), b AS (SELECT key, string_agg(DISTINCT name, ',' ORDER BY name) AS in_test FROM n WHERE p_partkey % 3 = 0 GROUP BY key)
SELECT key, in_train, in_test FROM a JOIN b USING (key)""")
def leaked_names(spark, sf_dir):
    """Names on both sides whatever their spelling, with all spellings."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    out = joins.leakage(n.where("p_partkey % 3 <> 0"), n.where("p_partkey % 3 = 0"), "name")
    return out.select("key", F.array_join("in_train", ",").alias("in_train"), F.array_join("in_test", ",").alias("in_test"))


@query(sql("SELECT image_id FROM image ANTI JOIN (SELECT image_id FROM ann WHERE cls IN ('helmet', 'head')) a USING (image_id)"))
def negative_images(spark, sf_dir):
    return joins.negative_images(images(spark, sf_dir), annotations(spark, sf_dir), PRIMARY).select("image_id")


@query(sql("""
, neg AS (SELECT image_id FROM image ANTI JOIN (SELECT image_id FROM ann WHERE cls IN ('helmet', 'head')) a USING (image_id))
SELECT v.arm, (SELECT count(*) FROM neg) AS n_images, count(det_id) AS n_false, round(count(det_id) / (SELECT count(*) FROM neg), 6) AS rate
FROM (VALUES (0), (1)) v(arm) LEFT JOIN (SELECT arm, det_id FROM det SEMI JOIN neg USING (image_id) WHERE score >= 0.5 AND cls <> 'person') d USING (arm) GROUP BY v.arm"""))
def negative_rates(spark, sf_dir):
    """False positives of each arm on images without truth; arms without any are there."""
    neg = joins.negative_images(images(spark, sf_dir), annotations(spark, sf_dir), PRIMARY)
    d = detections(spark, sf_dir).where("score >= 0.5 and cls <> 'person'").join(neg, "image_id", "left_semi").groupBy("arm").agg(F.count("*").alias("n_false"))
    arms = spark.createDataFrame([(0,), (1,)], "arm int")
    n = neg.agg(F.count("*").alias("n_images"))
    return arms.join(d, "arm", "left").na.fill(0).crossJoin(F.broadcast(n)).select("arm", "n_images", "n_false", F.round(F.col("n_false") / F.col("n_images"), 6).alias("rate"))


@query(sql("""
SELECT det_id FROM det d WHERE arm = 0 AND EXISTS (SELECT 1 FROM ann r WHERE r.image_id = d.image_id AND r.cls = 'person' AND d.x + d.w / 2 BETWEEN r.x AND r.x + r.w AND d.y + d.h / 2 BETWEEN r.y AND r.y + r.h)"""))
def detections_in_regions(spark, sf_dir):
    """Detections in any region, each once."""
    regions = annotations(spark, sf_dir).where("cls = 'person'").select("image_id", "x", "y", "w", "h")
    return joins.in_any_region(detections(spark, sf_dir).where("arm = 0"), regions, ["image_id"]).select("det_id")


@query(sql("""
, h AS (SELECT * FROM det WHERE arm = 0 AND cls = 'head'), t AS (SELECT * FROM det WHERE arm = 0 AND cls = 'helmet')
SELECT h.det_id, count(t.det_id) > 0 AS compliant FROM h LEFT JOIN t ON h.image_id = t.image_id AND abs((t.x + t.w / 2 - (h.x + h.w / 2)) / h.w) <= 0.6 AND (t.y + t.h / 2 - (h.y + h.h / 2)) / h.h BETWEEN -1 AND 0.4 AND t.w / h.w BETWEEN 0.4 AND 2.5 GROUP BY h.det_id"""))
def geometric_pairing(spark, sf_dir):
    """A head complies if some helmet of its image is worn on it."""
    det = detections(spark, sf_dir).where("arm = 0").drop("arm")
    return joins.paired_heads(det.where("cls = 'head'"), det.where("cls = 'helmet'"), ["image_id"]).select("det_id", "compliant")


@query(f"WITH {VEC.strip()} SELECT a, b, hamming FROM edge WHERE hamming <= 18")
def hamming_pairs(spark, sf_dir):
    return joins.near_hash_pairs(vectors(spark, sf_dir), BASE)


@query(f"WITH {VEC.strip()} SELECT a, b, hamming, round(cosine, 5) AS cosine FROM good")
def guarded_pairs(spark, sf_dir):
    """Near by hash, or less near with a high cosine."""
    return joins.guarded_pairs(vectors(spark, sf_dir), BASE, GUARD, COSINE).withColumn("cosine", F.round("cosine", 5))


@query(f"""WITH RECURSIVE {VEC.strip()}, e2 AS (SELECT a, b FROM good UNION ALL SELECT b, a FROM good),
r AS (SELECT item_id AS node, item_id AS low FROM hh UNION SELECT e2.b, r.low FROM r JOIN e2 ON r.node = e2.a WHERE r.low < e2.b)
SELECT node AS item_id, min(low) AS group_id FROM r GROUP BY node""")
def near_duplicate_groups(spark, sf_dir):
    """Connected components of the guarded pairs, by their smallest item."""
    v = vectors(spark, sf_dir)
    return graph.grouped(v, joins.guarded_pairs(v, BASE, GUARD, COSINE, forest=True))


@query(f"WITH {VEC.strip()}, two AS (SELECT a AS item_id, hamming FROM edge UNION ALL SELECT b, hamming FROM edge) SELECT item_id, min(hamming) AS distance FROM two GROUP BY item_id")
def nearest_other_hash(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return joins.nearest_hash(v, v)


@query(sql(f"""
, p AS (SELECT a.ann_id, b.ann_id AS person_id, {_INTER} / (a.w * a.h) AS cover, a.w / b.w AS width_ratio, a.h / b.h AS height_ratio FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.cls <> 'person' AND b.cls = 'person' WHERE {_INTER} / (a.w * a.h) >= 0.7)
SELECT ann_id, person_id, cover, width_ratio, height_ratio FROM p QUALIFY row_number() OVER (PARTITION BY ann_id ORDER BY cover DESC, person_id) = 1"""))
def best_containers(spark, sf_dir):
    """The person that covers most of a helmet or head."""
    ann = annotations(spark, sf_dir)
    return joins.best_container(ann.where("cls <> 'person'"), ann.where("cls = 'person'"), ["image_id"])


@query(sql(f"""
SELECT a.ann_id, coalesce(max(CASE WHEN b.w > 0 THEN {_INTER} / greatest(least(a.w * a.h, b.w * b.h), 1) END), 0) AS max_io_min, coalesce(max(CASE WHEN b.w > 0 THEN {_INTER} / (a.w * a.h + b.w * b.h - {_INTER}) END), 0) AS max_iou
FROM ann a LEFT JOIN ann b ON a.image_id = b.image_id AND a.cls = b.cls AND a.ann_id <> b.ann_id GROUP BY a.ann_id"""))
def same_class_overlap(spark, sf_dir):
    return joins.same_class_overlap(annotations(spark, sf_dir), ["image_id", "cls"])


@query(sql("SELECT d.det_id, d.score, a.cls, i.scenario, c.c_mktsegment FROM det d JOIN ann a ON d.det_id // 2 = a.ann_id JOIN image i ON a.image_id = i.image_id JOIN orders o ON o.o_orderkey = i.image_id JOIN customer c ON c.c_custkey = o.o_custkey WHERE d.arm = 1"))
def provenance(spark, sf_dir):
    """Four-way enrichment by keys."""
    d = detections(spark, sf_dir).where("arm = 1").select("det_id", "score", F.expr("det_id div 2").alias("ann_id"))
    ann = annotations(spark, sf_dir).select("ann_id", "image_id", "cls")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return d.join(ann, "ann_id").join(images(spark, sf_dir).select("image_id", "scenario"), "image_id").join(o, "image_id").join(c, "o_custkey").select("det_id", "score", "cls", "scenario", "c_mktsegment")


@query(sql("""
, j AS (SELECT p.image_id, p.ann_id AS person_id, h.w / p.w AS w_ratio, h.h / p.h AS h_ratio FROM ann p JOIN ann h ON p.image_id = h.image_id AND p.cls = 'person' AND h.cls = 'helmet'),
k AS (SELECT person_id, any_value(w_ratio) AS w_ratio, any_value(h_ratio) AS h_ratio FROM j GROUP BY person_id HAVING count(*) = 1)
SELECT count(*) AS n, round(median(w_ratio), 6) AS w_ratio, round(median(h_ratio), 6) AS h_ratio FROM k"""))
def single_pair_medians(spark, sf_dir):
    """Ratios of persons with exactly one helmet."""
    ann = annotations(spark, sf_dir)
    pairs = joins.pairs_in(ann.where("cls = 'person'"), ann.where("cls = 'helmet'"), ["image_id"])
    one = pairs.groupBy("l_ann_id").agg(F.count("*").alias("k"), F.first(F.col("r_w") / F.col("l_w")).alias("w_ratio"), F.first(F.col("r_h") / F.col("l_h")).alias("h_ratio")).where("k = 1")
    return one.agg(F.count("*").alias("n"), F.round(F.percentile("w_ratio", 0.5), 6).alias("w_ratio"), F.round(F.percentile("h_ratio", 0.5), 6).alias("h_ratio"))


@query()
def frozen_split(spark, sf_dir):
    """Whole near-duplicate groups allotted to train, val and test; every item once. Held against a plain loop in tests."""
    v = vectors(spark, sf_dir)
    groups = graph.grouped(v, joins.guarded_pairs(v, BASE, GUARD, COSINE, forest=True))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    splits = allocate.allocate(sizes, {"train": 0.7, "val": 0.15, "test": 0.15})
    return groups.join(splits.select("group_id", "split"), "group_id").select("item_id", "group_id", "split")


@query()
def matched_controls(spark, sf_dir):
    """For each head of arm 1 the nearest free truth of its scenario and class by log size."""
    ann = annotations(spark, sf_dir).where("cls = 'head'").join(images(spark, sf_dir), "image_id").select("scenario", "cls", F.col("ann_id").alias("id"), "w", "h", F.pmod(F.xxhash64("image_id"), F.lit(64)).alias("fold"))
    return allocate.refilled_nearest(ann.where("id % 3 = 0"), ann.where("id % 3 <> 0"), ["scenario", "cls", "fold"])


@query()
def bank_assignment(spark, sf_dir):
    """Boxes of even images get one of odd images of about their size, each used twice at most and never within a group of images; tests hold it against a loop."""
    ann = annotations(spark, sf_dir).withColumn("apart", F.col("image_id") % 97)
    targets = ann.where("image_id % 2 = 0").withColumnRenamed("ann_id", "target_id")
    items = ann.where("image_id % 2 = 1").withColumnRenamed("ann_id", "item_id")
    return assign.assigned(targets, items, 2)
