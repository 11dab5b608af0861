"""Differences of two arms, self-evaluation, required metrics, clips, manifests with groups, invariants of a record."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.hashing import hash_fold
from marlstone.operators import aggregates as agg
from marlstone.operators import audit, coco, graph, joins, matching, rules
from marlstone.operators.sampling import first_in_group
from marlstone.plans.fixtures import annotations, detections, scenes, sql, table, vectors
from marlstone.plans.join_queries import BASE, COSINE, GUARD, VEC
from marlstone.plans.matching_queries import _I, greedy_sql, recursive
from marlstone.plans.registry import query
from marlstone.plans.rule_queries import records


@query(recursive(greedy_sql(arm="0, 1") + f"""
, wrong AS (SELECT d.* FROM det d LEFT JOIN m ON m.arm = d.arm AND m.det_id = d.det_id WHERE m.det_id IS NULL),
pc AS (SELECT d.image_id, d.det_id AS l, a.det_id AS r, {_I} / (d.w * d.h + a.w * a.h - {_I}) AS iou FROM wrong d JOIN wrong a ON d.image_id = a.image_id AND d.cls = a.cls AND d.arm = 0 AND a.arm = 1 AND {_I} > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, l, r) AS k FROM pc WHERE iou >= 0.5),
pf AS (
  SELECT image_id, 0::BIGINT AS k, []::BIGINT[] AS ul, []::BIGINT[] AS ur, NULL::BIGINT AS l, NULL::BIGINT AS r FROM (SELECT DISTINCT image_id FROM c)
  UNION ALL
  SELECT f.image_id, c.k, CASE WHEN ok THEN list_append(f.ul, c.l) ELSE f.ul END, CASE WHEN ok THEN list_append(f.ur, c.r) ELSE f.ur END, CASE WHEN ok THEN c.l END, CASE WHEN ok THEN c.r END
  FROM pf f JOIN c ON f.image_id = c.image_id AND c.k = f.k + 1, LATERAL (SELECT NOT list_contains(f.ul, c.l) AND NOT list_contains(f.ur, c.r) AS ok)),
p AS (SELECT l, r FROM pf WHERE l IS NOT NULL)
SELECT cls, CASE WHEN arm = 0 AND det_id IN (SELECT l FROM p) THEN 'shared_fp' WHEN arm = 1 AND det_id IN (SELECT r FROM p) THEN 'second_of_shared' WHEN arm = 0 THEN 'fixed_fp' ELSE 'new_fp' END AS outcome, count(*) AS n FROM wrong GROUP BY ALL"""))
def false_positive_difference(spark, sf_dir):
    """False positives of two arms, paired by overlap: shared ones, those that the second arm mended and those that it made."""
    return matching.false_positive_outcomes(scenes(spark, sf_dir), 0, 1, 0.5).groupBy("cls", "outcome").agg(F.count("*").alias("n"))


@query(sql("""
, r(bucket, low, high) AS (VALUES ('all', 0, 100000000), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 100000000)),
n AS (SELECT cls, bucket, count(*) AS n FROM ann, r WHERE w * h BETWEEN low AND high GROUP BY ALL)
SELECT 0 AS arm, c.cls, r.bucket, CASE WHEN n.n IS NULL THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS ap FROM (SELECT DISTINCT cls FROM ann) c CROSS JOIN r LEFT JOIN n ON n.cls = c.cls AND n.bucket = r.bucket"""))
def self_evaluation(spark, sf_dir):
    """Truths as detections of full score: average precision is 1 wherever there is a truth."""
    truth = annotations(spark, sf_dir)
    det = truth.select(F.lit(0).alias("arm"), F.col("ann_id").alias("det_id"), "image_id", "cls", *"xywh", F.lit(1.0).alias("score"))
    return coco.average_precision(det, truth)


@query(sql("""
, m AS (SELECT DISTINCT arm, metric FROM (SELECT arm, 'ap.' || cls AS metric FROM det WHERE NOT (arm = 1 AND cls = 'head') UNION ALL SELECT arm, 'bare_head_recall' FROM det WHERE arm = 0 UNION ALL SELECT arm, 'map' FROM det)),
r AS (SELECT 'map' AS metric UNION SELECT 'bare_head_recall' UNION SELECT 'ap.' || cls FROM ann)
SELECT a.arm, r.metric FROM (SELECT DISTINCT arm FROM m) a CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = a.arm AND m.metric = r.metric)"""))
def missing_derived_intervals(spark, sf_dir):
    """Metrics that must have an interval, by the classes that the truth has, and that an arm lacks."""
    det = detections(spark, sf_dir)
    have = det.where("not (arm = 1 and cls = 'head')").select("arm", F.concat(F.lit("ap."), "cls").alias("metric")).unionByName(det.where("arm = 0").select("arm", F.lit("bare_head_recall").alias("metric"))).unionByName(det.select("arm", F.lit("map").alias("metric"))).distinct()
    return audit.missing_of(have, "arm", "metric", audit.required_metrics(annotations(spark, sf_dir)))


@query(sql("""
, s AS (SELECT d.arm, d.image_id % 10 AS clip, d.image_id AS frame, count(*) FILTER (WHERE cls = 'helmet') AS ok, count(*) FILTER (WHERE cls <> 'person') AS n, CAST(sum(w) + 10 AS DOUBLE) AS model_ms, CAST(sum(w) + max(h) + 20 AS DOUBLE) AS whole_ms FROM det d GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY arm, clip ORDER BY frame) AS k, count(*) OVER (PARTITION BY arm, clip) AS total FROM s)
SELECT arm, clip, count(*) AS frames, bool_or(total > 300) AS truncated, round(avg(ok / nullif(n, 0)), 6) AS mean_rate, median(model_ms) AS model_ms, median(whole_ms) AS whole_ms FROM k WHERE k <= 300 GROUP BY arm, clip"""))
def capped_clips(spark, sf_dir):
    """The first 300 frames of a clip: mean of the defined rates, medians of the times, and whether frames were left out."""
    frames = detections(spark, sf_dir).groupBy("arm", (F.col("image_id") % 10).alias("clip"), F.col("image_id").alias("frame")).agg(
        F.count_if(F.col("cls") == "helmet").alias("ok"), F.count_if(F.col("cls") != "person").alias("n"), (F.sum("w") + 10).cast("double").alias("model_ms"), (F.sum("w") + F.max("h") + 20).cast("double").alias("whole_ms"))
    total = frames.groupBy("arm", "clip").agg(F.count("*").alias("total"))
    kept = first_in_group(frames, ["arm", "clip"], [F.col("frame")], 300).groupBy("arm", "clip").agg(F.count("*").alias("frames"), F.round(F.avg(F.try_divide("ok", "n")), 6).alias("mean_rate"), F.percentile("model_ms", 0.5).alias("model_ms"), F.percentile("whole_ms", 0.5).alias("whole_ms"))
    return kept.join(total, ["arm", "clip"]).select("arm", "clip", "frames", (F.col("total") > F.col("frames")).alias("truncated"), "mean_rate", "model_ms", "whole_ms")


@query(f"""WITH RECURSIVE {VEC.strip()}, e2 AS (SELECT a, b FROM good UNION ALL SELECT b, a FROM good),
r AS (SELECT item_id AS node, item_id AS low FROM hh UNION SELECT e2.b, r.low FROM r JOIN e2 ON r.node = e2.a WHERE r.low < e2.b),
g AS (SELECT node AS item_id, min(low) AS group_id FROM r GROUP BY node),
s AS (SELECT *, ('0x' || substr(sha256('split|' || group_id), 1, 16))::UBIGINT % 10 AS fold FROM g)
SELECT s.item_id, sha256('item ' || s.item_id) AS sha256, lower(lpad(to_hex(hash::UBIGINT), 16, '0')) AS phash, group_id, CASE WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'val' ELSE 'train' END AS split, fold = 0 AS blocked FROM s JOIN hh ON hh.item_id = s.item_id""")
def grouped_manifest(spark, sf_dir):
    """Every item's digest, perceptual hash, near-duplicate group, split (whole groups) and whether it is on the test blocklist."""
    v = vectors(spark, sf_dir)
    groups = graph.grouped(v, joins.guarded_pairs(v, BASE, GUARD, COSINE, forest=True))
    digests = v.select("item_id", F.sha2(F.concat(F.lit("item "), F.col("item_id").cast("string")), 256).alias("sha256"))
    return audit.manifest(digests, v.select("item_id", "hash"), groups)


@query(sql("""
, i AS (SELECT image_id, ann_id, row_number() OVER (PARTITION BY image_id ORDER BY y + h, ann_id) AS z, row_number() OVER (PARTITION BY image_id ORDER BY ann_id) AS n, w - CASE WHEN ann_id % 400 = 0 THEN w ELSE 0 END AS w, h FROM ann WHERE ann_id % 11 <> 0),
t AS (SELECT image_id, bool_or(w * h <= 0) AS zero, bool_or(z <> n) AS disorder FROM i GROUP BY image_id)
SELECT o.image_id, concat_ws(',', CASE WHEN o.image_id % 17 = 0 THEN 'annotation_count' END, CASE WHEN zero THEN 'zero_area' END, CASE WHEN disorder THEN 'z_order' END, CASE WHEN o.image_id % 23 = 0 THEN 'blocklist' END) AS broken
FROM (SELECT DISTINCT image_id FROM ann) o LEFT JOIN t USING (image_id)"""))
def broken_invariants(spark, sf_dir):
    """Invariants of a composed record that don't hold: generator faults, not reasons to filter."""
    rows = records(spark, sf_dir).withColumn("instances", F.transform("instances", lambda i: i.withField("w", F.when(i["id"] % 400 == 0, F.lit(0)).otherwise(i["w"])).withField("z_index", i["id"])))
    held = F.struct(F.lit(9).alias("n_in"), F.lit(2).alias("n_removed"), (F.lit(7) - (F.col("image_id") % 17 == 0).cast("int")).alias("n_out"), (F.col("image_id") % 23 != 0).alias("blocklist_untouched"))
    return rows.select("image_id", F.array_join(rules.broken_invariants(F.col("instances"), held), ",").alias("broken"))
