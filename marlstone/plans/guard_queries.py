"""Gates on measured masks and units, adequacy of buckets, nesting, required metrics, intervals of ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import analysis, audit, bootstrap, joins, rules
from marlstone.plans.aggregate_queries import scored
from marlstone.plans.fixtures import PRIMARY, annotations, detections, images, sql, vectors
from marlstone.plans.join_queries import VEC
from marlstone.plans.registry import query

#: Measured masks from the annotation's box and id: name, SQL for the value; the text is SQL to both engines.
_MASK = {
    "iou_score": "(x % 41 + 60) / 100", "object_score_logit": "(y % 50 + 150) / 10", "outside_box_ratio": "(ann_id * 13 % 20) / 100", "second_component_ratio": "(ann_id * 17 % 30) / 100",
    "hole_fill_ratio": "(ann_id * 19 % 50 + 90) / 100", "mask_to_box_coverage": "(ann_id * 23 % 90 + 10) / 100", "solidity": "(ann_id * 29 % 60 + 40) / 100", "mask_area_px": "w * h", "edge_touch_top": "(ann_id * 31 % 100) / 100", "edge_touch_side": "(ann_id * 37 % 100) / 100",
}
#: The bounds stand here once more, as text.
_TESTS = {
    "iou_score": "iou_score < 0.8", "object_score_logit": "object_score_logit < 18", "outside_box_ratio": "outside_box_ratio > 0.15", "second_component_ratio": "second_component_ratio > 0.25", "hole_fill_ratio": "hole_fill_ratio > 1.3",
    "mask_to_box_coverage": "CASE cls WHEN 'helmet' THEN mask_to_box_coverage NOT BETWEEN 0.2 AND 0.8 WHEN 'head' THEN mask_to_box_coverage NOT BETWEEN 0.3 AND 0.85 ELSE mask_to_box_coverage NOT BETWEEN 0.15 AND 0.85 END",
    "solidity": "solidity < CASE cls WHEN 'helmet' THEN 0.6 WHEN 'head' THEN 0.7 ELSE 0.55 END", "mask_area_px": "mask_area_px < 300", "edge_touch_top": "cls IN ('helmet', 'head') AND edge_touch_top > 0.4", "edge_touch_side": "cls = 'person' AND edge_touch_side > 0.75",
}


def _listed(tests: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests.items()) + ")"


@query(sql(f", m AS (SELECT ann_id, cls, {', '.join(f'CAST({e} AS DOUBLE) AS {k}' for k, e in _MASK.items())} FROM ann) SELECT ann_id, {_listed(_TESTS)} AS failures FROM m"))
def mask_gate(spark, sf_dir):
    """Measured masks against the bounds of their class; all failures in the order of the gate."""
    metrics = F.struct(*[F.expr(f"cast({e} as double)").alias(k) for k, e in _MASK.items()])
    return annotations(spark, sf_dir).select("ann_id", F.array_join(rules.mask_failures(metrics, F.col("cls")), ",").alias("failures"))


_UNIT = {
    "NOT_PERSON": "cls <> 'person'", "NOT_TRAIN": "ann_id % 5 = 0", "NOT_PREFERRED_TIER": "ann_id % 7 = 0", "VOC_FLAGGED": "ann_id % 11 = 0 OR ann_id % 13 = 0", "PERSON_TOO_SMALL": "h < 60", "SOURCE_PERSON_TOO_HIGH": "(y + h) / 416 < 0.6",
    "PERSON_TOO_HORIZONTAL": "h / greatest(w, 1) < 1.25", "HEAD_TOO_LOW": "(ann_id % 40 + 10) / greatest(h, 1) > 0.3", "HEAD_TOO_WIDE": "(ann_id % 60 + 1) / greatest(w, 1) > 0.5", "INVALID_HEAD_BOX": "x - 40 + ann_id % 60 + 1 <= 0",
    "MASK_TOUCHES_TOP": "ann_id % 23 / 100 > 0.15", "MASK_TOUCHES_SIDE": "ann_id % 29 / 100 > 0.15",
}


@query(sql(f"SELECT ann_id, {_listed(_UNIT)} AS reasons FROM ann"))
def unit_reject_reasons(spark, sf_dir):
    """Every predicate of a person and the head linked to it, in order."""
    i = F.col("ann_id")
    person = F.struct("cls", F.when(i % 5 == 0, "val").otherwise("train").alias("split"), (i % 7 != 0).alias("preferred"), (i % 11 == 0).alias("truncated"), (i % 13 == 0).alias("difficult"), *"xywh", (i % 23 / 100).alias("touch_top"), (i % 29 / 100).alias("touch_side"))
    head = F.struct((F.col("x") - 40).alias("x"), (F.col("y") + i % 40).alias("y"), (i % 60 + 1).alias("w"), F.lit(20).alias("h"))
    return annotations(spark, sf_dir).select("ann_id", F.array_join(rules.unit_reasons(person, head, F.lit(416)), ",").alias("reasons"))


@query(sql("""
, c AS (SELECT count(*) FILTER (WHERE w * h < 1024) AS n_small, count(*) AS n_all FROM ann WHERE cls IN ('helmet', 'head'))
SELECT n_small, n_all, round(n_small / n_all, 6) AS share, n_small < 1000 OR n_small / n_all < 1 / 3 AS thin, n_small = 0 AS empty, round(100 / n_small, 6) AS points, round(50 * 1.959963984540054::DOUBLE / sqrt(n_small), 6) AS half_width, round(sqrt(2) * 50 * 1.959963984540054::DOUBLE / sqrt(n_small), 6) AS gap_floor FROM c"""))
def small_bucket_adequacy(spark, sf_dir):
    """Whether small instances of the primary classes can carry a claim."""
    bucket = g.bucket_half_open(g.area(g.box()), [("small", 0, 1024), ("medium", 1024, 9216), ("large", 9216, 10**9)])
    counts = annotations(spark, sf_dir).where(F.col("cls").isin(*PRIMARY)).groupBy("cls", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    out = analysis.adequacy(counts, "bucket", "small", "n", 3, least=1000)
    return out.select("n_small", "n_all", "thin", "empty", *[F.round(c, 6).alias(c) for c in ("share", "points", "half_width", "gap_floor")])


@query(sql("""
, a AS (SELECT image_id FROM image WHERE image_id % 12 = 0), b AS (SELECT image_id FROM image WHERE image_id % 6 = 0), c AS (SELECT DISTINCT image_id FROM ann)
SELECT 'small' AS "inner", 'large' AS "outer", (SELECT count(*) FROM a ANTI JOIN b USING (image_id)) AS n_outside, (SELECT count(*) FROM a ANTI JOIN b USING (image_id)) = 0 AS nested
UNION ALL SELECT 'large', 'annotated', (SELECT count(*) FROM b ANTI JOIN c USING (image_id)), (SELECT count(*) FROM b ANTI JOIN c USING (image_id)) = 0"""))
def nested_subsets(spark, sf_dir):
    """small <= large <= annotated, by what is outside."""
    own = images(spark, sf_dir)
    return analysis.nested([("small", own.where("image_id % 12 = 0")), ("large", own.where("image_id % 6 = 0")), ("annotated", annotations(spark, sf_dir))], "image_id")


@query(f"WITH {VEC.strip()} SELECT a, b, round(cosine, 5) AS cosine FROM edge WHERE cosine >= 0.4")
def cosine_pairs(spark, sf_dir):
    """All pairs by cosine, without a prefilter."""
    return joins.cosine_pairs(vectors(spark, sf_dir), 0.4).withColumn("cosine", F.round("cosine", 5))


@query(sql("""
, m AS (SELECT DISTINCT arm, 'ap.' || cls AS metric FROM det WHERE NOT (arm = 1 AND cls = 'head')), r AS (SELECT unnest(['map', 'ap.head', 'ap.person', 'ap.helmet']) AS metric)
SELECT arm, metric FROM (SELECT DISTINCT arm FROM m) a, r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.arm = a.arm AND m.metric = r.metric)"""))
def missing_interval_metrics(spark, sf_dir):
    """Metrics that must have an interval and that an arm lacks."""
    have = detections(spark, sf_dir).where("not (arm = 1 and cls = 'head')").select("arm", F.concat(F.lit("ap."), "cls").alias("metric")).distinct()
    return audit.missing_metrics(have, "arm", "metric", ["map", "ap.head", "ap.person", "ap.helmet"])


@query()
def auc_interval(spark, sf_dir):
    """Percentile interval of an area under the ROC curve over resampled rows; tests hold it against a loop."""
    return bootstrap.auc_interval(scored(spark, sf_dir), "label", "score")
