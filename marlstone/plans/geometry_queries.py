"""Scalar geometry, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import joins
from marlstone.plans.fixtures import annotations, detections, images, sql
from marlstone.plans.registry import query

_INTER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"
_B = "x y w h".split()


@query(sql(f"""
SELECT det_id, ann_id, i / (da + aa - i) AS iou FROM (
  SELECT b.det_id, a.ann_id, {_INTER} AS i, b.w * b.h AS da, a.w * a.h AS aa FROM ann a JOIN det b ON a.image_id = b.image_id AND a.cls = b.cls AND b.arm = 0) WHERE i > 0"""))
def iou_pairs(spark, sf_dir):
    """IoU of every overlapping (detection, truth) pair of a class in an image."""
    det = detections(spark, sf_dir).where("arm = 0").drop("arm")
    pairs = joins.overlapping(annotations(spark, sf_dir), det, ["image_id", "cls"])
    return pairs.select(F.col("r_det_id").alias("det_id"), F.col("l_ann_id").alias("ann_id"), "iou")


@query(sql(f"""
SELECT a.ann_id AS a_id, b.ann_id AS b_id, {_INTER} / greatest(least(a.w * a.h, b.w * b.h), 1) AS io_min_floor, CASE WHEN least(a.w * a.h, b.w * b.h) > 0 THEN {_INTER} / least(a.w * a.h, b.w * b.h) ELSE 0 END AS io_min_plain
FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.ann_id < b.ann_id"""))
def io_min_pairs(spark, sf_dir):
    """Intersection over the smaller area, with a floor and with a zero guard."""
    ann = annotations(spark, sf_dir)
    pairs = joins.pairs_in(ann, ann, ["image_id"]).where("l_ann_id < r_ann_id")
    a, b = g.box("l_"), g.box("r_")
    return pairs.select(F.col("l_ann_id").alias("a_id"), F.col("r_ann_id").alias("b_id"), g.io_min(a, b).alias("io_min_floor"), g.io_min(a, b, None).alias("io_min_plain"))


@query(sql("""
SELECT ann_id, w * h AS area, x + w AS x2, y + h AS y2, greatest(least(x + w, width) - greatest(x, 0), 0) * greatest(least(y + h, height) - greatest(y, 0), 0) / greatest(w * h, 1) AS inside,
       least(x, y, width - x - w, height - y - h) AS margin, x + w / 2 AS cx, y + h / 2 AS cy FROM ann JOIN image USING (image_id)"""))
def box_measures(spark, sf_dir):
    """Area, corners, share inside the frame, edge margin, centre."""
    rows = annotations(spark, sf_dir).join(images(spark, sf_dir), "image_id")
    b = g.box()
    _, _, x2, y2 = g.to_xyxy(b)
    cx, cy = g.centre(b)
    return rows.select("ann_id", g.area(b).alias("area"), x2.alias("x2"), y2.alias("y2"), g.inside_ratio(b, F.col("width"), F.col("height")).alias("inside"), g.edge_margin(b, F.col("width"), F.col("height")).alias("margin"), cx.alias("cx"), cy.alias("cy"))


_RAW = """raw AS (SELECT ann_id, width, height, CASE WHEN ann_id % 3 = 0 THEN x + w ELSE x END + (ann_id % 4) * 0.25::DOUBLE AS x1, y + (ann_id % 2) * 0.5::DOUBLE AS y1,
  CASE WHEN ann_id % 3 = 0 THEN x ELSE x + w END + (ann_id % 4) * 0.25::DOUBLE AS x2, y + h + 0.5::DOUBLE AS y2 FROM ann JOIN image USING (image_id))"""


@query(sql(f"""
, {_RAW},
r AS (SELECT *, CAST(round_even(x1, 0) AS INT) AS a, CAST(round_even(y1, 0) AS INT) AS b, CAST(round_even(x2, 0) AS INT) AS c, CAST(round_even(y2, 0) AS INT) AS d FROM raw),
o AS (SELECT *, least(a, c) - 1 AS lx, least(b, d) - 1 AS ly, greatest(a, c) AS hx, greatest(b, d) AS hy FROM r),
k AS (SELECT *, greatest(lx, 0) AS nx, greatest(ly, 0) AS ny, least(hx, width) - greatest(lx, 0) AS nw, least(hy, height) - greatest(ly, 0) AS nh FROM o)
SELECT ann_id, nx AS x, ny AS y, nw AS w, nh AS h, (a <> x1 OR b <> y1 OR c <> x2 OR d <> y2) AS rounded, (a > c OR b > d) AS swapped,
       (nx <> lx OR ny <> ly OR least(hx, width) <> hx OR least(hy, height) <> hy) AS clipped FROM k WHERE nw > 0 AND nh > 0"""))
def normalised_boxes(spark, sf_dir):
    """Half-even rounding, order, offset of one, clipping; empty boxes go."""
    rows = annotations(spark, sf_dir).join(images(spark, sf_dir), "image_id")
    q = (F.col("ann_id") % 4) * 0.25
    odd = F.col("ann_id") % 3 == 0
    low, high = F.col("x"), F.col("x") + F.col("w")
    x1, x2 = F.when(odd, high).otherwise(low) + q, F.when(odd, low).otherwise(high) + q
    b, done = g.normalised(x1, F.col("y") + (F.col("ann_id") % 2) * 0.5, x2, F.col("y") + F.col("h") + 0.5, F.col("width"), F.col("height"), 1)
    out = rows.select("ann_id", *[c.alias(n) for n, c in zip(_B, b)], *[c.alias(n) for n, c in done.items()])
    return out.where("not empty").drop("empty")


@query(sql("SELECT det_id, x * (640.0::DOUBLE / width) AS x, y * (640.0::DOUBLE / height) AS y, w * (640.0::DOUBLE / width) AS w, h * (640.0::DOUBLE / height) AS h FROM det JOIN image USING (image_id) WHERE arm = 1"))
def rescaled_detections(spark, sf_dir):
    """Each image's boxes by its own factors; an unknown image is an error."""
    det = joins.lookup(detections(spark, sf_dir).where("arm = 1"), images(spark, sf_dir).join(detections(spark, sf_dir).where("arm = 1"), "image_id", "left_semi"), "image_id")
    return det.select("det_id", *[c.alias(n) for n, c in zip(_B, g.rescale(g.box(), F.lit(640.0) / F.col("width"), F.lit(640.0) / F.col("height")))])


@query(sql("""
SELECT arm, det_id FROM det JOIN image USING (image_id) WHERE w > 0 AND h > 0 AND w * h / (width * height) <= 0.02 AND h / height <= 0.15 AND w / greatest(h, 1) BETWEEN 0.3 AND 2.0
  AND 1 - greatest(least(x + w, width) - greatest(x, 0), 0) * greatest(least(y + h, height) - greatest(y, 0), 0) / greatest(w * h, 1) <= 0.25"""))
def plausible_detections(spark, sf_dir):
    """Inclusive bounds on area, height, aspect and outside share."""
    rows = detections(spark, sf_dir).join(images(spark, sf_dir), "image_id")
    ok = g.geometry_filter(g.box(), F.col("width"), F.col("height"), max_area=0.02, max_height=0.15, min_aspect=0.3, max_aspect=2.0, max_outside=0.25)
    return rows.where(ok).select("arm", "det_id")


@query(sql(f"""
SELECT a.ann_id AS head_id, b.ann_id AS hat_id, (b.x + b.w / 2 - (a.x + a.w / 2)) / a.w AS dx, (b.y + b.h / 2 - (a.y + a.h / 2)) / a.h AS dy,
       greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / a.h AS overlap_y, b.w / a.w AS r_w, b.h / a.h AS r_h, CASE WHEN {_INTER} > 0 THEN {_INTER} / (a.w * a.h + b.w * b.h - {_INTER}) ELSE 0 END AS iou
FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.cls = 'head' AND b.cls = 'helmet'"""))
def pair_descriptors(spark, sf_dir):
    ann = annotations(spark, sf_dir)
    pairs = joins.pairs_in(ann.where("cls = 'head'"), ann.where("cls = 'helmet'"), ["image_id"])
    return pairs.select(F.col("l_ann_id").alias("head_id"), F.col("r_ann_id").alias("hat_id"), g.pair_descriptor(g.box("l_"), g.box("r_")).alias("p")).select("head_id", "hat_id", "p.*")


@query(sql("""
SELECT a.ann_id AS head_id, bool_or(a.x + a.w / 2 BETWEEN b.x - a.w AND b.x + b.w + a.w AND a.y + a.h / 2 BETWEEN b.y - a.h AND b.y + b.h * 0.65::DOUBLE + a.h) AS near,
       bool_or(a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h * 0.55::DOUBLE) AS inside
FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.cls = 'head' AND b.cls = 'person' GROUP BY a.ann_id"""))
def person_context(spark, sf_dir):
    """Whether a head is near, or inside, the upper part of some person; both variants."""
    ann = annotations(spark, sf_dir)
    pairs = joins.pairs_in(ann.where("cls = 'head'"), ann.where("cls = 'person'"), ["image_id"])
    a, b = g.box("l_"), g.box("r_")
    return pairs.groupBy(F.col("l_ann_id").alias("head_id")).agg(F.bool_or(g.in_person_context(a, b)).alias("near"), F.bool_or(g.in_person_context(a, b, 0.55, False)).alias("inside"))


@query(sql("SELECT ann_id, (416 - x - w) * 0.5::DOUBLE + 3 AS x, y * 0.5::DOUBLE - 2 AS y, w * 0.5::DOUBLE AS w, h * 0.5::DOUBLE AS h FROM ann"))
def transformed_boxes(spark, sf_dir):
    """Mirrored, scaled and shifted."""
    b = g.moved(g.flipped(g.box(), F.lit(416)), F.lit(0.5), F.lit(3), F.lit(-2))
    return annotations(spark, sf_dir).select("ann_id", *[c.alias(n) for n, c in zip(_B, b)])


@query("SELECT p_partkey, lower(regexp_extract(replace(n, chr(92), '/'), '[^/]*$')) AS key FROM (SELECT p_partkey, 'Data' || chr(92) || p_brand || '/' || p_name || '.PNG' AS n FROM part)")
def name_identity(spark, sf_dir):
    """Base names whatever the slash and the case."""
    from marlstone.plans.fixtures import table

    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Data\\"), "p_brand", F.lit("/"), "p_name", F.lit(".PNG")).alias("n"))
    return rows.select("p_partkey", joins.normal_name(F.col("n")).alias("key"))


@query(sql("SELECT det_id, CASE cls WHEN 'helmet' THEN 'COMPLIANT' WHEN 'head' THEN 'NON_COMPLIANT' END AS status FROM det WHERE arm = 0 AND cls <> 'person'"))
def class_direct_status(spark, sf_dir):
    """Status by class; persons have none, an unknown class is an error."""
    status = spark.createDataFrame([("helmet", "COMPLIANT"), ("head", "NON_COMPLIANT")], "cls string, status string")
    return joins.lookup(detections(spark, sf_dir).where("arm = 0 and cls <> 'person'"), status, "cls").select("det_id", "status")


@query(sql("""
SELECT ann_id, CASE WHEN least(x, y, 416 - x - w, 416 - y - h) < 0 THEN 'outside' WHEN w < 10 THEN 'narrow' WHEN h < 20 THEN 'low' WHEN w * h > 5000 THEN 'large' END AS first_reason FROM ann"""))
def first_guard(spark, sf_dir):
    """The first guard that fails; null where none does."""
    b = g.box()
    guards = [("outside", g.edge_margin(b, F.lit(416), F.lit(416)) < 0), ("narrow", b.w < 10), ("low", b.h < 20), ("large", g.area(b) > 5000)]
    return annotations(spark, sf_dir).select("ann_id", F.coalesce(*[F.when(test, F.lit(name)) for name, test in guards]).alias("first_reason"))


@query(sql("SELECT ann_id AS det_id, image_id, cls, x, y, w, h, 1.0::DOUBLE AS score FROM ann WHERE cls <> 'person'"))
def truth_as_detections(spark, sf_dir):
    return annotations(spark, sf_dir).where("cls <> 'person'").select(F.col("ann_id").alias("det_id"), "image_id", "cls", *_B, F.lit(1.0).alias("score"))


@query(sql("""
, s AS (SELECT cls, quantile_cont(w, 0.05) AS lo, quantile_cont(w, 0.95) AS hi FROM ann GROUP BY cls)
SELECT a.cls AS a_cls, b.cls AS b_cls, (a.hi < b.lo OR b.hi < a.lo) AS apart FROM s a JOIN s b ON a.cls < b.cls"""))
def separable_intervals(spark, sf_dir):
    """Whether the intervals of two arms are disjoint."""
    s = annotations(spark, sf_dir).groupBy("cls").agg(F.percentile("w", 0.05).alias("lo"), F.percentile("w", 0.95).alias("hi"))
    a, b = s.select(*[F.col(c).alias("a_" + c) for c in s.columns]), s.select(*[F.col(c).alias("b_" + c) for c in s.columns])
    return a.join(b, F.col("a_cls") < F.col("b_cls")).select("a_cls", "b_cls", ((F.col("a_hi") < F.col("b_lo")) | (F.col("b_hi") < F.col("a_lo"))).alias("apart"))
