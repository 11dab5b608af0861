"""Greedy matching, recall, sweeps, arm differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import aggregates as agg
from marlstone.operators import bootstrap, coco, compliance, joins, matching
from marlstone.plans.fixtures import annotations, crowds, detections, images, sql
from marlstone.plans.registry import query

_I = "greatest(least(d.x + d.w, a.x + a.w) - greatest(d.x, a.x), 0) * greatest(least(d.y + d.h, a.y + a.h) - greatest(d.y, a.y), 0)"


def greedy_sql(tie: str = "ann_id", arm: str = "0", group: str = "image_id, cls", classes: bool = True, threshold: str = "0.5") -> str:
    """Recursive matching: one detection of every group a step. Gives m(arm, image_id, cls, det_id, ann_id, iou)."""
    same = "AND d.cls = a.cls" if classes else ""
    part = "image_id, cls" if classes else "image_id"
    cls = "d.cls" if classes else "'any' AS cls"
    return f""", RECURSIVE_MARK cand AS (SELECT d.arm, d.image_id, {cls}, d.det_id, d.score, a.ann_id, {_I} / (d.w * d.h + a.w * a.h - {_I}) AS iou FROM det d JOIN ann a ON d.image_id = a.image_id {same} AND {_I} > 0 WHERE d.arm IN ({arm})),
dd AS (SELECT arm, image_id, cls, det_id, row_number() OVER (PARTITION BY arm, image_id, cls ORDER BY score DESC, det_id) AS k, opts FROM (
  SELECT arm, image_id, cls, det_id, score, list(struct_pack(ann_id := ann_id, iou := iou) ORDER BY iou DESC, {tie}) AS opts FROM cand GROUP BY ALL)),
fold AS (
  SELECT arm, image_id, cls, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS det_id, NULL::BIGINT AS ann_id, NULL::DOUBLE AS iou FROM (SELECT DISTINCT arm, image_id, cls FROM dd)
  UNION ALL
  SELECT f.arm, f.image_id, f.cls, dd.k, CASE WHEN o.iou >= {threshold} THEN list_append(f.used, o.ann_id) ELSE f.used END, CASE WHEN o.iou >= {threshold} THEN dd.det_id END, CASE WHEN o.iou >= {threshold} THEN o.ann_id END, o.iou
  FROM fold f JOIN dd ON f.arm = dd.arm AND f.image_id = dd.image_id AND f.cls = dd.cls AND dd.k = f.k + 1, LATERAL (SELECT list_filter(dd.opts, lambda e: NOT list_contains(f.used, e.ann_id))[1] AS o)),
m AS (SELECT arm, image_id, cls, det_id, ann_id, iou FROM fold WHERE det_id IS NOT NULL)"""


def recursive(body: str) -> str:
    return sql(body.replace("RECURSIVE_MARK ", "")).replace("WITH ", "WITH RECURSIVE ", 1)


def _matched(spark, sf_dir, arms=(0,)):
    det = detections(spark, sf_dir).where(F.col("arm").isin(*arms))
    ann = annotations(spark, sf_dir)
    return det, ann, matching.greedy(matching.candidates(det, ann, ["image_id", "cls"], ["arm"]), ["arm", "image_id", "cls"], 0.5)


@query(recursive(greedy_sql() + " SELECT det_id, ann_id, iou FROM m"))
def greedy_match(spark, sf_dir):
    """Class-aware one-to-one matching by score; the best free truth, first of equals."""
    return _matched(spark, sf_dir)[2].select("det_id", "ann_id", "iou")


@query(recursive(greedy_sql(tie="ann_id DESC") + " SELECT det_id, ann_id, iou FROM m"))
def greedy_match_last_tie(spark, sf_dir):
    """Of equal truths the last."""
    det = detections(spark, sf_dir).where("arm = 0")
    pairs = matching.candidates(det, annotations(spark, sf_dir), ["image_id", "cls"])
    return matching.greedy(pairs, ["image_id", "cls"], 0.5, last_of_equal=True).select("det_id", "ann_id", "iou")


@query(recursive(greedy_sql(classes=False, threshold="0.3") + " SELECT det_id, ann_id, iou FROM m"))
def greedy_match_any_class(spark, sf_dir):
    det = detections(spark, sf_dir).where("arm = 0")
    pairs = matching.candidates(det, annotations(spark, sf_dir), ["image_id"])
    return matching.greedy(pairs, ["image_id"], 0.3).select("det_id", "ann_id", "iou")


@query(recursive(f"""
, cand AS (SELECT d.image_id, d.det_id AS l, a.det_id AS r, {_I} / (d.w * d.h + a.w * a.h - {_I}) AS iou FROM det d JOIN det a ON d.image_id = a.image_id AND d.cls = a.cls AND d.arm = 0 AND a.arm = 1 AND {_I} > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, l, r) AS k FROM cand WHERE iou >= 0.5),
fold AS (
  SELECT image_id, 0::BIGINT AS k, []::BIGINT[] AS ul, []::BIGINT[] AS ur, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::DOUBLE AS iou FROM (SELECT DISTINCT image_id FROM c)
  UNION ALL
  SELECT f.image_id, c.k, CASE WHEN ok THEN list_append(f.ul, c.l) ELSE f.ul END, CASE WHEN ok THEN list_append(f.ur, c.r) ELSE f.ur END, CASE WHEN ok THEN c.l END, CASE WHEN ok THEN c.r END, c.iou
  FROM fold f JOIN c ON f.image_id = c.image_id AND c.k = f.k + 1, LATERAL (SELECT NOT list_contains(f.ul, c.l) AND NOT list_contains(f.ur, c.r) AS ok))
SELECT l AS left_id, r AS right_id, iou FROM fold WHERE l IS NOT NULL"""))
def pair_two_arms(spark, sf_dir):
    """Greedy pairing of two arms' detections by IoU alone."""
    det = detections(spark, sf_dir)
    right = det.where("arm = 1").withColumnRenamed("det_id", "ann_id")
    pairs = matching.candidates(det.where("arm = 0"), right, ["image_id", "cls"])
    out = matching.greedy_pairs(pairs, ["image_id"], 0.5)
    return out.select(F.col("det_id").alias("left_id"), F.col("ann_id").alias("right_id"), "iou")


@query(recursive(greedy_sql(arm="0, 1") + """
, t AS (SELECT d.arm, d.cls, count(m.det_id) AS tp, count(*) - count(m.det_id) AS fp FROM det d LEFT JOIN m USING (arm, det_id) GROUP BY d.arm, d.cls),
n AS (SELECT cls, count(*) AS n FROM ann GROUP BY cls), i AS (SELECT arm, cls, median(iou) AS mid FROM m GROUP BY arm, cls)
SELECT arm, cls, tp, fp, n - tp AS fn, round(tp / greatest(tp + fp, 1), 6) AS "precision", round(tp / greatest(n, 1), 6) AS recall, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(n, 1)) / (tp / greatest(tp + fp, 1) + tp / greatest(n, 1)), 6) AS f1, round(mid, 6) AS median_iou
FROM t JOIN n USING (cls) JOIN i USING (arm, cls)"""))
def precision_recall(spark, sf_dir):
    """Micro-averaged precision, recall, F1 and median IoU by arm and class."""
    det, ann, edges = _matched(spark, sf_dir, (0, 1))
    d = det.join(edges.select("arm", "det_id", "iou"), ["arm", "det_id"], "left").groupBy("arm", "cls").agg(F.count("iou").alias("tp"), F.count_if(F.col("iou").isNull()).alias("fp"), F.percentile("iou", 0.5).alias("mid"))
    rows = d.join(ann.groupBy("cls").agg(F.count("*").alias("n")), "cls").withColumn("fn", F.col("n") - F.col("tp"))
    m = agg.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select("arm", "cls", "tp", "fp", "fn", *[F.round(c, 6).alias(k) for k, c in m.items()], F.round("mid", 6).alias("median_iou"))


@query(recursive(greedy_sql() + f"""
, wrong AS (SELECT d.* FROM det d LEFT JOIN m USING (det_id) WHERE d.arm = 0 AND m.det_id IS NULL),
b AS (SELECT d.det_id, max(CASE WHEN d.cls = a.cls THEN {_I} / (d.w * d.h + a.w * a.h - {_I}) END) AS own, max(CASE WHEN d.cls <> a.cls THEN {_I} / (d.w * d.h + a.w * a.h - {_I}) END) AS other FROM wrong d JOIN ann a USING (image_id) GROUP BY d.det_id)
SELECT CASE WHEN b.det_id IS NULL THEN 'empty_gt' WHEN own >= 0.5 THEN 'duplicate' WHEN own >= 0.1 THEN 'localization' WHEN other >= 0.1 THEN 'semantic' ELSE 'background' END AS error, count(*) AS n FROM wrong LEFT JOIN b USING (det_id) GROUP BY 1"""))
def error_histogram(spark, sf_dir):
    """Kinds of false positives."""
    det, ann, edges = _matched(spark, sf_dir)
    return matching.error_types(det, ann, edges).groupBy("error").agg(F.count("*").alias("n"))


@query(recursive(greedy_sql() + """
, s AS (SELECT score, count(m.det_id) AS tp, count(*) - count(m.det_id) AS fp FROM det d LEFT JOIN m USING (det_id) WHERE d.arm = 0 GROUP BY score)
SELECT score AS threshold, CAST(sum(tp) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(fp) OVER (ORDER BY score DESC) AS BIGINT) AS fp, (SELECT count(*) FROM ann) AS n_truth FROM s"""))
def operating_sweep(spark, sf_dir):
    """Counts at every distinct score."""
    return matching.sweep(*_matched(spark, sf_dir))


@query(recursive(greedy_sql() + """
, s AS (SELECT score, count(m.det_id) AS tp, count(*) AS k FROM det d LEFT JOIN m USING (det_id) WHERE d.arm = 0 GROUP BY score),
c AS (SELECT score AS threshold, sum(tp) OVER w / greatest(sum(k) OVER w, 1) AS p, sum(tp) OVER w / (SELECT count(*) FROM ann) AS r FROM s WINDOW w AS (ORDER BY score DESC))
SELECT threshold, round(p, 6) AS "precision", round(r, 6) AS recall FROM c WHERE p >= 0.8 AND r > 0 ORDER BY r DESC, p DESC, threshold DESC LIMIT 1"""))
def operating_point(spark, sf_dir):
    """The threshold with the most recall whose precision reaches the floor."""
    rows = matching.sweep(*_matched(spark, sf_dir)).select("threshold", (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("p"), (F.col("tp") / F.col("n_truth")).alias("r"))
    return rows.where("p >= 0.8 and r > 0").orderBy(F.desc("r"), F.desc("p"), F.desc("threshold")).limit(1).select("threshold", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"))


@query(recursive(greedy_sql(arm="0, 1") + """
, a0 AS (SELECT ann_id FROM m WHERE arm = 0), a1 AS (SELECT ann_id FROM m WHERE arm = 1)
SELECT cls, CASE WHEN a0.ann_id IS NULL AND a1.ann_id IS NULL THEN 'both_wrong' WHEN a0.ann_id IS NULL THEN 'fixed_fn' WHEN a1.ann_id IS NULL THEN 'new_fn' ELSE 'both_right' END AS outcome, count(*) AS n
FROM ann LEFT JOIN a0 USING (ann_id) LEFT JOIN a1 USING (ann_id) GROUP BY ALL"""))
def arm_difference(spark, sf_dir):
    """Four-way outcome of each truth under two arms."""
    _, ann, edges = _matched(spark, sf_dir, (0, 1))
    hit = edges.groupBy("ann_id").agg(F.bool_or(F.col("arm") == 0).alias("a0"), F.bool_or(F.col("arm") == 1).alias("a1"))
    a0, a1 = F.coalesce("a0", F.lit(False)), F.coalesce("a1", F.lit(False))
    outcome = F.when(~a0 & ~a1, "both_wrong").when(~a0, "fixed_fn").when(~a1, "new_fn").otherwise("both_right")
    return ann.join(hit, "ann_id", "left").groupBy("cls", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(recursive(greedy_sql() + f"""
, f AS (SELECT ann.* FROM ann LEFT JOIN m USING (ann_id) WHERE m.ann_id IS NULL),
c AS (SELECT a.ann_id, bool_or({_I} / (d.w * d.h + a.w * a.h - {_I}) >= 0.5) AS near, bool_or({_I} / (d.w * d.h + a.w * a.h - {_I}) >= 0.5 AND d.cls = a.cls) AS own FROM f a JOIN det d ON d.arm = 0 AND d.image_id = a.image_id GROUP BY a.ann_id)
SELECT CASE WHEN coalesce(own, false) THEN 'consumed' WHEN coalesce(near, false) THEN 'other_class' ELSE 'not_localised' END AS miss, count(*) AS n FROM f LEFT JOIN c USING (ann_id) GROUP BY 1"""))
def miss_attribution(spark, sf_dir):
    """Why each unmatched truth was missed."""
    det, ann, edges = _matched(spark, sf_dir)
    missed = ann.join(edges, "ann_id", "left_anti")
    pairs = joins.pairs_in(missed, det, ["image_id"]).withColumn("near", g.iou(g.box("l_"), g.box("r_")) >= 0.5)
    c = pairs.groupBy(F.col("l_ann_id").alias("ann_id")).agg(F.bool_or("near").alias("near"), F.bool_or(F.col("near") & (F.col("l_cls") == F.col("r_cls"))).alias("own"))
    return missed.join(c, "ann_id", "left").groupBy(F.when(F.coalesce("own", F.lit(False)), "consumed").when(F.coalesce("near", F.lit(False)), "other_class").otherwise("not_localised").alias("miss")).agg(F.count("*").alias("n"))


@query()
def average_precision(spark, sf_dir):
    """Average precision by arm, class and area over ten IoU thresholds; tests hold it against hand arithmetic."""
    return coco.average_precision(detections(spark, sf_dir), annotations(spark, sf_dir))


@query()
def average_precision_with_crowds(spark, sf_dir):
    """The same where every seventh truth stands for a crowd; tests hold it against a loop."""
    return coco.average_precision(detections(spark, sf_dir), crowds(annotations(spark, sf_dir)))


@query()
def ap_interval(spark, sf_dir):
    """Percentile intervals of average precision over 1000 resamples of all images, drawn with replacement; tests hold it against a loop."""
    return bootstrap.ap_interval(detections(spark, sf_dir), annotations(spark, sf_dir), images(spark, sf_dir))


_GRID = [0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9]
_WORN = "abs((t.x + t.w / 2 - (h.x + h.w / 2)) / h.w) <= 0.6 AND (t.y + t.h / 2 - (h.y + h.h / 2)) / h.h BETWEEN -1 AND 0.4 AND t.w / h.w BETWEEN 0.4 AND 2.5"


def grid_sql(verdicts: str) -> str:
    """Recomputes every threshold from the detections over it. ``verdicts`` is a SELECT of v(tau, image_id, det_id, score, cls, x, y, w, h, ok) from kept."""
    return f"""
, taus AS (SELECT unnest([0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9]::DOUBLE[]) AS tau),
kept AS (SELECT tau, d.* FROM det d, taus WHERE arm = 0 AND cls <> 'person' AND score >= tau),
v AS ({verdicts}),
cand AS (SELECT d.tau, d.image_id, d.ok, d.det_id, d.score, d.cls, d.x, d.y, d.w, d.h, a.ann_id, {_I} / (d.w * d.h + a.w * a.h - {_I}) AS iou FROM v d JOIN ann a ON d.image_id = a.image_id AND a.cls = CASE WHEN d.ok THEN 'helmet' ELSE 'head' END AND {_I} > 0),
dd AS (SELECT tau, image_id, ok, det_id, row_number() OVER (PARTITION BY tau, image_id, ok ORDER BY score DESC, cls, x, y, w, h, det_id) AS k, opts FROM (
  SELECT tau, image_id, ok, det_id, score, cls, x, y, w, h, list(ann_id ORDER BY iou DESC, ann_id DESC) AS opts FROM cand WHERE iou >= 0.5 GROUP BY ALL)),
fold AS (
  SELECT tau, image_id, ok, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS ann_id FROM (SELECT DISTINCT tau, image_id, ok FROM dd)
  UNION ALL
  SELECT f.tau, f.image_id, f.ok, dd.k, CASE WHEN o IS NOT NULL THEN list_append(f.used, o) ELSE f.used END, o
  FROM fold f JOIN dd ON f.tau = dd.tau AND f.image_id = dd.image_id AND f.ok = dd.ok AND dd.k = f.k + 1, LATERAL (SELECT list_filter(dd.opts, lambda e: NOT list_contains(f.used, e))[1] AS o)),
m AS (SELECT tau, count(*) FILTER (WHERE ok) AS true_compliant, count(*) FILTER (WHERE NOT ok) AS matched_bare_heads FROM fold WHERE ann_id IS NOT NULL GROUP BY tau),
n AS (SELECT tau, count(*) FILTER (WHERE ok) AS n_compliant, count(*) FILTER (WHERE NOT ok) AS n_non_compliant FROM v GROUP BY tau)
SELECT 0 AS arm, tau AS threshold, coalesce(n_compliant, 0) AS n_compliant, coalesce(n_non_compliant, 0) AS n_non_compliant, coalesce(true_compliant, 0) AS true_compliant, coalesce(matched_bare_heads, 0) AS matched_bare_heads,
       b AS n_bare_heads, round(coalesce(matched_bare_heads, 0) / b, 9) AS bare_head_recall, round(coalesce(true_compliant, 0) / nullif(n_compliant, 0), 9) AS compliance_precision
FROM taus LEFT JOIN n USING (tau) LEFT JOIN m USING (tau), (SELECT count(*) AS b FROM ann WHERE cls = 'head')"""


def _grid(spark, sf_dir, mode):
    det = detections(spark, sf_dir).where("arm = 0")
    out = compliance.sweep(det, annotations(spark, sf_dir), mode, split="validation", thresholds=_GRID)
    return out.withColumns({c: F.round(c, 9) for c in ("bare_head_recall", "compliance_precision")})


@query(recursive(grid_sql(f"SELECT h.tau, h.image_id, h.det_id, h.score, h.cls, h.x, h.y, h.w, h.h, EXISTS (SELECT 1 FROM kept t WHERE t.tau = h.tau AND t.image_id = h.image_id AND t.cls = 'helmet' AND {_WORN}) AS ok FROM kept h WHERE h.cls = 'head'")))
def geometric_sweep_grid(spark, sf_dir):
    """Operating points of the geometric mode at given thresholds."""
    return _grid(spark, sf_dir, "geometric_pairing")


@query(recursive(grid_sql("SELECT tau, image_id, det_id, score, cls, x, y, w, h, cls = 'helmet' AS ok FROM kept")))
def class_direct_sweep_grid(spark, sf_dir):
    """Operating points where the class is the status."""
    return _grid(spark, sf_dir, "class_direct")


@query()
def geometric_sweep(spark, sf_dir):
    """Operating points of both arms at every distinct score; a test recomputes each threshold."""
    return compliance.sweep(detections(spark, sf_dir), annotations(spark, sf_dir), "geometric_pairing", split="validation")


@query(sql(f"""
, kept AS (SELECT * FROM det WHERE arm = 0 AND score >= 0.5 AND cls <> 'person'),
v AS (SELECT 'class_direct' AS mode, image_id, cls = 'helmet' AS ok FROM kept UNION ALL
      SELECT 'geometric_pairing', h.image_id, EXISTS (SELECT 1 FROM kept t WHERE t.image_id = h.image_id AND t.cls = 'helmet' AND {_WORN}) FROM kept h WHERE h.cls = 'head')
SELECT mode, image_id, count(*) FILTER (WHERE ok) AS n_compliant, count(*) FILTER (WHERE NOT ok) AS n_non_compliant, round(count(*) FILTER (WHERE ok) / count(*), 9) AS compliance_rate FROM v GROUP BY ALL"""))
def compliance_by_mode(spark, sf_dir):
    """Each image's verdicts at 0.5 by every registered mode."""
    det = detections(spark, sf_dir).where("arm = 0")
    parts = [compliance.derived(det, name, 0.5, "image_id").select(F.lit(name).alias("mode"), "image_id", "n_compliant", "n_non_compliant", F.round("compliance_rate", 9).alias("compliance_rate")) for name in ("class_direct", "geometric_pairing")]
    return parts[0].unionByName(parts[1])
