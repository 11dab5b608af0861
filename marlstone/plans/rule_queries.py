"""Rule engine over records that are put together from annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import aggregates as agg
from marlstone.operators import joins, rules
from marlstone.plans.fixtures import annotations, images, sql
from marlstone.plans.registry import query


def records(spark, sf_dir, **measured):
    """image_id, width, height, instances in the order of their ids, with further fields by name."""
    rows = annotations(spark, sf_dir).select(
        "image_id",
        F.struct(
            F.col("ann_id").alias("id"), "cls", "x", "y", "w", "h", F.when(F.col("ann_id") % 11 == 0, F.lit(False)).alias("kept"), ((F.col("ann_id") * 7 % 100) / 100).alias("visible"),
            F.when(F.col("ann_id") % 5 != 0, (F.col("ann_id") * 13 % 100) / 100).alias("coverage"), (F.col("ann_id") * 29 % 256).cast("double").alias("luma"),
            *[value.alias(name) for name, value in measured.items()],
        ).alias("i"),
    )
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_list("i")).alias("instances")).join(images(spark, sf_dir), "image_id")


_INST = """
inst AS (SELECT ann.*, width, height, ann_id % 11 <> 0 AS kept, ann_id * 7 % 100 / 100 AS visible, CASE WHEN ann_id % 5 <> 0 THEN ann_id * 13 % 100 / 100 END AS coverage,
           CAST(ann_id * 29 % 256 AS DOUBLE) AS luma, greatest(least(x + w, width) - greatest(x, 0), 0) * greatest(least(y + h, height) - greatest(y, 0), 0) / greatest(w * h, 1) AS inside
         FROM ann JOIN image USING (image_id)),
pr AS (SELECT a.image_id, a.ann_id AS ai, b.ann_id AS bi, a.cls AS ac, b.cls AS bc, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh,
         greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i
       FROM inst a JOIN inst b ON a.image_id = b.image_id AND a.ann_id <> b.ann_id AND a.kept AND b.kept)"""


def _reasons_sql(t: dict[str, str]) -> str:
    """Reason rows with the order in which the rules give them: r, o1, o2, o3. ``t``: SQL for each threshold."""
    return f"""
  SELECT image_id, 'OUT_OF_BOUNDS' AS r, 1 AS o1, ann_id AS o2, 1 AS o3 FROM inst_v WHERE kept AND inside < {t["bounds.min_inside"]}
  UNION ALL SELECT image_id, 'TOO_SMALL', 1, ann_id, 2 FROM inst_v WHERE kept AND w * h < {t["size.min_area"]}
  UNION ALL SELECT image_id, 'LOW_VISIBILITY', 1, ann_id, 3 FROM inst_v WHERE kept AND visible < {t["visible.min"]}
  UNION ALL SELECT image_id, 'OVERLAP', 2, 0, 0 FROM pr_v WHERE ac = bc AND (i / greatest(least(aw * ah, bw * bh), 1) > {t["overlap.max_io_min"]} OR i / (aw * ah + bw * bh - i) > {t["overlap.max_iou"]})
  UNION ALL SELECT image_id, 'LOW_COVERAGE', 3, ann_id, 0 FROM inst_v WHERE kept AND coverage < {t["coverage.min"]}
  UNION ALL SELECT image_id, CASE WHEN (by_ + bh / 2 - (ay + ah / 2)) / ah < {t["pair.min_dy"]} THEN 'FLOATING' WHEN bw / aw > {t["pair.max_ratio"]} OR bh / ah > {t["pair.max_ratio"]} THEN 'SWALLOWS' ELSE 'MISALIGNED' END, 4, ai, bi
    FROM pr_v WHERE ac = 'head' AND bc = 'helmet' AND i > 0 AND ((by_ + bh / 2 - (ay + ah / 2)) / ah < {t["pair.min_dy"]} OR bw / aw > {t["pair.max_ratio"]} OR bh / ah > {t["pair.max_ratio"]} OR abs((bx + bw / 2 - (ax + aw / 2)) / aw) > {t["pair.max_dx"]})
  UNION ALL SELECT image_id, 'NOT_CONTAINED', 5, ai, 0 FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ai ORDER BY bi) AS k FROM pr_v WHERE ac = 'helmet' AND bc = 'person' AND i > 0) WHERE k = 1 AND i / (aw * ah) < {t["person.min_containment"]}
  UNION ALL SELECT image_id, 'CLIPPED', 6, ann_id, 0 FROM inst_v WHERE 1 - inside > {t["clip.max_outside"]}
  UNION ALL SELECT image_id, 'ILLEGIBLE', 7, ann_id, 0 FROM inst_v WHERE kept AND luma < CASE cls WHEN 'head' THEN {t["luma.head"]} WHEN 'helmet' THEN {t["luma.helmet"]} ELSE {t["luma.person"]} END"""


_BASE = {k: f"{v}::DOUBLE" for k, v in rules.DEFAULTS.items()}
_PLAIN = f", {_INST.strip()}, inst_v AS (SELECT * FROM inst), pr_v AS (SELECT * FROM pr), rs AS ({_reasons_sql(_BASE)}), "


@query(sql(_PLAIN + """
d AS (SELECT image_id, r, min(struct_pack(o1 := o1, o2 := o2, o3 := o3)) AS o FROM rs GROUP BY ALL)
SELECT i.image_id, coalesce(string_agg(r, ',' ORDER BY o), '') AS reject_reasons, arg_min(r, o) AS first_reason, count(r) = 0 AS passed
FROM (SELECT DISTINCT image_id FROM inst) i LEFT JOIN d USING (image_id) GROUP BY i.image_id"""))
def record_filter(spark, sf_dir):
    """Every rule runs; reasons are distinct in first-seen order."""
    out = rules.judged_by_key(records(spark, sf_dir), ["image_id"])
    return out.select("image_id", F.array_join("reject_reasons", ",").alias("reject_reasons"), "first_reason", "passed")


@query(sql(_PLAIN + """
f AS (SELECT image_id, arg_min(r, struct_pack(o1 := o1, o2 := o2, o3 := o3)) AS first_reason FROM rs GROUP BY image_id)
SELECT coalesce(first_reason, 'ACCEPTED') AS outcome, count(*) AS n FROM (SELECT DISTINCT image_id FROM inst) i LEFT JOIN f USING (image_id) GROUP BY 1"""))
def first_reason_funnel(spark, sf_dir):
    return rules.judged_by_key(records(spark, sf_dir), ["image_id"]).groupBy(F.coalesce("first_reason", F.lit("ACCEPTED")).alias("outcome")).agg(F.count("*").alias("n"))


_VARIANTS = ", ".join("(" + ", ".join([f"'{r[0]}'", f"{r[1]}::DOUBLE", *[f"{v!r}::DOUBLE" for v in r[2:]]]) + ")" for r in rules.variants(rules.DEFAULTS))
_COLUMNS = ", ".join(p.replace(".", "_") for p in sorted(rules.DEFAULTS))


@query(sql(f"""
, {_INST.strip()}, v(path, factor, {_COLUMNS}) AS (VALUES {_VARIANTS}),
inst_v AS (SELECT inst.* EXCLUDE (image_id), struct_pack(image_id := image_id, path := path, factor := factor) AS image_id, v.* FROM inst, v),
pr_v AS (SELECT pr.* EXCLUDE (image_id), struct_pack(image_id := image_id, path := path, factor := factor) AS image_id, v.* FROM pr, v),
rs AS (SELECT DISTINCT image_id FROM ({_reasons_sql({k: k.replace(".", "_") for k in rules.DEFAULTS})})),
n AS (SELECT count(DISTINCT image_id) AS n FROM inst)
SELECT v.path, v.factor, any_value(n.n) AS n, any_value(n.n) - count(rs.image_id) AS n_passed FROM v CROSS JOIN n LEFT JOIN rs ON rs.image_id.path = v.path AND rs.image_id.factor = v.factor GROUP BY v.path, v.factor"""))
def threshold_sensitivity(spark, sf_dir):
    """Acceptance with each threshold a fifth lower and higher."""
    return rules.sensitivity(records(spark, sf_dir))


@query(sql("""
SELECT ann_id, CASE WHEN ann_id % 7 <> 0 AND ann_id % 50 / 100 < 0.1 THEN 'NO_CHANGE,' ELSE '' END || CASE WHEN ann_id % 3 = 0 AND ann_id % 40 <= 6 THEN 'NEAR_SYNTHETIC,' ELSE '' END || CASE WHEN ann_id % 60 <= 6 THEN 'NEAR_REAL,' ELSE '' END AS reasons FROM ann"""))
def duplicate_gate(spark, sf_dir):
    """Change ratio and distances; a missing measurement passes."""
    i = F.col("ann_id")
    reasons = rules.near_duplicate_reasons(F.when(i % 7 != 0, i % 50 / 100), F.when(i % 3 == 0, i % 40), i % 60, least_change=0.1, least_distance=6)
    return annotations(spark, sf_dir).select("ann_id", F.concat(F.array_join(reasons, ","), F.when(F.size(reasons) > 0, F.lit(",")).otherwise(F.lit(""))).alias("reasons"))


@query(sql("""
, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ann_id) AS k FROM ann WHERE cls = 'person' AND w * h >= 1024)
SELECT CASE WHEN a.cls <> 'person' THEN 'not_person' WHEN a.w * a.h < 1024 THEN 'small' WHEN r.k > 2 THEN 'capped' ELSE 'accepted' END AS stage, count(*) AS n FROM ann a LEFT JOIN r USING (ann_id) GROUP BY 1"""))
def accept_ledger(spark, sf_dir):
    """Three-stage funnel with a cap for each image."""
    ann = annotations(spark, sf_dir)
    fit = (F.col("cls") == "person") & (g.area(g.box()) >= 1024)
    capped = rules.capped_ledger(ann.where(fit), "image_id", ["ann_id"], 2).select(F.when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("capped")).alias("stage"))
    rest = ann.where(~fit).select(F.when(F.col("cls") != "person", F.lit("not_person")).otherwise(F.lit("small")).alias("stage"))
    return capped.unionByName(rest).groupBy("stage").agg(F.count("*").alias("n"))


@query(sql("""
, p AS (SELECT image_id, count(*) AS k FROM ann WHERE cls = 'helmet' GROUP BY image_id)
SELECT ann_id, CASE WHEN coalesce(k, 0) = 0 THEN 'no_child' WHEN k > 1 THEN 'many_children' WHEN w < 20 THEN 'narrow' END AS reason FROM ann LEFT JOIN p USING (image_id) WHERE cls = 'person'"""))
def unit_eligibility(spark, sf_dir):
    """Exactly one linked child, then the unit's own guards."""
    ann = annotations(spark, sf_dir)
    children = ann.where("cls = 'helmet'").groupBy("image_id").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return ann.where("cls = 'person'").join(children, "image_id", "left").select("ann_id", F.when(k == 0, "no_child").when(k > 1, "many_children").when(F.col("w") < 20, "narrow").alias("reason"))


@query(sql("""
SELECT cls, quantile_cont(w, 0.01) AS w_p1, quantile_cont(w, 0.99) AS w_p99, quantile_cont(h, 0.05) AS h_p5, quantile_cont(h, 0.95) AS h_p95 FROM ann WHERE x + w <= 416 GROUP BY cls"""))
def calibrated_thresholds(spark, sf_dir):
    """Bounds from percentiles after structural gates."""
    p = lambda c, s, n: F.percentile(c, F.lit(s)).alias(n)
    return annotations(spark, sf_dir).where("x + w <= 416").groupBy("cls").agg(p("w", 0.01, "w_p1"), p("w", 0.99, "w_p99"), p("h", 0.05, "h_p5"), p("h", 0.95, "h_p95"))


@query(sql("""
, f AS (SELECT quantile_cont(w, 0.05) AS lo, quantile_cont(w, 0.95) AS hi FROM ann WHERE x + w <= 416)
SELECT ann_id FROM ann, f WHERE w BETWEEN lo AND hi"""))
def calibrated_filter(spark, sf_dir):
    """The bounds as a one-row table that meets every row."""
    ann = annotations(spark, sf_dir)
    bounds = ann.where("x + w <= 416").agg(F.percentile("w", 0.05).alias("lo"), F.percentile("w", 0.95).alias("hi"))
    return ann.crossJoin(F.broadcast(bounds)).where("w between lo and hi").select("ann_id")


@query(sql("""
SELECT count(*) = count(DISTINCT ann_id) AS ids_distinct, min(w) > 0 AND min(h) > 0 AS sides_positive, count(*) FILTER (WHERE cls = 'helmet') + count(*) FILTER (WHERE cls = 'head') + count(*) FILTER (WHERE cls = 'person') = count(*) AS classes_add_up,
       min(x) >= 0 AND min(y) >= 0 AS in_frame FROM ann"""))
def ledger_checks(spark, sf_dir):
    """Reconciliation as one row of booleans."""
    n = F.count("*")
    return annotations(spark, sf_dir).agg(
        (n == F.countDistinct("ann_id")).alias("ids_distinct"), ((F.min("w") > 0) & (F.min("h") > 0)).alias("sides_positive"),
        (F.count_if(F.col("cls") == "helmet") + F.count_if(F.col("cls") == "head") + F.count_if(F.col("cls") == "person") == n).alias("classes_add_up"), ((F.min("x") >= 0) & (F.min("y") >= 0)).alias("in_frame"),
    )


@query(sql("""
, o AS (SELECT ann_id, row_number() OVER (PARTITION BY image_id ORDER BY y + h, ann_id) - 1 AS z, row_number() OVER (PARTITION BY image_id ORDER BY ann_id) - 1 AS n, image_id FROM ann)
SELECT image_id, bool_and(z = n) AS in_z_order FROM o GROUP BY image_id"""))
def z_order_invariant(spark, sf_dir):
    """Whether an image's instances already lie in the order of (lower edge, id)."""
    key = lambda i: F.struct((i["y"] + i["h"]).alias("b"), i["id"].alias("i"))
    keys = F.transform("instances", key)
    return records(spark, sf_dir).select("image_id", (F.array_sort(keys) == keys).alias("in_z_order"))


#: Measured fields of an instance; the text is SQL to both engines.
_FIELDS = {
    "kind": "CASE WHEN ann_id % 9 = 4 THEN 'hard_negative' WHEN ann_id % 9 < 3 THEN 'existing' WHEN ann_id % 9 < 8 THEN 'pasted' END", "mask_ok": "(x + y) % 8 <> 0", "retries_exhausted": "(x * 3 + h) % 29 = 0",
    "behind": "y % 5 = 0", "poke": "CAST(h % 40 AS DOUBLE) / 100", "seam": "CAST(w % 9 AS DOUBLE)", "annotation_iou": "CAST(x % 12 AS DOUBLE) / 100",
}
_INST_0, _PR = _INST.strip().split("\npr AS")
_MEASURED_INST = f"""{_INST_0.replace("inst AS (", "inst_0 AS (", 1)}
inst AS (SELECT * REPLACE (kept AND coalesce(kind, 'pasted') <> 'hard_negative' AS kept) FROM (SELECT *, {", ".join(f"{e} AS {k}" for k, e in _FIELDS.items())} FROM inst_0)),
pr AS{_PR}"""
#: The bounds stand here once more, as text.
_MEASURED_REASONS = """
  UNION ALL SELECT image_id, 'BAD_MASK_COVERAGE', 3.5, ann_id, 1 FROM inst WHERE kept AND coverage NOT BETWEEN CASE cls WHEN 'helmet' THEN 0.2 WHEN 'head' THEN 0.3 ELSE 0.15 END AND CASE cls WHEN 'person' THEN 0.85 ELSE 0.9 END
  UNION ALL SELECT image_id, 'SAM2_MASK_REJECTED', 3.5, ann_id, 2 FROM inst WHERE kept AND coalesce(kind, 'pasted') = 'pasted' AND NOT mask_ok
  UNION ALL SELECT image_id, 'PLACEMENT_RETRIES_EXHAUSTED', 3.5, ann_id, 3 FROM inst WHERE kept AND retries_exhausted
  UNION ALL SELECT image_id, 'BAD_SIZE_RATIO', 5.5, 0, 0 FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ai ORDER BY bi) AS k FROM pr WHERE ac IN ('head', 'helmet') AND bc = 'person' AND i / greatest(aw * ah, 1) >= 0.6) WHERE k = 1
    AND (aw * ah / greatest(bw * bh, 1) NOT BETWEEN 0.02 AND CASE ac WHEN 'head' THEN 0.4 ELSE 0.6 END OR ac = 'head' AND (aw / greatest(bw, 1) NOT BETWEEN 0.2 AND 0.8 OR (ay - by_) / greatest(bh, 1) > 0.5))
  UNION ALL SELECT image_id, 'POKES_THROUGH', 6.5, ann_id, 1 FROM inst WHERE behind AND poke BETWEEN 0.05 AND 0.25
  UNION ALL SELECT image_id, 'SEAM_ARTIFACT', 6.5, ann_id, 2 FROM inst WHERE seam > 6
  UNION ALL SELECT image_id, 'HARD_NEGATIVE_OVERLAPS_ANNOTATION', 6.7, ann_id, 0 FROM inst WHERE kind = 'hard_negative' AND annotation_iou > 0.05"""
_MEASURED = f", {_MEASURED_INST}, inst_v AS (SELECT * FROM inst), pr_v AS (SELECT * FROM pr), rs AS ({_reasons_sql(_BASE)}{_MEASURED_REASONS}), "


def measured_records(spark, sf_dir):
    """``records`` whose instances have all measured fields."""
    return records(spark, sf_dir, **{k: F.expr(e.replace("<>", "!=")) for k, e in _FIELDS.items()})


@query(sql(_MEASURED + """
d AS (SELECT image_id, r, min(struct_pack(o1 := o1, o2 := o2, o3 := o3)) AS o FROM rs GROUP BY ALL)
SELECT i.image_id, coalesce(string_agg(r, ',' ORDER BY o), '') AS reject_reasons, arg_min(r, o) AS first_reason, count(r) = 0 AS passed
FROM (SELECT DISTINCT image_id FROM inst) i LEFT JOIN d USING (image_id) GROUP BY i.image_id"""))
def measured_record_filter(spark, sf_dir):
    """Every rule, those over measured masks, placement, sizes, seams and hard negatives too."""
    out = rules.judged_by_key(measured_records(spark, sf_dir), ["image_id"], measured={})
    return out.select("image_id", F.array_join("reject_reasons", ",").alias("reject_reasons"), "first_reason", "passed")


@query(sql(_MEASURED + "n AS (SELECT r, count(DISTINCT image_id) AS n FROM rs GROUP BY r) SELECT r AS reason, n FROM n"))
def measured_reason_counts(spark, sf_dir):
    """Records that each reason rejects, alone or among others."""
    return rules.reason_counts(measured_records(spark, sf_dir), ["image_id"], measured={})


@query(sql("""
, l AS (SELECT p.ann_id, count(*) AS n, min(struct_pack(ann_id := c.ann_id, x := c.x, y := c.y, w := c.w, h := c.h)) AS c FROM ann p JOIN ann c ON p.image_id = c.image_id AND p.cls = 'person' AND c.cls = 'helmet'
        AND c.x + c.w / 2 BETWEEN p.x AND p.x + p.w AND c.y + c.h / 2 BETWEEN p.y AND p.y + p.h * 0.55::DOUBLE GROUP BY p.ann_id)
SELECT p.ann_id, coalesce(n, 0) AS n_children, CASE WHEN n IS NULL THEN 'no_child' WHEN n > 1 THEN 'too_many_children' WHEN p.ann_id % 7 = 0 THEN 'NOT_PREFERRED_TIER' WHEN p.h < 60 THEN 'PERSON_TOO_SMALL' WHEN (p.y + p.h) / 416 < 0.6 THEN 'SOURCE_PERSON_TOO_HIGH'
         WHEN p.h / greatest(p.w, 1) < 1.25 THEN 'PERSON_TOO_HORIZONTAL' WHEN (c.y + c.h / 2 - p.y) / greatest(p.h, 1) > 0.3 THEN 'HEAD_TOO_LOW' WHEN c.w / greatest(p.w, 1) > 0.5 THEN 'HEAD_TOO_WIDE' END AS reason
FROM ann p LEFT JOIN l USING (ann_id) WHERE p.cls = 'person'"""))
def linked_unit_eligibility(spark, sf_dir):
    """Persons with exactly one helmet linked to them, then the first of the unit's own reasons."""
    ann = annotations(spark, sf_dir)
    units = rules.linked_units(ann.where("cls = 'person'"), ann.where("cls = 'helmet'"))
    no = F.lit(False)
    person = F.struct("cls", F.lit("train").alias("split"), (F.col("ann_id") % 7 != 0).alias("preferred"), no.alias("truncated"), no.alias("difficult"), *"xywh", F.lit(0.0).alias("touch_top"), F.lit(0.0).alias("touch_side"))
    own = F.get(rules.unit_reasons(person, F.col("child"), F.lit(416)), F.lit(0))
    return units.select("ann_id", "n_children", F.coalesce("link_reason", own).alias("reason"))
