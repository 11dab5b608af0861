"""Train context, guards on surroundings, coverage, targeting, consistency of records, merged settings, named statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import context
from marlstone.plans.fixtures import annotations, detections, images, sql, table
from marlstone.plans.registry import query

_SPLIT = "CASE WHEN image_id % 10 < 8 THEN 'train' WHEN image_id % 10 = 8 THEN 'val' ELSE 'test' END"
_BLOCKED = "image_id % 30 = 9 OR image_id % 100 = 5"


def _context(spark, sf_dir):
    """images, manifest, blocked."""
    own = images(spark, sf_dir)
    return own, own.select("image_id", F.expr(_SPLIT).alias("split")), own.where(_BLOCKED).select("image_id")


@query(sql(f"""
SELECT image_id, scenario, coalesce(ids, '') AS ann_ids FROM image LEFT JOIN (SELECT image_id, string_agg(ann_id, ',' ORDER BY ann_id) AS ids FROM ann GROUP BY image_id) USING (image_id)
WHERE {_SPLIT} = 'train' AND NOT ({_BLOCKED})"""))
def train_context(spark, sf_dir):
    """Train images that are not blocked, with their annotations in order."""
    own, manifest, blocked = _context(spark, sf_dir)
    out = context.train_context(own, manifest, annotations(spark, sf_dir), blocked, "image_id", "ann_id")
    return out.select("image_id", "scenario", F.array_join(F.transform("annotations", lambda a: a["ann_id"].cast("string")), ",").alias("ann_ids"))


@query(sql(f"""
, m AS (SELECT image_id, {_SPLIT} AS split FROM image), s AS (SELECT DISTINCT image_id FROM ann WHERE cls = 'helmet')
SELECT 0 AS only_images, 0 AS only_manifest, count(*) FILTER (WHERE split = 'train' AND ({_BLOCKED})) AS train_blocked,
       (SELECT count(*) FROM s LEFT JOIN m USING (image_id) WHERE split IS DISTINCT FROM 'train') AS sources_outside_train FROM m"""))
def context_problems(spark, sf_dir):
    """Key sets, blocked train images and bank sources outside of train, counted."""
    own, manifest, blocked = _context(spark, sf_dir)
    return context.context_problems(own, manifest, blocked, annotations(spark, sf_dir).where("cls = 'helmet'"), "image_id")


@query(sql("""
, f AS (SELECT quantile_cont(w * h, 0.05) AS a0, quantile_cont(w * h, 0.95) AS a1, quantile_cont(w / h, 0.05) AS r0, quantile_cont(w / h, 0.95) AS r1 FROM ann WHERE cls = 'helmet')
SELECT ann_id, EXISTS (SELECT 1 FROM ann o WHERE o.image_id = a.image_id AND o.cls IN ('head', 'person') AND a.x + a.w / 2 BETWEEN o.x - 0.25 * o.w AND o.x + 1.25 * o.w
         AND CASE o.cls WHEN 'head' THEN o.y BETWEEN a.y + a.h - 0.25 * a.h AND a.y + a.h + 2.5 * a.h ELSE a.y + a.h BETWEEN o.y - 0.25 * a.h AND o.y + 0.5 * o.h END) AS below,
       NOT (w * h BETWEEN a0 AND a1 AND w / h BETWEEN r0 AND r1) AS atypical
FROM ann a, f WHERE cls = 'helmet'"""))
def candidate_guards(spark, sf_dir):
    """Helmets that are worn, by what lies below, and those of untypical size or shape."""
    ann = annotations(spark, sf_dir)
    helmets = ann.where("cls = 'helmet'")
    return context.atypical(context.something_below(helmets, ann, "image_id", "ann_id"), helmets).select("ann_id", "below", "atypical")


@query(sql("""
, c AS (SELECT ann_id, image_id, cls = 'person' AS person, greatest(x, 0) AS l, greatest(y, 0) AS t, least(x + w, width) AS r, least(y + h, height) AS b FROM ann JOIN image USING (image_id)),
o AS (SELECT a.ann_id, greatest(a.l, b.l) AS l, greatest(a.t, b.t) AS t, least(a.r, b.r) AS r, least(a.b, b.b) AS b FROM c a JOIN c b USING (image_id, person)
      WHERE a.ann_id <> b.ann_id AND least(a.r, b.r) > greatest(a.l, b.l) AND least(a.b, b.b) > greatest(a.t, b.t)),
e AS (SELECT ann_id, l AS x FROM o UNION SELECT ann_id, r FROM o),
s AS (SELECT ann_id, x AS x0, lead(x) OVER (PARTITION BY ann_id ORDER BY x) AS x1 FROM e),
v AS (SELECT ann_id, x0, x1, t, b, max(b) OVER (PARTITION BY ann_id, x0 ORDER BY t, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s JOIN o USING (ann_id) WHERE o.l <= x0 AND o.r >= x1),
u AS (SELECT ann_id, sum((x1 - x0) * greatest(0, b - greatest(t, coalesce(seen, t)))) AS n FROM v GROUP BY ann_id)
SELECT ann_id, round(coalesce(n, 0) / greatest(greatest(r - l, 0) * greatest(b - t, 0), 1), 6) AS covered FROM c LEFT JOIN u USING (ann_id)"""))
def covered_share(spark, sf_dir):
    """How much of a box the union of others hides."""
    out = context.covered_share(annotations(spark, sf_dir), images(spark, sf_dir), "image_id", "ann_id")
    return out.select("ann_id", F.round("covered", 6).alias("covered"))


@query(sql("""
, share AS (SELECT scenario, count(*) AS share FROM image GROUP BY scenario), slice AS (SELECT * FROM (VALUES ('1-URGENT', 'helmet'), ('2-HIGH', 'head'), ('3-MEDIUM', 'person'))  v(scenario, slice)),
side AS (SELECT cls AS slice, arm, count(*) AS n, sum(w * h) AS a, count(*) FILTER (WHERE score >= 0.5) AS k FROM det GROUP BY ALL),
d AS (SELECT o.metric, n.slice, CASE o.metric WHEN 'count' THEN n.n - b.n WHEN 'area' THEN n.a - b.a ELSE n.k - b.k END AS delta FROM side n JOIN side b ON n.slice = b.slice AND n.arm = 1 AND b.arm = 0, (VALUES ('count'), ('area'), ('confident')) o(metric)),
t AS (SELECT scenario AS tested, slice AS target FROM share JOIN slice USING (scenario) ORDER BY share DESC, scenario LIMIT 1), l AS (SELECT scenario AS leader FROM share ORDER BY share DESC, scenario LIMIT 1),
g AS (SELECT metric, leader, tested, target, max(delta) FILTER (WHERE slice = target) AS target_delta, max(delta) FILTER (WHERE slice <> target) AS best_other FROM d, t, l GROUP BY ALL)
SELECT metric, leader, tested, target, CAST(target_delta AS BIGINT) AS target_delta, CAST(best_other AS BIGINT) AS best_other,
       CASE WHEN target_delta <= 0 THEN 'target_slice_did_not_improve' WHEN target_delta > best_other THEN 'targeted' ELSE 'more_data_not_targeted' END AS verdict FROM g"""))
def targeting_verdict(spark, sf_dir):
    """Whether the scenario with the largest share of a budget gained most, for three metrics."""
    shares = images(spark, sf_dir).groupBy("scenario").agg(F.count("*").alias("share"))
    slices = spark.createDataFrame([("1-URGENT", "helmet"), ("2-HIGH", "head"), ("3-MEDIUM", "person")], "scenario string, slice string")
    sign = F.expr("case arm when 1 then 1 else -1 end")
    side = detections(spark, sf_dir).groupBy(F.col("cls").alias("slice")).agg(F.sum(sign).alias("count"), F.sum(sign * g.area(g.box())).alias("area"), F.sum(F.when(F.col("score") >= 0.5, sign).otherwise(0)).alias("confident"))
    deltas = side.unpivot("slice", ["count", "area", "confident"], "metric", "delta")
    return context.targeting_verdict(shares, slices, deltas)


@query(sql("""
, a AS (SELECT image_id, count(*) AS n, sum(w * h) AS area FROM ann WHERE cls <> 'person' GROUP BY image_id), b AS (SELECT image_id, count(*) AS n, sum(w * h) AS area FROM det WHERE arm = 0 AND cls <> 'person' GROUP BY image_id)
SELECT image_id, CASE WHEN b.n IS NULL THEN 'not_derived' WHEN a.n IS NULL THEN 'not_recorded' WHEN a.n = b.n AND a.area = b.area THEN 'equal'
       ELSE concat_ws(',', CASE WHEN a.n <> b.n THEN 'n' END, CASE WHEN a.area <> b.area THEN 'area' END) END AS status FROM a FULL JOIN b USING (image_id)"""))
def record_consistency(spark, sf_dir):
    """Recorded sums of an image against those derived from an arm."""
    sums = lambda rows: rows.where("cls <> 'person'").groupBy("image_id").agg(F.count("*").alias("n"), F.sum(g.area(g.box())).alias("area"))
    return context.record_consistency(sums(annotations(spark, sf_dir)), sums(detections(spark, sf_dir).where("arm = 0")), "image_id", ["n", "area"])


@query(sql("""
, p AS (SELECT image_id, unnest([struct_pack(s := 'frame', k := 'width', v := CASE WHEN image_id % 3 = 0 THEN '400' ELSE CAST(width AS VARCHAR) END), struct_pack(s := 'frame', k := 'height', v := CAST(height AS VARCHAR)),
          struct_pack(s := 'tags', k := 'scenario', v := scenario), struct_pack(s := CASE WHEN image_id % 3 = 0 THEN 'extra' ELSE NULL END, k := 'group', v := CAST(image_id % 7 AS VARCHAR))]) AS r FROM image)
SELECT image_id, r.s AS section, r.k AS key, r.v AS value FROM p WHERE r.s IS NOT NULL"""))
def merged_settings(spark, sf_dir):
    """An image's settings under those of its group: the group's values win, sections merge."""
    text = lambda c: F.col(c).cast("string")
    base = F.create_map(F.lit("frame"), F.create_map(F.lit("width"), text("width"), F.lit("height"), text("height")), F.lit("tags"), F.create_map(F.lit("scenario"), F.col("scenario")))
    override = F.create_map(F.lit("frame"), F.create_map(F.lit("width"), F.lit("400")), F.lit("extra"), F.create_map(F.lit("group"), (F.col("image_id") % 7).cast("string")))
    own = images(spark, sf_dir)
    merged = own.withColumn("base", base).withColumn("over", F.when(F.col("image_id") % 3 == 0, override).otherwise(F.create_map().cast("map<string,map<string,string>>")))
    sections = merged.select("image_id", F.explode(context.deep_merge(F.col("base"), F.col("over"), 2)).alias("section", "entries"))
    return sections.select("image_id", "section", F.explode("entries").alias("key", "value"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS max FROM events GROUP BY event_type")
def named_statistics(spark, sf_dir):
    """Statistics chosen by name."""
    rounded = lambda n: F.round(context.statistic(n, "value"), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[rounded(n).alias(n) for n in ("mean", "median")], context.statistic("max", "value").alias("max"))
