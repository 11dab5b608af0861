"""Selections, verdicts, curves, set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import analysis
from marlstone.plans.fixtures import annotations, detections, images, sql, table
from marlstone.plans.registry import query


@query(sql("""
, gr AS (SELECT s / 10.0::DOUBLE AS min_score, a * 500 AS min_area FROM range(1, 10) t(s), range(0, 4) u(a))
SELECT min_score, min_area, count(det_id) AS n, round(coalesce(avg(score), 0), 6) AS mean_score FROM gr LEFT JOIN det ON arm = 0 AND score >= min_score AND w * h >= min_area GROUP BY ALL"""))
def threshold_grid(spark, sf_dir):
    """Every combination of two thresholds, from one pass: rows are counted in the grid cells that they pass."""
    det = detections(spark, sf_dir).where("arm = 0").select("score", (F.col("w") * F.col("h")).alias("area"))
    return analysis.grid(det, {"min_score": ("score", [s / 10 for s in range(1, 10)]), "min_area": ("area", [0, 500, 1000, 1500])}, "score").withColumn("min_area", F.col("min_area").cast("long"))


@query(sql("""
, s AS (SELECT o_orderpriority AS arm, avg(o_totalprice) AS f1, count(*) AS n FROM orders GROUP BY 1)
SELECT arm, n FROM s WHERE n >= 2900 ORDER BY f1 DESC, n DESC, arm LIMIT 1"""))
def best_candidate(spark, sf_dir):
    """Lexicographic choice over a floor."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.avg("o_totalprice").alias("f1"), F.count("*").alias("n"))
    return analysis.first_by(s.where("n >= 2900"), F.desc("f1"), F.desc("n"), F.col("arm")).select("arm", "n")


@query("""
WITH m AS (SELECT n_name AS arm, count(*) AS n, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
b AS (SELECT total / n AS base FROM m WHERE arm = (SELECT min(arm) FROM m))
SELECT arm, total / n > base AS better FROM m, b WHERE arm <> (SELECT min(arm) FROM m)""")
def versus_baseline(spark, sf_dir):
    """Strictly better than the baseline arm or not."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.groupBy(F.col("n_name").alias("arm")).agg((F.sum("c_acctbal") / F.count("*")).alias("value"))
    return analysis.versus(m, "arm", "value", m.agg(F.min("arm")).first()[0]).select("arm", "better")


_CURVE = """c AS (SELECT event_type AS arm, user_id % 50 AS step, max(value) AS value FROM events WHERE (user_id % 50) % 3 <> 1 GROUP BY event_type, user_id % 50)"""


def curves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 50).alias("step"), "value").where("step % 3 <> 1")
    return e.groupBy("arm", "step").agg(F.max("value").alias("value"))


@query(f"""WITH {_CURVE},
seg AS (SELECT arm, step AS x0, value AS y0, lead(step) OVER w AS x1, lead(value) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY arm ORDER BY step)),
gr AS (SELECT g AS x FROM range(0, 50) t(g)), arms AS (SELECT DISTINCT arm FROM c)
SELECT arms.arm, x, round(CASE WHEN x = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 6) AS value FROM arms CROSS JOIN gr LEFT JOIN seg ON seg.arm = arms.arm AND (x >= x0 AND x < x1 OR x = x0 AND x1 IS NULL)""")
def interpolated_curves(spark, sf_dir):
    """Each arm's curve on a grid, piecewise linear, null outside its range."""
    return analysis.interpolated(curves(spark, sf_dir), "arm", "step", "value", list(range(50))).select("arm", F.col("x").cast("long").alias("x"), F.round("value", 6).alias("value"))


@query(f"""WITH {_CURVE},
p AS (SELECT a.step, a.value - b.value AS lead_ FROM c a JOIN c b ON a.step = b.step AND a.arm = (SELECT min(arm) FROM c) AND b.arm = (SELECT max(arm) FROM c))
SELECT max(step) FILTER (WHERE lead_ > 0) AS last_lead, round(max(lead_), 6) AS most, arg_max(step, struct_pack(l := lead_, s := -step)) AS at FROM p""")
def crossover(spark, sf_dir):
    """The last step where the challenger leads, its largest lead and the first step of it."""
    c = curves(spark, sf_dir)
    names = c.agg(F.min("arm"), F.max("arm")).first()
    return analysis.crossover(c, "arm", "step", "value", names[0], names[1])


@query("SELECT event_type, round(quantile_cont(value, 0.95) / quantile_cont(value, 0.5), 6) AS ratio, quantile_cont(value, 0.95) / quantile_cont(value, 0.5) > 1.5 AS contended FROM events GROUP BY event_type")
def contention(spark, sf_dir):
    """Tail over median, against a limit."""
    ratio = F.percentile("value", 0.95) / F.percentile("value", 0.5)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(ratio, 6).alias("ratio"), (ratio > 1.5).alias("contended"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL THEN 'absent' WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'conflict' WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'resumable' END AS state FROM orders""")
def run_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus").isNull(), "absent").when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), "conflict").when(F.col("o_orderstatus") == "F", "complete").otherwise("resumable")
    return o.select("o_orderkey", state.alias("state"))


@query(sql("""
, a AS (SELECT DISTINCT image_id FROM ann WHERE cls = 'helmet'), b AS (SELECT DISTINCT image_id FROM ann WHERE cls = 'head'), c AS (SELECT DISTINCT image_id FROM ann WHERE cls = 'person')
(SELECT image_id FROM a EXCEPT SELECT image_id FROM b) UNION SELECT image_id FROM c INTERSECT SELECT image_id FROM b"""))
def set_algebra(spark, sf_dir):
    """(helmets without heads) together with (persons with heads)."""
    ids = lambda cls: annotations(spark, sf_dir).where(F.col("cls") == cls).select("image_id")
    return ids("helmet").subtract(ids("head")).union(ids("person").intersect(ids("head"))).distinct()


@query(sql("SELECT (SELECT count(*) FROM (SELECT image_id FROM image EXCEPT SELECT image_id FROM ann)) AS only_images, (SELECT count(*) FROM (SELECT image_id FROM ann EXCEPT SELECT image_id FROM image)) AS only_annotations"))
def key_set_difference(spark, sf_dir):
    return analysis.key_difference(images(spark, sf_dir), annotations(spark, sf_dir), "image_id", "only_images", "only_annotations")


@query("""
WITH old AS (SELECT event_type AS metric, user_id % 5 AS arm, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL), new AS (SELECT 'click' AS metric, arm, value * 2 AS value FROM old WHERE metric = 'click')
SELECT metric, arm, value FROM old WHERE metric <> 'click' UNION ALL SELECT metric, arm, value FROM new""")
def owned_replacement(spark, sf_dir):
    """Rows of the owned metrics are replaced, others stay."""
    old = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("arm")).agg(F.count("*").cast("double").alias("value"))
    return analysis.replaced(old, old.where("metric = 'click'").withColumn("value", F.col("value") * 2), "metric", ["click"])


@query(sql("SELECT image_id, ann_id, cls FROM ann SEMI JOIN (SELECT image_id FROM image WHERE scenario = '1-URGENT') i USING (image_id)"))
def subset_projection(spark, sf_dir):
    """Images by a condition, cascading to their annotations."""
    kept = images(spark, sf_dir).where("scenario = '1-URGENT'")
    return annotations(spark, sf_dir).join(kept, "image_id", "left_semi").select("image_id", "ann_id", "cls")


@query(sql("""
, s AS (SELECT d.arm, d.image_id % 10 AS clip, d.image_id AS frame, count(*) FILTER (WHERE cls = 'helmet') AS ok, count(*) FILTER (WHERE cls <> 'person') AS n FROM det d GROUP BY ALL)
SELECT arm, clip, count(*) AS frames, round(avg(ok / nullif(n, 0)), 6) AS mean_rate FROM s GROUP BY arm, clip"""))
def clip_rates(spark, sf_dir):
    """Mean over frames of the defined compliance rates."""
    s = detections(spark, sf_dir).groupBy("arm", (F.col("image_id") % 10).alias("clip"), "image_id").agg(F.count_if(F.col("cls") == "helmet").alias("ok"), F.count_if(F.col("cls") != "person").alias("n"))
    return s.groupBy("arm", "clip").agg(F.count("*").alias("frames"), F.round(F.avg(F.try_divide("ok", "n")), 6).alias("mean_rate"))
