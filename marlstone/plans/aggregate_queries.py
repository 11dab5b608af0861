"""Rank statistics, bootstrap, slices, quartiles, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.functions.hashing import hash_fold
from marlstone.operators import aggregates as agg
from marlstone.operators import bootstrap, probe
from marlstone.plans.fixtures import annotations, detections, images, sql, table
from marlstone.plans.registry import query

_SCORED = "s AS (SELECT l.doc_id, source, quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(d, "doc_id")


@query(f"""WITH {_SCORED},
c AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p FROM s GROUP BY score), r AS (SELECT *, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2 AS rank FROM c)
SELECT sum(p)::BIGINT AS n_pos, sum(n - p)::BIGINT AS n_neg, round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 9) AS auc FROM r""")
def roc_auc(spark, sf_dir):
    """Tie-corrected AUC."""
    return agg.roc_auc(scored(spark, sf_dir), "label", "score").select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, round(corr(a, b), 9) AS rho, count(*) AS n FROM r GROUP BY l_returnflag""")
def spearman(spark, sf_dir):
    """Rank correlation by group."""
    return agg.spearman(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), "l_quantity", "l_discount", "l_returnflag").select("l_returnflag", F.round("rho", 9).alias("rho"), "n")


@query(sql("SELECT cls, CASE WHEN count(*) FILTER (WHERE v > -1) = 0 THEN -1 ELSE round(avg(v) FILTER (WHERE v > -1), 6) END AS mean FROM (SELECT cls, CASE WHEN cls = 'person' OR ann_id % 3 = 0 THEN -1.0::DOUBLE ELSE CAST(w AS DOUBLE) END AS v FROM ann) GROUP BY cls"))
def mean_of_defined(spark, sf_dir):
    rows = annotations(spark, sf_dir).select("cls", F.when((F.col("cls") == "person") | (F.col("ann_id") % 3 == 0), F.lit(-1.0)).otherwise(F.col("w").cast("double")).alias("v"))
    return rows.groupBy("cls").agg(F.round(agg.mean_of_defined("v"), 6).alias("mean"))


@query(sql("""
, r AS (SELECT w, h, w * h AS area, row_number() OVER (PARTITION BY cls ORDER BY w * h, ann_id) AS k, count(*) OVER (PARTITION BY cls) AS n, cls FROM ann)
SELECT cls, round(median(w) FILTER (WHERE k <= greatest(n // 4, 1)), 6) AS low_w, round(median(w) FILTER (WHERE k > n - greatest(n // 4, 1)), 6) AS high_w, round(avg(CAST(w > h AS INT)) FILTER (WHERE k <= greatest(n // 4, 1)), 6) AS low_wide FROM r GROUP BY cls"""))
def quartile_summary(spark, sf_dir):
    """Bottom and top quarter of each class by area."""
    rows = annotations(spark, sf_dir).withColumn("area", g.area(g.box()).cast("long"))
    n = rows.groupBy("cls").agg(F.greatest(F.floor(F.count("*") / 4), F.lit(1)).alias("q"), F.count("*").alias("n"))
    ranked = agg.running_sum(rows.withColumn("one", F.lit(1)), "one", ["area", "ann_id"], ["cls"]).withColumn("k", F.col("__before") + 1).join(F.broadcast(n), "cls")
    low, high = F.col("k") <= F.col("q"), F.col("k") > F.col("n") - F.col("q")
    mid = lambda test, c: F.round(F.percentile(F.when(test, F.col(c)), 0.5), 6)
    return ranked.groupBy("cls").agg(mid(low, "w").alias("low_w"), mid(high, "w").alias("high_w"), F.round(F.avg(F.when(low, (F.col("w") > F.col("h")).cast("int"))), 6).alias("low_wide"))


@query(sql("""
, sl AS (SELECT image_id, 'all' AS slice FROM image UNION ALL SELECT image_id, 'odd' FROM image WHERE image_id % 2 = 1 UNION ALL SELECT image_id, 'urgent' FROM image WHERE scenario = '1-URGENT')
SELECT slice, arm, count(*) AS n, round(avg(score), 6) AS mean_score FROM det JOIN sl USING (image_id) GROUP BY slice, arm"""))
def slice_metrics(spark, sf_dir):
    """One pass over overlapping slices."""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("image_id") % 2 == 1, F.lit("odd")), F.when(F.col("scenario") == "1-URGENT", F.lit("urgent"))))
    sl = images(spark, sf_dir).select("image_id", F.explode(names).alias("slice"))
    return detections(spark, sf_dir).join(sl, "image_id").groupBy("slice", "arm").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(sql("""
, m AS (SELECT image_id % 2 = 1 AS a, scenario = '1-URGENT' AS b, width = 415 AND height = 415 AS c FROM image),
h AS (SELECT CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS k FROM m)
SELECT v.k AS memberships, count(h.k) AS n FROM (VALUES (0), (1), (2), (3)) v(k) LEFT JOIN h ON v.k = h.k GROUP BY v.k"""))
def slice_memberships(spark, sf_dir):
    """How many slices an image is in, zero-filled."""
    k = (F.col("image_id") % 2 == 1).cast("int") + (F.col("scenario") == "1-URGENT").cast("int") + ((F.col("width") == 415) & (F.col("height") == 415)).cast("int")
    counts = images(spark, sf_dir).groupBy(k.alias("memberships")).agg(F.count("*").alias("n"))
    return agg.zero_filled(counts, spark.createDataFrame([(i,) for i in range(4)], "memberships int"), "memberships")


@query(sql("SELECT count(*) FILTER (WHERE image_id % 2 = 1 AND scenario = '1-URGENT') AS ab, count(*) FILTER (WHERE image_id % 2 = 1 AND width = 415) AS ac, count(*) FILTER (WHERE scenario = '1-URGENT' AND width = 415) AS bc FROM image"))
def slice_overlaps(spark, sf_dir):
    a, b, c = F.col("image_id") % 2 == 1, F.col("scenario") == "1-URGENT", F.col("width") == 415
    return images(spark, sf_dir).agg(F.count_if(a & b).alias("ab"), F.count_if(a & c).alias("ac"), F.count_if(b & c).alias("bc"))


@query("SELECT p_brand, sha256(string_agg(p_name, chr(10) ORDER BY p_name)) AS names_sha256, count(*) AS n, greatest(1, count(*) // 16) * 3 AS steps FROM part GROUP BY p_brand")
def delivered_summary(spark, sf_dir):
    """Digest of the sorted names, counts and derived steps."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p_name")), "\n"), 256).alias("names_sha256"), F.count("*").alias("n"), (F.greatest(F.lit(1), F.expr("count(*) div 16")) * 3).alias("steps"))


@query("SELECT props_kind AS path, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT event_type AS props_kind, max(round(value)) AS value FROM events GROUP BY event_type, user_id) GROUP BY props_kind")
def distinct_object_sums(spark, sf_dir):
    """One value for each object, then sums by area."""
    one = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max(F.round("value")).alias("value"))
    return one.groupBy(F.col("event_type").alias("path")).agg(F.sum("value").alias("total"))


@query()
def bootstrap_interval(spark, sf_dir):
    """Percentile interval of a rate over resampled images; draws are undefined where the denominator is 0."""
    per_image = detections(spark, sf_dir).where("arm = 0").groupBy("image_id").agg(F.count_if(F.col("score") >= 0.5).alias("part"), F.count("*").alias("whole"))
    return bootstrap.rate_interval(per_image, "image_id", "part", "whole", seed=1337)


def probed(spark, sf_dir):
    """vec_id, features, label (classes of odd number against even ones), pair (vectors that belong together)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).alias("label"))
    return rows.withColumn("pair", F.floor(F.col("vec_id") / 2))


@query()
def probe_auc(spark, sf_dir):
    """A linear probe's area under the ROC curve on pairs that its fit hasn't seen, with its interval; tests hold the fit against a dense one."""
    return probe.held_out_auc(probed(spark, sf_dir), "features", "label", "pair")


@query()
def probe_scores(spark, sf_dir):
    """Each vector's score by the probe, and whether its pair was held out."""
    rows = probed(spark, sf_dir)
    fitted, _ = probe.evaluated(rows, "features", "label", "pair")
    return rows.select("vec_id", (hash_fold(1337, F.col("pair"), 5, ":") == 0).alias("held_out"), F.round(fitted.score("features"), 6).alias("score"))
