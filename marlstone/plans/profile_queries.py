"""Class, size and geometry profiles of a ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.operators import aggregates as agg
from marlstone.plans.fixtures import annotations, detections, images, sql, table
from marlstone.plans.registry import query

_CLOSED = "(VALUES ('all', 0, 100000000), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 100000000)) b(bucket, lo, hi)"


@query(sql(f"""
SELECT cls AS class_name, bucket, count(*) AS n_instances, count(DISTINCT image_id) AS n_images
FROM ann JOIN {_CLOSED} ON w * h BETWEEN lo AND hi GROUP BY cls, bucket"""))
def class_bucket_counts(spark, sf_dir):
    """Instances and images for each class and closed area range."""
    rows = agg.in_ranges(annotations(spark, sf_dir), g.area(g.box()))
    return rows.groupBy(F.col("cls").alias("class_name"), "bucket").agg(F.count("*").alias("n_instances"), F.countDistinct("image_id").alias("n_images"))


@query(sql("""
SELECT c.cls, b.bucket, count(a.ann_id) AS n FROM (VALUES ('helmet'), ('head'), ('person'), ('vest')) c(cls), (VALUES ('small'), ('medium'), ('large')) b(bucket)
LEFT JOIN (SELECT ann_id, cls, CASE WHEN w * h < 1024 THEN 'small' WHEN w * h < 9216 THEN 'medium' ELSE 'large' END AS bucket FROM ann) a ON a.cls = c.cls AND a.bucket = b.bucket
GROUP BY ALL"""))
def half_open_bucket_counts(spark, sf_dir):
    """Counts in half-open buckets, zero-filled over the whole domain of classes and buckets."""
    ranges = [("small", 0, 1024), ("medium", 1024, 9216), ("large", 9216, 10**9)]
    counts = annotations(spark, sf_dir).groupBy("cls", g.bucket_half_open(g.area(g.box()), ranges).alias("bucket")).agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(c, b) for c in ("helmet", "head", "person", "vest") for b, _, _ in ranges], "cls string, bucket string")
    return agg.zero_filled(counts, domain, "cls", "bucket")


@query(sql("SELECT cls, count(*) FILTER (WHERE w * h < 1024) AS small, count(*) FILTER (WHERE w * h >= 1024 AND w * h < 9216) AS medium, count(*) FILTER (WHERE w * h >= 9216) AS large FROM ann GROUP BY cls"))
def class_bucket_pivot(spark, sf_dir):
    ranges = [("small", 0, 1024), ("medium", 1024, 9216), ("large", 9216, 10**9)]
    rows = annotations(spark, sf_dir).withColumn("bucket", g.bucket_half_open(g.area(g.box()), ranges))
    return rows.groupBy("cls").pivot("bucket", ["small", "medium", "large"]).count().na.fill(0)


@query(sql("SELECT cls, count(DISTINCT image_id) AS n_images, count(*) AS n FROM ann GROUP BY cls"))
def images_per_class(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("cls").agg(F.countDistinct("image_id").alias("n_images"), F.count("*").alias("n"))


@query(sql("""
SELECT cls, count(*) AS n, CAST(min(w * h) AS DOUBLE) AS least, CAST(max(w * h) AS DOUBLE) AS most, round(avg(w * h), 6) AS mean,
       round(quantile_cont(w * h, 0.05), 6) AS p5, round(quantile_cont(w * h, 0.5), 6) AS p50, round(quantile_cont(w * h, 0.95), 6) AS p95 FROM ann GROUP BY cls"""))
def area_percentiles(spark, sf_dir):
    """Descriptive statistics with linearly interpolated percentiles."""
    rows = annotations(spark, sf_dir).withColumn("area", g.area(g.box()).cast("double"))
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.min("area").alias("least"), F.max("area").alias("most"), F.round(F.avg("area"), 6).alias("mean"), *agg.percentiles("area", 0.05, 0.5, 0.95))


@query(sql("""
SELECT scenario, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM image SEMI JOIN ann USING (image_id) GROUP BY scenario"""))
def scenario_shares(spark, sf_dir):
    """Share of the annotated images by scenario."""
    kept = images(spark, sf_dir).join(annotations(spark, sf_dir).select("image_id"), "image_id", "left_semi")
    counts = kept.groupBy("scenario").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("scenario", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(sql("""
, c AS (
  SELECT cls, CAST(floor(least(greatest((x + w / 2.0::DOUBLE) / 416, 0), 1 - 1e-9) * 16) AS INT) AS cx, CAST(floor(least(greatest((y + h / 2.0::DOUBLE) / 416, 0), 1 - 1e-9) * 16) AS INT) AS cy FROM ann),
grid AS (SELECT cls, i, j FROM (SELECT DISTINCT cls FROM c), range(16) a(i), range(16) b(j)),
k AS (SELECT grid.cls, i, j, count(c.cx) + 1 AS n FROM grid LEFT JOIN c ON c.cls = grid.cls AND c.cx = i AND c.cy = j GROUP BY ALL),
t AS (SELECT cls, n, sum(n) OVER (PARTITION BY cls) AS total FROM k)
SELECT cls, round(sum(-(n / total) * ln(n / total)) / ln(256), 6) AS entropy, round(max(n / total), 6) AS peak FROM t GROUP BY cls"""))
def centre_entropy(spark, sf_dir):
    """Entropy and peak of the centres' 16 x 16 histogram."""
    cx, cy = g.centre(g.box())
    rows = annotations(spark, sf_dir).select("cls", (cx / 416).alias("cx"), (cy / 416).alias("cy"))
    return agg.centre_entropy(rows, 16, "cls").select("cls", F.round("entropy", 6).alias("entropy"), F.round("peak", 6).alias("peak"))


@query(sql("""
SELECT image_id, count(*) AS n, string_agg(CAST(ann_id AS VARCHAR), ',' ORDER BY ann_id) AS ann_ids,
       count(*) FILTER (WHERE cls = 'helmet') AS helmet, count(*) FILTER (WHERE cls = 'head') AS head, count(*) FILTER (WHERE cls = 'person') AS person FROM ann GROUP BY image_id"""))
def image_group_stats(spark, sf_dir):
    """Members and class counts of each group, the classes complete."""
    grouped = annotations(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("ann_id")), lambda x: x.cast("string")), ",").alias("ann_ids"), *[F.count_if(F.col("cls") == c).alias(c) for c in ("helmet", "head", "person")])
    return grouped


@query(sql(", s AS (SELECT image_id, count(*) AS size FROM ann GROUP BY image_id) SELECT size, count(*) AS n_groups FROM s GROUP BY size"))
def group_size_histogram(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


@query(sql("SELECT image_id, count(*) AS size FROM ann GROUP BY image_id ORDER BY size DESC, image_id LIMIT 20"))
def largest_groups(spark, sf_dir):
    """The 20 largest groups (a report)."""
    return annotations(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "image_id").limit(20)


@query(sql("""
SELECT coalesce(cls, 'all classes') AS cls, coalesce(scenario, 'all scenarios') AS scenario, count(*) AS n FROM ann JOIN image USING (image_id) GROUP BY ROLLUP (cls, scenario)"""))
def class_scenario_rollup(spark, sf_dir):
    """Totals row by rollup."""
    rows = annotations(spark, sf_dir).join(images(spark, sf_dir), "image_id")
    return rows.rollup("cls", "scenario").agg(F.count("*").alias("n")).select(F.coalesce("cls", F.lit("all classes")).alias("cls"), F.coalesce("scenario", F.lit("all scenarios")).alias("scenario"), "n")


@query(sql("""
SELECT arm, cls, count(*) AS n, count(*) FILTER (WHERE score >= 0.5) AS n_over, round(count(*) FILTER (WHERE score >= 0.5 AND cls = 'head') / nullif(count(*) FILTER (WHERE cls = 'head'), 0), 6) AS head_rate
FROM det WHERE cls <> 'person' GROUP BY arm, cls"""))
def conditional_rates(spark, sf_dir):
    """Counts and rates by condition; a rate without a denominator is null."""
    rows = detections(spark, sf_dir).where("cls <> 'person'")
    over, head = F.col("score") >= 0.5, F.col("cls") == "head"
    return rows.groupBy("arm", "cls").agg(F.count("*").alias("n"), F.count_if(over).alias("n_over"), F.round(agg.rate(F.count_if(over & head), F.count_if(head)), 6).alias("head_rate"))


@query("""
SELECT least_bucket, metric, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM (
  SELECT CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'mid' ELSE 'high' END AS least_bucket, metric, v
  FROM (SELECT l_quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (v FOR metric IN (price, discount, tax)))
GROUP BY least_bucket, metric""")
def strata_metric_percentiles(spark, sf_dir):
    """Percentiles of each metric in each stratum, over an unpivot."""
    rows = table(spark, sf_dir, "lineitem").select(F.expr("case when l_quantity < 17 then 'low' when l_quantity < 34 then 'mid' else 'high' end").alias("least_bucket"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = rows.unpivot(["least_bucket"], ["price", "discount", "tax"], "metric", "v")
    return agg.grouped_percentiles(long, "v", ["least_bucket", "metric"], 0.1, 0.5, 0.9)
