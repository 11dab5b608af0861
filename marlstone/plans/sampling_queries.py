"""Hash ranks, folds, strata, quotas, ranks within groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.functions import hashing as h
from marlstone.operators import joins, sampling
from marlstone.plans.fixtures import annotations, detections, images, sql, table
from marlstone.plans.registry import query


@query(sql("SELECT image_id, sha256('1337|' || image_id) AS by_bar, sha256('1337:' || image_id) AS by_colon FROM image"))
def hash_ranks(spark, sf_dir):
    i = F.col("image_id")
    return images(spark, sf_dir).select(i, h.hash_hex(1337, i).alias("by_bar"), h.hash_hex(1337, i, ":").alias("by_colon"))


@query(sql("SELECT image_id, CAST(('0x' || substr(sha256('7|' || image_id), 1, 16))::UBIGINT % 5 AS INT) AS fold FROM image"))
def hash_folds(spark, sf_dir):
    return images(spark, sf_dir).select("image_id", h.hash_fold(7, F.col("image_id"), 5).alias("fold"))


@query(sql("SELECT image_id FROM image ORDER BY sha256('11|' || image_id), image_id LIMIT 100"))
def hash_sample(spark, sf_dir):
    """A hundred images without a random generator (the sample is the feature)."""
    return sampling.top_by_hash(images(spark, sf_dir), "image_id", 100, 11).select("image_id")


@query(sql("SELECT image_id, arg_min(ann_id, struct_pack(h := sha256('3|' || ann_id), i := ann_id)) AS ann_id FROM ann GROUP BY image_id"))
def group_representatives(spark, sf_dir):
    return sampling.representative(annotations(spark, sf_dir), "image_id", "ann_id", 3)


@query(sql("SELECT ann_id, CAST(ntile(4) OVER (ORDER BY w * h, ann_id) AS INT) AS tile FROM ann"))
def quartile_strata(spark, sf_dir):
    rows = annotations(spark, sf_dir).select("ann_id", g.area(g.box()).alias("area"))
    return sampling.tiles(rows, ["area", "ann_id"], 4).select("ann_id", "tile")


@query(sql("""
, s AS (SELECT scenario, count(*) AS n, sum(count(*)) OVER () AS total FROM image GROUP BY scenario), q AS (SELECT scenario, n, 500 * n / total AS exact, round_even(500 * n / total, 0) AS q FROM s),
d AS (SELECT *, CAST(500 - sum(q) OVER () AS BIGINT) AS missing FROM q),
f AS (SELECT *, row_number() OVER (ORDER BY sign(missing) * (exact - q) DESC, scenario DESC) AS k FROM d),
z AS (SELECT scenario, q + CASE WHEN k <= abs(missing) THEN sign(missing) ELSE 0 END AS quota FROM f),
r AS (SELECT image_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY sha256('5|' || image_id), image_id) AS rank FROM image)
SELECT image_id, scenario FROM r JOIN z USING (scenario) WHERE rank <= quota"""))
def stratified_sample(spark, sf_dir):
    """Five hundred images by scenario quotas."""
    return sampling.stratified(images(spark, sf_dir), "scenario", "image_id", 500, 5).select("image_id", "scenario")


@query(sql(", r AS (SELECT image_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY image_id) AS k FROM image) SELECT image_id, scenario FROM r ORDER BY k, scenario LIMIT 50"))
def round_robin_pick(spark, sf_dir):
    return sampling.round_robin(images(spark, sf_dir), "scenario", "image_id", 50).select("image_id", "scenario")


@query("""
SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS k, count(*) OVER () AS n FROM part) WHERE k <= n * 10 // 100""")
def lowest_decile(spark, sf_dir):
    return sampling.lowest_share(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 10).select("p_partkey")


@query(sql(", r AS (SELECT arm, cls, det_id, row_number() OVER (PARTITION BY arm, cls ORDER BY score DESC, det_id, x, y) AS rank FROM det) SELECT arm, cls, det_id, rank FROM r WHERE rank <= 5"))
def top_per_class(spark, sf_dir):
    """The five best detections of each arm and class."""
    out = sampling.first_in_group(detections(spark, sf_dir), ["arm", "cls"], [F.desc("score"), F.col("det_id"), F.col("x"), F.col("y")], 5)
    return out.select("arm", "cls", "det_id", F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT ann_id, row_number() OVER (PARTITION BY image_id ORDER BY y + h, ann_id) - 1 AS z FROM ann"))
def z_ranks(spark, sf_dir):
    rows = annotations(spark, sf_dir).withColumn("b", F.col("y") + F.col("h"))
    return sampling.first_in_group(rows, ["image_id"], [F.col("b"), F.col("ann_id")], 10**6, "z").select("ann_id", (F.col("z") - 1).cast("long").alias("z"))


@query(sql("""
, c AS (SELECT a.ann_id, bool_or(sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) / ((sqrt(a.w * a.h) + sqrt(b.w * b.h)) / 2) <= 1.5) AS near FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.ann_id <> b.ann_id GROUP BY a.ann_id)
SELECT ann_id, greatest(1.0::DOUBLE, CASE WHEN cls = 'head' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN w * h < 1024 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN coalesce(near, false) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM ann LEFT JOIN c USING (ann_id)"""))
def sampling_weights(spark, sf_dir):
    """The largest of the weights that apply; one of them for a close neighbour."""
    ann = annotations(spark, sf_dir)
    pairs = joins.pairs_in(ann, ann, ["image_id"]).where("l_ann_id <> r_ann_id")
    a, b = g.box("l_"), g.box("r_")
    (ax, ay), (bx, by) = g.centre(a), g.centre(b)
    apart = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / ((F.sqrt(g.area(a)) + F.sqrt(g.area(b))) / 2)
    near = pairs.groupBy(F.col("l_ann_id").alias("ann_id")).agg(F.bool_or(apart <= 1.5).alias("near"))
    one = F.lit(1.0)
    weight = F.greatest(one, F.when(F.col("cls") == "head", 2.0).otherwise(one), F.when(g.area(g.box()) < 1024, 1.5).otherwise(one), F.when(F.coalesce("near", F.lit(False)), 3.0).otherwise(one))
    return ann.join(near, "ann_id", "left").select("ann_id", weight.alias("weight"))


@query(sql("""
, a AS (SELECT ann_id, cls, CASE WHEN w * h < 1024 THEN 's' ELSE 'l' END AS bin FROM ann),
r AS (SELECT *, row_number() OVER (PARTITION BY bin, cls ORDER BY sha256('9|' || ann_id), ann_id) AS k FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY CASE WHEN k <= 4 THEN 0 ELSE 1 END, sha256('9|' || ann_id), ann_id) AS n FROM r)
SELECT ann_id, bin FROM f WHERE n <= 20"""))
def class_minimum_fill(spark, sf_dir):
    """Four of each class in every bin, then filled up to twenty by hash."""
    a = annotations(spark, sf_dir).select("ann_id", "cls", F.when(g.area(g.box()) < 1024, "s").otherwise("l").alias("bin"), h.hash_hex(9, F.col("ann_id")).alias("h"))
    first = sampling.first_in_group(a, ["bin", "cls"], [F.col("h"), F.col("ann_id")], 20, "k")
    return sampling.first_in_group(first, ["bin"], [(F.col("k") > 4).cast("int"), F.col("h"), F.col("ann_id")], 20, "n").select("ann_id", "bin")
