"""Audits, drift, reproducibility, flattened metrics, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import audit
from marlstone.plans.fixtures import annotations, detections, images, sql, table
from marlstone.plans.registry import query


@query(sql("""
SELECT 'in_frame' AS check, 'warning' AS severity, CAST(ann_id AS VARCHAR) AS message FROM ann JOIN image USING (image_id) WHERE x < 0 OR y < 0 OR x + w > width OR y + h > height
UNION ALL SELECT 'annotated', 'warning', CAST(image_id AS VARCHAR) FROM image ANTI JOIN ann USING (image_id)
UNION ALL SELECT 'known_class', 'fatal', CAST(ann_id AS VARCHAR) FROM ann WHERE cls = 'person'"""))
def audit_findings(spark, sf_dir):
    """Findings of a ground truth where persons are not a known class."""
    return audit.audit(images(spark, sf_dir), annotations(spark, sf_dir), ("helmet", "head"))


@query("""
WITH a AS (SELECT p_partkey, sha256(p_name) AS d FROM part WHERE p_partkey % 50 <> 1), b AS (SELECT p_partkey, sha256(CASE WHEN p_partkey % 70 = 0 THEN p_name || '!' ELSE p_name END) AS d FROM part WHERE p_partkey % 40 <> 3)
SELECT p_partkey, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'new' ELSE 'changed' END AS state FROM a FULL JOIN b USING (p_partkey) WHERE a.d IS DISTINCT FROM b.d""")
def content_drift(spark, sf_dir):
    """Recorded digests against those of the contents."""
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 50 <> 1").select("p_partkey", F.sha2("p_name", 256).alias("d"))
    b = p.where("p_partkey % 40 <> 3").select("p_partkey", F.sha2(F.when(F.col("p_partkey") % 70 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("d"))
    return audit.drift(a, b, "p_partkey", "d")


@query(sql("""
, m AS (SELECT arm, cls, avg(score) AS mean_score, max(score) AS best_score FROM det GROUP BY arm, cls), n AS (SELECT arm, cls, count(*) AS n_instances, count(DISTINCT image_id) AS n_images FROM det GROUP BY arm, cls)
SELECT arm, cls, metric, round(value, 6) AS value, n_instances, n_images FROM (SELECT * FROM m UNPIVOT (value FOR metric IN (mean_score, best_score))) JOIN n USING (arm, cls)"""))
def flattened_metrics(spark, sf_dir):
    """Metrics as rows with the denominators of the same classes."""
    det = detections(spark, sf_dir)
    wide = det.groupBy("arm", "cls").agg(F.avg("score").alias("mean_score"), F.max("score").alias("best_score"))
    counts = det.groupBy("arm", "cls").agg(F.count("*").alias("n_instances"), F.countDistinct("image_id").alias("n_images"))
    return audit.flattened(wide, ["arm", "cls"], counts).withColumn("value", F.round("value", 6))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread, max(value) - min(value) >= 2 AS discriminates FROM events GROUP BY event_type")
def discrimination(spark, sf_dir):
    return audit.spread(table(spark, sf_dir, "events"), "event_type", "value", 2.0).withColumn("spread", F.round("spread", 6))


@query("""
SELECT d.doc_id, sha256(d.text) AS sha256, CASE WHEN crc32(CAST(d.doc_id AS VARCHAR)) % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents d""".replace("crc32(CAST(d.doc_id AS VARCHAR)) % 10 = 0", "('0x' || substr(sha256('split|' || d.doc_id), 1, 16))::UBIGINT % 10 = 0"))
def split_manifest(spark, sf_dir):
    """Content digest and split of every item."""
    from marlstone.functions.hashing import hash_fold

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.when(hash_fold("split", F.col("doc_id"), 10) == 0, "test").otherwise("train").alias("split"))


@query("SELECT o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"order\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def canonical_fingerprint(spark, sf_dir):
    """Digest of each row as compact JSON with sorted keys."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.sha2(F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"))), 256).alias("fingerprint"))


@query("SELECT o.o_orderkey FROM orders o ANTI JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0) d ON o.o_orderkey = d.o_orderkey AND o.o_totalprice = d.o_totalprice")
def resume_candidates(spark, sf_dir):
    """Rows whose stored fingerprint is missing or differs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.join(o.where("o_orderkey % 4 <> 0"), ["o_orderkey", "o_totalprice"], "left_anti").select("o_orderkey")


@query("""
WITH u AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part), p AS (SELECT DISTINCT p_brand AS name FROM part)
SELECT name, name IN (SELECT name FROM p) AS has_provenance FROM u""")
def provenance_ledger(spark, sf_dir):
    """Union of two name sets, each with whether its origin is known."""
    part = table(spark, sf_dir, "part")
    p = part.select(F.col("p_brand").alias("name")).distinct()
    u = p.union(part.select("p_type")).distinct()
    return u.join(p.withColumn("has_provenance", F.lit(True)), "name", "left").select("name", F.coalesce("has_provenance", F.lit(False)).alias("has_provenance"))


@query("""
WITH r AS (SELECT event_type AS arm, user_id AS run, count(*) AS steps, bool_and(value > 0) AS complete FROM events GROUP BY ALL)
SELECT arm, arg_max(run, struct_pack(s := steps, r := run)) AS run FROM r WHERE complete GROUP BY arm""")
def latest_valid_run(spark, sf_dir):
    """Of the complete runs of each arm the one with the most steps, then the largest number."""
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), F.col("user_id").alias("run")).agg(F.count("*").alias("steps"), F.bool_and(F.col("value") > 0).alias("complete"))
    return r.where("complete").groupBy("arm").agg(F.max_by("run", F.struct("steps", "run")).alias("run"))
