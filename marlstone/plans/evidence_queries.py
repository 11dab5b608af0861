"""Evidence: approval gates over JSON, published records, provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.operators import approval
from marlstone.plans.fixtures import table
from marlstone.plans.registry import query
from marlstone.sources import bundles
from marlstone.storage import shared_dir

R = approval.Rule
RULES = [
    R("labeler", "$.experiment", "number", "<>", -1), R("labeler", "$.metrics.precision", "number", ">=", 0.85), R("review", "$.real_helmets", "number", "=", 0), R("review", "$.signed", "boolean", "=", True),
    R("manifest", "$.experiment", "number", "=", other=("labeler", "$.experiment")), R("manifest", "$.status", "string", "=", "final"),
]


def evidence(spark, sf_dir):
    """Three documents for each order, as text, with faults by the order's key."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 13).alias("k"), F.col("o_custkey").alias("c"), "o_orderstatus")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    precision = F.when(F.col("k") == 2, F.lit('"0.9"')).when(F.col("k") == 4, F.lit("null")).otherwise(F.format_string("0.%02d", F.col("c") % 20 + 80))
    metrics = F.when(F.col("k") == 3, F.lit('{"recall": 0.5}')).otherwise(F.concat(F.lit('{"precision": '), precision, F.lit("}")))
    body = F.when(F.col("k") == 1, F.lit('{"experiment": ')).otherwise(F.concat(F.lit('{"experiment": '), text("id"), F.lit(', "metrics": '), metrics, F.lit("}")))
    labeler = rows.where("k <> 0").select("id", body.alias("body"))
    signed = F.when(F.col("k") == 5, F.lit('"yes"')).when(F.col("k") == 8, F.lit("false")).otherwise(F.lit("true"))
    review = rows.select("id", F.concat(F.lit('{"real_helmets": '), text(F.col("c") % 3), F.lit(', "signed": '), signed, F.lit("}")).alias("body"), F.explode(F.when(F.col("k") == 6, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")
    status = F.when(F.col("o_orderstatus") == "F", "final").otherwise("draft")
    manifest = rows.select("id", F.concat(F.lit('{"experiment": '), text(F.when(F.col("k") == 7, F.col("id") + 1).otherwise(F.col("id"))), F.lit(', "status": "'), status, F.lit('"}')).alias("body"))
    return approval.documents({"labeler": labeler, "review": review, "manifest": manifest}, "id", "body")


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 13 AS k, o_custkey AS c, o_orderstatus AS s FROM orders)
SELECT id, concat_ws(',', CASE k WHEN 0 THEN 'labeler:absent' WHEN 1 THEN 'labeler:unreadable' END, CASE WHEN k = 6 THEN 'review:repeated' END,
  CASE WHEN k IN (3, 4) THEN 'labeler.metrics.precision:missing' WHEN k = 2 THEN 'labeler.metrics.precision:ill_typed' WHEN k > 1 AND c % 20 < 5 THEN 'labeler.metrics.precision:refused' END,
  CASE WHEN k <> 6 AND c % 3 <> 0 THEN 'review.real_helmets:refused' END, CASE k WHEN 5 THEN 'review.signed:ill_typed' WHEN 8 THEN 'review.signed:refused' END,
  CASE WHEN k < 2 THEN 'manifest.experiment:unmatched' WHEN k = 7 THEN 'manifest.experiment:refused' END, CASE WHEN s <> 'F' THEN 'manifest.status:refused' END) AS failures,
  k > 8 AND c % 20 >= 5 AND c % 3 = 0 AND s = 'F' AS approved FROM o""")
def approval_gates(spark, sf_dir):
    """Three documents an experiment under six rules; every kind of failure occurs."""
    out = approval.judged(evidence(spark, sf_dir), RULES)
    return out.select("id", F.array_join("failures", ",").alias("failures"), "approved")


def page_records(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), (F.col("page_id") % 16).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))


@query("SELECT 'pages/' || (page_id % 16) || '/' || page_id || '.html' AS member, octet_length(encode(coalesce(html, '')))::BIGINT AS size, sha256(coalesce(html, '')) AS sha256 FROM pages")
def published_pages(spark, sf_dir):
    """Pages published as a bundle of archives and read back from it; digests are taken of what the archives give."""
    root = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    bundles.publish(page_records(spark, sf_dir), root)
    return bundles.published(spark, root).select("member", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("""
WITH a AS (SELECT n_name AS member, sha256(n_name) AS own, 1 AS n FROM nation UNION ALL SELECT r_name, sha256(r_name), CASE WHEN r_regionkey = 2 THEN 2 ELSE 1 END FROM region),
b AS (SELECT n_name AS member, CASE WHEN n_nationkey % 5 = 1 THEN sha256('x') ELSE sha256(n_name) END AS told, CASE WHEN n_nationkey % 5 = 2 THEN 2 ELSE 1 END AS m FROM nation WHERE n_nationkey % 5 <> 0
      UNION ALL SELECT DISTINCT c_mktsegment, sha256(c_mktsegment), 1 FROM customer UNION ALL SELECT r_name, sha256(r_name), 1 FROM region)
SELECT member, unnest(list_filter([CASE WHEN m IS NULL THEN 'no_provenance' END, CASE WHEN n IS NULL THEN 'no_record' END, CASE WHEN n > 1 THEN 'repeated_record' END, CASE WHEN m > 1 THEN 'repeated_provenance' END, CASE WHEN own <> told THEN 'other_digest' END], lambda x: x IS NOT NULL)) AS problem
FROM a FULL JOIN b USING (member)""")
def bundle_problems(spark, sf_dir):
    """Records of a release against their provenance: names and digests that don't fit."""
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    own = lambda c: [F.col(c).alias("member"), F.sha2(c, 256).alias("sha256")]
    records = nation.select(*own("n_name")).unionByName(region.select(*own("r_name"))).unionByName(region.where("r_regionkey = 2").select(*own("r_name")))
    told = nation.where("n_nationkey % 5 <> 0").select("n_nationkey", F.col("n_name").alias("member"), F.when(F.col("n_nationkey") % 5 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("n_name", 256)).alias("sha256"))
    told = told.unionByName(told.where("n_nationkey % 5 = 2")).drop("n_nationkey")
    told = told.unionByName(customer.select(*own("c_mktsegment")).distinct()).unionByName(region.select(*own("r_name")))
    return bundles.bundle_problems(records, told)
