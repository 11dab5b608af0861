"""Text scans: links, numbers, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import text_audit
from marlstone.plans.fixtures import table
from marlstone.plans.registry import query


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) SELECT page_id, link, count(*) AS n FROM l GROUP BY ALL""")
def link_scan(spark, sf_dir):
    return text_audit.links(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(r"""
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS number FROM documents) SELECT doc_id, number, CAST(length(regexp_extract(number, '\.([0-9]+)', 1)) AS INT) AS decimals, count(*) AS n FROM n GROUP BY ALL""")
def number_scan(spark, sf_dir):
    """Numbers as shown, with their displayed precision."""
    return text_audit.numbers(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "number", "decimals").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT l_returnflag AS label, avg(l_discount) AS value FROM lineitem GROUP BY 1), shown AS (SELECT label, value, round(value + CASE WHEN label = 'N' THEN 0.02 ELSE 0.0004 END, 3) AS shown FROM s)
SELECT label, abs(shown - value) <= 0.0005 + 1e-12 AS agrees FROM shown""")
def shown_value_check(spark, sf_dir):
    """Whether shown values agree with computed ones to half a unit of the last place shown."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.avg("l_discount").alias("value"))
    shown = s.withColumn("shown", F.round(F.col("value") + F.when(F.col("label") == "N", 0.02).otherwise(0.0004), 3))
    return shown.select("label", text_audit.agrees(F.col("shown"), F.col("value"), F.lit(3)).alias("agrees"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
SELECT doc_id, CAST(n + 1 AS INT) AS line_no, regexp_matches(line, '(?i)\b(?:token|license|licensed)\b') AS hit FROM l WHERE regexp_matches(line, '(?i)\b(?:token|license|licensed)\b')""")
def token_scan(spark, sf_dir):
    """Lines with forbidden words."""
    return text_audit.forbidden(table(spark, sf_dir, "documents"), "doc_id", "text", r"(?i)\b(?:token|license|licensed)\b").withColumn("hit", F.lit(True))


@query("""
WITH f AS (SELECT page_id, replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '.html', '') AS path FROM pages), k AS (SELECT path, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages, count(*) AS n FROM f GROUP BY path)
SELECT path, pages, n FROM k WHERE n > 1""")
def referenced_files(spark, sf_dir):
    """Paths that more than one page has, with the pages in order."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*(/[^?#]*)", 1), r"\.html", "")
    k = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("pages"), F.count("*").alias("n"))
    return k.where("n > 1")
