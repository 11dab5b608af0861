"""URL rules by hashed expressions, in DataFrame operations only.

A rule is a host and a path prefix; its expression is their concatenation. A URL is expanded into the host suffixes that
have as many labels as rules have, combined with the path prefixes that are as long as rules' paths are. Expressions meet
rules in an equi-join on the first 32 bits of their SHA-256, confirmed by the full digest. The longest rule wins. URLs that
no rule fits leave nothing behind the join, equal ones are summed up before any shuffle, and what is left meets the pages once.
Both joins have a written table on one side, so that a host with many pages is split between tasks.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import persisted

PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_filter(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rule and the verdict for each row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the URL's path starts with the
    rule's. Of those that fit, the one with the longest host and path together wins, then the one with the longer host;
    where one rule is given both verdicts, ``block`` wins. Without a fitting rule, ``rule`` is null and ``verdict`` is
    ``default``. Rules with a null column are left out; an empty rule table gives ``default`` throughout.

    A null URL or one without ``://`` has an empty host and path, which no rule with a host fits. Repeated rows come out as
    often as they went in. Other columns of ``pages`` are not read.
    """
    rules = persisted(
        rules.where("host is not null and path is not null and verdict is not null")
        .select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("rule_digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    )
    labels = F.size(F.split("rule_host", r"\."))
    shape = rules.agg(F.sort_array(F.collect_set(labels)).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    label_counts, lengths = (F.array(*[F.lit(x) for x in xs] or [F.lit(-1)]).cast("array<int>") for xs in (shape["labels"], shape["lengths"]))

    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    suffixes = F.transform(F.filter(label_counts, lambda n: (n > 0) & (n <= F.size(F.split("host", r"\.")))), lambda n: _last_labels(F.col("host"), n))
    prefixes = F.transform(F.filter(lengths, lambda n: (n >= 0) & (n <= F.length("path"))), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, p), 256))))
    expanded = rows.select("host", "path", F.explode(expressions).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    met = expanded.join(rules, "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = persisted(met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "rule", "rule_verdict")).alias("best")))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def _last_labels(host: Column, n: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")


#: The four rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.n, r.rh || r.rp AS rule, r.v,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.rh || r.rp) DESC, length(r.rh) DESC) AS k
  FROM p JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.n = m.n AND m.k = 1
"""
