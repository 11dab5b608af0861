"""Line dedup by frequency within a site.

Pages are grouped by host. A line's share is the number of the host's pages that contain it over the host's page total;
lines over a ratio are boilerplate and go. One ratio for all lines misses passages that stand in a few pages of a hundred,
so there may also be lower ratios by the length of the line. Copies of a page would lose all their lines to those, so lower
ratios are judged by runs of such lines, the usual menu or licence: only pages of which they are half at most count, and a
line goes if its runs there have three or more different surroundings. So a block goes or stays as a whole. Counting moves one 16-byte digest for each distinct line of a
page and is summed before the shuffle. At most (lines a page / ratio) lines of a host can be over the ratio, so each host's boilerplate is a
short array; texts meet it in one join by host and are rebuilt in place.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import persisted, whole_text
from marlstone.storage import written_table

RATIO = 0.1
#: Pages that must contain a line before it can be boilerplate, so that small hosts keep theirs.
LEAST_PAGES = 3
#: Least length in code points and the ratio from there on. At sf0.1 (500 pages a source) every line of 50
#: words or more that repeats within a source is in 0.6-0.8 % of its pages, the common passages are in 1-5 %, and lines of
#: three words or fewer reach 4.8 %.
LOW_RATIOS = ((0, 0.02), (20, 0.01), (60, 0.005))
#: Different surroundings (the lines before and after the run) that a line needs to go by a low ratio, at least.
LEAST_NEIGHBOURS = 3
BROADCAST_BYTES = 16 << 20
_WHITE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    """Digest of a line without the white space around it; null for a blank one."""
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def _exact(ratio: float) -> Column:
    """The ratio as a decimal, so that a share of exactly the ratio isn't over it."""
    return F.lit(Decimal(str(ratio))).cast("decimal(10,6)")


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__all``: digest and length of the lines that aren't blank, in order."""
    line = lambda x: F.struct(_digest(x).alias("digest"), F.length(F.btrim(x, F.lit(_WHITE))).alias("length"))
    return rows.withColumn("__all", F.filter(F.transform(_lines(F.col("text")), line), lambda x: x["digest"].isNotNull()))


def _first_of_each(entries: str) -> Column:
    """Of sorted entries the first of each digest."""
    return F.filter(entries, lambda x, i: (i == 0) | (F.get(entries, i - 1)["digest"] != x["digest"]))


def _counted(rows: DataFrame) -> DataFrame:
    """host, digest, n, length of each line: pages, code points. A page counts once for a line."""
    one = _parsed(rows).withColumn("__sorted", F.sort_array("__all"))
    return one.select("host", F.explode(_first_of_each("__sorted")).alias("x")).groupBy("host", F.col("x.digest").alias("digest")).agg(F.count("*").alias("n"), F.first("x.length").alias("length"))


def _surroundings(rows: DataFrame, often: DataFrame) -> DataFrame:
    """host, digest, n, around: pages of which lines of ``often`` (__host, often: digests) are half at most, and the different
    pairs of lines around the runs of such lines that the line is in. A page counts once for a line, with its first run."""
    met = _parsed(rows).join(often, rows["host"].eqNullSafe(often["__host"]))
    met = met.withColumn("__own", F.array_intersect("often", F.transform("__all", lambda x: x["digest"])))
    flags = F.array_join(F.transform("__all", lambda x: F.when(F.array_contains("__own", x["digest"]), F.lit("1")).otherwise(F.lit("0"))), "")
    met = met.where(F.size("__own") > 0).withColumn("__flags", flags).where(2 * F.length(F.translate("__flags", "0", "")) <= F.size("__all"))
    hits, gaps = F.regexp_extract_all("__flags", F.lit("1+"), F.lit(0)), F.split("__flags", "1+", -1)
    zipped = F.filter(F.zip_with(hits, gaps, lambda h, gap: F.struct(F.length(h).alias("n"), F.length(gap).alias("gap"))), lambda z: z["n"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,n:int>>)").alias("runs"))
    step = lambda acc, z: F.struct((acc["at"] + z["gap"] + z["n"]).alias("at"), F.concat(acc["runs"], F.array(F.struct((acc["at"] + z["gap"]).alias("start"), z["n"].alias("n")))).alias("runs"))
    met = met.withColumn("__runs", F.aggregate(zipped, zero, step, lambda acc: acc["runs"]))
    at = lambda i: F.coalesce(F.get("__all", i)["digest"], F.lit(b""))
    around = lambda r: F.xxhash64(at(r["start"] - 1), F.lit(0), at(r["start"] + r["n"]))
    entries = F.flatten(F.transform("__runs", lambda r: F.transform(F.slice("__all", r["start"] + 1, r["n"]), lambda x: F.struct(x["digest"].alias("digest"), r["start"].alias("start"), around(r).alias("around")))))
    met = met.withColumn("__entries", F.sort_array(entries))
    one = met.select("host", F.explode(_first_of_each("__entries")).alias("x")).groupBy("host", F.col("x.digest").alias("digest"), F.col("x.around").alias("around")).agg(F.count("*").alias("n"))
    return one.groupBy("host", "digest").agg(F.sum("n").alias("n"), F.count("*").alias("around"))


def boilerplate(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, low_ratios: tuple[tuple[int, float], ...] = ()) -> DataFrame:
    """host, digests: the boilerplate lines of each host that has any."""
    rows = docs.select(F.col(host_col).alias("host"), whole_text(text_col).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "__host")
    with_totals = lambda counts: counts.where(F.col("n") >= least_pages).join(totals, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    over = F.col("n") > _exact(ratio) * F.col("pages")
    if not low_ratios:
        return with_totals(_counted(rows)).where(over).groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("digests"))
    low = F.coalesce(*[F.when(F.col("length") >= least, _exact(r)) for least, r in sorted(low_ratios, reverse=True)])
    often = written_table(with_totals(_counted(rows)).withColumns({"low": low * F.col("pages"), "over": over}).where(F.coalesce(F.col("n") > F.col("low"), F.lit(False)) | over))
    by_host = written_table(often.groupBy(F.col("host").alias("__host")).agg(F.sort_array(F.collect_list("digest")).alias("often")))
    seen = _surroundings(rows, by_host).where((F.col("n") >= least_pages) & (F.col("around") >= LEAST_NEIGHBOURS)).select(F.col("host").alias("__h"), F.col("digest").alias("__d"), F.col("n").alias("__n"))
    met = often.join(seen, F.col("host").eqNullSafe(F.col("__h")) & (F.col("digest") == F.col("__d")), "left")
    return met.where("over or coalesce(__n > low, false)").groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("digests"))


def line_dedup(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, low_ratios: tuple[tuple[int, float], ...] = ()) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_dropped (long) last.

    A line goes if more than ``ratio`` of its host's pages, and at least ``least_pages``, contain it; with ``low_ratios``
    (least length, ratio) also if more than its length's ratio do. For that only pages count that are half of such lines at
    most, and the runs of such lines that it is in must have three or more different surroundings, so that pages that are
    copies of each other keep their lines and a block of lines goes as a whole. Lines are compared
    without the white space around them; the others stay as they were, blank ones included. A page counts once for a
    line however often it has it.

    A null text is empty (one blank line) and counts as a page. Null hosts are one host. Repeated rows are pages of their
    own. A page may end up empty; its row stays. An empty table gives an empty result. Columns of ``docs`` named n_lines or
    n_dropped are replaced.
    """
    found = persisted(boilerplate(docs, host_col=host_col, text_col=text_col, ratio=ratio, least_pages=least_pages, low_ratios=low_ratios))
    size = found.agg(F.sum(F.size("digests") * 24 + F.coalesce(F.length("host"), F.lit(0)) + 32)).first()[0] or 0
    found = found.select(F.col("host").alias("__host"), F.col("digests").alias("__digests"))
    rows = docs.drop("n_lines", "n_dropped")
    met = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, rows[host_col].eqNullSafe(found["__host"]), "left")
    lines = _lines(whole_text(text_col))
    met = met.withColumn("__lines", lines)
    met = met.withColumn("__bad", F.array_intersect(F.coalesce("__digests", F.array().cast("array<binary>")), F.transform("__lines", _digest)))
    met = met.withColumn("__kept", F.when(F.size("__bad") > 0, F.filter("__lines", lambda x: ~F.coalesce(F.array_contains("__bad", _digest(x)), F.lit(False)))).otherwise(F.col("__lines")))
    text = F.array_join("__kept", "\n")
    return met.select(*[text.alias(text_col) if c == text_col else F.col(c) for c in rows.columns], F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"))


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT n, source, line, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS bare, pos
  FROM (SELECT n, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t)),
pages AS (SELECT source, count(*) AS pages FROM t GROUP BY source),
full_ AS (SELECT n, source, bare, row_number() OVER (PARTITION BY n ORDER BY pos) AS i, count(*) OVER (PARTITION BY n) AS k FROM l WHERE bare <> ''),
c AS (SELECT source, bare, count(DISTINCT n) AS k FROM full_ GROUP BY source, bare),
often AS (
  SELECT c.source, c.bare, c.k, p.pages, CASE WHEN length(bare) >= 60 THEN 5 WHEN length(bare) >= 20 THEN 10 ELSE 20 END * p.pages AS low, 10 * c.k > p.pages AS over FROM c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source WHERE c.k >= 3),
cand AS (SELECT * FROM often WHERE over OR 1000 * k > low),
hit AS (SELECT f.*, count(*) OVER (PARTITION BY f.n) AS hits, f.i - row_number() OVER (PARTITION BY f.n ORDER BY f.i) AS run FROM full_ f JOIN cand ON f.source IS NOT DISTINCT FROM cand.source AND f.bare = cand.bare),
ends AS (SELECT n, run, min(i) AS a, max(i) AS b FROM hit WHERE 2 * hits <= k GROUP BY n, run),
around AS (SELECT e.n, e.run, coalesce(x.bare, '') AS before, coalesce(y.bare, '') AS after FROM ends e LEFT JOIN full_ x ON x.n = e.n AND x.i = e.a - 1 LEFT JOIN full_ y ON y.n = e.n AND y.i = e.b + 1),
firsts AS (SELECT n, source, bare, min(run) AS run FROM (SELECT h.* FROM hit h WHERE 2 * hits <= k) GROUP BY n, source, bare),
seen AS (SELECT f.source, f.bare, count(*) AS m, count(DISTINCT struct_pack(a := before, b := after)) AS pairs FROM firsts f JOIN around USING (n, run) GROUP BY f.source, f.bare),
bad AS (
  SELECT cand.source, cand.bare FROM cand LEFT JOIN seen ON cand.source IS NOT DISTINCT FROM seen.source AND cand.bare = seen.bare
  WHERE over OR coalesce(m >= 3 AND pairs >= 3 AND 1000 * m > low, false)),
j AS (SELECT l.n, l.pos, l.line, bad.bare IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.bare = bad.bare),
g AS (SELECT n, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM j GROUP BY n)
SELECT t.doc_id, g.n_lines, g.n_dropped, sha256(g.text) AS text_sha256 FROM t JOIN g USING (n)
"""
