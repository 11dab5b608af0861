"""Run-length masks, weighted sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.functions import rle
from marlstone.operators import joins, sampling
from marlstone.plans.fixtures import annotations, sql, table
from marlstone.plans.registry import query

#: Masks of 13 x 13 cells of 32 pixels: each box's cells, without every third cell of a column for ids that 4 divides.
_GRID = "x0 AS (SELECT ann_id, image_id, x // 32 AS cx, y // 32 AS cy, least(w // 32 + 1, 13 - x // 32) AS cw, least(h // 32 + 1, 13 - y // 32) AS ch FROM ann)"


def masks(spark, sf_dir):
    """ann_id, image_id, pixels (text of 169 cells in column order)."""
    cell = lambda c: F.floor(F.col(c) / 32).cast("int")
    rows = annotations(spark, sf_dir).select("ann_id", "image_id", cell("x").alias("cx"), cell("y").alias("cy"), F.least(cell("w") + 1, 13 - cell("x")).alias("cw"), F.least(cell("h") + 1, 13 - cell("y")).alias("ch"))

    fore = lambda row: (row >= F.col("cy")) & (row < F.col("cy") + F.col("ch")) & ~((F.col("ann_id") % 4 == 0) & (row % 3 == 2))
    column = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda row: F.when(fore(row), F.lit("1")).otherwise(F.lit("0"))), "")
    empty = F.lit("0" * 13)
    return rows.select("ann_id", "image_id", F.concat(F.repeat(empty, F.col("cx")), F.repeat(column, F.col("cw")), F.repeat(empty, 13 - F.col("cx") - F.col("cw"))).alias("pixels"))


@query(sql(f"""
, {_GRID},
px AS (SELECT ann_id, p, (p // 13 >= cx AND p // 13 < cx + cw AND p % 13 >= cy AND p % 13 < cy + ch AND NOT (ann_id % 4 = 0 AND p % 13 % 3 = 2))::INT AS v FROM x0, range(169) r(p)),
ch AS (SELECT *, coalesce(v <> lag(v) OVER w, v = 1)::INT AS c FROM px WINDOW w AS (PARTITION BY ann_id ORDER BY p)),
rn AS (SELECT ann_id, v, min(p) AS pos, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY ann_id ORDER BY p) AS g FROM ch) GROUP BY ann_id, g, v),
ct AS (SELECT ann_id, n, row_number() OVER (PARTITION BY ann_id ORDER BY pos, o) - 1 AS i FROM (SELECT ann_id, pos, n, 1 AS o FROM rn UNION ALL SELECT ann_id, 0, 0, 0 FROM rn WHERE pos = 0 AND v = 1)),
df AS (SELECT ann_id, i, (n - CASE WHEN i > 2 THEN lag(n, 2) OVER (PARTITION BY ann_id ORDER BY i) ELSE 0 END)::BIGINT AS d FROM ct),
tx AS (SELECT ann_id, string_agg(CASE WHEN d BETWEEN -16 AND 15 THEN chr((d & 31)::INT + 48) ELSE chr((d & 31)::INT + 80) || chr(((d >> 5) & 31)::INT + 48) END, '' ORDER BY i) AS code FROM df GROUP BY ann_id),
bx AS (SELECT ann_id, min(p // 13) AS bx, min(p % 13) AS by_, max(p // 13) - min(p // 13) + 1 AS bw, max(p % 13) - min(p % 13) + 1 AS bh, count(*) AS area FROM px WHERE v = 1 GROUP BY ann_id)
SELECT ann_id, code, coalesce(area, 0) AS area, bx, by_ AS by, bw, bh FROM tx LEFT JOIN bx USING (ann_id)"""))
def mask_codes(spark, sf_dir):
    """Each mask's compact text, and its area and box from the decoded text."""
    coded = masks(spark, sf_dir).select("ann_id", rle.from_pixels(F.col("pixels")).alias("runs")).select("ann_id", rle.encode(F.col("runs")).alias("code")).withColumn("counts", rle.decode(F.col("code")))
    told = coded.select("ann_id", "code", rle.area(F.col("counts")).alias("area"), rle.bounds(F.col("counts"), F.lit(13)).alias("box"))
    return told.select("ann_id", "code", "area", *[F.col("box")[c].alias(f"b{c}") for c in "xywh"])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = rle.shared_pixels(batch.column("l_edges"), batch.column("r_edges"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "both")), pa.array(shared, pa.int64())], ["a", "b", "both", "shared"])


@query(sql(f"""
, {_GRID},
px AS (SELECT ann_id, image_id, p FROM x0, range(169) r(p) WHERE p // 13 >= cx AND p // 13 < cx + cw AND p % 13 >= cy AND p % 13 < cy + ch AND NOT (ann_id % 4 = 0 AND p % 13 % 3 = 2)),
n AS (SELECT ann_id, count(*) AS n FROM px GROUP BY ann_id),
s AS (SELECT a.ann_id AS a, b.ann_id AS b, count(*) AS shared FROM px a JOIN px b ON a.image_id = b.image_id AND a.p = b.p AND a.ann_id < b.ann_id GROUP BY ALL)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 9) AS iou FROM s JOIN n x ON x.ann_id = a JOIN n y ON y.ann_id = b"""))
def mask_overlaps(spark, sf_dir):
    """Pixels that two masks of an image share, from their runs."""
    counts = masks(spark, sf_dir).select("image_id", "ann_id", rle.from_pixels(F.col("pixels")).alias("counts"))
    coded = counts.select("image_id", "ann_id", rle.area(F.col("counts")).alias("area"), rle.edges(F.col("counts")).alias("edges"))
    pairs = joins.pairs_in(coded, coded, ["image_id"]).where("l_ann_id < r_ann_id").select(F.col("l_ann_id").alias("a"), F.col("r_ann_id").alias("b"), (F.col("l_area") + F.col("r_area")).alias("both"), "l_edges", "r_edges")
    met = pairs.mapInArrow(_shared, "a long, b long, both long, shared long").where("shared > 0")
    return met.select("a", "b", "shared", F.round(F.col("shared") / (F.col("both") - F.col("shared")), 9).alias("iou"))


@query("""
WITH w AS (SELECT o_orderpriority AS name, count(*) AS weight FROM orders GROUP BY 1), t AS (SELECT sum(weight) AS total, count(*) AS k, count(*) * 1000 AS n FROM w),
e AS (SELECT name, weight * (n - k) // total AS whole, weight * (n - k) % total AS part FROM w, t),
q AS (SELECT name, 1 + whole + CASE WHEN row_number() OVER (ORDER BY part DESC, name) <= (SELECT n - k - (SELECT sum(whole) FROM e) FROM t) THEN 1 ELSE 0 END AS quota FROM e),
r AS (SELECT name, unnest(range(quota::BIGINT)) AS i FROM q)
SELECT row_number() OVER (ORDER BY sha256('7|' || name || ':' || i), name, i) - 1 AS position, name FROM r""")
def scenario_sequence(spark, sf_dir):
    """A sequence of scenarios by weight: exact quotas in an order that is independent of partitions."""
    weights = {r[0]: r[1] for r in table(spark, sf_dir, "orders").groupBy("o_orderpriority").count().collect()}
    return sampling.weighted_sequence(spark, weights, 1000 * len(weights), 7)
