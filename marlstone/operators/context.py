"""Operators on an annotation's surroundings, on train context and on recorded against derived facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import geometry as g

#: Statistics that a configuration may name.
STATISTICS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}


def statistic(name: str, column: str) -> Column:
    """The aggregate of that name; an unknown name is an error."""
    if name not in STATISTICS:
        raise ValueError(f"unknown statistic {name!r}: one of {sorted(STATISTICS)}")
    return STATISTICS[name](column)


def train_context(images: DataFrame, manifest: DataFrame, annotations: DataFrame, blocked: DataFrame, key: str, ann_id: str) -> DataFrame:
    """Train images of the manifest that are not blocked, each with its annotations as an array in the order of their ids (empty: none)."""
    train = images.join(manifest.where("split = 'train'").select(key), key, "left_semi").join(blocked.select(key), key, "left_anti")
    rows = annotations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ann_id, *[c for c in annotations.columns if c not in (key, ann_id)]))).alias("annotations"))
    return train.join(rows, key, "left").withColumn("annotations", F.coalesce("annotations", F.array()))


def context_problems(images: DataFrame, manifest: DataFrame, blocked: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """One row of counts that must be 0: only_images, only_manifest, train_blocked, and bank sources that are not train."""
    sides = [(images, "i"), (manifest, "m"), (manifest.where("split = 'train'"), "t"), (blocked, "b"), (sources, "s")]
    has = None
    for rows, mark in sides:
        marked = rows.select(key, F.lit(mark).alias("mark"))
        has = marked if has is None else has.union(marked)
    flags = has.groupBy(key).agg(*[F.bool_or(F.col("mark") == m).alias(m) for _, m in sides])
    return flags.agg(F.expr("count_if(i and not m)").alias("only_images"), F.expr("count_if(m and not i)").alias("only_manifest"), F.expr("count_if(t and b)").alias("train_blocked"), F.expr("count_if(s and not t)").alias("sources_outside_train"))


def something_below(candidates: DataFrame, others: DataFrame, key: str, candidate_id: str) -> DataFrame:
    """``candidates`` with ``below``: a head or person of the same image lies where it would be under a worn helmet.

    The candidate's middle is within a quarter of the other's width of it; a head starts between a quarter of the candidate's
    height above its lower edge and 2.5 heights under it; the edge lies from a quarter of the candidate's height above a
    person to the person's middle.
    """
    o = others.where("cls in ('head', 'person')").select(key, F.col("cls").alias("o_cls"), *[F.col(c).alias(f"o_{c}") for c in "xywh"])
    middle, bottom = F.expr("x + w / 2"), F.expr("y + h")
    across = middle.between(F.expr("o_x - 0.25D * o_w"), F.expr("o_x + 1.25D * o_w"))
    head = F.col("o_y").between(bottom - F.expr("0.25D * h"), bottom + F.expr("2.5D * h"))
    person = bottom.between(F.expr("o_y - 0.25D * h"), F.expr("o_y + 0.5D * o_h"))
    hit = candidates.join(o, key).where(across & F.when(F.col("o_cls") == "head", head).otherwise(person)).select(candidate_id).distinct().withColumn("below", F.lit(True))
    return candidates.join(hit, candidate_id, "left").withColumn("below", F.coalesce("below", F.lit(False)))


def atypical(rows: DataFrame, typical: DataFrame, *, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``rows`` with ``atypical``: area or aspect ratio outside the percentiles of ``typical``, one row that meets every row."""
    area, aspect = F.expr("w * h"), F.expr("w / h")
    p = lambda e, at, name: F.percentile(e, at).alias(name)
    bounds = typical.agg(p(area, low, "__a0"), p(area, high, "__a1"), p(aspect, low, "__r0"), p(aspect, high, "__r1"))
    inside = area.between(F.col("__a0"), F.col("__a1")) & aspect.between(F.col("__r0"), F.col("__r1"))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("atypical", ~inside).drop("__a0", "__a1", "__r0", "__r1")


def union_area(rectangles: Column) -> Column:
    """Area that an array of (l, t, r, b) covers, overlaps once: in each strip between neighbour edges spans are run through in order."""
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform(rectangles, lambda q: F.array(q["l"], q["r"])))))

    def strip(left: Column, i: Column) -> Column:
        right = F.get(edges, i + 1)
        spans = F.transform(F.filter(rectangles, lambda q: (q["l"] <= left) & (q["r"] >= right)), lambda q: F.struct(q["t"].cast("double").alias("t"), q["b"].cast("double").alias("b")))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
        add = lambda s, q: F.struct((s["sum"] + F.greatest(F.lit(0.0), q["b"] - F.greatest(q["t"], s["end"]))).alias("sum"), F.greatest(s["end"], q["b"]).alias("end"))
        return F.aggregate(F.array_sort(spans), start, add, lambda s: s["sum"] * (right - left))

    return F.aggregate(F.transform(edges, lambda left, i: F.coalesce(strip(left, i), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def covered_share(annotations: DataFrame, images: DataFrame, key: str, ann_id: str) -> DataFrame:
    """``ann_id``, covered: share of a box, cut to its frame, under the union of other boxes of its image; persons count
    under persons, other classes under other classes."""
    cut = annotations.join(images.select(key, "width", "height"), key).select(
        key, ann_id, (F.col("cls") == "person").alias("person"), F.greatest(F.floor("x"), F.lit(0)).alias("l"), F.greatest(F.floor("y"), F.lit(0)).alias("t"),
        F.least(F.ceil(F.expr("x + w")), "width").alias("r"), F.least(F.ceil(F.expr("y + h")), "height").alias("b"),
    )
    o = cut.select(key, "person", F.col(ann_id).alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in "ltrb"])
    met = cut.join(o, [key, "person"]).where((F.col(ann_id) != F.col("o_id")) & F.expr("least(r, o_r) > greatest(l, o_l) and least(b, o_b) > greatest(t, o_t)"))
    part = F.struct(F.expr("greatest(l, o_l)").alias("l"), F.expr("greatest(t, o_t)").alias("t"), F.expr("least(r, o_r)").alias("r"), F.expr("least(b, o_b)").alias("b"))
    parts = met.groupBy(ann_id).agg(F.collect_list(part).alias("parts"))
    own = g.area(g.Box(F.col("l"), F.col("t"), F.expr("r - l"), F.expr("b - t")))
    return cut.join(parts, ann_id, "left").select(ann_id, F.coalesce(union_area(F.col("parts")) / F.greatest(own, F.lit(1)), F.lit(0.0)).alias("covered"))


def targeting_verdict(shares: DataFrame, slices: DataFrame, deltas: DataFrame) -> DataFrame:
    """metric, leader, tested, target, target_delta, best_other, verdict for each metric of ``deltas`` (metric, slice, delta).

    The leader has the largest of ``shares`` (scenario, share), the tested scenario the largest of those that ``slices``
    (scenario, slice) isolate; ties go to the first name. A gain counts as targeted only if it is above 0 and strictly
    above that of every other slice.
    """
    first = lambda rows: rows.orderBy(F.desc("share"), "scenario").limit(1)
    leader = first(shares).select(F.col("scenario").alias("leader"))
    tested = first(shares.join(slices, "scenario")).select(F.col("scenario").alias("tested"), F.col("slice").alias("target"))
    aim = F.broadcast(leader.join(tested, how="left"))
    own, other = F.col("slice") == F.col("target"), ~F.coalesce(F.col("slice") == F.col("target"), F.lit(False))
    out = deltas.crossJoin(aim).groupBy("metric", "leader", "tested", "target").agg(F.max(F.when(own, F.col("delta"))).alias("target_delta"), F.max(F.when(other, F.col("delta"))).alias("best_other"))
    verdict = (
        F.when(F.col("tested").isNull(), "budget_leader_has_no_slice")
        .when(F.col("target_delta").isNull(), "target_slice_unmeasurable")
        .when(F.col("target_delta") <= 0, "target_slice_did_not_improve")
        .when(F.col("best_other").isNull() | (F.col("target_delta") > F.col("best_other")), "targeted")
        .otherwise("more_data_not_targeted")
    )
    return out.withColumn("verdict", verdict)


def record_consistency(recorded: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, status: equal, not_derived, not_recorded, or the columns whose values differ, nulls compared as values."""
    a = recorded.select(key, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = derived.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    differing = F.concat_ws(",", *[F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in columns])
    status = F.when(F.col("__b").isNull(), "not_derived").when(F.col("__a").isNull(), "not_recorded").when(differing == "", "equal").otherwise(differing)
    return a.join(b, key, "full").select(key, status.alias("status"))


def deep_merge(base: Column, override: Column, depth: int) -> Column:
    """Maps of maps, ``depth`` levels: keys of either side, the override's value where it has the key, even if null."""

    def value(k: Column, x: Column, y: Column) -> Column:
        if depth == 1:
            return F.when(F.map_contains_key(override, k), y).otherwise(x)
        return F.when(~F.map_contains_key(override, k), x).when(y.isNull() | x.isNull(), y).otherwise(deep_merge(x, y, depth - 1))

    return F.map_zip_with(base, override, value)
