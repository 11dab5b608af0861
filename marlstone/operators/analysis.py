"""Choices, comparisons with a baseline, curves, set differences."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, *order: Column) -> DataFrame:
    """The first row of a total order; none of an empty table."""
    return df.orderBy(*order).limit(1)


def grid(df: DataFrame, axes: dict[str, tuple[str, list[float]]], value: str) -> DataFrame:
    """For every combination of lower thresholds: the axes' values, n and mean_score of the rows that pass all.

    A row is first counted in the cell of the highest thresholds that it passes; cells are few, and each combination
    sums the cells at or above it. The rows are read once whatever the size of the grid.
    """
    cells = df
    for name, (column, values) in axes.items():
        index = sum([(F.col(column) >= v).cast("int") for v in sorted(values)], F.lit(0))
        cells = cells.withColumn(f"__{name}", index)
    cells = cells.groupBy(*[f"__{n}" for n in axes]).agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    combos = df.sparkSession.range(1).select(*[F.lit(None).alias("__none")])
    for name, (_, values) in axes.items():
        steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(sorted(values))])
        combos = combos.withColumn(f"__c_{name}", F.explode(steps))
    met = combos.join(cells, [F.col(f"__{n}") >= F.col(f"__c_{n}.i") for n in axes], "left")
    out = met.groupBy(*[F.col(f"__c_{n}.v").alias(n) for n in axes]).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.sum("__s").alias("__s"))
    return out.select(*axes, "n", F.round(F.coalesce(F.try_divide("__s", "n"), F.lit(0.0)), 6).alias("mean_score"))


def versus(metrics: DataFrame, arm: str, value: str, baseline: str) -> DataFrame:
    """``metrics`` without the baseline, with ``better``: strictly above it. A missing baseline is an error."""
    found = metrics.where(F.col(arm) == baseline).select(value).take(2)
    if len(found) != 1:
        raise ValueError(f"no single row of {baseline!r}")
    return metrics.where(F.col(arm) != baseline).withColumn("better", F.col(value) > F.lit(found[0][0]))


def interpolated(curve: DataFrame, arm: str, x: str, y: str, at: list[int]) -> DataFrame:
    """arm, x, value for each arm and grid point: linear between an arm's points, null outside its range.

    Each segment makes the grid points that it holds, so there is no range join.
    """
    w = Window.partitionBy(arm).orderBy(x)
    seg = curve.select(arm, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    points = F.array(*[F.lit(v) for v in at])
    inside = F.filter(points, lambda p: (p >= F.col("x0")) & F.coalesce(p < F.col("x1"), p == F.col("x0")))
    made = seg.select(arm, "x0", "y0", "x1", "y1", F.explode(inside).alias("x"))
    value = F.when(F.col("x") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    domain = curve.select(arm).distinct().withColumn("x", F.explode(points))
    return domain.join(made.select(arm, "x", value.alias("value")), [arm, "x"], "left")


def crossover(curve: DataFrame, arm: str, x: str, y: str, challenger: str, baseline: str) -> DataFrame:
    """last_lead, most, at: over the points that both have."""
    a = curve.where(F.col(arm) == challenger).select(x, F.col(y).alias("__a"))
    b = curve.where(F.col(arm) == baseline).select(x, F.col(y).alias("__b"))
    lead = a.join(b, x).withColumn("lead", F.col("__a") - F.col("__b"))
    return lead.agg(F.max(F.when(F.col("lead") > 0, F.col(x))).alias("last_lead"), F.round(F.max("lead"), 6).alias("most"), F.max_by(x, F.struct("lead", -F.col(x))).alias("at"))


def key_difference(a: DataFrame, b: DataFrame, key: str, only_a: str, only_b: str) -> DataFrame:
    """Distinct keys that just one side has, counted; both 0: equal key sets."""
    sides = a.select(key, F.lit(1).alias("s")).union(b.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.bool_or(F.col("s") == 1).alias("a"), F.bool_or(F.col("s") == 2).alias("b"))
    return sides.agg(F.count_if(F.col("a") & ~F.col("b")).alias(only_a), F.count_if(F.col("b") & ~F.col("a")).alias(only_b))


def replaced(old: DataFrame, new: DataFrame, column: str, owned: list[str]) -> DataFrame:
    """Rows of ``old`` whose ``column`` is not owned, and all of ``new``."""
    return old.where(~F.col(column).isin(owned)).unionByName(new)


def nested(chain: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """inner, outer, n_outside, nested for each neighbour pair of ``chain``: distinct keys of the inner table that the outer lacks."""
    rows = []
    for (inner, a), (outer, b) in zip(chain, chain[1:]):
        n = a.select(key).distinct().join(b.select(key), key, "left_anti").agg(F.count("*").alias("n_outside"))
        rows.append(n.select(F.lit(inner).alias("inner"), F.lit(outer).alias("outer"), "n_outside", (F.col("n_outside") == 0).alias("nested")))
    return reduce(DataFrame.unionByName, rows)


def adequacy(counts: DataFrame, bucket: str, smallest: str, n: str, buckets: int, *, least: int, level: float = 0.95) -> DataFrame:
    """Whether the smallest bucket can carry a claim: n_small, n_all, share, thin, empty, points, half_width, gap_floor.

    It is thin under ``least`` instances or under an even share of the buckets. ``points`` is what one instance weighs, in per
    cent; ``half_width`` the worst case of one proportion's interval, ``gap_floor`` that of a difference of two; null if empty.
    """
    small = F.coalesce(F.sum(F.when(F.col(bucket) == smallest, F.col(n))), F.lit(0)).cast("long")
    sums = counts.agg(small.alias("n_small"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_all"))
    share = F.coalesce(F.try_divide("n_small", "n_all"), F.lit(0.0))
    width = F.try_divide(F.lit(50.0 * NormalDist().inv_cdf(0.5 + level / 2)), F.sqrt("n_small"))
    thin = (F.col("n_small") < least) | (share < 1 / buckets)
    return sums.select("n_small", "n_all", share.alias("share"), thin.alias("thin"), (F.col("n_small") == 0).alias("empty"), F.try_divide(F.lit(100.0), "n_small").alias("points"), width.alias("half_width"), (width * 2**0.5).alias("gap_floor"))
