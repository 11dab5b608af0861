"""Counts, rates, percentiles and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.storage import persisted

#: Closed ranges: an area on a boundary is in two of them.
AREA_RANGES = [("all", 0, 10**8), ("small", 0, 1024), ("medium", 1024, 9216), ("large", 9216, 10**8)]


def zero_filled(counts: DataFrame, domain: DataFrame, *on: str) -> DataFrame:
    """``counts`` for every row of ``domain``; missing numbers are 0."""
    return domain.join(counts, [*on], "left").na.fill(0)


def in_ranges(df: DataFrame, value: Column, ranges: list[tuple[str, float, float]] = AREA_RANGES, out: str = "bucket") -> DataFrame:
    """A row for each closed range [low, high] that holds the value, without a join: ranges are literals."""
    names = F.array(*[F.when(value.between(low, high), F.lit(name)) for name, low, high in ranges])
    return df.select("*", F.explode(F.array_compact(names)).alias(out))


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percentiles(value: str, *shares: float, scale: int = 6) -> list[Column]:
    """Percentiles with linear interpolation, named p5, p50, ..."""
    return [F.round(F.percentile(value, F.lit(s)), scale).alias(f"p{round(s * 100)}") for s in shares]


def grouped_percentiles(df: DataFrame, value: str, groups: list[str], *shares: float, scale: int = 6) -> DataFrame:
    """``groups`` and the percentiles of ``percentiles``, for groups of any size.

    Equal values are counted first, and running sums of the counts over range partitions say which values stand at the ranks
    asked for, so that no task holds the values of a group. A group without a value has nulls. Groups are few: their sizes are broadcast.
    """
    counts = df.groupBy(*groups, value).agg(F.count(value).alias("__n"))
    summed = running_sum(counts, "__n", [value], groups)
    total = df.groupBy(*groups).agg(F.count(value).alias("__total"))
    own = total.select(*[F.col(c).alias(f"__of_{c}") for c in groups], "__total")
    met = summed.join(F.broadcast(own), [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in groups])
    at = [F.lit(float(s)) * (F.col("__total") - 1) for s in shares]
    holds = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
    ends = [F.max(F.when(holds(rank(a)), F.col(value))).alias(f"__{side}{i}") for i, a in enumerate(at) for side, rank in (("low", F.floor), ("high", F.ceil))]
    found = met.groupBy(*groups, "__total").agg(*ends)

    def between(i: int) -> Column:
        low, high = F.col(f"__low{i}").cast("double"), F.col(f"__high{i}").cast("double")
        return F.when(F.floor(at[i]) == F.ceil(at[i]), low).otherwise((F.ceil(at[i]) - at[i]) * low + (at[i] - F.floor(at[i])) * high)

    return found.select(*groups, *[F.round(between(i), scale).alias(f"p{round(s * 100)}") for i, s in enumerate(shares)])


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Micro-averages; denominators count as 1 at least."""
    one = F.lit(1)
    p, r = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


def average_ranks(df: DataFrame, value: str, out: str, *partition: str) -> DataFrame:
    """``df`` with tie-averaged ranks of ``value``.

    Ranks come from counts of distinct values: one range-partitioned running sum over them, joined back. With
    ``partition`` each group has ranks of its own.
    """
    counts = df.groupBy(*partition, value).agg(F.count("*").alias("__n"))
    summed = running_sum(counts, "__n", [value], list(partition))
    ranks = summed.select(*partition, value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, [*partition, value])


def running_sums(df: DataFrame, values: dict[str, str], order: list[str], partition: list[str]) -> DataFrame:
    """``df`` with a sum for each of ``values`` (column -> new column): over the rows before each, in a total order, within a group.

    Rows are range-partitioned by group and order; each part adds its own running sums to the totals of the parts before
    it, so that no part has to hold a whole group. Which part a row is in depends on the sample that the ranges are cut by,
    so rows and parts are written once, and both totals and rows come from there. Null groups and null keys are ordered
    first, as in any sort; a null value adds nothing.
    """
    keys = [*partition, *order]
    own = Window.partitionBy("__part", *partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    within = persisted(parts.withColumns({out: F.coalesce(F.sum(value).over(own), F.lit(0)) for value, out in values.items()}))
    totals = within.groupBy("__part", *partition).agg(*[F.sum(value).alias(f"__sum_{out}") for value, out in values.items()])
    before = Window.partitionBy(*partition).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    same = ["__part", *partition]
    offsets = totals.select(*[F.col(c).alias(f"__of_{c}") for c in same], *[F.coalesce(F.sum(f"__sum_{out}").over(before), F.lit(0)).alias(f"__offset_{out}") for out in values.values()])
    met = within.join(offsets, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in same], "left")
    return met.select(*df.columns, *[(F.col(out) + F.col(f"__offset_{out}")).alias(out) for out in values.values()])


def running_sum(df: DataFrame, value: str, order: list[str], partition: list[str]) -> DataFrame:
    """``df`` with ``__before``: the running sum of one column, see ``running_sums``."""
    return running_sums(df, {value: "__before"}, order, partition)


def roc_auc(df: DataFrame, label: str, score: str, *group: str) -> DataFrame:
    """Tie-corrected area under the ROC curve for each group; null where a label is missing."""
    ranked = average_ranks(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()), score, "__rank", *group)
    positive = F.col(label) == 1
    sums = ranked.groupBy(*group).agg(F.sum(F.when(positive, F.col("__rank"))).alias("__s"), F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))
    return sums.withColumn("auc", F.try_divide(F.col("__s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))).drop("__s")


def spearman(df: DataFrame, a: str, b: str, *group: str) -> DataFrame:
    """Rank correlation for each group."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(rows, a, "__ra", *group), b, "__rb", *group)
    return ranked.groupBy(*group).agg(F.corr("__ra", "__rb").alias("rho"), F.count("*").alias("n"))


def mean_of_defined(value: str, undefined: float = -1.0) -> Column:
    """Mean of the values above ``undefined``, which is also the result where there are none."""
    return F.coalesce(F.avg(F.when(F.col(value) > undefined, F.col(value))), F.lit(undefined))


def centre_entropy(df: DataFrame, bins: int, *group: str) -> DataFrame:
    """Entropy of normalised centres (cx, cy in [0, 1]) on a grid with one added to each cell, over its largest value.

    Also the peak probability. Only cells that are hit are counted; the rest enter in closed form.
    """
    cell = lambda c: F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1 - 1e-9)) * bins)
    cells = df.groupBy(*group, cell("cx").alias("col"), cell("cy").alias("row")).agg(F.count("*").alias("n"))
    total = cells.groupBy(*group).agg((F.sum("n") + bins * bins).alias("total"), F.count("*").alias("hit"), F.max("n").alias("top"))
    p = (F.col("n") + 1) / F.col("total")
    parts = cells.join(total, [*group]).groupBy(*group, "total", "hit", "top").agg(F.sum(-p * F.ln(p)).alias("h"))
    empty = 1 / F.col("total")
    h = F.col("h") - (bins * bins - F.col("hit")) * empty * F.ln(empty)
    return parts.select(*group, (h / F.ln(F.lit(float(bins * bins)))).alias("entropy"), ((F.col("top") + 1) / F.col("total")).alias("peak"))
