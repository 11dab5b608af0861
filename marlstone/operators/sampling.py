"""Deterministic sampling by hash rank, strata, quotas."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.hashing import hash_hex
from marlstone.operators.aggregates import running_sum


def top_by_hash(df: DataFrame, id_col: str, n: int, seed: int | str) -> DataFrame:
    """The ``n`` rows with the smallest hash ranks: a sample that grows by nesting."""
    return df.orderBy(hash_hex(seed, F.col(id_col)), id_col).limit(n)


def representative(df: DataFrame, group: str, id_col: str, seed: int | str) -> DataFrame:
    """Of each group the row with the smallest hash rank: group, id."""
    return df.groupBy(group).agg(F.min_by(id_col, F.struct(hash_hex(seed, F.col(id_col)).alias("h"), F.col(id_col).alias("i"))).alias(id_col))


def first_in_group(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` of each group with their rank; ranks beyond ``n`` are dropped while they are sorted."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(out) <= n)


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """``df`` with its row number (from 1) in a total order, by range partitions and offsets: no task holds all rows."""
    ranked = running_sum(df.withColumn("__one", F.lit(1)), "__one", order, [])
    return ranked.withColumn(out, (F.col("__before") + 1).cast("long")).drop("__one", "__before")


def tiles(df: DataFrame, order: list[str], k: int, out: str = "tile") -> DataFrame:
    """Row numbers cut into ``k`` runs whose sizes differ by one at most, the longer ones first."""
    n = df.count()
    size, more = divmod(n, k)
    r = F.col("__rank") - 1
    tile = F.when(r < more * (size + 1), F.floor(r / (size + 1))).otherwise(more + F.floor((r - more * (size + 1)) / max(size, 1))) + 1
    return global_rank(df, order, "__rank").withColumn(out, tile.cast("int")).drop("__rank")


def settled_quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Quotas of about n * size / total, rounded half to even, then settled by one each where the slack is largest."""
    total = sum(sizes.values())
    exact = {k: n * v / total for k, v in sizes.items()}
    quota = {k: min(sizes[k], round(x)) for k, x in exact.items()}
    while (left := min(n, total) - sum(quota.values())) != 0:
        sign = 1 if left > 0 else -1
        free = [k for k in quota if 0 <= quota[k] + sign <= sizes[k]]
        best = max(free, key=lambda k: (sign * (exact[k] - quota[k]), k))
        quota[best] += sign
    return quota


def stratified(df: DataFrame, stratum: str, id_col: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows over the strata by settled quotas, in each those with the smallest hash ranks. Strata are few."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    quota = settled_quotas(sizes, n)
    allowed = F.coalesce(*[F.when(F.col(stratum).eqNullSafe(F.lit(k)), F.lit(q)) for k, q in quota.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_hex(seed, F.col(id_col)), id_col))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= allowed).drop("__rank")


def round_robin(df: DataFrame, bucket: str, id_col: str, n: int) -> DataFrame:
    """``n`` rows, one of each bucket in turn: by rank within the bucket, then bucket."""
    ranked = first_in_group(df, [bucket], [F.col(id_col)], n)
    return ranked.orderBy("rank", bucket).limit(n).drop("rank")


def lowest_share(df: DataFrame, value: str, id_col: str, percent: int) -> DataFrame:
    """The floor(n * percent / 100) rows with the smallest (value, id)."""
    n = df.count() * percent // 100
    return global_rank(df, [value, id_col], "__rank").where(F.col("__rank") <= n).drop("__rank")


def largest_remainder(weights: dict[str, float], n: int) -> dict[str, int]:
    """``n`` dealt out by weight: the whole parts, and one more each for the largest remainders (of equal ones the first names)."""
    if n < 0 or any(w < 0 for w in weights.values()) or (n and not sum(weights.values()) > 0):
        raise ValueError("weights must not be negative, and some must be positive")
    exact = {k: Fraction(w) * n / sum(map(Fraction, weights.values())) for k, w in weights.items()} if n else dict.fromkeys(weights, Fraction(0))
    quota = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (quota[k] - exact[k], k))[: n - sum(quota.values())]:
        quota[k] += 1
    return quota


def weighted_sequence(spark: SparkSession, weights: dict[str, float], n: int, seed: int | str) -> DataFrame:
    """position, name: ``n`` names by weight in a random order.

    Each name comes once, the other places go by weight (largest remainders). With fewer places than names it is ``n``
    different ones, the heavier the likelier: those with the least -ln(u) / weight, u from the hash of the name. The order
    is that of the hashes of (name, number), found by range partitions, so it depends on the seed and the quotas alone.
    """
    names = sorted(weights)
    if n < len(names):
        unit = {k: (int(hashlib.sha256(f"{seed}|{k}".encode()).hexdigest()[:16], 16) + 1) / 2.0**64 for k in names}
        chosen = sorted((k for k in names if weights[k] > 0), key=lambda k: (-math.log(unit[k]) / weights[k], k))[:n]
        if len(chosen) < n:
            raise ValueError("fewer names with a weight than places")
        quota = dict.fromkeys(chosen, 1)
    else:
        quota = {k: 1 + more for k, more in largest_remainder(weights, n - len(names)).items()}
    ends, at = [], 0
    for k, q in sorted(quota.items()):
        at += q
        ends.append((k, at - q, at))
    name = F.coalesce(*[F.when(F.col("id") < stop, F.lit(k)) for k, _, stop in ends], F.lit(None).cast("string"))
    first = F.coalesce(*[F.when(F.col("id") < stop, F.lit(start)) for _, start, stop in ends], F.lit(0))
    rows = spark.range(n).select(name.alias("name"), (F.col("id") - first).alias("i"))
    ranked = global_rank(rows.withColumn("h", hash_hex(seed, F.concat_ws(":", "name", F.col("i").cast("string")))), ["h", "name", "i"])
    return ranked.select((F.col("rank") - 1).alias("position"), "name")
