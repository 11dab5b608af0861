"""Assignment of whole groups to splits.

Groups are as many as there are near-duplicate groups, so only (group, size, class counts) rows are allocated; they are
pulled through one task in order of size, in batches, with a state of one deficit for each split and class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import hash_hex


def allocate(groups: DataFrame, shares: dict[str, float], seed: int = 1337, classes: tuple[str, ...] = ()) -> DataFrame:
    """``groups`` (group_id, size and a count for each of ``classes``) to splits: group_id, size, split.

    Largest group first, ties by hash; each goes to the split with the largest mean relative deficit of images and
    classes; of equal ones (to 1e-12) the first in the order of ``shares``. A split is never given a group of rows twice,
    and every group gets one split.
    """
    columns = ["size", *classes]
    totals = {c: float(v or 0) for c, v in zip(columns, groups.agg(*[F.sum(c) for c in columns]).first())}
    names = list(shares)

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = {s: {c: totals[c] * shares[s] for c in columns} for s in names}
        left = {s: dict(target[s]) for s in names}
        for batch in batches:
            splits = []
            for row in batch[columns].itertuples(index=False):
                best, most = names[0], None
                for s in names:
                    parts = [left[s][c] / target[s][c] for c in columns if target[s][c] > 0]
                    need = sum(parts) / max(1, len(parts))
                    if most is None or need > most + 1e-12:
                        best, most = s, need
                for c, n in zip(columns, row):
                    left[best][c] -= n
                splits.append(best)
            yield batch[["group_id", "size"]].assign(split=splits)

    ordered = groups.withColumn("__h", hash_hex(seed, F.col("group_id"))).orderBy(F.desc("size"), "__h", "group_id").coalesce(1)
    kind = groups.schema["group_id"].dataType.simpleString()
    return ordered.mapInPandas(assign, f"group_id {kind}, size long, split string")


def refilled_nearest(targets: DataFrame, pool: DataFrame, group: list[str]) -> DataFrame:
    """For each target in order of id the nearest free pool row by squared distance of log sizes: target_id, pool_id.

    Both have ``group`` columns, id, w and h. A used row is free again once all rows of the group are used; equal distances go
    to the smaller id. Groups (class, fold and context) are worked on apart.
    """
    import numpy as np

    rows = targets.select(*group, "id", "w", "h", F.lit(0).alias("side")).unionByName(pool.select(*group, "id", "w", "h", F.lit(1).alias("side")))

    def match(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        t, p = frame[frame.side == 0], frame[frame.side == 1]
        size = lambda x: np.log(np.maximum(x[["w", "h"]].to_numpy(float), 1))
        a, b, ids = size(t), size(p), p["id"].to_numpy()
        free, out = np.ones(len(p), dtype=bool), []
        for i, row in zip(t["id"].tolist(), a):
            if not len(p):
                break
            if not free.any():
                free[:] = True
            d = np.where(free, ((b - row) ** 2).sum(1), np.inf)
            k = int(d.argmin())
            free[k] = False
            out.append((i, int(ids[k])))
        return pd.DataFrame(out, columns=["target_id", "pool_id"])

    return rows.groupBy(*group).applyInPandas(match, "target_id long, pool_id long")
