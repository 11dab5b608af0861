"""Assignment of targets to items of similar size under usage caps, a stable one, without a loop over rows.

Targets and items prefer each other by the squared distance of their log sizes, so all rows of one class and size are alike,
and the stable assignment is one of sizes: from each size of targets so many to each size of items. There are as many sizes as
a frame has, whatever the rows. They are matched in rounds: every size with something left proposes to its nearest size with
something left on the other side, and where two propose to each other, as many as both have are assigned. Rows then find
their partner by rank: the ranks of targets within their size and of uses within the items' size are running sums over range
partitions, so no size, class or item is one task.

A target may not get an item that shares its ``apart`` value (the image or group that both come from). Pairs that would are
left out and tried again with the uses that are left, in another order; what can't be placed so stays without an item. Few
targets are left then, and only the first uses of a size are asked for: items that can't hold them by their hash are not ranked.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.aggregates import running_sum
from marlstone.storage import persisted, scratch_tables

#: Distances that a task holds at once.
BLOCK = 1 << 22
#: Phases at most, and phases in a row without a new pair after which what is left stays so.
PHASES, IN_VAIN = 20, 3
#: Leading bits of the hashes that order a later phase: uses are counted a size and part.
PART_BITS = 5
_FLOWS = "cls string, w double, h double, flows array<struct<stop:bigint,shift:bigint,w:double,h:double,n:bigint>>"
#: Columns that rows alike share.
SIZE = ["cls", "w", "h"]


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the first nearest row of ``b``, and its distance."""
    best, far = np.empty(len(a), np.int64), np.empty(len(a))
    step = max(1, BLOCK // max(len(b), 1))
    for i in range(0, len(a), step):
        d = ((a[i : i + step, None, :] - b[None]) ** 2).sum(axis=2)
        best[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d.min(axis=1)
    return best, far


def flows_of(need: np.ndarray, have: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(size of targets, size of items, number) of the stable assignment; ``a`` and ``b`` are log sizes. Of equal distances the first sizes."""
    need, have, out = need.copy(), have.copy(), []
    while True:
        left, right = np.flatnonzero(need), np.flatnonzero(have)
        if not len(left) or not len(right):
            return out
        to, _ = _nearest(a[left], b[right])
        back, _ = _nearest(b[right], a[left])
        for i in np.flatnonzero(back[to] == np.arange(len(left))).tolist():
            s, c = int(left[i]), int(right[to[i]])
            n = int(min(need[s], have[c]))
            out.append((s, c, n))
            need[s] -= n
            have[c] -= n


def _matched_sizes(group: pa.Table) -> pa.Table:
    """Sizes of one class (side, w, h, n) to each target size's flows: from which rank on which size of items, and the shift to a rank there."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("side", "w", "h", "n"))))
    sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
    size = lambda own: np.log(np.maximum(np.array([[r[1], r[2]] for r in own], float).reshape(-1, 2), 1.0))
    a, b = size(sides[0]), size(sides[1])
    found = flows_of(*(np.array([r[3] for r in own], np.int64) for own in sides), a, b)
    near = lambda s, c: float(((a[s] - b[c]) ** 2).sum())
    at_item: dict[tuple[int, int], int] = {}
    used: dict[int, int] = {}
    for s, c, n in sorted(found, key=lambda f: (f[1], near(f[0], f[1]), f[0])):
        at_item[s, c] = used.get(c, 0)
        used[c] = used.get(c, 0) + n
    flows: dict[int, list[dict]] = {}
    for s, c, n in sorted(found, key=lambda f: (f[0], near(f[0], f[1]), f[1])):
        begin = flows[s][-1]["stop"] if s in flows else 0
        flows.setdefault(s, []).append({"stop": begin + n, "shift": at_item[s, c] - begin, "w": sides[1][c][1], "h": sides[1][c][2], "n": n})
    kind = pa.list_(pa.struct([("stop", pa.int64()), ("shift", pa.int64()), ("w", pa.float64()), ("h", pa.float64()), ("n", pa.int64())]))
    told = sorted(flows)
    return pa.table({"cls": pa.array([group.column("cls")[0].as_py()] * len(told), pa.string()), "w": pa.array([sides[0][s][1] for s in told], pa.float64()), "h": pa.array([sides[0][s][2] for s in told], pa.float64()), "flows": pa.array([flows[s] for s in told], kind)})


def _order(id_col: str, phase: int) -> Column:
    """What orders the rows of a size in a phase: ids in the first, then hashes."""
    return F.xxhash64(F.lit(phase), id_col) if phase else F.lit(0).cast("long")


def _part(id_col: str, phase: int) -> Column:
    """Which part of a phase's order a row is in; parts are in order."""
    return F.shiftright(_order(id_col, phase), 64 - PART_BITS) if phase else F.lit(0).cast("long")


def _ranked(rows: DataFrame, id_col: str, n: str, phase: int) -> DataFrame:
    """``rows`` with ``__before``: the sum of ``n`` over the rows of the class and size before each, in an order of this phase."""
    return running_sum(rows.withColumn("__order", _order(id_col, phase)), n, ["__order", id_col], SIZE).drop("__order")


def _asked_for(items: DataFrame, counts: DataFrame, flows: DataFrame, phase: int) -> DataFrame:
    """``items`` with ``__asked`` (uses of their size that flows ask for), without those whose part of the order lies behind them."""
    flow = flows.select("cls", F.explode("flows").alias("f")).select("cls", F.col("f.w").alias("w"), F.col("f.h").alias("h"), "f.n")
    asked = flow.groupBy(*SIZE).agg(F.sum("n").alias("__asked"))
    if not phase:
        return items.join(F.broadcast(asked), SIZE)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*SIZE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.where("side = 1").withColumn("__upto", before).join(asked, SIZE).where("__upto < __asked").groupBy(*SIZE, "__asked").agg(F.max("part").alias("__last"))
    return items.join(F.broadcast(last), SIZE).where(_part("item_id", phase) <= F.col("__last")).drop("__last")


def assigned(targets: DataFrame, items: DataFrame, cap: int, *, phases: int = PHASES) -> DataFrame:
    """target_id, item_id, phase of the targets that get an item; every item is used ``cap`` times at most.

    ``targets`` has target_id, ``items`` item_id, both cls, w, h and apart. Ids are different within each table. A null apart is
    shared with nothing. In the first phase targets and items of a size go by id; of equal distances the smaller sizes come first.
    """
    shape = lambda df, key: df.select(key, F.col("cls").cast("string").alias("cls"), *[F.col(c).cast("double").alias(c) for c in "wh"], "apart")
    out, vain = [], 0
    spark = targets.sparkSession
    with scratch_tables(spark) as written:
        open_targets = written(shape(targets, "target_id").withColumn("one", F.lit(1).cast("long")))
        open_items = written(shape(items, "item_id").withColumn("left", F.lit(cap).cast("long")))
        for phase in range(phases):
            # few rows, of which the classes' sizes and the items' parts are both summed
            count = lambda df, side, n, part: df.groupBy(*SIZE, part.alias("part")).agg(F.sum(n).alias("n")).withColumn("side", F.lit(side))
            counts = written(count(open_targets, 0, "one", F.lit(0).cast("long")).unionByName(count(open_items.where("left > 0"), 1, "left", _part("item_id", phase))))
            sizes = counts.groupBy(*SIZE, "side").agg(F.sum("n").alias("n"))
            flows = written(sizes.where("cls is not null").groupBy("cls").applyInArrow(_matched_sizes, _FLOWS))
            # a target without a flow has a use that no item has, its own, so that such targets lie in no one task
            flow = F.get(F.filter("flows", lambda f: F.col("__before") < f["stop"]), F.lit(0))
            asked = _ranked(open_targets, "target_id", "one", phase).join(F.broadcast(flows), SIZE, "left").withColumn("__f", flow)
            asked = asked.select(*open_targets.columns, F.coalesce("__f.w", "w").alias("i_w"), F.coalesce("__f.h", "h").alias("i_h"), F.coalesce(F.col("__before") + F.col("__f.shift"), -1 - F.col("__before")).alias("use"))
            uses = _ranked(_asked_for(open_items.where("left > 0"), counts, flows, phase), "item_id", "left", phase).where("__before < __asked")
            use = F.explode(F.sequence(F.col("__before"), F.least(F.col("__before") + F.col("left"), "__asked") - 1))
            uses = uses.select("item_id", "cls", F.col("w").alias("i_w"), F.col("h").alias("i_h"), F.col("apart").alias("i_apart"), use.alias("use"))
            clash = F.coalesce(F.col("apart") == F.col("i_apart"), F.lit(False)) | F.col("item_id").isNull()
            met = written(asked.join(uses, ["cls", "i_w", "i_h", "use"], "left").select(*open_targets.columns, F.when(~clash, F.col("item_id")).alias("item_id")))
            new = met.where("item_id is not null").select("target_id", "item_id", F.lit(phase).alias("phase"))
            vain = vain + 1 if new.isEmpty() else 0
            if vain == IN_VAIN:
                break
            out.append(new)
            open_targets = met.where("item_id is null").drop("item_id")
            if open_targets.isEmpty():
                break
            if not vain:
                taken = new.groupBy("item_id").agg(F.count("*").alias("__taken"))
                open_items = written(open_items.join(taken, "item_id", "left").withColumn("left", F.col("left") - F.coalesce("__taken", F.lit(0))).drop("__taken").where("left > 0"))
        return persisted(reduce(DataFrame.unionByName, out))
