"""Health snapshots: policy violations, stalls, sequential acceptance. Batch and stream run the same expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(value: Column, limits: dict[str, tuple[str, float]]) -> Column:
    """Names of the limits that a value breaks, in order: name -> (``max`` or ``min``, bound)."""
    return F.array_compact(F.array(*[F.when(value > b if kind == "max" else value < b, F.lit(name)) for name, (kind, b) in limits.items()]))


def checked(events: DataFrame, limits: dict[str, tuple[str, float]], value: str = "value") -> DataFrame:
    """``events`` with ``violations``; works on a stream as on a table."""
    return events.withColumn("violations", violations(F.col(value), limits))


def stalls(events: DataFrame, key: str, ts: str, progress: str, seconds: int) -> DataFrame:
    """Per key the spells of more than ``seconds`` without a new maximum of ``progress``: key, since, until."""
    w = Window.partitionBy(key).orderBy(ts, progress)
    best = F.max(progress).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = events.withColumn("__best", best).where(F.col("__best").isNull() | (F.col(progress) > F.col("__best")))
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    return steps.select(key, F.col(ts).alias("since"), after.alias("until")).where(F.unix_timestamp(F.col("until").cast("timestamp")) - F.unix_timestamp(F.col("since").cast("timestamp")) > seconds)


def windowed_violations(events: DataFrame, limits: dict[str, tuple[str, float]], *, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window_start, n, n_bad: tumbling counts behind a watermark."""
    rows = checked(events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), limits)
    out = rows.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.size("violations") > 0).alias("n_bad"))
    return out.select(F.col("w.start").alias("window_start"), "n", "n_bad")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now of a stream, as a table in memory (for small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def accepted_in_order(items: DataFrame, pool: str, order: str, hash_col: str, distance: int) -> DataFrame:
    """``pool``, ``order``, accepted: in order, an item is accepted if no accepted one is within ``distance`` bits.

    Acceptance depends on what came before, so each pool is one fold; independent pools run apart. Only (order, hash) go
    through it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = frame.sort_values(order)
        kept = np.zeros(len(frame), dtype=np.int64)
        n, flags = 0, []
        for h in frame[hash_col].to_numpy(np.int64):
            near = n and int(np.bitwise_count(np.bitwise_xor(kept[:n], h).view(np.uint64)).min()) <= distance
            flags.append(not near)
            if not near:
                kept[n] = h
                n += 1
        return frame[[pool, order]].assign(accepted=flags)

    return items.select(pool, order, hash_col).groupBy(pool).applyInPandas(fold, f"{pool} {kinds[pool]}, {order} {kinds[order]}, accepted boolean")


def stream_progress(events: DataFrame, key: str, ts: str, progress: str) -> DataFrame:
    """Stateful form of the stall check: key, best, changed_at after each batch, kept as state for each key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, at = state.get if state.exists else (float("-inf"), 0)
        for frame in frames:
            for t, p in frame[[ts, progress]].sort_values(ts).itertuples(index=False):
                if p > best:
                    best, at = float(p), int(t.timestamp())
        state.update((best, at))
        yield pd.DataFrame({key: [k[0]], "best": [best], "changed_at": [at]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, best double, changed_at long", "best double, changed_at long", "update", GroupStateTimeout.NoTimeout)
