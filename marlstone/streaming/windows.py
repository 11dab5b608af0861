"""Windows behind a watermark in append mode: each window is given once, when no row can reach it any more; later rows are dropped.

The watermark is the largest time seen, less the bound for late rows. ``late_counts`` keeps what arrives too late in state of
its own, by key, so that it is known where rows are lost; ``dropped`` is the engine's own number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marlstone.streaming.health import checked

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LATE_SCHEMA = "n long, n_late long, newest timestamp"


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sliding_violations(events: DataFrame, limits: dict[str, tuple[str, float]], *, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """window_start, n, n_bad of overlapping windows; a row is in each that holds it."""
    rows = checked(_timed(events, ts, late), limits)
    out = rows.groupBy(F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.size("violations") > 0).alias("n_bad"))
    return out.select(F.col("w.start").alias("window_start"), "n", "n_bad")


def sessions(events: DataFrame, key: str, *, ts: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """key, session_start, session_end, n: spells of a key's rows with ``gap`` or less between them; the end is ``gap`` after the last."""
    out = _timed(events, ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class LateRows(StatefulProcessor):
    """Rows of a key, those that came more than ``bound`` seconds after a newer one of the key, and the newest time."""

    def __init__(self, ts: str, bound: int):
        self.ts, self.bound = ts, bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", LATE_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, n_late, newest = self.seen.get() if self.seen.exists() else (0, 0, None)
        limit = newest  # rows of one batch came together
        for frame in rows:
            times = pd.to_datetime(frame[self.ts])
            n += len(times)
            if limit is not None:
                n_late += int((times < pd.Timestamp(limit) - pd.Timedelta(seconds=self.bound)).sum())
            newest = max(times.max(), pd.Timestamp(newest)) if newest is not None else times.max()
        self.seen.update((n, n_late, newest.to_pydatetime()))
        yield pd.DataFrame({"key": [str(key[0])], "n": [n], "n_late": [n_late]})

    def close(self) -> None:
        pass


def late_counts(events: DataFrame, key: str, *, ts: str = "ts", bound: int = 600) -> DataFrame:
    """key, n, n_late after each batch of a stream, for keys that it touched. State is kept by key in RocksDB (set ROCKSDB)."""
    rows = events.select(key, F.col(ts).cast("timestamp").alias(ts))
    return rows.groupBy(key).transformWithStateInPandas(LateRows(ts, bound), outputStructType="key string, n long, n_late long", outputMode="Update", timeMode="None")


def dropped(query: StreamingQuery) -> int:
    """Rows that a query has dropped because they were behind its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
