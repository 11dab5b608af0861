"""Append-mode windows over two batches: late rows are dropped and counted, rows within the bound are kept."""

import time

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import health, windows

SCHEMA = "user string, ts timestamp, value double"
#: The third batch has a row within the bound of ten minutes and one beyond it; a watermark drops rows from the batch after next on.
BATCHES = [
    [("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 10:20:00", 99.0), ("b", "2024-01-01 10:58:00", 5.0)],
    [("d", "2024-01-01 10:58:00", 5.0)],
    [("a", "2024-01-01 10:50:00", 50.0), ("a", "2024-01-01 10:05:00", 70.0), ("b", "2024-01-01 12:30:00", 5.0)],
    [("c", "2024-01-01 15:00:00", 5.0)],
]


@pytest.fixture
def stream(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, "user string, ts string, value double").select("user", F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        time.sleep(1.1)  # batches go by time of the files
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, folder, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, df.sparkSession.table(name)


def test_sliding_windows_drop_late_rows(spark, stream, tmp_path):
    q, out = run(windows.sliding_violations(stream, {"hot": ("max", 60.0)}, window="1 hour", slide="30 minutes"), "sliding", tmp_path)
    got = {str(r.window_start)[11:16]: (r.n, r.n_bad) for r in out.collect()}
    # the watermark is 10:48 when 10:05 comes: the window that ends at 10:30 is closed, the one that ends at 11:00 isn't
    assert got == {"09:30": (2, 1), "10:00": (6, 2), "10:30": (3, 0), "12:00": (1, 0), "12:30": (1, 0)}
    assert windows.dropped(q) == 1


def test_sessions_drop_late_rows(spark, stream, tmp_path):
    q, out = run(windows.sessions(stream, "user", gap="30 minutes"), "sessions", tmp_path)
    got = sorted((r.user, str(r.session_start)[11:16], str(r.session_end)[11:16], r.n) for r in out.collect())
    assert got == [("a", "10:00", "11:20", 3), ("b", "10:58", "11:28", 1), ("b", "12:30", "13:00", 1), ("d", "10:58", "11:28", 1)]
    assert windows.dropped(q) == 1


def test_late_rows_are_counted_in_state(spark, stream, tmp_path):
    held = spark.conf.get(windows.ROCKSDB[0], None)
    spark.conf.set(*windows.ROCKSDB)
    try:
        _, out = run(windows.late_counts(stream, "user", bound=600), "late", tmp_path, "update")
        last = {r.key: (r.n, r.n_late) for r in out.groupBy("key").agg(F.max("n").alias("n"), F.max("n_late").alias("n_late")).collect()}
    finally:
        spark.conf.unset(windows.ROCKSDB[0]) if held is None else spark.conf.set(windows.ROCKSDB[0], held)
    assert last == {"a": (4, 1), "b": (2, 0), "c": (1, 0), "d": (1, 0)}


def test_stream_progress_keeps_the_best(spark, stream, tmp_path):
    _, out = run(health.stream_progress(stream, "user", "ts", "value"), "progress", tmp_path, "update")
    assert {r.user: r.best for r in out.groupBy("user").agg(F.max("best").alias("best")).collect()} == {"a": 99.0, "b": 5.0, "c": 5.0, "d": 5.0}
