"""Health events: violations, stalls, windows, sequential acceptance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.plans.fixtures import table, vectors
from marlstone.plans.registry import query
from marlstone.storage import shared_dir
from marlstone.streaming import health, windows

LIMITS = {"too_hot": ("max", 80.0), "too_cold": ("min", 2.0), "hot": ("max", 60.0)}


@query("SELECT event_id, concat_ws(',', CASE WHEN value > 80 THEN 'too_hot' END, CASE WHEN value < 2 THEN 'too_cold' END, CASE WHEN value > 60 THEN 'hot' END) AS violations FROM events WHERE value > 60 OR value < 2")
def health_violations(spark, sf_dir):
    """Events that break a limit, with all the limits they break."""
    out = health.checked(table(spark, sf_dir, "events"), LIMITS).where(F.size("violations") > 0)
    return out.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("""
WITH b AS (SELECT user_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
s AS (SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM b WHERE best IS NULL OR value > best)
SELECT user_id, since, until FROM s WHERE floor(epoch(until)) - floor(epoch(since)) > 86400""")
def progress_stalls(spark, sf_dir):
    """More than a day without a new best."""
    return health.stalls(table(spark, sf_dir, "events"), "user_id", "ts", "value", 86400)


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE value > 60 OR value < 2) AS n_bad FROM events GROUP BY 1")
def streamed_violation_windows(spark, sf_dir):
    """Tumbling windows over a stream of the events table, run to its end."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"windows_{uuid.uuid4().hex}"
    out = health.run_once(health.windowed_violations(stream, LIMITS, window="1 day"), name, f"{shared_dir(spark)}/{name}", "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query()
def sequential_acceptance(spark, sf_dir):
    """Items taken in order unless near an accepted one; pools by label."""
    v = vectors(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return health.accepted_in_order(v, "label", "item_id", "hash", 24)


def _streamed(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _plain_times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("""
WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 hour AS mark FROM events),
w AS (SELECT time_bucket(INTERVAL 6 hours, ts) - d * INTERVAL 6 hours AS window_start, value FROM events, range(4) r(d))
SELECT window_start, count(*) AS n, count(*) FILTER (WHERE value > 60 OR value < 2) AS n_bad FROM w, m WHERE window_start + INTERVAL 1 day <= mark GROUP BY window_start""")
def streamed_sliding_windows(spark, sf_dir):
    """Overlapping windows in append mode: those that the watermark has passed at the stream's end."""
    name = f"sliding_{uuid.uuid4().hex}"
    out = windows.sliding_violations(_streamed(spark, sf_dir), LIMITS, late="1 hour", window="1 day", slide="6 hours")
    return _plain_times(health.run_once(out, name, f"{shared_dir(spark)}/{name}"), "window_start")


@query("""
WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 hour AS mark FROM events),
g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 hours THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 hours AS session_end, count(*) AS n FROM s, m GROUP BY user_id, k, mark HAVING max(ts) + INTERVAL 12 hours <= mark""")
def streamed_sessions(spark, sf_dir):
    """A user's sessions in append mode: those that the watermark has passed at the stream's end."""
    name = f"sessions_{uuid.uuid4().hex}"
    out = windows.sessions(_streamed(spark, sf_dir), "user_id", late="1 hour", gap="12 hours")
    return _plain_times(health.run_once(out, name, f"{shared_dir(spark)}/{name}"), "session_start", "session_end")
