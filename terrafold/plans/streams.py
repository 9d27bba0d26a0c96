"""Windows over event time (an extension beyond the reference)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators.tables import table as t
from terrafold.registry import register
from terrafold.streaming import windows


def _events(spark, d):
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    w = windows.windowed(_events(spark, d), "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("stream_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT user_id, ts, SUM(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT MIN(ts) AS start, user_id, COUNT(*) AS n FROM g GROUP BY user_id, k")
def stream_sessions(spark, d):
    s = windows.sessions(_events(spark, d), "30 minutes")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")
