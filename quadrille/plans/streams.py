"""Windows over the event table (the same operators serve streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows
from .registry import query, table


@query("daily_events", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS total_cents FROM events GROUP BY 1, 2")
def daily_events(spark, sf):
    w = windows.tumbling(table(spark, sf, "events"))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("total_cents"))


@query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events")).select("user_id", F.unix_timestamp("start").alias("start"), "n")
