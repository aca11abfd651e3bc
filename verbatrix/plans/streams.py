"""Streaming queries over events, with batch SQL as their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatrix.plans.registry import query
from verbatrix.streaming import incremental as M

_TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_SHOW = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# append mode emits a window once the watermark has passed its end
@query(f"""SELECT event_type, {_TEXT.format("time_bucket(INTERVAL '1 day', ts)")} AS window_start, count(*) AS n FROM events WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events) GROUP BY 1, 2""")
def tumbling_counts(spark, d):
    out = M.drain(M.tumbling(M.stream_table(spark, d, "events"), "ts", ["event_type"], "1 day", "10 minutes"))
    return out.withColumn("window_start", _SHOW("window_start"))


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, {_TEXT.format('min(ts)')} AS session_start, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL '12 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def session_counts(spark, d):
    out = M.drain(M.sessions(M.stream_table(spark, d, "events"), "ts", ["user_id"], "12 hours", "10 minutes"))
    return out.select("user_id", _SHOW("session_start").alias("session_start"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def late_dedupe(spark, d):
    """Every event sent twice comes out once."""
    events = M.stream_table(spark, d, "events")
    twice = events.select("event_id", "user_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return M.drain(M.late_dedupe(twice, "ts", ["event_id"], "365 days")).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, before, event_type AS after FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before <> event_type")
def change_detection(spark, d):
    return M.drain(M.changes(M.stream_table(spark, d, "events"), "user_id", "event_type", "event_id"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def heartbeat_latest(spark, d):
    rows = M.stream_table(spark, d, "events").select("user_id", "event_id", "event_type")
    return M.drain_upserts(rows, ["user_id"], ["event_id"])
