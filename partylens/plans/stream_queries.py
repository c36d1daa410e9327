"""Streams over the events table, drained, and a scan of delimited files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partylens.plans.registry import query, t
from partylens.streaming import live


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    out = live.drain(live.windowed_counts(live.events(spark, d), "1 day"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2""")
def stream_sliding_counts(spark, d):
    out = live.drain(live.windowed_counts(live.events(spark, d), "12 hours", "6 hours"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS new, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return live.drain(live.session_counts(live.events(spark, d), "2 hours")).select("user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    out = live.first_of(live.events(spark, d), ["user_id", "event_type"], "365 days")
    return live.drain(out.select("user_id", "event_type"), "append")


@query("SELECT event_id, 'U' || user_id AS uid FROM events WHERE user_id % 3 = 0")
def stream_screen(spark, d):
    """Each event's party, in another order and legal form, against a static list."""
    parties = t(spark, d, "events").select("user_id").distinct().filter("user_id % 3 = 0").select(F.concat(F.lit("U"), "user_id").alias("uid"), F.concat(F.lit("Número "), "user_id", F.lit(" Ltd")).alias("name"))
    stream = live.events(spark, d).withColumn("party", F.concat("user_id", F.lit(" NUMERO, Inc.")))
    return live.drain(live.exact_screen(stream, "party", parties).select("event_id", "uid"), "append")


@query("SELECT user_id, count(*) AS events, count(*) - 1 AS edges, list(event_type ORDER BY ts, event_id)[-1] AS last_type FROM events GROUP BY user_id")
def stream_case_progress(spark, d):
    """Per-case state: events, edges and the last activity."""
    return live.drain(live.case_progress(live.events(spark, d)), "update")
