"""Process mining over the events table. A case is one user's day."""

from __future__ import annotations

from pyspark.sql import functions as F

from partylens.operators import process as P
from partylens.plans.registry import query, t

_LOG = "log AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id, event_type AS activity, ts, event_id, user_id FROM events)"
_NEXT = f"{_LOG}, steps AS (SELECT *, lead(activity) OVER w AS next_activity, lead(ts) OVER w AS next_ts FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))"
_TRACES = f"{_LOG}, traces AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts, event_id) AS variant, count(*) AS steps FROM log GROUP BY case_id)"
_SEC = "(epoch_us({b}) - epoch_us({a})) / 1e6"


def log(spark, d):
    case = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("ts").cast("date").cast("string"))
    return t(spark, d, "events").select(case.alias("case_id"), F.col("event_type").alias("activity"), "ts", "event_id", "user_id")


@query(f"WITH {_NEXT} SELECT activity AS from_activity, next_activity AS to_activity, count(*) AS n FROM steps WHERE next_activity IS NOT NULL GROUP BY ALL")
def dfg_edges(spark, d):
    return P.dfg_edges(log(spark, d))


@query(f"""WITH {_NEXT}, w AS (SELECT activity, next_activity, {_SEC.format(a="ts", b="next_ts")} AS wait FROM steps WHERE next_activity IS NOT NULL),
g AS (SELECT activity AS from_activity, next_activity AS to_activity, count(*) AS n, quantile_cont(wait, 0.5) AS m, quantile_cont(wait, 0.95) AS p FROM w GROUP BY ALL)
SELECT from_activity, to_activity, n, round(m, 3) AS median_wait, round(p, 3) AS p95_wait, round(m * n, 2) AS exposure FROM g""")
def dfg_waits(spark, d):
    return P.dfg_waits(log(spark, d))


@query(f"""WITH {_LOG}, c AS (SELECT DISTINCT case_id, first_value(activity) OVER w AS f, last_value(activity) OVER w AS l FROM log
WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT f AS activity, count(*) AS starts FROM c GROUP BY 1), e AS (SELECT l AS activity, count(*) AS ends FROM c GROUP BY 1)
SELECT coalesce(s.activity, e.activity) AS activity, coalesce(starts, 0) AS starts, coalesce(ends, 0) AS ends FROM s FULL JOIN e ON s.activity = e.activity""")
def dfg_start_end(spark, d):
    return P.start_end(log(spark, d))


@query(f"""WITH {_NEXT} SELECT s.activity AS from_activity, s.next_activity AS to_activity, count(*) AS n FROM steps s WHERE s.next_activity IS NOT NULL
AND EXISTS (SELECT 1 FROM log b WHERE b.case_id = s.case_id AND b.activity = s.next_activity AND (b.ts < s.ts OR (b.ts = s.ts AND b.event_id <= s.event_id))) GROUP BY ALL""")
def rework_edges(spark, d):
    return P.rework_edges(log(spark, d))


@query(f"WITH {_TRACES} SELECT variant, count(*) AS cases FROM traces GROUP BY variant")
def variants(spark, d):
    return P.variants(log(spark, d))


@query(f"""WITH {_TRACES}, v AS (SELECT variant, count(*) AS cases FROM traces GROUP BY variant)
SELECT CAST(row_number() OVER w AS INTEGER) AS rank, variant, cases, round(sum(cases) OVER (ORDER BY cases DESC, variant ROWS UNBOUNDED PRECEDING) / (SELECT sum(cases) FROM v), 6) AS coverage
FROM v WINDOW w AS (ORDER BY cases DESC, variant)""")
def variant_coverage(spark, d):
    return P.variant_coverage(log(spark, d))


@query(f"""WITH {_TRACES} SELECT count(*) AS cases, quantile_cont(steps, 0.5) AS median_steps, max(steps) AS most_steps, (SELECT count(DISTINCT activity) FROM log) AS activities,
CASE WHEN quantile_cont(steps, 0.5) <= 2 THEN 'reject' ELSE 'ok' END AS case_notion,
CASE WHEN (SELECT count(DISTINCT activity) FROM log) < 5 THEN 'coarse' WHEN (SELECT count(DISTINCT activity) FROM log) > 15 THEN 'fine' ELSE 'healthy' END AS granularity FROM traces""")
def trace_stats(spark, d):
    return P.trace_stats(log(spark, d))


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)
SELECT count(*) AS cases, count(*) FILTER (a >= TIMESTAMP '2024-01-05 12:00:00' AND b < TIMESTAMP '2024-01-25 12:00:00') AS complete,
round(1 - count(*) FILTER (a >= TIMESTAMP '2024-01-05 12:00:00' AND b < TIMESTAMP '2024-01-25 12:00:00') / count(*), 6) AS excluded FROM s""")
def censoring(spark, d):
    return P.censoring(log(spark, d), "2024-01-05 12:00:00", "2024-01-25 12:00:00")


@query(f"""WITH {_LOG}, c AS (SELECT case_id, arg_max(activity, (ts, event_id)) AS last, bool_or(activity = 'purchase') AS done FROM log GROUP BY case_id)
SELECT last AS activity, count(*) AS cases FROM c WHERE NOT done GROUP BY last""")
def stalled(spark, d):
    return P.stalled(log(spark, d), ["purchase"])


_CONFIGURED = "('signup','view'),('view','click'),('click','purchase'),('purchase','refund')"


def _conformance(spark, d):
    configured = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "refund")], "from_activity string, to_activity string")
    return P.conformance(log(spark, d), configured)


_CONF_SQL = f"""WITH {_NEXT}, o AS (SELECT activity AS f, next_activity AS g, count(*) AS n FROM steps WHERE next_activity IS NOT NULL GROUP BY ALL),
c(f, g) AS (VALUES {_CONFIGURED})
SELECT coalesce(c.f, o.f) AS from_activity, coalesce(c.g, o.g) AS to_activity, CASE WHEN o.n IS NULL THEN 'unused' WHEN c.f IS NULL THEN 'undefined' ELSE 'conforming' END AS kind, coalesce(n, 0) AS n
FROM c FULL JOIN o ON c.f = o.f AND c.g = o.g"""


@query(f"SELECT from_activity, to_activity FROM ({_CONF_SQL}) WHERE kind = 'unused'")
def conformance_unused(spark, d):
    return _conformance(spark, d).filter("kind = 'unused'").select("from_activity", "to_activity")


@query(f"SELECT from_activity, to_activity, n FROM ({_CONF_SQL}) WHERE kind = 'undefined'")
def conformance_undefined(spark, d):
    return _conformance(spark, d).filter("kind = 'undefined'").select("from_activity", "to_activity", "n")


@query(f"""WITH {_LOG}, g AS (SELECT *, CASE WHEN {_SEC.format(a="lag(ts) OVER w", b="ts")} > 3600 THEN 1 ELSE 0 END AS new FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT case_id, CAST(session AS BIGINT) AS session, count(*) AS events, round({_SEC.format(a="min(ts)", b="max(ts)")}, 3) AS seconds FROM n GROUP BY case_id, session""")
def sessions(spark, d):
    return P.sessions(log(spark, d), 3600)


@query(f"""WITH {_LOG}, m AS (SELECT *, CASE WHEN activity IN ('click', 'view') THEN 'browse' ELSE activity END AS a FROM log),
g AS (SELECT *, coalesce(lag(a) OVER w = a AND {_SEC.format(a="lag(ts) OVER w", b="ts")} <= 7200, false) AS again FROM m WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))
SELECT a AS activity, count(*) AS n FROM g WHERE NOT again GROUP BY a""")
def activity_collapse(spark, d):
    return P.collapse(log(spark, d), {"click": "browse", "view": "browse"}, 7200).groupBy("activity").agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 3")
def burst_minutes(spark, d):
    return P.bursts(log(spark, d), 3)


@query("""WITH l AS (SELECT user_id, event_id, ts - INTERVAL 1 HOUR * (event_id % 2) AS ts FROM events),
g AS (SELECT user_id, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), false) AS back FROM l)
SELECT CAST(user_id AS VARCHAR) AS case_id, count(*) FILTER (back) AS back, count(*) AS events FROM g GROUP BY 1 HAVING count(*) FILTER (back) > 0""")
def tz_mix(spark, d):
    shifted = F.when(F.col("event_id") % 2 == 1, F.expr("ts - interval 1 hour")).otherwise(F.col("ts"))
    return P.clock_mix(log(spark, d).withColumn("case_id", F.col("user_id").cast("string")).withColumn("ts", shifted))


@query("""SELECT count(*) AS events, round(count(*) FILTER (user_id IS NULL) / count(*), 6) AS actor_null, round(count(*) FILTER (ts IS NULL) / count(*), 6) AS time_null,
round(count(*) FILTER (event_type IS NULL) / count(*), 6) AS activity_null, round(count(*) FILTER (user_id IS NULL OR ts IS NULL) / count(*), 6) AS case_null,
count(*) > 0 AND count(*) FILTER (user_id IS NULL OR ts IS NULL OR event_type IS NULL) = 0 AS eligible FROM events""")
def log_eligibility(spark, d):
    return P.eligibility(log(spark, d), "user_id")


@query(f"""WITH {_LOG}, c AS (SELECT case_id, {_SEC.format(a="min(ts)", b="max(ts)")} AS s FROM log GROUP BY case_id), w AS (SELECT {_SEC.format(a="min(ts)", b="max(ts)")} AS w FROM log)
SELECT round(quantile_cont(s, 0.5), 3) AS median_seconds, round(any_value(w), 3) AS window_seconds, any_value(w) >= 3 * quantile_cont(s, 0.5) AS sufficient FROM c, w""")
def window_check(spark, d):
    return P.window_check(log(spark, d))


@query("""WITH l AS (SELECT event_type AS activity, CASE WHEN user_id % 3 = 0 THEN 'integration' ELSE 'human' END AS lane FROM events)
SELECT lane, activity, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lane), 6) AS share FROM l GROUP BY lane, activity""")
def lane_share(spark, d):
    from pyspark.sql import Window

    lane = F.when(F.col("user_id") % 3 == 0, "integration").otherwise("human")
    counts = log(spark, d).groupBy(lane.alias("lane"), "activity").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lane")), 6))


@query("""WITH l AS (SELECT *, user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id, CASE WHEN user_id % 3 = 0 THEN 'integration' ELSE 'human' END AS lane FROM events),
s AS (SELECT lane, event_type AS a, lead(event_type) OVER (PARTITION BY lane, case_id ORDER BY ts, event_id) AS b FROM l)
SELECT lane, a AS from_activity, b AS to_activity, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL""")
def dfg_by_lane(spark, d):
    lane = F.when(F.col("user_id") % 3 == 0, "integration").otherwise("human")
    steps = P.with_next(log(spark, d).withColumn("lane", lane)).filter("next_activity is not null")
    return steps.groupBy("lane", F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity")).agg(F.count("*").alias("n"))


@query(f"""WITH {_LOG}, ok AS (SELECT case_id FROM log GROUP BY case_id HAVING min(ts) >= (SELECT min(ts) FROM events) + INTERVAL 5 DAY), b AS (SELECT date_trunc('minute', ts) AS m FROM log GROUP BY 1 HAVING count(*) >= 2)
SELECT event_id FROM log WHERE case_id IN (SELECT case_id FROM ok) AND date_trunc('minute', ts) NOT IN (SELECT m FROM b)""")
def settled_log(spark, d):
    """The log from five days after its first event on, without minutes of bulk entry."""
    events = log(spark, d)
    start = events.agg(F.min("ts").alias("a")).select(F.date_format(F.col("a") + F.expr("INTERVAL 5 DAYS"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return P.settled(events, start, 2).select("event_id")


@query(f"WITH {_TRACES}, v AS (SELECT variant, count(*) AS cases FROM traces GROUP BY variant), b AS (SELECT sum(cases) AS c FROM (SELECT cases FROM v ORDER BY cases DESC, variant LIMIT 5)) SELECT count(*) AS variants, round(any_value(c) / sum(cases), 6) AS coverage, any_value(c) / sum(cases) < 0.6 AS scattered FROM v, b")
def variant_health(spark, d):
    return P.variant_health(log(spark, d))
