"""Monitoring rollups, reports, alerts, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contexts, monitoring, sessions
from ..session import cut_lineage
from ..sources import tables
from .base import add_view, query


def session_view(gap: int) -> str:
    return f"""
SELECT user_id, session_no, min(timestamp) AS session_start, max(timestamp) AS session_end, count(*) AS events,
       date_diff('microsecond', min(timestamp), max(timestamp)) / 1000 AS duration_ms FROM (
  SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
         AS session_no FROM (
    SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL
                OR date_diff('microsecond', lag(timestamp) OVER w, timestamp) > {gap} * 60000000::BIGINT
              THEN 1 ELSE 0 END AS f FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id)))
GROUP BY user_id, session_no"""


add_view("sessions30", session_view(30))
add_view("sessions360", session_view(360))

SESSION_COLS = """user_id, session_no, CAST(session_start AS VARCHAR) AS session_start,
  CAST(session_end AS VARCHAR) AS session_end, events, round(duration_ms, 6) AS duration_ms"""


@query("sessionize", f"SELECT {SESSION_COLS} FROM sessions30")
def _(spark, sf):
    return sessions.session_table(tables.events(spark, sf), 30)


@query("sessionize_6h", f"SELECT {SESSION_COLS} FROM sessions360")
def _(spark, sf):
    return sessions.session_table(tables.events(spark, sf), 360)


REQUEST_SQL = """count(*) AS total_requests, count(*) FILTER (success) AS successful_requests,
  count(*) FILTER (NOT success) AS failed_requests, round(avg(duration_ms), 6) AS avg_response_time,
  count(DISTINCT user_id) AS unique_users, round(count(*) FILTER (success) / greatest(count(*), 1) * 100, 6)
  AS success_rate"""


@query("request_metrics", f"SELECT {REQUEST_SQL} FROM requests")
def _(spark, sf):
    return monitoring.request_metrics(tables.requests(spark, sf))


@query(
    "request_metrics_24h",
    f"""
SELECT {REQUEST_SQL} FROM requests WHERE timestamp > (SELECT max(timestamp) FROM requests) - INTERVAL 24 HOUR""",
)
def _(spark, sf):
    return monitoring.request_metrics(monitoring.last_hours(tables.requests(spark, sf), 24))


@query("algorithm_distribution", "SELECT algorithm, count(*) AS requests FROM requests GROUP BY algorithm")
def _(spark, sf):
    return monitoring.algorithm_distribution(tables.requests(spark, sf))


CACHE_SQL = """count(*) FILTER (cache_event = 'CacheHit') AS cache_hits,
  count(*) FILTER (cache_event = 'CacheMiss') AS cache_misses,
  round(count(*) FILTER (cache_event = 'CacheHit') * 100.0 / count(*), 6) AS cache_hit_rate"""


@query("cache_hit_rate", f"SELECT {CACHE_SQL} FROM requests")
def _(spark, sf):
    return monitoring.cache_hit_rate(tables.requests(spark, sf))


@query(
    "interactions_by_type",
    """
SELECT event_type, count(*) AS interactions, count(DISTINCT user_id) AS users FROM requests GROUP BY event_type
UNION ALL SELECT 'all', count(*), count(DISTINCT user_id) FROM requests""",
)
def _(spark, sf):
    return monitoring.interactions_by_type(tables.requests(spark, sf))


@query(
    "session_metrics",
    """
SELECT count(*) AS sessions, round(avg(duration_ms), 6) AS avg_session_duration,
       round(count(*) FILTER (duration_ms < 30000) * 100.0 / count(*), 6) AS bounce_rate FROM sessions360""",
)
def _(spark, sf):
    return monitoring.session_metrics(sessions.session_table(tables.events(spark, sf), 360))


@query(
    "retention",
    """
WITH d AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(timestamp AS DATE)) AS INTEGER) AS day,
                  CAST(year(timestamp) * 12 + month(timestamp) AS INTEGER) AS mon FROM ev),
a AS (SELECT DISTINCT user_id, 'daily' AS granularity, day AS period FROM d
      UNION SELECT user_id, 'weekly', CAST(floor(day / 7) AS INTEGER) FROM d
      UNION SELECT user_id, 'monthly', mon FROM d)
SELECT a.granularity, a.period, count(*) AS active_users, count(b.user_id) AS retained_users,
       round(count(b.user_id) / count(*) * 100, 6) AS retention
FROM a LEFT JOIN a b ON a.user_id = b.user_id AND a.granularity = b.granularity AND b.period = a.period + 1
GROUP BY a.granularity, a.period""",
)
def _(spark, sf):
    return monitoring.retention(tables.events(spark, sf))


@query(
    "peak_hours_days",
    """
WITH u AS (SELECT 'hour' AS unit, CAST(hour(timestamp) AS INTEGER) AS value FROM ev
           UNION ALL SELECT 'weekday', CAST(dayofweek(timestamp) + 1 AS INTEGER) FROM ev)
SELECT unit, value, count(*) AS interactions,
       CAST(row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, value) AS INTEGER) AS rank
FROM u GROUP BY unit, value QUALIFY rank <= 3""",
)
def _(spark, sf):
    return monitoring.peak_hours_days(tables.events(spark, sf))


@query(
    "response_time_stats",
    """
WITH e AS (SELECT epoch_us(min(timestamp)) AS a, epoch_us(max(timestamp)) AS b FROM requests),
s AS (SELECT avg(duration_ms) AS average, quantile_cont(duration_ms, 0.5) AS median,
             quantile_cont(duration_ms, 0.95) AS p95,
             avg(duration_ms) FILTER (epoch_us(timestamp) * 2 >= (SELECT a + b FROM e))
             - avg(duration_ms) FILTER (epoch_us(timestamp) * 2 < (SELECT a + b FROM e)) AS change FROM requests)
SELECT round(average, 6) AS average, round(median, 6) AS median, round(p95, 6) AS p95,
       CASE WHEN change > 0 THEN 'worsening' WHEN change < 0 THEN 'improving' ELSE 'stable' END AS trend FROM s""",
)
def _(spark, sf):
    return monitoring.response_time_stats(tables.requests(spark, sf))


@query(
    "sketch_rollups",
    """
SELECT unit, CAST(period AS VARCHAR) AS period, count(*) AS requests, count(DISTINCT user_id) AS exact_users,
       round(count(*) FILTER (success) / count(*) * 100, 6) AS success_rate, true AS users_near, true AS median_near, true AS p95_near
FROM (SELECT *, unnest(['day', 'week']) AS unit, unnest([date_trunc('day', timestamp), date_trunc('week', timestamp)])::TIMESTAMP AS period
      FROM requests) GROUP BY unit, period""",
)
def _(spark, sf):
    """Days and weeks from merged hours, held against exact figures: users within 4 %, quantiles within 2 % in rank."""
    rows = tables.requests(spark, sf)
    stored = cut_lineage(monitoring.sketch_rollup(rows))
    days = monitoring.merge_rollup(stored, "day")
    found = None
    for unit, merged in (("day", days), ("week", monitoring.merge_rollup(days, "week"))):
        figures = monitoring.rollup_figures(merged)
        exact = rows.withColumn("period", F.date_trunc(unit, "timestamp")).join(figures.select("period", "median", "p95"), "period")
        below = {name: F.count_if(F.col("duration_ms") < F.col(name)) / F.count(F.lit(1)) for name in ("median", "p95")}
        upto = {name: F.count_if(F.col("duration_ms") <= F.col(name)) / F.count(F.lit(1)) for name in ("median", "p95")}
        near = {n: (below[n] <= q + 0.02) & (upto[n] >= q - 0.02) for n, q in (("median", 0.5), ("p95", 0.95))}
        exact = exact.groupBy("period").agg(F.count_distinct("user_id").alias("exact_users"), *[v.alias(f"{n}_near") for n, v in near.items()])
        part = figures.join(exact, "period").select(
            F.lit(unit).alias("unit"), "period", "requests", "exact_users", "success_rate",
            (F.abs(F.col("users") - F.col("exact_users")) <= 1 + 0.04 * F.col("exact_users")).alias("users_near"), "median_near", "p95_near",
        )
        found = part if found is None else found.unionByName(part)
    return found


@query(
    "error_analysis",
    """
SELECT error_type, count(*) AS errors, CAST(row_number() OVER (ORDER BY count(*) DESC, error_type) AS INTEGER) AS rank,
       (SELECT count(*) FROM requests WHERE NOT success) AS total_errors,
       round((SELECT count(*) FILTER (NOT success) / count(*) * 100 FROM requests), 6) AS error_rate
FROM requests WHERE NOT success GROUP BY error_type QUALIFY rank <= 3""",
)
def _(spark, sf):
    return monitoring.error_analysis(tables.requests(spark, sf))


@query(
    "executive_summary",
    """
WITH m AS (SELECT max(timestamp) AS t FROM requests),
p AS (SELECT *, timestamp > (SELECT t FROM m) - INTERVAL 7 DAY AS now FROM requests
      WHERE timestamp > (SELECT t FROM m) - INTERVAL 14 DAY)
SELECT count(*) FILTER (now) AS total_recommendations, count(DISTINCT user_id) FILTER (now) AS unique_users,
       round(count(*) FILTER (now) / 7, 6) AS avg_daily_requests,
       round(count(*) FILTER (now AND success) / count(*) FILTER (now) * 100, 6) AS success_rate,
       round((count(*) FILTER (now) - count(*) FILTER (NOT now)) / count(*) FILTER (NOT now) * 100, 6)
         AS engagement_growth FROM p""",
)
def _(spark, sf):
    return monitoring.executive_summary(tables.requests(spark, sf))


EFFECT = """count(*) AS requests, round(avg(clicked), 6) AS accuracy,
  round(count(DISTINCT item_id) / (SELECT count(*) FROM part), 6) AS coverage,
  round(least(1.0, count(DISTINCT genre) / count(DISTINCT item_id)), 6) AS diversity"""


@query("algorithm_effectiveness", f"SELECT algorithm, {EFFECT} FROM reclog GROUP BY algorithm")
def _(spark, sf):
    size = tables.content(spark, sf).agg(F.count(F.lit(1))).scalar()
    return monitoring.algorithm_effectiveness(tables.recommendation_log(spark, sf), size)


@query(
    "algorithm_effectiveness_daily",
    f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, algorithm, {EFFECT} FROM reclog GROUP BY 1, 2",
)
def _(spark, sf):
    size = tables.content(spark, sf).agg(F.count(F.lit(1))).scalar()
    return monitoring.algorithm_effectiveness(tables.recommendation_log(spark, sf), size, daily=True)


add_view(
    "perf_hourly",
    """
SELECT date_trunc('hour', timestamp) AS h, count(*) AS total_requests,
       count(*) FILTER (success) / count(*) * 100 AS success_rate, avg(duration_ms) AS response_time,
       count(*) FILTER (cache_event = 'CacheHit') / count(*) * 100 AS cache_hit_rate,
       count(DISTINCT user_id) AS unique_users FROM requests GROUP BY 1""",
)
add_view(
    "eng_hourly",
    """
SELECT a.h, total_interactions, unique_users, avg_session_duration, bounce_rate FROM (
  SELECT date_trunc('hour', timestamp) AS h, count(*) AS total_interactions,
         count(DISTINCT user_id) AS unique_users FROM ev GROUP BY 1) a
LEFT JOIN (SELECT date_trunc('hour', session_start) AS h, avg(duration_ms) AS avg_session_duration,
                  count(*) FILTER (duration_ms < 30000) / count(*) * 100 AS bounce_rate
           FROM sessions360 GROUP BY 1) b ON a.h = b.h""",
)
HOUR = """CAST({t}.h AS VARCHAR) AS timestamp, CAST(hour({t}.h) AS INTEGER) AS hour,
  CAST(isodow({t}.h) - 1 AS INTEGER) AS day_of_week"""


@query(
    "hourly_rollup",
    f"""
SELECT {HOUR.format(t="p")}, total_requests, round(success_rate, 6) AS success_rate,
       round(response_time, 6) AS response_time, round(cache_hit_rate, 6) AS cache_hit_rate, unique_users
FROM perf_hourly p""",
)
def _(spark, sf):
    return monitoring.hourly_rollup(tables.requests(spark, sf))


@query(
    "hourly_engagement",
    f"""
SELECT {HOUR.format(t="e")}, total_interactions, unique_users,
       round(avg_session_duration, 6) AS avg_session_duration, round(bounce_rate, 6) AS bounce_rate FROM eng_hourly e""",
)
def _(spark, sf):
    events = tables.events(spark, sf)
    return monitoring.hourly_engagement(events, sessions.session_table(events, 360))


@query(
    "hourly_perf_x_engagement",
    f"""
SELECT {HOUR.format(t="p")}, total_requests, round(success_rate, 6) AS success_rate,
       round(response_time, 6) AS response_time, round(cache_hit_rate, 6) AS cache_hit_rate, p.unique_users,
       total_interactions, round(avg_session_duration, 6) AS avg_session_duration, round(bounce_rate, 6) AS bounce_rate
FROM perf_hourly p FULL JOIN eng_hourly e ON p.h = e.h""",
)
def _(spark, sf):
    events = tables.events(spark, sf)
    engagement = monitoring.hourly_engagement(events, sessions.session_table(events, 360))
    return monitoring.hourly_perf_x_engagement(monitoring.hourly_rollup(tables.requests(spark, sf)), engagement)


@query(
    "daily_algorithm_rollup",
    """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, algorithm, count(*) AS requests,
       count(DISTINCT user_id) AS unique_users, round(avg(duration_ms), 6) AS response_time,
       round(count(*) FILTER (success) / count(*) * 100, 6) AS success_rate FROM requests GROUP BY 1, 2""",
)
def _(spark, sf):
    return monitoring.daily_algorithm_rollup(tables.requests(spark, sf))


@query(
    "engagement_heatmap",
    """
SELECT CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week,
       count(*) AS interactions FROM ev GROUP BY 1, 2""",
)
def _(spark, sf):
    return monitoring.engagement_heatmap(tables.events(spark, sf))


@query(
    "bi_measures",
    """
SELECT CAST(sum(total_requests) AS BIGINT) AS total_requests, round(avg(success_rate), 6) AS avg_success_rate,
       round(avg(response_time), 6) AS avg_response_time,
       (SELECT CAST(sum(total_interactions) AS BIGINT) FROM eng_hourly) AS total_interactions,
       (SELECT max(unique_users) FROM eng_hourly) AS max_users FROM perf_hourly""",
)
def _(spark, sf):
    events = tables.events(spark, sf)
    engagement = monitoring.hourly_engagement(events, sessions.session_table(events, 360))
    return monitoring.bi_measures(monitoring.hourly_rollup(tables.requests(spark, sf)), engagement)


HOST_SQL = """
SELECT unnest(['cpu_utilization', 'memory_utilization', 'system_availability']) AS metric,
       unnest([avg(k) * 1.6, avg(k) * 1.9, 100 - avg(k) / 40]) AS value FROM requests"""


@query(
    "dashboard_kpis",
    f"""
WITH r AS (SELECT {REQUEST_SQL}, round(count(*) FILTER (cache_event = 'CacheHit') * 100.0 / count(*), 6) AS cache_hit_rate,
       (SELECT round(avg(duration_ms), 6) FROM sessions360) AS avg_session_duration,
       (SELECT round(count(*) FILTER (duration_ms < 30000) * 100.0 / count(*), 6) FROM sessions360) AS bounce_rate,
       round(count(*) / count(DISTINCT user_id), 6) AS interactions_per_user FROM requests),
h AS ({HOST_SQL}),
a AS (SELECT severity FROM (
    SELECT * FROM h UNION ALL SELECT unnest(['recommendation_error_rate', 'recommendation_response_time', 'cache_hit_rate']),
           unnest([100 - success_rate, avg_response_time, cache_hit_rate]) FROM r) m
  JOIN (VALUES ('recommendation_error_rate', '>', 5.0, 'high'), ('recommendation_response_time', '>', 2000.0, 'medium'),
    ('cache_hit_rate', '<', 70.0, 'low'), ('cpu_utilization', '>', 80.0, 'high'), ('memory_utilization', '>', 85.0, 'high'),
    ('system_availability', '<', 99.0, 'critical')) t(metric, op, threshold, severity) ON m.metric = t.metric
  WHERE (op = '>' AND value > threshold) OR (op = '<' AND value < threshold))
SELECT r.*, (SELECT round(value, 6) FROM h WHERE metric = 'cpu_utilization') AS cpu_utilization,
       (SELECT round(value, 6) FROM h WHERE metric = 'memory_utilization') AS memory_utilization,
       (SELECT round(value, 6) FROM h WHERE metric = 'system_availability') AS system_availability,
       (SELECT count(*) FROM a WHERE severity = 'critical') AS critical_alerts,
       (SELECT count(*) FROM a WHERE severity = 'high') AS high_alerts,
       (SELECT count(*) FROM a WHERE severity = 'medium') AS medium_alerts,
       (SELECT count(*) FROM a WHERE severity = 'low') AS low_alerts FROM r""",
)
def _(spark, sf):
    """Host figures are plain input rows, here derived from the log."""
    log = tables.requests(spark, sf)
    hosts = {"cpu_utilization": F.col("k") * 1.6, "memory_utilization": F.col("k") * 1.9, "system_availability": 100 - F.col("k") / 40}
    health = monitoring.metric_rows(log.agg(F.avg("k").alias("k")), hosts)
    return monitoring.dashboard_kpis(log, sessions.session_table(tables.events(spark, sf), 360), health)


add_view(
    "kpi5",
    """
SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS w, count(*) / 5 AS requests_per_minute,
       count(*) FILTER (success) / count(*) * 100 AS success_rate, avg(duration_ms) AS average_response_time,
       count(*) FILTER (cache_event = 'CacheHit') / count(*) * 100 AS cache_hit_rate FROM requests GROUP BY 1""",
)
KPI_SQL = """
SELECT CAST(w AS VARCHAR) AS window_start, round(requests_per_minute, 6) AS requests_per_minute,
       round(success_rate, 6) AS success_rate, round(average_response_time, 6) AS average_response_time,
       round(cache_hit_rate, 6) AS cache_hit_rate FROM kpi5"""


@query("realtime_kpis", KPI_SQL)
def _(spark, sf):
    return monitoring.realtime_kpis(tables.requests(spark, sf))


add_view(
    "day_metrics",
    """
SELECT day, unnest(['recommendation_error_rate', 'recommendation_response_time', 'cache_hit_rate',
                    'cpu_utilization', 'memory_utilization', 'system_availability']) AS metric,
       unnest([e, r, c, u, m, a]) AS value FROM (
  SELECT CAST(timestamp AS DATE) AS day, count(*) FILTER (NOT success) / count(*) * 100 AS e,
         avg(duration_ms) AS r, count(*) FILTER (cache_event = 'CacheHit') / count(*) * 100 AS c,
         avg(k) * 1.6 AS u, avg(k) * 1.7 AS m, 100 - avg(k) / 60 AS a FROM requests GROUP BY 1)""",
)
add_view(
    "day_alerts",
    """
SELECT d.day, d.metric, d.value, t.threshold, t.type, t.severity,
       t.label || ' ' || printf('%.1f', d.value) || t.unit || CASE WHEN t.op = '>' THEN ' exceeds' ELSE ' below' END
         || ' threshold ' || CAST(t.threshold AS VARCHAR) || t.unit AS message
FROM day_metrics d JOIN (VALUES
  ('recommendation_error_rate', '>', 5.0::DOUBLE, 'error_rate', 'high', 'Recommendation error rate', '%'),
  ('recommendation_response_time', '>', 2000.0, 'performance', 'medium', 'Average response time', 'ms'),
  ('cache_hit_rate', '<', 70.0, 'performance', 'low', 'Cache hit rate', '%'),
  ('cpu_utilization', '>', 80.0, 'system', 'high', 'CPU utilization', '%'),
  ('memory_utilization', '>', 85.0, 'system', 'high', 'Memory utilization', '%'),
  ('system_availability', '<', 99.0, 'availability', 'critical', 'System availability', '%'))
  t(metric, op, threshold, type, severity, label, unit) ON d.metric = t.metric
WHERE (op = '>' AND value > threshold) OR (op = '<' AND value < threshold)""",
)


def day_alerts(spark, sf):
    """Alerts per day; resource figures are plain input values, here derived from the log."""
    n = F.count(F.lit(1))
    days = tables.requests(spark, sf).groupBy(F.to_date("timestamp").alias("day")).agg(
        (F.count_if(~F.col("success")) / n * 100).alias("e"),
        F.avg("duration_ms").alias("r"),
        (F.count_if(F.col("cache_event") == "CacheHit") / n * 100).alias("c"),
        F.avg("k").alias("k"),
    )
    values = {
        "recommendation_error_rate": F.col("e"),
        "recommendation_response_time": F.col("r"),
        "cache_hit_rate": F.col("c"),
        "cpu_utilization": F.col("k") * 1.6,
        "memory_utilization": F.col("k") * 1.7,
        "system_availability": 100 - F.col("k") / 60,
    }
    return monitoring.alerts(monitoring.metric_rows(days, values, keep=["day"]))


@query(
    "alerts",
    "SELECT CAST(day AS VARCHAR) AS day, metric, round(value, 6) AS value, threshold, type, severity, message FROM day_alerts",
)
def _(spark, sf):
    return day_alerts(spark, sf)


@query("alert_summary", "SELECT severity, count(*) AS alerts FROM day_alerts GROUP BY severity")
def _(spark, sf):
    return monitoring.alert_summary(day_alerts(spark, sf))


@query(
    "dataset_profile",
    """
SELECT 'content' AS dataset, unnest(['rows', 'columns', 'min_year', 'max_year', 'mean_rating', 'mean_duration'])
         AS measure, unnest([count(*)::DOUBLE, 12, min(year), max(year), round(avg(rating), 6),
         round(avg(duration), 6)]) AS value FROM items
UNION ALL SELECT 'users', unnest(['rows', 'columns', 'premium_percent']),
       unnest([count(*)::DOUBLE, 9, round(avg(CASE WHEN is_premium THEN 1 ELSE 0 END) * 100, 6)]) FROM people
UNION ALL SELECT 'requests', unnest(['rows', 'columns', 'watch_hours']),
       unnest([count(*)::DOUBLE, 10, round(sum(k) / 60, 6)]) FROM requests""",
)
def _(spark, sf):
    content = tables.content(spark, sf)
    return (
        monitoring.table_profile(
            content,
            {
                "min_year": F.min("year"), "max_year": F.max("year"),
                "mean_rating": F.avg("rating"), "mean_duration": F.avg("duration"),
            },
            "content",
        )
        .unionByName(
            monitoring.table_profile(
                tables.users(spark, sf), {"premium_percent": F.avg(F.col("is_premium").cast("int")) * 100}, "users"
            )
        )
        .unionByName(
            monitoring.table_profile(tables.requests(spark, sf), {"watch_hours": F.sum("k") / 60}, "requests")
        )
    )


@query(
    "dataset_value_counts",
    """
SELECT 'content' AS dataset, f AS field, v AS value, count(*) AS count FROM (
  SELECT unnest(['category', 'genre', 'language']) AS f, unnest([category, genre, language]) AS v FROM items)
GROUP BY f, v
UNION ALL SELECT 'users', f, v, count(*) FROM (
  SELECT unnest(['country', 'segment', 'is_premium']) AS f,
         unnest([country, segment, CAST(is_premium AS VARCHAR)]) AS v FROM people) GROUP BY f, v
UNION ALL SELECT 'events', 'event_type', event_type, count(*) FROM ev GROUP BY event_type""",
)
def _(spark, sf):
    return (
        monitoring.value_counts(tables.content(spark, sf), ["category", "genre", "language"], "content")
        .unionByName(monitoring.value_counts(tables.users(spark, sf), ["country", "segment", "is_premium"], "users"))
        .unionByName(monitoring.value_counts(tables.events(spark, sf), ["event_type"], "events"))
    )


@query(
    "trending_searches",
    """
WITH m AS (SELECT max(timestamp) AS t FROM ev),
c AS (SELECT k AS query, count(*) FILTER (timestamp > (SELECT t FROM m) - INTERVAL 48 HOUR) AS searches,
             count(*) FILTER (timestamp <= (SELECT t FROM m) - INTERVAL 48 HOUR) AS previous FROM ev
      WHERE timestamp > (SELECT t FROM m) - INTERVAL 96 HOUR GROUP BY k)
SELECT query, searches, previous, CASE WHEN previous > 0 THEN round((searches - previous) / previous * 100, 6) END
         AS growth, CAST(row_number() OVER (ORDER BY searches DESC, query) AS INTEGER) AS rank
FROM c WHERE searches > 0 QUALIFY rank <= 20""",
)
def _(spark, sf):
    return monitoring.trending_searches(tables.events(spark, sf), "k", hours=48, n=20)


@query(
    "consumption_metrics",
    """
SELECT round(avg(position / 10) * 100, 6) AS consumption_rate,
       round((SELECT count(*) FROM (SELECT DISTINCT user_id, genre FROM reclog)) / count(*) * 100, 6) AS discovery_rate,
       round(avg(clicked) * 100, 6) AS acceptance_rate FROM reclog""",
)
def _(spark, sf):
    return monitoring.consumption_metrics(tables.recommendation_log(spark, sf), F.col("position") / 10)


@query(
    "kusto_hourly",
    """
SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS hour, round(avg(duration_ms), 6) AS avg_duration,
       count(*) AS requests FROM requests GROUP BY 1""",
)
def _(spark, sf):
    return monitoring.hourly_durations(tables.requests(spark, sf))


@query(
    "errors_by_algorithm",
    "SELECT algorithm, count(*) AS requests FROM requests WHERE NOT success GROUP BY algorithm",
)
def _(spark, sf):
    return monitoring.algorithm_distribution(tables.requests(spark, sf).filter(~F.col("success")))


@query(
    "union_metrics",
    """
SELECT count(*) AS total_requests, round(avg(duration_ms), 6) AS avg_response_time, NULL::VARCHAR AS algorithm,
       NULL::BIGINT AS requests, NULL::BIGINT AS cache_hits FROM requests
UNION ALL SELECT NULL, NULL, algorithm, count(*), NULL FROM requests GROUP BY algorithm
UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FILTER (cache_event = 'CacheHit') FROM requests""",
)
def _(spark, sf):
    log = tables.requests(spark, sf)
    return monitoring.union_metrics(
        monitoring.request_metrics(log).select("total_requests", "avg_response_time"),
        monitoring.algorithm_distribution(log),
        monitoring.cache_hit_rate(log).select("cache_hits"),
    )


@query(
    "next_item_counts",
    """
WITH l AS (SELECT k AS next_item, lag(k) OVER w AS item,
                  date_diff('microsecond', lag(timestamp) OVER w, timestamp) AS gap FROM ev
           WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id))
SELECT item, next_item, count(*) AS transitions,
       CAST(row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, next_item) AS INTEGER) AS rank
FROM l WHERE gap <= 360 * 60000000::BIGINT GROUP BY item, next_item QUALIFY rank <= 5""",
)
def _(spark, sf):
    return sessions.next_item_counts(tables.events(spark, sf), "k", top=5, gap_minutes=360)


@query(
    "next_item_contexts",
    """
WITH g AS (SELECT user_id, event_id, timestamp, k, date_diff('microsecond', lag(timestamp) OVER w, timestamp) > 86400 * 1000000::BIGINT AS f
           FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id)),
s AS (SELECT *, sum(coalesce(f, true)::INTEGER) OVER (PARTITION BY user_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g),
l AS (SELECT k AS next_item, lag(k) OVER w AS a, lag(k, 2) OVER w AS b, lag(k, 3) OVER w AS c FROM s
      WINDOW w AS (PARTITION BY user_id, no ORDER BY timestamp, event_id)),
c AS (SELECT '' AS context, next_item FROM l
      UNION ALL SELECT a::VARCHAR, next_item FROM l WHERE a IS NOT NULL
      UNION ALL SELECT a || '|' || b, next_item FROM l WHERE b IS NOT NULL
      UNION ALL SELECT a || '|' || b || '|' || c, next_item FROM l WHERE c IS NOT NULL),
n AS (SELECT context, next_item::BIGINT AS next_item, count(*) AS n, sum(count(*)) OVER (PARTITION BY context)::BIGINT AS total FROM c GROUP BY 1, 2)
SELECT * FROM n WHERE total >= 5""",
)
def _(spark, sf):
    """Contexts of up to three items with at least five followers; shorter parts of a context have no fewer."""
    return contexts.context_tree(contexts.session_positions(tables.events(spark, sf), "k", 24 * 60))


@query(
    "binge_sessions",
    """
WITH f AS (SELECT user_id, event_type, timestamp, event_id,
                  row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id)
                  - row_number() OVER (PARTITION BY user_id, event_type ORDER BY timestamp, event_id) AS g FROM ev)
SELECT user_id, event_type, count(*) AS length, CAST(min(timestamp) AS VARCHAR) AS run_start
FROM f GROUP BY user_id, event_type, g HAVING count(*) >= 3""",
)
def _(spark, sf):
    return sessions.binge_runs(tables.events(spark, sf), "event_type").drop("run_no")


@query(
    "last_n_items",
    """
SELECT user_id, string_agg(CAST(k AS VARCHAR), '|' ORDER BY timestamp, k) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, k DESC) AS rn FROM ev)
WHERE rn <= 20 GROUP BY user_id""",
)
def _(spark, sf):
    from ..operators.ranking import last_n_items

    return last_n_items(tables.events(spark, sf), 20, item="k")


@query(
    "context_features",
    """
SELECT event_id, CASE WHEN hour(timestamp) BETWEEN 6 AND 11 THEN 'morning'
         WHEN hour(timestamp) BETWEEN 12 AND 16 THEN 'afternoon'
         WHEN hour(timestamp) BETWEEN 17 AND 22 THEN 'evening' ELSE 'late_night' END AS time_of_day,
       CAST(dayofweek(timestamp) + 1 AS INTEGER) AS day_of_week, dayofweek(timestamp) IN (0, 6) AS weekend,
       CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' WHEN month(timestamp) IN (3, 4, 5) THEN 'spring'
            WHEN month(timestamp) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
       round(date_diff('microsecond', lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id),
             timestamp) / 1000000, 6) AS seconds_since_last FROM ev""",
)
def _(spark, sf):
    rows = sessions.context_features(tables.events(spark, sf))
    return rows.select("event_id", "time_of_day", "day_of_week", "weekend", "season", "seconds_since_last")


@query(
    "exploration_mode",
    """
WITH p AS (SELECT user_id, CAST(floor(date_diff('microsecond', timestamp, (SELECT max(timestamp) FROM reclog))
                  / (7 * 86400000000)) AS BIGINT) AS period, genre FROM reclog),
g AS (SELECT user_id, period, count(DISTINCT genre) AS genres FROM p GROUP BY 1, 2)
SELECT user_id, coalesce(max(genres) FILTER (period = 0), 0) AS recent_genres,
       round(avg(genres) FILTER (period > 0), 6) AS usual_genres,
       coalesce(coalesce(max(genres) FILTER (period = 0), 0) > avg(genres) FILTER (period > 0), false)
         AS exploration_mode FROM g GROUP BY user_id""",
)
def _(spark, sf):
    return sessions.exploration_mode(tables.recommendation_log(spark, sf))
