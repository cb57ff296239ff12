"""A/B experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments
from ..sources import tables
from .base import add_view, query

BUCKET = """((((((('0x' || substr(md5({u}), 1, 8))::BIGINT % 10000) * 7296
  + ('0x' || substr(md5({u}), 9, 8))::BIGINT) % 10000) * 7296
  + ('0x' || substr(md5({u}), 17, 8))::BIGINT) % 10000) * 7296
  + ('0x' || substr(md5({u}), 25, 8))::BIGINT) % 10000"""
VARIANT = f"CASE WHEN ({BUCKET}) / 10000 < 0.3 THEN 'treatment' ELSE 'control' END"


@query(
    "ab_assign",
    f"""
SELECT user_id, {BUCKET.format(u="CAST(user_id AS VARCHAR)")} AS bucket,
       {VARIANT.format(u="CAST(user_id AS VARCHAR)")} AS variant FROM people""",
)
def _(spark, sf):
    return experiments.ab_assign(tables.users(spark, sf).select("user_id"))


add_view(
    "abtests",
    """
SELECT n_name AS test_name, n_nationkey % 3 <> 0 AS enabled, n_nationkey / 20 AS traffic_split,
       CASE WHEN n_nationkey % 5 <> 0 THEN DATE '2000-01-01' + n_nationkey * 20 END AS start_date,
       CASE WHEN n_nationkey % 4 <> 0 THEN DATE '2000-06-01' + n_regionkey * 60 END AS end_date,
       ['hybrid', 'collaborative', 'content'][n_nationkey % 3 + 1] AS control_algorithm,
       ['hybrid', 'collaborative', 'content'][n_regionkey % 3 + 1] AS treatment_algorithm FROM nation""",
)


def ab_tests(spark, sf):
    key = F.col("n_nationkey")
    return tables.table(spark, sf, "nation").select(
        F.col("n_name").alias("test_name"),
        (key % 3 != 0).alias("enabled"),
        (key / 20).alias("traffic_split"),
        F.when(key % 5 != 0, F.date_add(F.lit("2000-01-01").cast("date"), key * 20)).alias("start_date"),
        F.when(key % 4 != 0, F.date_add(F.lit("2000-06-01").cast("date"), F.col("n_regionkey") * 60)).alias("end_date"),
        tables.pick(tables.ALGORITHMS, key).alias("control_algorithm"),
        tables.pick(tables.ALGORITHMS, F.col("n_regionkey")).alias("treatment_algorithm"),
    )


@query(
    "active_tests",
    """
SELECT test_name, round(traffic_split, 6) AS traffic_split FROM abtests
WHERE enabled AND (start_date IS NULL OR start_date <= DATE '2000-07-15')
  AND (end_date IS NULL OR end_date >= DATE '2000-07-15')""",
)
def _(spark, sf):
    now = F.lit("2000-07-15").cast("date")
    return experiments.active_tests(ab_tests(spark, sf), now).select("test_name", "traffic_split")


@query(
    "validate_tests",
    """
SELECT test_name, CASE WHEN traffic_split NOT BETWEEN 0 AND 1 THEN 'traffic split out of range'
         WHEN start_date >= end_date THEN 'start not before end' END AS reason,
       CASE WHEN control_algorithm = treatment_algorithm THEN 'same algorithm in both arms' END AS warning
FROM abtests""",
)
def _(spark, sf):
    return experiments.validate_tests(ab_tests(spark, sf)).select("test_name", "reason", "warning")


add_view(
    "abresults",
    f"""
SELECT user_id, timestamp, event_type, value, CASE WHEN k % 10 <> 0 THEN value * 20 END AS response_time_ms,
       event_type = 'error' AS error_occurred, k % 4 AS n_recs,
       CASE WHEN k % 4 > 0 THEN (k % 4 * k + (k % 4) * (k % 4 - 1) / 2) / 110 / (k % 4) END AS conf,
       {VARIANT.format(u="CAST(user_id AS VARCHAR)")} AS variant FROM ev""",
)


def ab_results(spark, sf):
    """Result log: as many recommendations per row as k mod 4, confidences (k + i) / 110."""
    recs = F.when(
        F.col("k") % 4 > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("k") % 4 - 1, F.lit(0))),
            lambda i: F.struct(((F.col("k") + i) / 110).alias("confidence_score")),
        ),
    ).otherwise(F.array().cast("array<struct<confidence_score:double>>"))
    rows = tables.events(spark, sf).select(
        "user_id", "timestamp", "event_type", "value",
        F.when(F.col("k") % 10 != 0, F.col("value") * 20).alias("response_time_ms"),
        (F.col("event_type") == "error").alias("error_occurred"),
        recs.alias("recommendations"), F.lit("default").alias("test_name"),
    )
    return experiments.ab_assign(rows)


@query(
    "ab_metrics",
    """
WITH r AS (SELECT * FROM abresults WHERE timestamp >= (SELECT max(timestamp) FROM abresults) - INTERVAL 7 DAY),
s AS (SELECT count(*) AS total_requests,
  count(*) FILTER (variant = 'control') AS cn, count(*) FILTER (variant = 'treatment') AS tn,
  count(DISTINCT user_id) FILTER (variant = 'control') AS cu,
  count(DISTINCT user_id) FILTER (variant = 'treatment') AS tu,
  avg(coalesce(response_time_ms, 0)) FILTER (variant = 'control') AS cms,
  avg(coalesce(response_time_ms, 0)) FILTER (variant = 'treatment') AS tms,
  count(*) FILTER (variant = 'control' AND error_occurred) AS cerr,
  count(*) FILTER (variant = 'treatment' AND error_occurred) AS terr,
  sum(conf) FILTER (variant = 'control') AS cconf, sum(conf) FILTER (variant = 'treatment') AS tconf,
  avg(conf) FILTER (variant = 'control') AS cmean, avg(conf) FILTER (variant = 'treatment') AS tmean FROM r)
SELECT total_requests, cn AS control_requests, tn AS treatment_requests, cu AS control_users, tu AS treatment_users,
  round(tn / total_requests, 6) AS actual_treatment_split,
  round(cms, 2) AS control_avg_response_time_ms, round(tms, 2) AS treatment_avg_response_time_ms,
  round((cms - tms) / cms * 100, 2) AS response_time_improvement,
  round(cerr / cn * 100, 2) AS control_error_rate, round(terr / tn * 100, 2) AS treatment_error_rate,
  round(cconf / cn, 3) AS control_avg_confidence, round(tconf / tn, 3) AS treatment_avg_confidence,
  round((tconf / tn - cconf / cn) / (cconf / cn) * 100, 2) AS confidence_improvement,
  round(cmean, 3) AS control_mean_confidence, round(tmean, 3) AS treatment_mean_confidence FROM s""",
)
def _(spark, sf):
    return experiments.ab_metrics(ab_results(spark, sf))


@query(
    "ab_significance",
    """
WITH s AS (SELECT
  count(*) FILTER (variant = 'control') AS c_n, count(*) FILTER (variant = 'treatment') AS t_n,
  count(DISTINCT user_id) FILTER (variant = 'control') AS c_users,
  count(DISTINCT user_id) FILTER (variant = 'treatment') AS t_users,
  avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) FILTER (variant = 'control') AS c_rate,
  avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) FILTER (variant = 'treatment') AS t_rate,
  avg(value) FILTER (variant = 'control') AS c_mean, avg(value) FILTER (variant = 'treatment') AS t_mean,
  var_samp(value) FILTER (variant = 'control') AS c_var, var_samp(value) FILTER (variant = 'treatment') AS t_var
  FROM abresults),
z AS (SELECT *, (c_rate * c_n + t_rate * t_n) / (c_n + t_n) AS p FROM s),
y AS (SELECT *, (t_rate - c_rate) / sqrt(p * (1 - p) * (1 / c_n + 1 / t_n)) AS zz,
             (t_mean - c_mean) / sqrt(c_var / c_n + t_var / t_n) AS tt,
             (t_rate - c_rate) / c_rate * 100 AS eff FROM z)
SELECT c_n, t_n, c_users, t_users, round(c_rate, 6) AS c_rate, round(t_rate, 6) AS t_rate,
       round(c_mean, 6) AS c_mean, round(t_mean, 6) AS t_mean, round(c_var, 6) AS c_var, round(t_var, 6) AS t_var,
       round(zz, 6) AS z, round(tt, 6) AS welch_t, round(eff, 6) AS effect_percent,
       c_users >= 1000 AND t_users >= 1000 AS enough_users, abs(zz) > 1.96 AS significant,
       abs(eff) >= 5 AS large_enough FROM y""",
)
def _(spark, sf):
    return experiments.ab_significance(
        ab_results(spark, sf), F.col("event_type") == "purchase", F.col("value")
    )


@query("variant_counts", "SELECT variant, count(*) AS requests FROM abresults GROUP BY variant")
def _(spark, sf):
    return experiments.variant_counts(ab_results(spark, sf))
