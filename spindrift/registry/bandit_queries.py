"""Exploration and off-policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import md5_uniform
from ..operators import bandits, monitoring, ranking
from ..sources import tables
from .base import add_view, query

RANKED = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY round({s}, 6) DESC, item_id) AS INTEGER) AS rank"

UNIFORM = "('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296"


def log(spark, sf):
    return tables.recommendation_log(spark, sf)


@query(
    "epsilon_greedy",
    f"""
WITH l AS (SELECT user_id, item_id, {RANKED.format(s="score")} FROM list_a QUALIFY rank <= 10),
s AS (SELECT user_id, max(rank) AS n FROM l GROUP BY user_id),
d AS (SELECT request_id, r.user_id, {UNIFORM.format(k="'e' || request_id")} < 0.1 AS explored, n,
             {UNIFORM.format(k="'p' || request_id")} AS u FROM requests r JOIN s ON r.user_id = s.user_id),
c AS (SELECT request_id, user_id, explored,
             CAST(CASE WHEN explored AND n > 1 THEN floor(u * (n - 1)) + 2 ELSE 1 END AS INTEGER) AS rank FROM d)
SELECT c.user_id, c.rank, c.request_id, c.explored, l.item_id
FROM c JOIN l ON c.user_id = l.user_id AND c.rank = l.rank""",
)
def _(spark, sf):
    lists = ranking.top_n_per_user(tables.scored_lists(spark, sf)[0], 10)
    return bandits.epsilon_greedy(tables.requests(spark, sf).select("request_id", "user_id"), lists)


add_view(
    "arms",
    """
SELECT item_id, count(*) AS trials, CAST(sum(clicked) AS BIGINT) AS successes,
       CAST(count(*) - sum(clicked) AS BIGINT) AS failures FROM reclog GROUP BY item_id""",
)


@query("arm_counts", "SELECT * FROM arms")
def _(spark, sf):
    return bandits.arm_counts(log(spark, sf))


@query(
    "ucb_score",
    """
WITH s AS (SELECT *, successes / trials + sqrt(ln((SELECT sum(trials) FROM arms)) / trials) AS sc FROM arms)
SELECT item_id, trials, successes, failures, round(sc, 6) AS score,
       CAST(row_number() OVER (ORDER BY round(sc, 6) DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""",
)
def _(spark, sf):
    return bandits.ucb_score(bandits.arm_counts(log(spark, sf)), n=20)


def gamma_sql(column):
    u, angle, test = (UNIFORM.format(k=f"'42{column}|' || item_id || '|' || t || '{part}'") for part in "xyz")
    return f"""
SELECT item_id, any_value(d) AS d, min_by(d * v, t) FILTER (v > 0 AND ln(1 - z) < x * x / 2 + d - d * v + d * ln(greatest(v, 1e-300))) AS g FROM (
  SELECT item_id, t, d, z, x, pow(1 + x / sqrt(9 * d), 3) AS v FROM (
    SELECT item_id, t, {column} + 1 - 1.0::DOUBLE / 3 AS d, {test} AS z, sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * ({angle})) AS x
    FROM arms, (SELECT unnest(range(0, 8)) AS t))) GROUP BY item_id"""


@query(
    "thompson_sampling",
    f"""
WITH w AS ({gamma_sql("successes")}), l AS ({gamma_sql("failures")}),
s AS (SELECT a.item_id, successes, failures, coalesce(w.g, w.d) / (coalesce(w.g, w.d) + coalesce(l.g, l.d)) AS score
      FROM arms a JOIN w USING (item_id) JOIN l USING (item_id))
SELECT item_id, successes, failures, round(score, 6) AS score,
       CAST(row_number() OVER (ORDER BY round(score, 6) DESC, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""",
)
def _(spark, sf):
    return bandits.thompson_sampling(bandits.arm_counts(log(spark, sf)), n=20)


@query(
    "update_counts",
    """
SELECT item_id, CAST(2 * trials AS BIGINT) AS trials, CAST(2 * successes AS BIGINT) AS successes,
       CAST(2 * failures AS BIGINT) AS failures FROM arms""",
)
def _(spark, sf):
    return bandits.update_counts(bandits.arm_counts(log(spark, sf)), log(spark, sf))


@query(
    "propensity",
    """
SELECT item_id, count(*) AS impressions, CAST(sum(clicked) AS BIGINT) AS clicks, round(sum(clicked) / count(*), 6)
  AS propensity FROM reclog GROUP BY item_id""",
)
def _(spark, sf):
    return bandits.propensity(log(spark, sf))


@query(
    "position_debias",
    """
WITH c AS (SELECT position, avg(clicked) AS ctr FROM reclog GROUP BY position)
SELECT item_id, count(*) AS impressions,
       round(avg(clicked / (ctr / (SELECT max(ctr) FROM c))), 6) AS relevance
FROM reclog r JOIN c ON r.position = c.position GROUP BY item_id""",
)
def _(spark, sf):
    return bandits.position_debias(log(spark, sf))


@query(
    "calibrated_score",
    f"""
WITH s AS (SELECT a.user_id, a.item_id, a.score, a.score - 0.1 * ln(1 + i.popularity) AS c
           FROM list_a a JOIN items i ON a.item_id = i.item_id)
SELECT user_id, item_id, round(score, 6) AS score, round(c, 6) AS calibrated, {RANKED.format(s="c")}
FROM s QUALIFY rank <= 10""",
)
def _(spark, sf):
    items = tables.content(spark, sf).select("item_id", "popularity")
    rows = tables.scored_lists(spark, sf)[0].join(items, "item_id")
    return bandits.calibrated_score(rows, F.col("popularity")).drop("popularity")


add_view(
    "polog",
    f"""
SELECT user_id, item_id, clicked::DOUBLE AS reward, 0.05 + 0.9 * {UNIFORM.format(k="'q' || request_id")} AS p,
       position / 10 AS predicted FROM reclog""",
)
add_view(
    "policy",
    """
SELECT user_id, item_id AS new_item FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, item_id) AS rn
  FROM reclog GROUP BY user_id, item_id) WHERE rn = 1""",
)


def policy_log(spark, sf):
    """A log with propensities and model predictions, and a policy serving each user their most seen item."""
    rows = log(spark, sf)
    draw = md5_uniform(F.concat(F.lit("q"), F.col("request_id").cast("string")))
    logged = rows.select(
        "user_id", "item_id", F.col("clicked").cast("double").alias("reward"),
        (0.05 + 0.9 * draw).alias("p"), (F.col("position") / 10).alias("predicted"),
    )
    seen = rows.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    policy = ranking.top_n_per_user(seen, 1).select("user_id", F.col("item_id").alias("new_item"))
    return logged, policy


@query(
    "ips_evaluate",
    """
SELECT count(*) AS matched, round(sum(reward / p) / sum(1 / p), 6) AS value
FROM polog l JOIN policy n ON l.user_id = n.user_id WHERE l.item_id = n.new_item""",
)
def _(spark, sf):
    return bandits.ips_evaluate(*policy_log(spark, sf))


@query(
    "doubly_robust",
    """
SELECT count(*) AS interactions,
       round(avg(predicted + CASE WHEN item_id = new_item THEN (reward - predicted) / p ELSE 0 END), 6) AS value
FROM polog l JOIN policy n ON l.user_id = n.user_id""",
)
def _(spark, sf):
    return bandits.doubly_robust(*policy_log(spark, sf))


@query(
    "engagement_metrics",
    """
WITH d AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(timestamp AS DATE)) AS INTEGER) AS d
           FROM ev),
w AS (SELECT DISTINCT user_id, CAST(floor(d / 7) AS INTEGER) AS d FROM d),
dr AS (SELECT count(b.user_id) / count(*) * 100 AS r FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND b.d = a.d + 1
       GROUP BY a.d),
wr AS (SELECT count(b.user_id) / count(*) * 100 AS r FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.d = a.d + 1
       GROUP BY a.d),
lists AS (SELECT user_id, CAST(timestamp AS DATE) AS d, clicked, row_number() OVER (
            PARTITION BY user_id, CAST(timestamp AS DATE) ORDER BY position, request_id) AS place FROM reclog),
gains AS (SELECT user_id, d, sum(clicked / log2(place + 1)) AS dcg, sum(clicked)::INTEGER AS c FROM lists GROUP BY 1, 2),
ideal AS (SELECT g.*, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, c + 1)) AS i)) AS best FROM gains g WHERE c > 0),
first AS (SELECT user_id, min(d) AS f FROM d GROUP BY 1),
gaps AS (SELECT d.user_id, min(CASE WHEN d.d > f THEN d.d - f END) AS gap FROM d JOIN first USING (user_id) GROUP BY 1),
watched AS (SELECT e.value, i.duration FROM ev e LEFT JOIN items i ON i.item_id = e.event_id % 200 AND i.duration > 0)
SELECT round(avg(clicked), 6) AS ctr, (SELECT round(sum(value), 6) FROM watched) AS watch_time,
       (SELECT round(avg(least(value / duration, 1.0)), 6) FROM watched WHERE duration IS NOT NULL) AS completion_rate,
       (SELECT round(avg(dcg / best), 6) FROM ideal) AS ndcg,
       (SELECT round(count(*) FILTER (gap <= 7) / count(*) * 100, 6) FROM gaps) AS retention_7d,
       (SELECT round(count(*) FILTER (gap <= 30) / count(*) * 100, 6) FROM gaps) AS retention_30d,
       round(count(DISTINCT item_id) / (SELECT count(*) FROM part), 6) AS coverage,
       round((SELECT count(*) FROM (SELECT DISTINCT user_id, genre FROM reclog)) / count(*), 6) AS exploration_rate,
       (SELECT round(avg(r), 6) FROM dr) AS daily_retention, (SELECT round(avg(r), 6) FROM wr) AS weekly_retention
FROM reclog""",
)
def _(spark, sf):
    """The value of an event counts as minutes watched of the item shown."""
    items, events = tables.content(spark, sf), tables.events(spark, sf)
    size = items.agg(F.count(F.lit(1))).scalar()
    watched = events.select((F.col("event_id") % 200).alias("item_id"), F.col("value").alias("minutes"))
    lists = log(spark, sf).withColumn("day", F.to_date("timestamp"))
    parts = [
        bandits.watch_figures(watched, items).select(F.struct("*")).scalar(),
        bandits.list_quality(lists, ["user_id", "day"], ["position", "request_id"]).select(F.struct("*")).scalar(),
        bandits.return_rates(events).select(F.struct("*")).scalar(),
    ]
    names = [("watch_time", "completion_rate"), ("ndcg",), ("retention_7d", "retention_30d")]
    report = bandits.engagement_metrics(log(spark, sf), size, F.lit(0), monitoring.retention(events)).drop("watch_time")
    return report.withColumns({n: part[n] for part, group in zip(parts, names) for n in group})
