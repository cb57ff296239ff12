"""Feature tables, windows, trending."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, ranking
from ..sources import tables
from .base import add_view, query
from .cleaning_queries import clean

add_view(
    "ustats",
    """
SELECT user_id, count(*) AS total_interactions, avg(rating) AS avg_rating,
       coalesce(stddev_samp(rating), 0) AS rating_std, min(rating) AS min_rating, max(rating) AS max_rating,
       count(DISTINCT item_id) AS unique_items, min(timestamp) AS first_interaction, max(timestamp) AS last_interaction,
       max(rating) - min(rating) AS rating_range,
       CAST(date_diff('day', min(timestamp), max(timestamp)) + 1 AS INTEGER) AS days_active,
       count(*) / greatest(date_diff('day', min(timestamp), max(timestamp)) + 1, 1) AS interactions_per_day
FROM clean GROUP BY user_id""",
)
add_view(
    "genre_ranks",
    """
SELECT c.user_id, i.genre AS genre_primary, count(*) AS genre_count, avg(c.rating) AS genre_avg_rating,
       CAST(row_number() OVER (PARTITION BY c.user_id ORDER BY count(*) DESC, i.genre) AS INTEGER) AS rank
FROM clean c JOIN items i ON c.item_id = i.item_id GROUP BY c.user_id, i.genre""",
)
add_view(
    "tprofile",
    """
SELECT a.user_id, avg_interaction_hour, most_active_day, weekend_preference FROM (
  SELECT user_id, avg(hour(timestamp)) AS avg_interaction_hour,
         avg(CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END) AS weekend_preference
  FROM clean GROUP BY user_id) a
JOIN (SELECT user_id, CAST(dow AS INTEGER) AS most_active_day FROM (
        SELECT user_id, dayofweek(timestamp) + 1 AS dow,
               row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, dayofweek(timestamp)) AS rn
        FROM clean GROUP BY user_id, dayofweek(timestamp)) WHERE rn = 1) b ON a.user_id = b.user_id""",
)
add_view(
    "istats",
    """
SELECT item_id, count(*) AS total_ratings, count(DISTINCT user_id) AS unique_users, avg(rating) AS avg_rating,
       coalesce(stddev_samp(rating), 0) AS rating_std, min(timestamp) AS first_rating, max(timestamp) AS last_rating,
       CAST(date_diff('day', min(timestamp), (SELECT max(timestamp) FROM clean)) AS INTEGER) AS days_since_first_rating,
       CAST(date_diff('day', max(timestamp), (SELECT max(timestamp) FROM clean)) AS INTEGER) AS days_since_last_rating,
       count(*) / greatest(date_diff('day', min(timestamp), (SELECT max(timestamp) FROM clean)), 1) AS ratings_per_day
FROM clean GROUP BY item_id""",
)
add_view(
    "trend90",
    """
SELECT *, CAST(row_number() OVER (ORDER BY round(trending_score, 6) DESC, item_id) AS INTEGER) AS trending_rank FROM (
  SELECT item_id, count(*) AS interaction_count, count(DISTINCT user_id) AS unique_users, avg(rating) AS avg_rating,
         count(*) * avg(rating) * ln(count(DISTINCT user_id) + 1) AS trending_score
  FROM clean WHERE CAST(timestamp AS DATE) >= (SELECT CAST(max(timestamp) AS DATE) - 90 FROM clean)
  GROUP BY item_id)
QUALIFY trending_rank <= 100""",
)

USTATS = """user_id, total_interactions, round(avg_rating, 6) AS avg_rating, round(rating_std, 6) AS rating_std, min_rating,
  max_rating, unique_items, CAST(first_interaction AS VARCHAR) AS first_interaction,
  CAST(last_interaction AS VARCHAR) AS last_interaction, rating_range, days_active,
  round(interactions_per_day, 6) AS interactions_per_day"""


@query("user_stats", f"SELECT {USTATS} FROM ustats")
def _(spark, sf):
    return features.user_stats(clean(spark, sf))


@query(
    "interactions_with_genre",
    """
SELECT c.user_id, c.item_id, c.rating, i.genre AS genre_primary FROM clean c JOIN items i ON c.item_id = i.item_id""",
)
def _(spark, sf):
    rows = features.interactions_with_genre(clean(spark, sf), tables.content(spark, sf))
    return rows.select("user_id", "item_id", "rating", "genre_primary")


@query(
    "rank_genre_per_user",
    """
SELECT user_id, genre_primary, genre_count, round(genre_avg_rating, 6) AS genre_avg_rating, rank FROM genre_ranks""",
)
def _(spark, sf):
    return features.rank_genre_per_user(clean(spark, sf), tables.content(spark, sf))


@query(
    "favorite_genre",
    """
SELECT user_id, genre_primary AS favorite_genre, round(genre_avg_rating, 6) AS favorite_genre_rating
FROM genre_ranks WHERE rank = 1""",
)
def _(spark, sf):
    return features.favorite_genre(clean(spark, sf), tables.content(spark, sf))


@query(
    "temporal_profile",
    """
SELECT user_id, round(avg_interaction_hour, 6) AS avg_interaction_hour, most_active_day,
       round(weekend_preference, 6) AS weekend_preference FROM tprofile""",
)
def _(spark, sf):
    return features.temporal_profile(clean(spark, sf))


@query(
    "temporal_profile_events",
    """
SELECT user_id, round(h, 6) AS avg_interaction_hour, CAST(dow AS INTEGER) AS most_active_day,
       round(w, 6) AS weekend_preference
FROM (SELECT user_id, avg(hour(timestamp)) AS h,
             avg(CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END) AS w FROM ev GROUP BY 1)
JOIN (SELECT user_id, dayofweek(timestamp) + 1 AS dow,
             row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, dayofweek(timestamp)) AS rn
      FROM ev GROUP BY user_id, dayofweek(timestamp)) USING (user_id) WHERE rn = 1""",
)
def _(spark, sf):
    return features.temporal_profile(tables.events(spark, sf))


@query(
    "user_features",
    f"""
SELECT {USTATS.replace("user_id,", "u.user_id,", 1)},
       g.genre_primary AS favorite_genre, round(g.genre_avg_rating, 6) AS favorite_genre_rating,
       round(t.avg_interaction_hour, 6) AS avg_interaction_hour, t.most_active_day,
       round(t.weekend_preference, 6) AS weekend_preference
FROM ustats u JOIN genre_ranks g ON u.user_id = g.user_id AND g.rank = 1 JOIN tprofile t ON u.user_id = t.user_id""",
)
def _(spark, sf):
    return features.user_features(clean(spark, sf), tables.content(spark, sf))


@query(
    "feature_left_joins",
    """
SELECT i.item_id, i.title, s.total_ratings, round(s.avg_rating, 6) AS avg_rating
FROM items i LEFT JOIN istats s ON i.item_id = s.item_id""",
)
def _(spark, sf):
    stats = features.item_stats(clean(spark, sf)).select("item_id", "total_ratings", "avg_rating")
    return tables.content(spark, sf).select("item_id", "title").join(stats, "item_id", "left")


ISTATS = """item_id, total_ratings, unique_users, round(avg_rating, 6) AS avg_rating, round(rating_std, 6) AS rating_std,
  CAST(first_rating AS VARCHAR) AS first_rating, CAST(last_rating AS VARCHAR) AS last_rating, days_since_first_rating,
  days_since_last_rating, round(ratings_per_day, 6) AS ratings_per_day"""


@query("item_stats", f"SELECT {ISTATS} FROM istats")
def _(spark, sf):
    return features.item_stats(clean(spark, sf))


@query(
    "popularity_percentile",
    """
SELECT item_id, total_ratings, round(percent_rank() OVER (ORDER BY total_ratings), 6) AS popularity_percentile
FROM istats""",
)
def _(spark, sf):
    stats = clean(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("total_ratings"))
    return features.popularity_percentile(stats)


@query(
    "item_features",
    """
WITH g AS (SELECT genre, CAST(row_number() OVER (ORDER BY count(*) DESC, genre) - 1 AS DOUBLE) AS genre_index
           FROM items GROUP BY genre),
s AS (SELECT *, percent_rank() OVER (ORDER BY total_ratings) AS popularity_percentile FROM istats)
SELECT i.item_id, i.title, i.genre, coalesce(total_ratings, 0) AS total_ratings,
       coalesce(unique_users, 0) AS unique_users, coalesce(round(avg_rating, 6), 0) AS avg_rating,
       coalesce(round(rating_std, 6), 0) AS rating_std, days_since_first_rating, days_since_last_rating,
       coalesce(round(ratings_per_day, 6), 0) AS ratings_per_day,
       coalesce(round(popularity_percentile, 6), 0) AS popularity_percentile, genre_index
FROM items i LEFT JOIN s ON i.item_id = s.item_id JOIN g ON i.genre = g.genre""",
)
def _(spark, sf):
    items = tables.content(spark, sf).select("item_id", "title", "genre")
    return features.item_features(clean(spark, sf), items).drop("first_rating", "last_rating")


@query(
    "index_genre",
    """
SELECT i.item_id, i.genre, genre_index FROM items i JOIN (
  SELECT genre, CAST(row_number() OVER (ORDER BY count(*) DESC, genre) - 1 AS DOUBLE) AS genre_index
  FROM items GROUP BY genre) g ON i.genre = g.genre""",
)
def _(spark, sf):
    return features.index_genre(tables.content(spark, sf).select("item_id", "genre"))


@query("interaction_matrix", "SELECT user_id, item_id, round(rating, 6) AS rating FROM ratings")
def _(spark, sf):
    return features.interaction_matrix(clean(spark, sf))


@query(
    "interaction_matrix_wide",
    """
SELECT user_id, coalesce(avg(CASE WHEN item_id = 1 THEN rating END), 0) AS "1",
       coalesce(avg(CASE WHEN item_id = 2 THEN rating END), 0) AS "2",
       coalesce(avg(CASE WHEN item_id = 3 THEN rating END), 0) AS "3" FROM clean GROUP BY 1""",
)
def _(spark, sf):
    return features.interaction_matrix_wide(clean(spark, sf), [1, 2, 3])


TREND = """item_id, interaction_count, unique_users, round(avg_rating, 6) AS avg_rating,
  round(trending_score, 6) AS trending_score, trending_rank"""


@query("trending_items", f"SELECT {TREND} FROM trend90")
def _(spark, sf):
    return features.trending_items(clean(spark, sf), days=90)


PAST = "2000-03-01"  # a day well inside the order dates


@query(
    "trending_items_as_of",
    f"""
SELECT {TREND} FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY round(trending_score, 6) DESC, item_id) AS INTEGER) AS trending_rank FROM (
    SELECT item_id, count(*) AS interaction_count, count(DISTINCT user_id) AS unique_users, avg(rating) AS avg_rating,
           count(*) * avg(rating) * ln(count(DISTINCT user_id) + 1) AS trending_score
    FROM clean WHERE CAST(timestamp AS DATE) BETWEEN DATE '{PAST}' - 90 AND DATE '{PAST}' GROUP BY item_id)
  QUALIFY trending_rank <= 100)""",
)
def _(spark, sf):
    """Trending at a past day: later interactions do not count."""
    return features.trending_items(clean(spark, sf), days=90, as_of=PAST)


@query(
    "item_stats_as_of",
    f"""
SELECT item_id, count(*) AS total_ratings, count(DISTINCT user_id) AS unique_users, round(avg(rating), 6) AS avg_rating,
       round(coalesce(stddev_samp(rating), 0), 6) AS rating_std, CAST(min(timestamp) AS VARCHAR) AS first_rating,
       CAST(max(timestamp) AS VARCHAR) AS last_rating,
       CAST(date_diff('day', min(timestamp), DATE '{PAST}') AS INTEGER) AS days_since_first_rating,
       CAST(date_diff('day', max(timestamp), DATE '{PAST}') AS INTEGER) AS days_since_last_rating,
       round(count(*) / greatest(date_diff('day', min(timestamp), DATE '{PAST}'), 1), 6) AS ratings_per_day
FROM clean WHERE CAST(timestamp AS DATE) <= DATE '{PAST}' GROUP BY item_id""",
)
def _(spark, sf):
    """Item statistics at a past day."""
    return features.item_stats(clean(spark, sf), PAST)


@query("global_trending_rank", "SELECT item_id, trending_rank FROM trend90")
def _(spark, sf):
    return features.trending_items(clean(spark, sf), days=90).select("item_id", "trending_rank")


@query(
    "trending_with_metadata",
    f"""
SELECT i.title, i.genre, i.year, {TREND.replace("item_id", "t.item_id", 1).replace("(avg", "(t.avg")}
FROM trend90 t JOIN items i ON t.item_id = i.item_id""",
)
def _(spark, sf):
    trend = features.trending_items(clean(spark, sf), days=90)
    return features.trending_with_metadata(trend, tables.content(spark, sf))


@query(
    "trending_window",
    """
SELECT item_id, interaction_count, unique_users, round(avg_rating, 6) AS avg_rating,
       round(trending_score, 6) AS trending_score,
       CAST(row_number() OVER (ORDER BY round(trending_score, 6) DESC, item_id) AS INTEGER) AS rank
FROM (SELECT item_id, count(*) AS interaction_count, count(DISTINCT user_id) AS unique_users,
             avg(clicked) AS avg_rating, count(*) * avg(clicked) * ln(count(DISTINCT user_id) + 1) AS trending_score
      FROM reclog WHERE timestamp > (SELECT max(timestamp) FROM reclog) - INTERVAL 168 HOUR AND genre <> 'PROMO'
      GROUP BY item_id)
ORDER BY rank LIMIT 50""",
)
def _(spark, sf):
    rows = tables.recommendation_log(spark, sf).withColumn("rating", F.col("clicked").cast("double"))
    return features.trending_window(rows, hours=168, n=50, where=F.col("genre") != "PROMO")


@query(
    "trending_window_as_of",
    """
SELECT item_id, interaction_count, unique_users, round(avg_rating, 6) AS avg_rating,
       round(trending_score, 6) AS trending_score,
       CAST(row_number() OVER (ORDER BY round(trending_score, 6) DESC, item_id) AS INTEGER) AS rank
FROM (SELECT item_id, count(*) AS interaction_count, count(DISTINCT user_id) AS unique_users,
             avg(clicked) AS avg_rating, count(*) * avg(clicked) * ln(count(DISTINCT user_id) + 1) AS trending_score
      FROM reclog WHERE timestamp > TIMESTAMP '2024-01-11' - INTERVAL 100 HOUR AND timestamp <= TIMESTAMP '2024-01-11'
      GROUP BY item_id)
ORDER BY rank LIMIT 20""",
)
def _(spark, sf):
    """Trend ranking of the hours before a past moment."""
    rows = tables.recommendation_log(spark, sf).withColumn("rating", F.col("clicked").cast("double"))
    return features.trending_window(rows, hours=100, as_of=F.lit("2024-01-11").cast("timestamp_ntz"))


@query(
    "encode_ids_text",
    """
SELECT username, row_number() OVER (ORDER BY username) - 1 AS user_index FROM (
  SELECT DISTINCT username FROM people JOIN clean USING (user_id))""",
)
def _(spark, sf):
    """Dense ids of text keys."""
    rated = clean(spark, sf).join(tables.users(spark, sf), "user_id")
    return features.encode_ids(rated, "username", "user_index")


@query(
    "encode_ids",
    """
SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_index FROM (SELECT DISTINCT user_id FROM clean)""",
)
def _(spark, sf):
    return features.encode_ids(clean(spark, sf), "user_id", "user_index")


@query(
    "training_stats",
    """
SELECT count(*) AS interactions, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
       (SELECT count(*) FROM part) AS content_rows FROM clean""",
)
def _(spark, sf):
    return features.training_stats(clean(spark, sf), tables.content(spark, sf))


@query(
    "top_n_per_user",
    """
SELECT user_id, item_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS INTEGER) AS rank
FROM list_a QUALIFY rank <= 10""",
)
def _(spark, sf):
    return ranking.top_n_per_user(tables.scored_lists(spark, sf)[0], 10)


@query(
    "response_rank",
    """
SELECT user_id, item_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS INTEGER) AS rank
FROM list_b QUALIFY rank <= 20""",
)
def _(spark, sf):
    served = ranking.top_n_per_user(tables.scored_lists(spark, sf)[1], 20).drop("rank")
    return ranking.response_rank(served)


@query(
    "minmax_normalize",
    """
SELECT user_id, item_id, round(score, 6) AS score,
       round(CASE WHEN max(score) OVER w > min(score) OVER w
                  THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) AS norm
FROM list_b WINDOW w AS (PARTITION BY user_id)""",
)
def _(spark, sf):
    return ranking.minmax_normalize(tables.scored_lists(spark, sf)[1])


@query(
    "position_bonus",
    """
WITH served AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM list_b
                QUALIFY rn <= 20)
SELECT user_id, item_id, score, round((count(*) OVER (PARTITION BY user_id) + 1 - rn)
       / count(*) OVER (PARTITION BY user_id) * 0.1, 6) AS bonus FROM served""",
)
def _(spark, sf):
    return ranking.position_bonus(ranking.top_n_per_user(tables.scored_lists(spark, sf)[1], 20).drop("rank"))


@query(
    "last_n_history",
    """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), '|' ORDER BY timestamp, item_id, rating) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC, rating DESC) AS rn
  FROM clean) WHERE rn <= 5 GROUP BY user_id""",
)
def _(spark, sf):
    return ranking.last_n_items(clean(spark, sf), 5)


@query(
    "top_values",
    "SELECT genre, count(*) AS count FROM items GROUP BY genre",
)
def _(spark, sf):
    return ranking.top_values(tables.content(spark, sf), "genre")
