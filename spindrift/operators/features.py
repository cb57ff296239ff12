"""User and item feature tables, popularity, trending and id encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .cleaning import fill_defaults
from .ranking import global_top

# The defaults of absent users and items.
USER_DEFAULTS = {"favorite_genre": "Unknown", "favorite_genre_rating": 0.0, "weekend_preference": 0.0}
ITEM_DEFAULTS = {
    "total_ratings": 0,
    "unique_users": 0,
    "avg_rating": 0.0,
    "rating_std": 0.0,
    "ratings_per_day": 0.0,
    "popularity_percentile": 0.0,
}


def as_of_date(df: DataFrame, as_of: str | Column | None, ts: str = "timestamp") -> Column:
    """The reference day: given, or the latest event day as a scalar subquery (no action)."""
    if as_of is None:
        return df.agg(F.to_date(F.max(ts))).scalar()
    return F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of


def _stat_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_interactions"),
        F.avg("rating").alias("avg_rating"),
        F.coalesce(F.stddev("rating"), F.lit(0.0)).alias("rating_std"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.min("timestamp").alias("first_interaction"),
        F.max("timestamp").alias("last_interaction"),
    ]


def _with_unique(stats: DataFrame, df: DataFrame, key: str, other: str, out: str, after: str) -> DataFrame:
    """Add the number of distinct ``other`` of each ``key`` behind the column ``after``.

    Beside a distinct count Spark would exchange all aggregates of a row by (key, other) first; apart, only the pairs are.
    """
    pairs = df.select(F.col(key).alias("_key"), other).distinct()
    unique = pairs.groupBy("_key").agg(F.count(other).alias(out))
    at = stats.columns.index(after) + 1
    joined = stats.join(unique, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(*stats.columns[:at], out, *stats.columns[at:])


def _profile_columns(ts: str) -> list[Column]:
    day = F.dayofweek(ts)
    return [
        F.avg(F.hour(ts)).alias("avg_interaction_hour"),
        F.mode(day, True).alias("most_active_day"),
        F.avg(day.isin(1, 7).cast("int")).alias("weekend_preference"),
    ]


def user_stats(df: DataFrame) -> DataFrame:
    """Counts, rating spread and activity span per user."""
    stats = df.groupBy("user_id").agg(*_stat_columns())
    return _with_span(_with_unique(stats, df, "user_id", "item_id", "unique_items", "max_rating"))


def _with_span(stats: DataFrame) -> DataFrame:
    days = F.date_diff("last_interaction", "first_interaction") + 1
    return stats.withColumns(
        {
            "rating_range": F.col("max_rating") - F.col("min_rating"),
            "days_active": days,
            "interactions_per_day": F.col("total_interactions") / F.greatest(days, F.lit(1)),
        }
    )


def interactions_with_genre(interactions: DataFrame, content: DataFrame) -> DataFrame:
    """Interactions of items that have a genre, with the first genre of the item."""
    genres = content.select("item_id", F.split("genre", ",").getItem(0).alias("genre_primary"))
    return interactions.join(genres.filter(F.col("genre_primary").isNotNull()), "item_id")


def rank_genre_per_user(interactions: DataFrame, content: DataFrame) -> DataFrame:
    """(user, genre) counts with the rank of each genre for the user.

    A user has at most as many rows as there are genres.
    """
    counted = (
        interactions_with_genre(interactions, content)
        .groupBy("user_id", "genre_primary")
        .agg(F.count(F.lit(1)).alias("genre_count"), F.avg("rating").alias("genre_avg_rating"))
    )
    w = Window.partitionBy("user_id").orderBy(F.desc("genre_count"), F.asc("genre_primary"))
    return counted.withColumn("rank", F.row_number().over(w))


def favorite_genre(interactions: DataFrame, content: DataFrame) -> DataFrame:
    """Most frequent genre per user and its mean rating; ties go to the first name."""
    return (
        rank_genre_per_user(interactions, content)
        .filter("rank = 1")
        .select(
            "user_id",
            F.col("genre_primary").alias("favorite_genre"),
            F.col("genre_avg_rating").alias("favorite_genre_rating"),
        )
    )


def temporal_profile(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Mean hour, most frequent weekday (ties: the smallest) and weekend share per user."""
    return df.groupBy("user_id").agg(*_profile_columns(ts))


def user_features(interactions: DataFrame, content: DataFrame) -> DataFrame:
    """One row per user: stats, favourite genre and temporal profile, defaults filled.

    Stats and profile come from one aggregate on the same key.
    """
    both = interactions.groupBy("user_id").agg(*_stat_columns(), *_profile_columns("timestamp"))
    both = _with_span(_with_unique(both, interactions, "user_id", "item_id", "unique_items", "max_rating"))
    joined = both.join(favorite_genre(interactions, content), "user_id", "left")
    return fill_defaults(joined, USER_DEFAULTS)


def item_stats(df: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Counts, rating spread and age in days per item, relative to ``as_of``; later rows do not count."""
    today = as_of_date(df, as_of)
    df = df.filter(F.to_date("timestamp") <= today)
    stats = df.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("total_ratings"),
        F.avg("rating").alias("avg_rating"),
        F.coalesce(F.stddev("rating"), F.lit(0.0)).alias("rating_std"),
        F.min("timestamp").alias("first_rating"),
        F.max("timestamp").alias("last_rating"),
    )
    stats = _with_unique(stats, df, "item_id", "user_id", "unique_users", "total_ratings")
    since_first = F.date_diff(today, F.to_date("first_rating"))
    return stats.withColumns(
        {
            "days_since_first_rating": since_first,
            "days_since_last_rating": F.date_diff(today, F.to_date("last_rating")),
            "ratings_per_day": F.col("total_ratings") / F.greatest(since_first, F.lit(1)),
        }
    )


def popularity_percentile(df: DataFrame, value: str = "total_ratings") -> DataFrame:
    """Add ``popularity_percentile`` = percent_rank over all rows by ``value``.

    A plain global window would sort every row in one task. Equal counts share
    a rank, so the running sum only needs the histogram of distinct counts, of
    which there are at most sqrt(2 x interactions): distinct positive counts
    summing to N. That table is numbered in one task and joined back.
    """
    histogram = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = histogram.select(
        value,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"),
        F.sum("_n").over(everything).alias("_total"),
    ).select(
        value,
        F.when(F.col("_total") > 1, F.col("_below") / (F.col("_total") - 1))
        .otherwise(0.0)
        .alias("popularity_percentile"),
    )
    return df.join(ranked, value)


def index_genre(df: DataFrame, genre: str = "genre", out: str = "genre_index") -> DataFrame:
    """Add the frequency rank of the genre, 0 = most frequent, ties by name.

    The window runs over one row per genre.
    """
    order = Window.orderBy(F.desc("count"), F.asc(genre))
    index = df.groupBy(genre).count().select(genre, (F.row_number().over(order) - 1).cast("double").alias(out))
    return df.join(index, genre, "left")


def item_features(interactions: DataFrame, content: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Content with item stats, popularity percentile and genre index, defaults filled."""
    stats = popularity_percentile(item_stats(interactions, as_of))
    joined = index_genre(content.join(stats, "item_id", "left"))
    return fill_defaults(joined, ITEM_DEFAULTS)


def interaction_matrix(df: DataFrame) -> DataFrame:
    """The user-item matrix in long form: mean rating per pair; absent pairs are zero."""
    return df.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def interaction_matrix_wide(df: DataFrame, item_ids: Sequence[int]) -> DataFrame:
    """The wide form for a given, bounded list of items; absent pairs are 0, and users without any keep a row."""
    return df.groupBy("user_id").pivot("item_id", list(item_ids)).agg(F.avg("rating")).fillna(0.0)


def trending_scores(df: DataFrame) -> DataFrame:
    """count x mean rating x ln(users + 1) per item.

    Users are counted after a (item, user) pre-aggregation, so a hot item is
    combined in the map tasks and spread over its users.
    """
    return (
        df.groupBy("item_id")
        .agg(
            F.count(F.lit(1)).alias("interaction_count"),
            F.count_distinct("user_id").alias("unique_users"),
            F.avg("rating").alias("avg_rating"),
        )
        .withColumn(
            "trending_score", F.col("interaction_count") * F.col("avg_rating") * F.log(F.col("unique_users") + 1)
        )
    )


def trending_items(
    interactions: DataFrame, days: int = 7, n: int = 100, as_of: str | Column | None = None
) -> DataFrame:
    """Top ``n`` items by trend score over the last ``days`` days up to ``as_of``."""
    today = as_of_date(interactions, as_of)
    day = F.to_date("timestamp")
    recent = interactions.filter((day >= F.date_sub(today, days)) & (day <= today))
    order = [F.round("trending_score", 6).desc(), F.col("item_id").asc()]
    return global_top(trending_scores(recent), n, order, rank="trending_rank")


def trending_with_metadata(trending: DataFrame, content: DataFrame) -> DataFrame:
    """Trending items with title, genre and year; ranks of unknown items leave gaps.

    Spark broadcasts the trending side if its size allows.
    """
    columns = [c for c in ("title", "genre", "year") if c in content.columns]
    return content.select("item_id", *columns).join(trending, "item_id")


def trending_window(
    interactions: DataFrame, hours: int = 24, n: int = 20, where: Column | None = None, as_of: Column | None = None
) -> DataFrame:
    """Trend ranking over the last ``hours`` (1-168) up to ``as_of``, the latest event by default, optionally filtered."""
    if not 1 <= hours <= 168:
        raise ValueError("hours must be within 1 and 168")
    if not 1 <= n <= 100:
        raise ValueError("n must be within 1 and 100")
    end = interactions.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    stamp = F.col("timestamp")
    recent = interactions.filter((stamp > end - F.make_dt_interval(hours=F.lit(hours))) & (stamp <= end))
    if where is not None:
        recent = recent.filter(where)
    order = [F.round("trending_score", 6).desc(), F.col("item_id").asc()]
    return global_top(trending_scores(recent), n, order)


def encode_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Dense zero-based ids in key order, for keys of any sortable type; null keys get none.

    Distinct keys are sorted by range partitions and written once. Only the sizes
    of the partitions, one row each, are summed in one place; an id is the offset
    of its partition plus the place in it.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(partitions, key)
    placed = cut_lineage(keys.withColumn("_b", F.spark_partition_id()))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return (
        placed.withColumn("_p", place)
        .join(offsets, "_b")
        .select(key, (F.col("_o") + F.col("_p")).cast("bigint").alias(out))
    )


def training_stats(interactions: DataFrame, content: DataFrame) -> DataFrame:
    """One row: interactions, distinct users, distinct items and catalogue rows."""
    return interactions.agg(
        F.count(F.lit(1)).alias("interactions"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
    ).withColumn("content_rows", content.agg(F.count(F.lit(1))).scalar())
