"""Validation, cleaning and row-level features for interactions and content."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The interaction types an event may carry.
EVENT_TYPES = ("view", "rating", "like", "share", "purchase", "download", "bookmark")
# Characters kept in content text; everything else is dropped.
TEXT_KEEP = r"[^a-zA-Z0-9\s\-,.]"


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Fail while the plan is built if a column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def clean_interactions(df: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Drop incomplete or out-of-range rows; one row per (user, item, timestamp).

    Repeats keep the lowest rating. Written as ``min`` so that Spark combines
    repeats before the shuffle and a much-repeated key never forms a big group.
    """
    require_columns(df, ("user_id", "item_id", "rating", "timestamp"))
    return (
        df.filter(
            F.col("user_id").isNotNull()
            & F.col("item_id").isNotNull()
            & F.col("timestamp").isNotNull()
            & F.col("rating").between(low, high)
        )
        .groupBy("user_id", "item_id", "timestamp")
        .agg(F.min("rating").alias("rating"))
        .select("user_id", "item_id", "rating", "timestamp")
    )


def clean_interactions_latest(
    df: DataFrame, min_interactions: int = 5, default_timestamp: Column | None = None
) -> DataFrame:
    """Loader variant: casts, first row per (user, item), then range check, then k-core.

    "First" is by timestamp, then rating. ``min(struct)`` is a partial aggregate.
    """
    require_columns(df, ("user_id", "item_id", "rating"))
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", default_timestamp if default_timestamp is not None else F.current_timestamp())
    first = (
        df.select(
            F.col("user_id").cast("bigint"),
            F.col("item_id").cast("bigint"),
            F.struct("timestamp", F.col("rating").cast("double").alias("rating")).alias("row"),
        )
        .groupBy("user_id", "item_id")
        .agg(F.min("row").alias("row"))
        .select("user_id", "item_id", "row.rating", "row.timestamp")
        .filter(F.col("rating").between(1, 5))
    )
    return k_core_filter(first, min_interactions)


def parse_timestamp(value: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Plain cast first, then the explicit pattern; null when neither fits."""
    return F.coalesce(value.try_cast("timestamp"), F.try_to_timestamp(value, F.lit(pattern)))


def temporal_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add rating_date, rating_hour, rating_dayofweek (1 = Sunday) and is_weekend."""
    day = F.dayofweek(ts)
    return df.withColumns(
        {
            "rating_date": F.to_date(ts),
            "rating_hour": F.hour(ts),
            "rating_dayofweek": day,
            "is_weekend": F.when(day.isin(1, 7), 1).otherwise(0),
        }
    )


def frequent_keys(df: DataFrame, key: str, at_least: int) -> DataFrame:
    return df.groupBy(key).count().filter(F.col("count") >= at_least).select(key)


def k_core_filter(df: DataFrame, min_interactions: int = 5) -> DataFrame:
    """Keep rows whose user and item both have enough rows; one pass, both counted on ``df``.

    The key tables grow with the data, so the join strategy is left to Spark's
    size estimates instead of a broadcast hint. Users come last: where both joins
    exchange rows, those of a user end side by side, and sums by user made from the
    written rows are combined before they are exchanged.
    """
    users = frequent_keys(df, "user_id", min_interactions)
    items = frequent_keys(df, "item_id", min_interactions)
    kept = df.join(items, "item_id", "left_semi").join(users, "user_id", "left_semi")
    return kept.select(*df.columns)


def semi_valid_users_items(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose user and item occur in the given key tables."""
    return df.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")


def _text(name: str) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(F.col(name), F.lit(""))), TEXT_KEEP, "")


def clean_content(df: DataFrame, fields: Sequence[str] = ("title", "description", "genre", "tags")) -> DataFrame:
    """One row per item with blank-filled, trimmed text of plain characters.

    Repeated item ids keep the smallest (title, description, ...) row. Because
    ids may repeat in bulk, the choice is an aggregate and not a window sort.
    """
    require_columns(df, ("item_id",))
    df = df.withColumns({f: F.lit("") for f in fields if f not in df.columns})
    rest = [c for c in df.columns if c != "item_id"]
    order = [f for f in fields] + [c for c in rest if c not in fields]
    return (
        df.filter(F.col("item_id").isNotNull())
        .groupBy("item_id")
        .agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c).cast("string").alias(c) for c in order])).alias("row"))
        .select("item_id", *[F.col(f"row.{c}").alias(c) for c in rest])
        .withColumns({f: _text(f) for f in fields})
    )


def clean_content_simple(df: DataFrame, fields: Sequence[str] = ("title", "description", "genre", "tags")) -> DataFrame:
    """Loader variant: cast the id, blank-fill text, one row per id; text is left as it is."""
    require_columns(df, ("item_id",))
    df = df.withColumns({f: F.lit("") for f in fields if f not in df.columns})
    filled = df.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("bigint").alias("item_id"),
        *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields],
    )
    return (
        filled.groupBy("item_id")
        .agg(F.min(F.struct(*fields)).alias("row"))
        .select("item_id", *[F.col(f"row.{f}").alias(f) for f in fields])
    )


def content_features(df: DataFrame) -> DataFrame:
    """Text lengths, description flag, first genre and tag count (an empty tag text counts 1)."""
    return df.withColumns(
        {
            "title_length": F.length("title"),
            "description_length": F.length("description"),
            "has_description": F.when(F.length("description") > 0, 1).otherwise(0),
            "genre_primary": F.split("genre", ",").getItem(0),
            "tag_count": F.size(F.split("tags", ",")),
        }
    )


def content_range_guard(df: DataFrame, as_of_year: int) -> DataFrame:
    """Null out impossible years and durations; add content_age. Absent columns are skipped."""
    if "release_year" in df.columns:
        year = F.col("release_year")
        df = df.withColumn("release_year", F.when(year.between(1900, as_of_year), year))
        df = df.withColumn("content_age", F.lit(as_of_year) - F.col("release_year"))
    if "duration_minutes" in df.columns:
        minutes = F.col("duration_minutes")
        df = df.withColumn("duration_minutes", F.when(minutes.between(1, 1000), minutes))
    return df


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``fillna`` limited to the columns present."""
    return df.fillna({k: v for k, v in defaults.items() if k in df.columns})


def validate_events(
    df: DataFrame,
    types: Sequence[str] = EVENT_TYPES,
    low: float = 1.0,
    high: float = 5.0,
    default_timestamp: Column | None = None,
) -> DataFrame:
    """Tag each event with ``reason``: null for a valid row, else why it is rejected.

    One pass; callers split with ``reason IS NULL`` so both halves share a scan.
    """
    stamp = F.col("timestamp") if default_timestamp is None else F.coalesce("timestamp", default_timestamp)
    rating = F.col("rating")
    return df.withColumn("timestamp", stamp).withColumn(
        "reason",
        F.when(F.col("user_id").isNull() | F.col("item_id").isNull(), "missing id")
        .when(F.col("timestamp").isNull(), "missing timestamp")
        .when(F.col("event_type").isNull() | ~F.col("event_type").isin(*types), "unknown type")
        .when(rating.isNotNull() & ~rating.between(low, high), "rating out of range"),
    )


def require_profile_fields(df: DataFrame, field: str = "preferences") -> DataFrame:
    """Tag profiles that lack the required field with a ``reason``."""
    return df.withColumn("reason", F.when(F.col(field).isNull(), f"missing {field}"))


def canonical_recommendations(df: DataFrame) -> DataFrame:
    """Map foreign recommendation rows to (item_id, confidence_score, relevance_score)."""
    have = set(df.columns)

    def first(*names: str) -> list[Column]:
        return [F.col(n) for n in names if n in have]

    keep = [c for c in df.columns if c not in {"item_id", "id", "score", "relevance_score", "confidence_score"}]
    return df.select(
        *keep,
        F.coalesce(*[c.cast("string") for c in first("item_id", "id")]).alias("item_id"),
        F.coalesce(*first("score"), F.lit(0.5)).alias("confidence_score"),
        F.coalesce(*first("relevance_score", "score"), F.lit(0.5)).alias("relevance_score"),
    )


INSIGHT_SCHEMA = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField(
            "additional_recommendations",
            T.ArrayType(
                T.StructType(
                    [T.StructField("id", T.StringType()), T.StructField("relevance_score", T.DoubleType())]
                )
            ),
        ),
        T.StructField("trending_opportunities", T.ArrayType(T.StringType())),
        T.StructField("user_segment", T.StringType()),
    ]
)


def parse_insights_json(df: DataFrame, response: str = "response") -> DataFrame:
    """Parse a stored model response; bad JSON and non-objects give the default fields."""
    text = F.trim(F.col(response))
    parsed = F.from_json(text, INSIGHT_SCHEMA, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(text.startswith("{") & F.try_parse_json(text).isNotNull(), F.lit(False))
    is_json = F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
    empty_recs = F.array().cast("array<struct<id:string,relevance_score:double>>")
    return (
        df.withColumn("_p", F.when(is_object, parsed))
        .withColumn(
            "summary",
            F.when(is_object, F.coalesce("_p.summary", F.lit("")))
            .when(is_json, "Invalid AI response format")
            .otherwise("AI analysis completed"),
        )
        .withColumn("additional_recommendations", F.coalesce("_p.additional_recommendations", empty_recs))
        .withColumn(
            "trending_opportunities", F.coalesce("_p.trending_opportunities", F.array().cast("array<string>"))
        )
        .withColumn("user_segment", F.coalesce("_p.user_segment", F.lit("general")))
        .drop("_p")
    )
