"""Cleaning, validation, filters and text recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog, text
from ..operators import cleaning
from ..sources import tables
from .base import query


def clean(spark, sf):
    return cleaning.clean_interactions(tables.interactions(spark, sf))


@query("clean_interactions", "SELECT user_id, item_id, rating, CAST(timestamp AS VARCHAR) AS timestamp FROM clean")
def _(spark, sf):
    return clean(spark, sf)


@query(
    "clean_interactions_latest",
    """
WITH first_row AS (
  SELECT user_id, item_id, rating, timestamp,
         row_number() OVER (PARTITION BY user_id, item_id ORDER BY timestamp, rating) AS rn FROM interactions),
kept AS (SELECT * FROM first_row WHERE rn = 1 AND rating BETWEEN 1 AND 5),
u AS (SELECT user_id FROM kept GROUP BY 1 HAVING count(*) >= 30),
i AS (SELECT item_id FROM kept GROUP BY 1 HAVING count(*) >= 30)
SELECT user_id, item_id, rating, CAST(timestamp AS VARCHAR) AS timestamp FROM kept
WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i)""",
)
def _(spark, sf):
    return cleaning.clean_interactions_latest(tables.interactions(spark, sf), min_interactions=30)


@query(
    "parse_timestamp",
    """
SELECT event_id, CAST(date_trunc('second', timestamp) AS VARCHAR) AS parsed FROM ev WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL FROM ev WHERE event_type = 'error'""",
)
def _(spark, sf):
    raw = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    )
    return tables.events(spark, sf).select("event_id", cleaning.parse_timestamp(raw).alias("parsed"))


@query(
    "temporal_features",
    """
SELECT event_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS rating_date,
       CAST(hour(timestamp) AS INTEGER) AS rating_hour,
       CAST(dayofweek(timestamp) + 1 AS INTEGER) AS rating_dayofweek,
       CAST(CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend FROM ev""",
)
def _(spark, sf):
    return cleaning.temporal_features(tables.events(spark, sf).select("event_id", "timestamp")).drop("timestamp")


K_CORE_SQL = """
WITH u AS (SELECT user_id FROM clean GROUP BY 1 HAVING count(*) >= 30),
i AS (SELECT item_id FROM clean GROUP BY 1 HAVING count(*) >= 30)
SELECT user_id, item_id, rating, CAST(timestamp AS VARCHAR) AS timestamp FROM clean
WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i)"""


@query("k_core_filter", K_CORE_SQL)
def _(spark, sf):
    return cleaning.k_core_filter(clean(spark, sf), 30)


@query(
    "semi_valid_users_items",
    """
SELECT user_id, item_id, rating FROM interactions
WHERE user_id IN (SELECT user_id FROM people WHERE is_premium)
  AND item_id IN (SELECT item_id FROM items WHERE genre = 'PROMO')""",
)
def _(spark, sf):
    premium = tables.users(spark, sf).filter("is_premium").select("user_id")
    promo = tables.content(spark, sf).filter("genre = 'PROMO'").select("item_id")
    rows = tables.interactions(spark, sf).select("user_id", "item_id", "rating")
    return cleaning.semi_valid_users_items(rows, premium, promo)


CLEAN_CONTENT = """
SELECT item_id, regexp_replace(trim(title), '[^a-zA-Z0-9\\s\\-,.]', '', 'g') AS title,
       regexp_replace(trim(description), '[^a-zA-Z0-9\\s\\-,.]', '', 'g') AS description,
       regexp_replace(trim(genre), '[^a-zA-Z0-9\\s\\-,.]', '', 'g') AS genre,
       regexp_replace(trim(tags), '[^a-zA-Z0-9\\s\\-,.]', '', 'g') AS tags FROM content"""


def cleaned_content(spark, sf):
    columns = ("item_id", "title", "description", "genre", "tags")
    return cleaning.clean_content(tables.content(spark, sf, with_text=True).select(*columns))


@query("clean_content", CLEAN_CONTENT)
def _(spark, sf):
    return cleaned_content(spark, sf)


@query(
    "content_features",
    f"""
WITH c AS ({CLEAN_CONTENT})
SELECT item_id, CAST(length(title) AS INTEGER) AS title_length,
       CAST(length(description) AS INTEGER) AS description_length,
       CAST(CASE WHEN length(description) > 0 THEN 1 ELSE 0 END AS INTEGER) AS has_description,
       split_part(genre, ',', 1) AS genre_primary, CAST(len(string_split(tags, ',')) AS INTEGER) AS tag_count FROM c""",
)
def _(spark, sf):
    return cleaning.content_features(cleaned_content(spark, sf)).drop("title", "description", "genre", "tags")


@query(
    "content_range_guard",
    """
SELECT item_id, CASE WHEN year BETWEEN 1900 AND 2001 THEN year END AS release_year,
       CASE WHEN year BETWEEN 1900 AND 2001 THEN 2001 - year END AS content_age,
       CASE WHEN duration * 5 - 20 BETWEEN 1 AND 1000 THEN duration * 5 - 20 END AS duration_minutes FROM items""",
)
def _(spark, sf):
    items = tables.content(spark, sf).select(
        "item_id", F.col("year").alias("release_year"), (F.col("duration") * 5 - 20).alias("duration_minutes")
    )
    return cleaning.content_range_guard(items, as_of_year=2001)


@query("clean_content_simple", "SELECT item_id, title, description, genre, tags FROM content")
def _(spark, sf):
    return cleaning.clean_content_simple(tables.content(spark, sf, with_text=True))


@query(
    "combined_text",
    """
SELECT item_id, title || ' ' || description || ' ' || genre || ' ' || tags AS tag_text,
       title || ' ' || description || ' ' || genre || ' ' || array_to_string(keywords, ' ') AS keyword_text,
       'Title: ' || title || CASE WHEN description <> '' THEN ' Description: ' || description ELSE '' END
         || ' Genres: ' || genre || ' Category: ' || category
         || ' Cast: ' || array_to_string(keywords[1:5], ', ') AS labelled_text FROM content""",
)
def _(spark, sf):
    return tables.content(spark, sf, with_text=True).select(
        "item_id",
        text.combined_text("title", "description", "genre", "tags").alias("tag_text"),
        F.concat_ws(" ", "title", "description", "genre", F.array_join("keywords", " ")).alias("keyword_text"),
        text.labelled_item_text(
            F.col("title"), F.col("description"), F.array("genre"), F.col("category"), F.col("keywords"),
            F.lit(None).cast("string"),
        ).alias("labelled_text"),
    )


FILTERS = {"language": "English", "year_min": 1960, "year_max": 2010, "rating_min": 2.0, "duration_max": 200}
FILTER_SQL = """language = 'English' AND year >= 1960 AND year <= 2010 AND rating >= 2.0 AND rating <> 0
  AND (duration IS NULL OR duration <= 200)"""


@query("filter_catalog", f"SELECT item_id, title, language, year, rating, duration FROM items WHERE {FILTER_SQL}")
def _(spark, sf):
    items = tables.content(spark, sf).filter(catalog.catalog_predicate({**FILTERS, "unknown": 1}))
    return items.select("item_id", "title", "language", "year", "rating", "duration")


@query(
    "filter_documents",
    """
SELECT item_id, genre, category, rating, duration FROM items
WHERE genre IN ('PROMO', 'SMALL') AND category IN ('Brand#1', 'Brand#2', 'Brand#3')
  AND language = 'French' AND rating >= 3.0 AND duration <= 180""",
)
def _(spark, sf):
    docs = tables.content(spark, sf).withColumn("genre", F.array("genre"))
    test = catalog.document_predicate(
        {
            "genre": ["PROMO", "SMALL"],
            "category": ["Brand#1", "Brand#2", "Brand#3"],
            "language": "French",
            "rating": {"gte": 3.0},
            "duration": {"lte": 180},
        }
    )
    return docs.filter(test).select("item_id", F.col("genre")[0].alias("genre"), "category", "rating", "duration")


@query(
    "filter_range_spec",
    """
SELECT item_id, genre, year, rating FROM items
WHERE genre IN ('ECONOMY', 'LARGE') AND year BETWEEN 1970 AND 1999 AND rating >= 4 AND rating < 9""",
)
def _(spark, sf):
    test = catalog.document_predicate(
        {"genre": ["ECONOMY", "LARGE"], "year": {"min": 1970, "max": 1999}, "rating": {"gte": 4.0, "lt": 9.0}},
        array_columns=(),
    )
    return tables.content(spark, sf).filter(test).select("item_id", "genre", "year", "rating")


@query(
    "bucket_columns",
    """
SELECT item_id, CAST((year // 10) * 10 AS VARCHAR) || 's' AS decade,
       CASE WHEN rating <> 0 THEN CAST(CAST(floor(rating) AS BIGINT) AS VARCHAR) || '-'
            || CAST(CAST(floor(rating) AS BIGINT) + 1 AS VARCHAR) END AS rating_range,
       CASE WHEN duration IS NULL OR duration = 0 THEN NULL WHEN duration < 60 THEN 'Under 1 hour'
            WHEN duration < 120 THEN '1-2 hours' WHEN duration < 180 THEN '2-3 hours'
            ELSE 'Over 3 hours' END AS duration_range FROM items""",
)
def _(spark, sf):
    return tables.content(spark, sf).select(
        "item_id",
        catalog.decade(F.col("year")).alias("decade"),
        catalog.rating_range(F.col("rating")).alias("rating_range"),
        catalog.duration_range(F.col("duration")).alias("duration_range"),
    )


def raw_events(spark, sf):
    """Events in intake shape: most types are not interaction types, many ratings are out of range."""
    return tables.events(spark, sf).select(
        "user_id",
        F.col("k").cast("bigint").alias("item_id"),
        F.when(F.col("event_type") == "click", "like").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "like", None).otherwise(F.col("value") / 20).alias("rating"),
        "timestamp",
    )


@query(
    "validate_events",
    """
WITH raw AS (SELECT user_id, CAST(k AS BIGINT) AS item_id,
       CASE WHEN event_type = 'click' THEN 'like' ELSE event_type END AS event_type, value / 20 AS rating, timestamp
  FROM ev)
SELECT user_id, item_id, event_type, rating, CAST(timestamp AS VARCHAR) AS timestamp,
       CASE WHEN event_type NOT IN ('view', 'rating', 'like', 'share', 'purchase', 'download', 'bookmark') THEN 'unknown type'
            WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating out of range' END AS reason
FROM raw""",
)
def _(spark, sf):
    return cleaning.validate_events(raw_events(spark, sf))


@query(
    "canonical_recommendations",
    """
SELECT user_id, CAST(item_id AS VARCHAR) AS item_id, coalesce(s, 0.5) AS confidence_score,
       coalesce(s, 0.5) AS relevance_score
FROM (SELECT user_id, item_id, CASE WHEN score >= 0.5 THEN score END AS s FROM list_a)""",
)
def _(spark, sf):
    foreign = tables.scored_lists(spark, sf)[0].select(
        "user_id", F.col("item_id").alias("id"), F.when(F.col("score") >= 0.5, F.col("score")).alias("score")
    )
    return cleaning.canonical_recommendations(foreign)


@query(
    "require_profile_fields",
    """
SELECT user_id, username, CASE WHEN preferences IS NULL THEN 'missing preferences' END AS reason FROM people""",
)
def _(spark, sf):
    return cleaning.require_profile_fields(tables.users(spark, sf)).select("user_id", "username", "reason")


@query(
    "fill_defaults",
    """
SELECT item_id, coalesce(rating, 0) AS rating, coalesce(CAST(created_date AS VARCHAR), 'Unknown') AS created_date
FROM items""",
)
def _(spark, sf):
    items = tables.content(spark, sf).select("item_id", "rating", F.col("created_date").cast("string"))
    return cleaning.fill_defaults(items, {"rating": 0.0, "created_date": "Unknown", "absent": 0})


@query(
    "user_context_text",
    """
WITH hist AS (
  SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ', ' ORDER BY timestamp, item_id, rating) AS recent FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC, rating DESC) AS rn
    FROM clean) WHERE rn <= 5 GROUP BY user_id)
SELECT p.user_id, concat_ws(' ', 'Preferred genres: ' || array_to_string(preferences, ', '),
  'Recently watched: ' || recent, 'Age group: ' || segment,
  CASE WHEN is_premium THEN 'Viewing on: tv' END) AS context
FROM people p LEFT JOIN hist h ON p.user_id = h.user_id""",
)
def _(spark, sf):
    from ..operators.ranking import last_n_items

    recent = last_n_items(clean(spark, sf), 5).select("user_id", F.col("items").cast("array<string>").alias("recent"))
    none = F.lit(None).cast("string")
    return (
        tables.users(spark, sf)
        .join(recent, "user_id", "left")
        .select(
            "user_id",
            text.user_context_text(
                F.col("preferences"), F.col("recent"), F.col("segment"), none, none,
                F.when(F.col("is_premium"), "tv"), none,
            ).alias("context"),
        )
    )


@query(
    "parse_insights_json",
    """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'AI analysis completed'
         WHEN event_type = 'signup' THEN 'Invalid AI response format'
         WHEN event_type = 'view' THEN 'seen' ELSE '' END AS summary,
       CASE WHEN event_type = 'view' THEN 'segment-' || k ELSE 'general' END AS user_segment,
       CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS INTEGER) AS n_recommendations FROM ev""",
)
def _(spark, sf):
    kind = F.col("event_type")
    body = F.concat(
        F.lit('{"summary": "seen", "user_segment": "segment-'), F.col("k").cast("string"),
        F.lit('", "additional_recommendations": [{"id": "'), F.col("event_id").cast("string"),
        F.lit('", "relevance_score": 0.8}]}'),
    )
    response = (
        F.when(kind == "error", '{"summary": "cut off')
        .when(kind == "signup", "[1, 2]")
        .when(kind == "view", body)
        .otherwise("{}")
    )
    parsed = cleaning.parse_insights_json(tables.events(spark, sf).withColumn("response", response))
    return parsed.select(
        "event_id", "summary", "user_segment", F.size("additional_recommendations").alias("n_recommendations")
    )
