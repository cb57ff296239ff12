"""Catalogue discovery: facets, collections, scoring modes, sorting and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import catalog_predicate, decade, duration_range, rating_range
from ..functions.text import slug
from .ranking import global_top

# Theme words per season.
SEASONAL_THEMES = {
    "winter": ["christmas", "holiday", "snow", "winter", "cozy"],
    "spring": ["romance", "renewal", "fresh", "growth"],
    "summer": ["adventure", "action", "beach", "vacation", "outdoors"],
    "fall": ["horror", "thriller", "dark", "mystery", "autumn"],
}
# Display name and kind of each facet.
FACETS = {
    "category": ("Category", "terms"),
    "genre": ("Genre", "terms"),
    "language": ("Language", "terms"),
    "decade": ("Decade", "terms"),
    "rating_range": ("Rating", "range"),
    "duration_range": ("Duration", "range"),
}


def facet_columns() -> dict[str, Column]:
    return {
        "category": F.col("category"),
        "genre": F.col("genre"),
        "language": F.col("language"),
        "decade": decade(F.col("year")),
        "rating_range": rating_range(F.col("rating")),
        "duration_range": duration_range(F.col("duration")),
    }


def search_facet_columns() -> dict[str, Column]:
    """The facet list of the search side: plain values, no ranges."""
    return {name: F.col(name).cast("string") for name in ("category", "genre", "year", "language", "rating")}


def facet_counts(df: DataFrame, columns: Mapping[str, Column] | None = None) -> DataFrame:
    """Long rows (facet, value, count, percentage of all items) in one pass over the catalogue.

    Each row is unpivoted and counted map-side, so a value shared by a third of
    the catalogue costs one partial count per task.
    """
    columns = columns or facet_columns()
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in columns.items()])
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("percentage", F.col("count") / total * 100)
    )


def facet_counts_filtered(
    df: DataFrame, filters: Mapping[str, object], columns: Mapping[str, Column] | None = None
) -> DataFrame:
    """Facets of the items that pass the filters."""
    return facet_counts(df.filter(catalog_predicate(dict(filters))), columns)


def facet_documents(counts: DataFrame) -> DataFrame:
    """One row per facet with its values nested, most frequent first, for export.

    Facet values are catalogue vocabulary; the list is as long as the vocabulary.
    """
    names = F.create_map(*[F.lit(x) for k, (d, t) in FACETS.items() for x in (k, d)])
    kinds = F.create_map(*[F.lit(x) for k, (d, t) in FACETS.items() for x in (k, t)])
    entry = F.struct((-F.col("count")).alias("o"), "value", "count", "percentage")
    return (
        counts.groupBy("facet")
        .agg(F.array_sort(F.collect_list(entry)).alias("v"))
        .select(
            F.col("facet").alias("name"),
            F.coalesce(F.try_element_at(names, "facet"), F.initcap("facet")).alias("display_name"),
            F.coalesce(F.try_element_at(kinds, "facet"), F.lit("terms")).alias("facet_type"),
            F.transform(
                "v",
                lambda x: F.struct(
                    x["value"].alias("value"), x["count"].alias("count"), x["percentage"].alias("percentage")
                ),
            ).alias("values"),
        )
    )


def collections(df: DataFrame, min_items: int = 5, top: int = 10) -> DataFrame:
    """Genre and decade collections with at least ``min_items`` items and their most popular ids.

    Counts and top lists are separate: the count is a partial aggregate and the
    list keeps ``top`` rows per collection before the shuffle.
    """
    kinds = F.array(
        F.struct(F.lit("genre").alias("type"), F.col("genre").alias("value")),
        F.struct(F.lit("decade").alias("type"), decade(F.col("year")).alias("value")),
    )
    members = df.select("item_id", "popularity", F.inline(kinds)).filter(F.col("value").isNotNull())
    sizes = members.groupBy("type", "value").agg(F.count(F.lit(1)).alias("item_count"))
    order = Window.partitionBy("type", "value").orderBy(F.desc("popularity"), F.asc("item_id"))
    lists = (
        members.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= top)
        .groupBy("type", "value")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "item_id"))).alias("_l"))
    )
    value = F.col("value")
    return (
        sizes.filter(F.col("item_count") >= min_items)
        .join(lists, ["type", "value"])
        .select(
            F.when(F.col("type") == "genre", F.concat(F.lit("genre-"), slug(value)))
            .otherwise(F.concat(F.lit("decade-"), value))
            .alias("id"),
            F.when(F.col("type") == "genre", F.concat(F.lit("Best of "), value))
            .otherwise(F.concat(value, F.lit(" Classics")))
            .alias("title"),
            "type",
            "item_count",
            F.transform("_l", lambda x: x["item_id"]).alias("items"),
        )
    )


def trending_score(as_of: Column) -> Column:
    """popularity x max(0.1, 1 - age/365); items without a date count as new."""
    age = F.date_diff(as_of, F.col("created_date"))
    boost = F.when(F.col("created_date").isNull(), 1.0).otherwise(F.greatest(F.lit(0.1), 1.0 - age / 365))
    return F.col("popularity") * boost


def recent_score(as_of: Column) -> Column:
    """max(0, 1 - age/30); items without a date score 0."""
    age = F.date_diff(as_of, F.col("created_date"))
    return F.when(F.col("created_date").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - age / 30))


def mode_score(mode: str, as_of: Column) -> Column:
    """The discovery score of a mode; an unknown mode scores as ``mixed``."""
    popular = F.col("popularity")
    if mode == "trending":
        return trending_score(as_of)
    if mode == "popular":
        return popular
    if mode == "recent":
        return recent_score(as_of)
    return 0.4 * trending_score(as_of) + 0.3 * popular + 0.3 * recent_score(as_of)


SORT_KEYS = {
    "discovery_score": lambda: F.round("discovery_score", 6),
    "popularity": lambda: F.col("popularity"),
    "rating": lambda: F.coalesce("rating", F.lit(0.0)),
    "year": lambda: F.col("year"),
    "title": lambda: F.col("title"),
}


def sort_order(sort_by: str = "popularity", direction: str = "desc") -> list[Column]:
    """Order columns of a catalogue sort, ties by id; an unknown key sorts by score."""
    key = SORT_KEYS.get(sort_by, SORT_KEYS["discovery_score"])()
    return [key.desc() if direction.lower() == "desc" else key.asc(), F.col("item_id").asc()]


def sort_catalog(df: DataFrame, sort_by: str = "popularity", direction: str = "desc") -> DataFrame:
    return df.orderBy(*sort_order(sort_by, direction))


def paginate(df: DataFrame, order: Sequence[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page; runs as a distributed top-k of offset + limit rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: Column, last_key: object, last_id: int, limit: int = 20) -> DataFrame:
    """The page after (last_key, last_id) of a descending sort: a filter instead of a deep offset."""
    later = (key < last_key) | ((key == last_key) & (F.col("item_id") > last_id))
    return df.filter(later).orderBy(key.desc(), F.col("item_id").asc()).limit(limit)


def discover(
    content: DataFrame,
    as_of: Column,
    filters: Mapping[str, object] | None = None,
    mode: str = "mixed",
    sort_by: str = "popularity",
    direction: str = "desc",
    limit: int = 20,
    offset: int = 0,
    similar_scores: DataFrame | None = None,
) -> DataFrame:
    """Filter, score, sort and cut one page; ``total`` is the number of matches.

    ``similar_scores`` (item_id, score) are the taste scores of the mode
    ``similar``; without them that mode falls back to popularity. The default
    sort is popularity, whatever the mode.
    """
    matched = content.filter(catalog_predicate(dict(filters or {})))
    total = matched.agg(F.count(F.lit(1))).scalar()
    if mode == "similar":
        if similar_scores is not None:
            matched = matched.join(similar_scores.select("item_id", "score"), "item_id", "left")
            scored = matched.withColumn("discovery_score", F.coalesce("score", F.lit(0.0))).drop("score")
        else:
            scored = matched.withColumn("discovery_score", F.col("popularity"))
    else:
        scored = matched.withColumn("discovery_score", mode_score(mode, as_of))
    return paginate(scored, sort_order(sort_by, direction), limit, offset).withColumn("total", total)


def season_of(day: Column) -> Column:
    """Meteorological season of a date."""
    month = F.month(day)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("fall")
    )


def seasonal(
    content: DataFrame, season: str, limit: int = 20, themes: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Items whose text holds theme words of the season, by number of distinct words found."""
    words = (themes or SEASONAL_THEMES).get(season, [])
    body = F.lower(F.concat_ws(" ", "title", "description", F.array_join("keywords", " ")))
    score = sum((F.when(F.contains(F.col("_body"), F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0))
    hits = (
        content.withColumn("_body", body)
        .withColumn("seasonal_score", score)
        .filter(F.col("seasonal_score") > 0)
        .select("item_id", "title", "category", "genre", "seasonal_score")
        .withColumn("season", F.lit(season))
    )
    return global_top(hits, limit, [F.col("seasonal_score").desc(), F.col("item_id").asc()])
