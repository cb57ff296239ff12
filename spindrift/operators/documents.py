"""Index documents: build, upsert, delete, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import labelled_item_text


def build_documents(items: DataFrame) -> DataFrame:
    """Catalogue rows as index documents: text id, genre list, renamed fields, defaults, combined text."""
    have = set(items.columns)

    def field(*names: str, default: object = None, kind: str = "string") -> Column:
        found = [F.col(n).cast(kind) for n in names if n in have]
        return F.coalesce(*found, F.lit(default).cast(kind))

    genre_type = dict(items.dtypes).get("genre", "string")
    genre = F.col("genre") if genre_type.startswith("array") else F.array(field("genre", default=""))
    names = "array<string>"
    cast = field("cast", "keywords", kind=names)
    docs = items.select(
        field("id", "item_id").alias("id"),
        field("title", default="").alias("title"),
        field("description", default="").alias("description"),
        field("category", default="").alias("category"),
        genre.alias("genre"),
        field("release_year", "year", kind="int").alias("release_year"),
        field("rating", default=0.0, kind="double").alias("rating"),
        field("duration_minutes", "duration", default=0, kind="int").alias("duration_minutes"),
        F.coalesce(cast, F.array().cast(names)).alias("cast"),
        field("director", default="").alias("director"),
        field("popularity_score", "popularity", default=0.0, kind="double").alias("popularity_score"),
    )
    return docs.withColumn(
        "combined_features",
        labelled_item_text(*[F.col(c) for c in ("title", "description", "genre", "category", "cast", "director")]),
    )


def upsert_documents(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old rows of the same key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def delete_documents(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_anti")


def table_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("document_count"))
