"""The feature build: ingest to saved feature tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, features
from ..session import cut_lineage
from ..sources import readers, sinks


def build_features(
    interactions: DataFrame, content: DataFrame, min_interactions: int = 5, trending_days: int = 7
) -> dict[str, DataFrame]:
    """Cleaned interactions, user and item features, rating matrix and trending items.

    Cleaned interactions feed every other table, so they are written once and
    read back instead of being recomputed per output.
    """
    parsed = cleaning.k_core_filter(cleaning.clean_interactions(interactions), min_interactions)
    cleaned = cut_lineage(parsed)
    items = cut_lineage(cleaning.content_features(cleaning.clean_content(content)))
    return {
        "interactions": cleaning.temporal_features(cleaned),
        "user_features": features.user_features(cleaned, items),
        "item_features": features.item_features(cleaned, items),
        "interaction_matrix": features.interaction_matrix(cleaned),
        "trending": features.trending_with_metadata(features.trending_items(cleaned, trending_days), items),
    }


def run_build(
    spark: SparkSession, paths: Mapping[str, str], out: str, partition_by: str = "rating_date", **options: int
) -> dict[str, DataFrame]:
    """Ingest, build, save. ``paths`` must name readable interactions and content.

    ``partition_by`` is rating_date, or rating_month where days are too small to
    be worth a directory.
    """
    raw = readers.ingest(spark, paths)
    missing = {"interactions", "content"} - set(raw)
    if missing:
        raise ValueError(f"missing required sources: {sorted(missing)}")
    tables = build_features(
        raw["interactions"].drop("ingestion_timestamp", "source_file"),
        raw["content"].drop("ingestion_timestamp", "source_file"),
        **options,
    )
    tables["interactions"] = tables["interactions"].withColumn("rating_month", F.date_format("rating_date", "yyyy-MM"))
    sinks.write_processed(tables, out, {"interactions": partition_by})
    return tables


def summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of the built tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
