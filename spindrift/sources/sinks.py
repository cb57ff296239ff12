"""Sinks: processed tables, single files by suffix, flat and nested exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_processed(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, str] | None = None) -> None:
    """Overwrite one parquet table per data set.

    Partition columns should be dates: a directory per user would mean millions
    of tiny files. The rebalance hint gathers each partition value into few
    files, while adaptive execution splits a value that holds too many rows.
    """
    for name, df in tables.items():
        key = (partition_by or {}).get(name)
        if key:
            df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_single(df: DataFrame, path: str) -> None:
    """Parquet or CSV (with header), chosen by suffix."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported file format: {path}")


def flatten_nested(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text; other columns as they are."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def export_flat(df: DataFrame, path: str) -> None:
    """CSV or parquet with nested columns as JSON text; JSON keeps them nested."""
    if path.endswith(".json"):
        df.write.mode("overwrite").json(path)
    else:
        write_single(flatten_nested(df), path)


def write_metrics_snapshot(metrics: DataFrame, path: str) -> None:
    """Append one run of metrics as JSON under its run date."""
    metrics.withColumn("run_date", F.current_date()).write.mode("append").partitionBy("run_date").json(path)


def bi_tables(snapshots: DataFrame) -> dict[str, DataFrame]:
    """Metric families of nested snapshots as long rows.

    ``snapshots``: timestamp, scalar columns, ``by_algorithm`` and ``by_type``
    (maps name -> count).
    """
    maps = ("by_algorithm", "by_type")
    scalars = [c for c in snapshots.columns if c not in maps]
    return {
        "performance": snapshots.select(*scalars),
        "algorithms": snapshots.select("timestamp", F.explode("by_algorithm").alias("algorithm", "count")),
        "types": snapshots.select("timestamp", F.explode("by_type").alias("type", "count")),
    }


def export_bi_tables(snapshots: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per metric family in CSV or JSON."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported export format: {fmt}")
    for name, df in bi_tables(snapshots).items():
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{path}/{name}") if fmt == "csv" else writer.json(f"{path}/{name}")


def export_facets(documents: DataFrame, path: str) -> None:
    """Nested facet documents as JSON."""
    documents.write.mode("overwrite").json(path)
