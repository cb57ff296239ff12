"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spindrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster the launcher sets ``spark.sql.shuffle.partitions`` and the
    memory sizes; adaptive execution then coalesces and splits partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where
    that is unset (a local test run) does a temporary folder stand in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = os.path.join(tempfile.mkdtemp(prefix="spindrift-"), "checkpoint")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's setting by which the shuffle files of a query are removed at its end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, fold: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike a local checkpoint the result outlives the executors that made it. A table of short rows may ``fold`` so
    many shuffle partitions into one file, as each file costs more than its rows; two tasks for each core stay. A table
    that is read by parts is written ``by`` the columns that name them. Nothing reads the shuffles of a written table
    again, so their files go at once instead of when the driver's memory is next collected.
    """
    spark = df.sparkSession
    if fold > 1:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(-(-partitions // fold), min(partitions, 2 * spark.sparkContext.defaultParallelism)))
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANED, before) if before is not None else spark.conf.unset(CLEANED)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Remove the table that ``cut_lineage`` returned, once what was made of it is written and nothing else reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
