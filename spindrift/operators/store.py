"""A document table that is changed by buckets: documents lie bucketed and sorted by id, a manifest names the files in force.

A merge reads and writes only the buckets that its ids fall in; all other files stay in force under their names. It is
committed by a new manifest, so readers see the old state or the new one, and what a failed merge left behind is never
read. One writer at a time is assumed; a second one fails when it tries to write the same version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, folder string, batch string"


@dataclass(frozen=True)
class DocumentStore:
    """Where the table lies, its key and its number of buckets, which never changes."""

    path: str
    key: str = "id"
    buckets: int = 64

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession) -> list[int]:
        """All committed versions, ascending."""
        return sorted(r[0] for r in self._manifests(spark).select("version").distinct().collect())

    def _manifests(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MANIFEST + ", version int").json(f"{self.path}/manifests")

    def manifest(self, spark: SparkSession, version: int | None = None) -> tuple[int, dict[int, str], set[str]]:
        """(version, folder of every bucket, merged batches); there is one row for each bucket and batch."""
        version = self.versions(spark)[-1] if version is None else version
        rows = self._manifests(spark).filter(F.col("version") == version).collect()
        return version, {r["bucket"]: r["folder"] for r in rows if r["folder"]}, {r["batch"] for r in rows if r["batch"]}

    def _commit(self, spark: SparkSession, version: int, folders: dict[int, str], batches: set[str]) -> None:
        rows = [(b, f, None) for b, f in sorted(folders.items())] + [(None, None, b) for b in sorted(batches)]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{self.path}/manifests/version={version}")

    def _write(self, docs: DataFrame) -> dict[int, str]:
        """New bucket files of a frame that has ``_bucket``; the folder of each bucket that got rows."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = docs.repartition(min(self.buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_bucket")
        dealt.sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        schema = docs.select("_bucket").schema
        written = docs.sparkSession.read.schema(schema).parquet(f"{self.path}/{folder}").distinct().collect()  # buckets at most
        return {r["_bucket"]: f"{folder}/_bucket={r['_bucket']}" for r in written}

    def create(self, docs: DataFrame) -> None:
        """Write the first version; of several rows with one key any one stays."""
        rows = docs.dropDuplicates([self.key]).withColumn("_bucket", self._bucket())
        self._commit(docs.sparkSession, 0, self._write(rows), set())

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The documents of a version, the latest by default."""
        _, folders, _ = self.manifest(spark, version)
        if not folders:
            raise ValueError("the store holds no documents")
        return spark.read.parquet(*[f"{self.path}/{f}" for f in folders.values()])

    def merge(self, upserts: DataFrame, deletes: DataFrame | None = None, batch: str | None = None) -> list[int]:
        """Replace or add ``upserts``, drop the ids of ``deletes``, and commit; returns the buckets that were rewritten.

        A row in both is deleted. A ``batch`` that was merged before changes nothing, so a replay is harmless.
        """
        spark = upserts.sparkSession
        version, folders, batches = self.manifest(spark)
        if batch is not None and batch in batches:
            return []
        new = upserts.dropDuplicates([self.key])
        gone = new.select(self.key)
        if deletes is not None:
            gone = gone.union(deletes.select(self.key))
            new = new.join(deletes.select(self.key).distinct(), self.key, "left_anti").select(*upserts.columns)
        touched = sorted(r[0] for r in gone.select(self._bucket().alias("b")).distinct().collect())  # buckets at most
        old = [f"{self.path}/{folders[b]}" for b in touched if b in folders]
        if old:
            kept = spark.read.schema(self.read(spark).schema).parquet(*old).join(gone.distinct(), self.key, "left_anti")
            new = kept.unionByName(new, allowMissingColumns=True)
        fresh = self._write(new.withColumn("_bucket", self._bucket())) if touched else {}
        left = {b: f for b, f in folders.items() if b not in touched}
        self._commit(spark, version + 1, left | fresh, batches | ({batch} if batch is not None else set()))
        return touched
