"""The bucketed document store."""

import glob

import pytest
from pyspark.errors import AnalysisException

from spindrift.operators.store import DocumentStore

SCHEMA = "id string, title string"


@pytest.fixture
def held(spark, tmp_path):
    store = DocumentStore(str(tmp_path / "s"), buckets=8)
    store.create(spark.createDataFrame([(f"d{i}", f"t{i}") for i in range(200)], SCHEMA))
    return store


def rows(store, spark, version=None):
    return {r.id: r.title for r in store.read(spark, version).select("id", "title").collect()}


def files(store, spark):
    _, folders, _ = store.manifest(spark)
    return {b: sorted(glob.glob(f"{store.path}/{f}/*.parquet")) for b, f in folders.items()}


def test_merge_rewrites_touched_buckets_only(spark, held):
    before = files(held, spark)
    touched = held.merge(spark.createDataFrame([("d3", "new"), ("x", "added")], SCHEMA), spark.createDataFrame([("d5",), ("nowhere",)], "id string"))
    after = files(held, spark)
    assert 1 <= len(touched) <= 4 and all(before[b] == after[b] for b in before if b not in touched)
    assert all(before[b] != after[b] for b in touched)
    want = {f"d{i}": f"t{i}" for i in range(200) if i != 5} | {"d3": "new", "x": "added"}
    assert rows(held, spark) == want
    # The version before is still there, and so are its files.
    assert rows(held, spark, 0) == {f"d{i}": f"t{i}" for i in range(200)} and held.versions(spark) == [0, 1]


def test_replayed_batch_changes_nothing(spark, held):
    change = spark.createDataFrame([("d1", "a")], SCHEMA)
    held.merge(change, batch="one")
    held.merge(spark.createDataFrame([("d1", "b")], SCHEMA), batch="two")
    before = files(held, spark)
    assert held.merge(change, batch="one") == [] and files(held, spark) == before and rows(held, spark)["d1"] == "b"


def test_files_are_sorted_and_keys_unique(spark, held):
    held.merge(spark.createDataFrame([("d9", "a"), ("d9", "a")], SCHEMA))
    for paths in files(held, spark).values():
        for path in paths:
            ids = [r.id for r in spark.read.parquet(path).collect()]
            assert ids == sorted(set(ids))


def test_bucket_may_become_empty_and_one_writer_wins(spark, held):
    everything = held.read(spark).select("id")
    held.merge(spark.createDataFrame([], SCHEMA), everything.filter("id <> 'd0'"))
    assert rows(held, spark) == {"d0": "t0"}
    version, folders, batches = held.manifest(spark)
    with pytest.raises(AnalysisException):
        held._commit(spark, version, folders, batches)
    held.merge(spark.createDataFrame([("d7", "again")], SCHEMA))
    assert rows(held, spark) == {"d0": "t0", "d7": "again"}
