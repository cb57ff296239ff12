"""Packed exchanges between text slots and hash buckets, and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.session import cut_lineage

from .buffers import give_back


#: Shuffle partitions whose edges go to one file.
FOLD = 8


def bucket_count(df: DataFrame) -> int:
    """How many hash buckets to deal to: one for each shuffle partition of the session.

    Slots and buckets follow the partitions that the cluster is set up for, so their size stays bounded as the input
    grows, and a slot sends at most one row to a bucket.
    """
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_cuts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending hashes: the cut points between buckets, dealt by the high bits."""
    step = (1 << 64) // buckets + 1
    edges = np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]), edges


def by_group(df: DataFrame, key: str, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``work`` to all rows of each key."""

    def run(_key: tuple, table: pa.Table) -> pa.Table:
        made = work(table)
        give_back()
        return made

    return df.groupBy(key).applyInArrow(run, schema)


def with_replies(df: DataFrame, replies: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """Apply ``work`` to the rows of each slot together with the packed replies for that slot."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        made = work(table, replies)
        give_back()
        return made

    return df.groupBy("slot").cogroup(replies.groupBy("slot")).applyInArrow(run, schema)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        if not len(a):
            break
        np.minimum.at(label, high, low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    ``edges`` has long columns ``a`` and ``b``; nodes without an edge are not returned. Alternates two star
    operations: link all larger neighbours of a node to its smallest neighbour, then all smaller neighbours.
    Each round is one written table, so a lost executor costs one round, and the number of rounds grows with
    the logarithm of the longest path. Only the number of edges and a checksum reach the driver.
    """
    directed = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links, before = cut_lineage(directed, FOLD), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        links = cut_lineage(small, FOLD)
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == before:
            break
        before = (state.n, state.x)
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
