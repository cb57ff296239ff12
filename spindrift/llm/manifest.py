"""A Merkle manifest of a dataset: leaf and root digests, inclusion proofs and their check.

Every row is a leaf, every source a tree over its leaves in order of id, and the trees' roots are the leaves of one more
tree. Trees are cut into superblocks of some levels. On the way up a superblock becomes one node of the next tier, so few
rounds reach the roots. On the way down each superblock is cogrouped with the one outer node that it became, which
carries its path to the root; one pass then finishes the local reduction, joins the proofs and folds the claimed leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.session import cut_lineage

from .buffers import take
from .graph import bucket_count

#: Characters of a digest.
HEX = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row: of its framed values, one after the other."""
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def fold(digest: str, path: str, proof: str) -> str:
    """The root that a leaf leads to: ``path`` is ``place/size`` of the run at each level, ``proof`` the siblings' digests."""
    at = 0
    for step in path.split(",") if path else ():
        place, size = (int(x) for x in step.split("/"))
        width = HEX * (size - 1)
        beside = proof[at : at + width]
        digest = sha256_hex(beside[: HEX * place] + digest + beside[HEX * place :])
        at += width
    return digest


def reduce_runs(digests: list[str], fan: int, levels: int) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """Reduce ``levels`` times: for each level the (step, siblings) of its nodes, and the nodes that remain."""
    beside = []
    for _ in range(levels):
        runs = [digests[i : i + fan] for i in range(0, len(digests), fan)]
        beside.append([(f"{k}/{len(run)}", "".join(run[:k] + run[k + 1 :])) for run in runs for k in range(len(run))])
        digests = [sha256_hex("".join(run)) for run in runs]
    return beside, digests


def _height(n: Column, fan: int) -> Column:
    """Levels until one of ``n`` nodes remains; ``n`` fits 63 bits."""
    bounds, bound = [], 1
    while bound < 1 << 62:
        bounds.append(bound)
        bound *= fan
    return sum((F.when(n > b, 1).otherwise(0) for b in bounds), F.lit(0))


def ranked(rows: DataFrame, fan: int, *order: str) -> DataFrame:
    """``rows`` with ``rank``, the place inside their ``tree``, and ``height``, the levels of that tree.

    Rows are sorted by range, so a tree of any size is spread over tasks; only one row for each tree and task is summed.
    """
    written = cut_lineage(
        rows.repartitionByRange(bucket_count(rows), "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33).alias("part")
    parts = written.groupBy("tree", part).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("tree"))
    starts = parts.select("tree", "part", (before - F.col("low")).alias("shift"), _height(total, fan).alias("height"))
    placed = written.withColumn("part", part).join(starts, ["tree", "part"])
    return placed.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


NODE = "tree string, rank long, height int, digest string"

OUTER = "tree string, rank long, path string, proof string, subroot string, root string"


def _tier_up(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """Each superblock becomes one node of the next tier."""

    def work(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        height = int(block["height"].iloc[0])
        _, top = reduce_runs(block["digest"].tolist(), fan, min(levels, height))
        return pd.DataFrame({"tree": [key[0]], "rank": [key[1]], "height": [max(height - levels, 0)], "digest": top})

    block = F.floor(F.col("rank") / F.lit(fan**levels)).cast("long").alias("block")
    return cut_lineage(nodes.select("tree", "rank", "height", "digest", block).groupBy("tree", "block").applyInPandas(work, NODE))


def _tier_down(nodes: DataFrame, outer: DataFrame, fan: int, levels: int, leaves: bool) -> DataFrame:
    """Superblocks cogrouped with their outer nodes: path and proof of every node, folded roots for leaves."""
    kept = ["id", "claimed"] if leaves else []

    def work(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rank")
        height = int(block["height"].iloc[0])
        beside, _ = reduce_runs(block["digest"].tolist(), fan, min(levels, height))
        up = above.iloc[0]
        path, proof = [], []
        for i in range(len(block)):
            near = [level[i // fan**k] for k, level in enumerate(beside)]
            path.append(",".join([s for s, _ in near] + ([up["path"]] if up["path"] else [])))
            proof.append("".join([p for _, p in near] + [up["proof"]]))
        made = {"tree": block["tree"], "rank": block["rank"], "path": path, "proof": proof, "subroot": up["subroot"], "root": up["root"]}
        if leaves:
            made |= {"id": block["id"], "leaf": block["digest"], "claimed": block["claimed"], "folded_root": [fold(*x) for x in zip(block["claimed"], path, proof, strict=True)]}
        return pd.DataFrame(made)

    block = F.floor(F.col("rank") / F.lit(fan**levels)).cast("long").alias("block")
    below = nodes.select("tree", "rank", "height", "digest", *kept, block).groupBy("tree", "block")
    schema = OUTER + (", id long, leaf string, claimed string, folded_root string" if leaves else "")
    return below.cogroup(outer.withColumnRenamed("rank", "block").groupBy("tree", "block")).applyInPandas(work, schema)


def _tiers(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """The nodes of every tier, from the given ones to one node for each tree."""
    tiers = [nodes]
    left = nodes.agg(F.max("height")).first()[0] or 0
    while left > 0:
        tiers.append(_tier_up(tiers[-1], fan, levels))
        left -= levels
    return tiers


def merkle_manifest(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    claims: Callable[[dict[str, Column]], dict[str, Column]] | None = None,
    fan: int = 16,
    levels: int = 3,
) -> DataFrame:
    """(id, leaf, subroot, root, path, proof, claimed, folded_root) for every row of ``docs``.

    A leaf is the digest of the framed ``columns``. Per source, leaves ascend by id; while several nodes remain, every
    ``fan`` consecutive ones become the digest of their joined digests. The source roots, ordered by source as UTF-8
    bytes with null first, lead to ``root`` in the same way. ``path`` and ``proof`` are what :func:`fold` needs.
    ``claims`` gets the columns by name and returns other expressions for some; the digest of such a row is ``claimed``,
    and ``folded_root`` the root that it leads to with the original siblings: a changed row misses ``root``.

    Rows without an id come first in their source; rows of one id are ordered by their leaf, repeated rows are leaves
    each. Texts of any length are digested where they are read and never shuffled. An empty table gives no rows.
    """
    plain = take(docs, **{f"v{i}": c for i, c in enumerate(columns)}, id_=doc_id, source_=source)
    values = [F.col(f"v{i}") for i in range(len(columns))]
    named = dict(zip(columns, values, strict=True))
    told = (named | (claims(named) if claims else {})).values()
    tree = F.when(F.col("source_").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source_").cast("string")))
    leaves = plain.select(tree.alias("tree"), F.col("id_").cast("long").alias("id"), leaf(*values).alias("digest"), leaf(*told).alias("claimed"))
    nodes = cut_lineage(ranked(leaves, fan, "id", "digest"))
    tiers = _tiers(nodes, fan, levels)
    roots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    summit = cut_lineage(ranked(roots, fan, "source"))
    top = _tiers(summit, fan, levels)
    outer = top[-1].select("tree", "rank", F.lit("").alias("path"), F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for tier in reversed(top[:-1]):
        outer = _tier_down(tier, outer, fan, levels, False)
    found = summit.join(outer.drop("tree"), "rank")
    outer = found.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", "proof", F.col("digest").alias("subroot"), "root")
    for tier in reversed(tiers[1:-1]):
        outer = _tier_down(tier, outer, fan, levels, False)
    return _tier_down(nodes, outer, fan, levels, True).select("id", "leaf", "subroot", "root", "path", "proof", "claimed", "folded_root")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)
