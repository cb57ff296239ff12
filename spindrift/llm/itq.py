"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and reranking.

A rotation learnt on a bounded sample turns vectors into balanced binary codes. Each distinct code is stored under all
values one bit away from each of its four segments, so two codes meet in a table if a segment differs in at most two
bits. Codes that meet and are close form a tile; the tile's original vectors are then compared exactly, block by block,
and the tile hands on link counts and a spanning forest, not pairs. A pair that meets in several tiles counts in the
first table, at the smallest common value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut_lineage

from .buffers import mix, take
from .graph import bucket_count, bucket_cuts, components, local_components

SEGMENTS = 4

#: Vectors on each side of one comparison; larger tiles are cut into pairs of chunks.
TILE = 2048

#: Rows of the product matrix held at once.
STRIP = 512


class Quantiser:
    """Codes of unit vectors: the signs of rotated principal components.

    The components are those of the second moments, without a mean taken off, so that signs follow angles also where
    most vectors point one way.
    """

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 50, seed: int = 5):
        self.size = sample.shape[1]
        self.bits = min(bits, self.size)
        _, vectors = np.linalg.eigh(sample.T @ sample)
        basis = vectors[:, ::-1][:, : self.bits]
        flat = sample @ basis
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            # Nearest corners for the rotation, then the rotation that moves the points nearest to them.
            corners = np.where(flat @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(flat.T @ corners)
            rotation = left @ right
        self.turn = basis @ rotation

    def codes(self, unit: np.ndarray) -> np.ndarray:
        if unit.shape[1] != self.size:
            fitted = np.zeros((len(unit), self.size))
            fitted[:, : min(self.size, unit.shape[1])] = unit[:, : self.size]
            unit = fitted
        signs = (unit @ self.turn >= 0).astype(np.uint64)
        return (signs << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _segments(codes: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """The value of each segment and its width."""
    cuts = np.linspace(0, bits, SEGMENTS + 1).astype(int)
    return [((codes >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value within one bit of both segment values that differ in at most two bits."""
    differ = a ^ b
    low = differ & (~differ + np.uint64(1))
    # Both bits differ: the middle values are a with one or the other bit changed.
    middle = np.minimum(a ^ low, a ^ (differ ^ low))
    return np.where(np.bitwise_count(differ) == 2, middle, np.minimum(a, b))


def _owned(a: np.ndarray, b: np.ndarray, bits: int, table: int, value: int) -> np.ndarray:
    """Do two codes meet first in this table, at this value?"""
    parts = list(zip(_segments(a, bits), _segments(b, bits), strict=True))
    mine = np.ones(np.broadcast_shapes(a.shape, b.shape), bool)
    for (x, _), (y, _) in parts[:table]:
        mine &= np.bitwise_count(x ^ y) > 2
    x, y = parts[table][0][0], parts[table][1][0]
    return mine & (np.bitwise_count(x ^ y) <= 2) & (_meeting(x, y) == np.uint64(value))


def _deal(batches: Iterable[pa.RecordBatch], buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Table entries of each distinct code, packed by bucket."""
    for batch in batches:
        cell, group, code = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)).view(np.uint64) for i in range(3))
        keys, tables, values = [], [], []
        for table, (part, width) in enumerate(_segments(code, bits)):
            for flip in [0, *(1 << j for j in range(width))]:
                value = part ^ np.uint64(flip)
                keys.append(mix(mix(group + np.uint64(table)) + value))
                tables.append(np.full(len(code), table, np.uint8))
                values.append(value)
        key, table, value = np.concatenate(keys), np.concatenate(tables), np.concatenate(values)
        times = len(key) // max(1, len(code))
        cells, codes = np.tile(cell, times), np.tile(code, times)
        order = np.argsort(key)
        arrays = [x[order] for x in (key, cells, codes, value, table)]
        cuts, _ = bucket_cuts(arrays[0], buckets)
        used = np.flatnonzero(np.diff(cuts))
        data = [b"".join(x[cuts[i] : cuts[i + 1]].tobytes() for x in arrays) for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(data, pa.binary())], ["bucket", "payload"])


def _close_codes(table: pa.Table, bits: int, most: int) -> pa.Table:
    """(tile, seg, value, cell) for every code that meets a close one in a table entry of this bucket."""
    parts = []
    for data in table.column("payload").to_pylist():
        n, at, part = len(data) // 33, 0, []
        for kind in (np.uint64, np.uint64, np.uint64, np.uint64, np.uint8):
            part.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts.append(part)
    key, cell, code, value, seg = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((cell, key))
    key, cell, code, value, seg = key[order], cell[order], code[order], value[order], seg[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    key, cell, code, value, seg = key[fresh], cell[fresh], code[fresh], value[fresh], seg[fresh]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.concatenate([heads[1:], [len(key)]])
    out = []
    for a, b in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist(), strict=True):
        own = code[a:b]
        met = np.zeros(b - a, bool)
        for low in range(0, b - a, STRIP):
            left = own[low : low + STRIP, None]
            close = (np.bitwise_count(left ^ own[None, :]) <= most) & (left != own[None, :])
            if close.any():
                i, j = np.nonzero(close)
                fits = _owned(own[low + i], own[j], bits, int(seg[a]), int(value[a]))
                met[low + i[fits]] = met[j[fits]] = True
        if met.any():
            k = int(met.sum())
            out.append((np.full(k, key[a]), np.full(k, seg[a]), np.full(k, value[a]), cell[a:b][met]))
    tile, seg, value, cell = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) * 4
    return pa.table({"tile": tile.view(np.int64), "seg": pa.array(seg, pa.int32()), "value": value.astype(np.uint64).view(np.int64), "cell": cell.view(np.int64)})


def _compare(table: pa.Table, bits: int, cosine: float) -> pa.Table:
    """(node, root, links): exact comparison of one chunk pair of a tile."""
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    seg, value = table.column("seg")[0].as_py(), table.column("value")[0].as_py()
    chunk = table.column("chunk").to_numpy()
    unit = np.array(table.column("emb").to_pylist(), np.float64)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    node, weight = table.column("node").to_numpy(), table.column("n").to_numpy()
    code = np.ascontiguousarray(table.column("code").to_numpy()).view(np.uint64)
    left, right = np.flatnonzero(chunk == p), np.flatnonzero(chunk == q)
    links = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    for low in range(0, len(left), STRIP):
        rows = left[low : low + STRIP]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= cosine)
        a, b = rows[i], right[j]
        use = a < b if p == q else a != b
        a, b = a[use], b[use]
        use = code[a] == code[b] if seg < 0 else (code[a] != code[b]) & _owned(code[a], code[b], bits, seg, value)
        a, b = a[use], b[use]
        links += np.bincount(a, weight[b], len(node)).astype(np.int64) + np.bincount(b, weight[a], len(node)).astype(np.int64)
        label = local_components(label[a], label[b], len(node))[label]
    met = np.flatnonzero(links)
    return pa.table({"node": node[met], "root": node[label[met]], "links": links[met]})


def fit(vectors: DataFrame, sample: int, bits: int) -> Quantiser | None:
    """The quantiser of at most ``sample`` vectors, chosen by a hash of their values; None without vectors."""
    drawn = vectors.orderBy("h1", "h2").limit(sample).select("emb").toArrow().column(0).to_pylist()
    if not drawn:
        return None
    size = max(len(v) for v in drawn)
    units = np.array([v for v in drawn if len(v) == size], float)
    return Quantiser(units / np.linalg.norm(units, axis=1)[:, None], bits)


def near_duplicate_vectors(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, sample: int = 20_000, bits: int = 64
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null, their vectors have the same length and their cosine reaches
    ``cosine`` in double precision. Null, empty and zero vectors, and those with null or non-finite components, link
    with nothing. n_links counts linked rows, repeated rows among them; component_id is the smallest vec_id reachable.
    Rows without a vec_id count as links but never name a component; alone they have a null component_id. Rows with
    equal vectors are one node, whose number is a 64-bit hash of vector and label. The quantiser is fitted on at most
    ``sample`` distinct vectors; every vector is indexed. Pairs whose codes differ in over a quarter of the bits, or
    that differ in three or more bits of every segment, are not retrieved; no linked pair is dropped otherwise.
    """
    plain = take(table, vec_id=vec_id, emb=embedding, label=label)
    emb = F.col("emb").cast("array<double>")
    finite = F.forall(emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("emb").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(emb, lambda x: x != 0)
    keyed = plain.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.xxhash64("label", "emb").alias("h1"),
        F.xxhash64("emb", "label", F.lit(1)).alias("h2"),
        emb.alias("emb"),
        F.xxhash64("label", F.size("emb")).alias("grp"),
    )
    good = keyed.where("usable")
    classes = good.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("emb").alias("emb"), F.first("grp").alias("grp"))
    quantiser = fit(classes, sample, bits)
    links = edges = None
    if quantiser:
        links, edges = _links(classes, quantiser, cosine)
        linked = components(edges)
        nodes = classes.select("h1", "h2", "n", "low").join(links, F.col("h1") == F.col("node"), "left").drop("node")
        nodes = nodes.join(linked, F.col("h1") == F.col("node"), "left").drop("node")
        nodes = nodes.withColumn("component", F.coalesce("component", "h1"))
        named = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
        found = nodes.join(named, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        joined = good.select("vec_id", "h1", "h2").join(found, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    else:
        joined = good.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = keyed.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, quantiser: Quantiser, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and edges (a, b) over distinct vectors."""
    bits, buckets = quantiser.bits, bucket_count(classes)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("emb"))
            size = np.diff(np.asarray(column.offsets))
            out = np.zeros(batch.num_rows, np.uint64)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                units = column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, n)
                out[rows] = quantiser.codes(units / np.linalg.norm(units, axis=1)[:, None])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], [*batch.schema.names, "code"])

    coded = classes.select(F.col("h1").alias("node"), "n", "grp", "emb").mapInArrow(code, "node long, n long, grp long, emb array<double>, code long")
    coded = cut_lineage(coded.withColumn("cell", F.xxhash64("grp", "code")))
    cells = coded.groupBy("cell", "grp", "code").agg(F.count("*").alias("size"))
    dealt = cells.select("cell", "grp", "code").mapInArrow(lambda batches: _deal(batches, buckets, bits), "bucket int, payload binary")
    met = dealt.groupBy("bucket").applyInArrow(lambda _key, t: _close_codes(t, bits, bits // 4), "tile long, seg int, value long, cell long")
    same = cells.where("size > 1").select(F.col("cell").alias("tile"), F.lit(-1).alias("seg"), F.lit(0).cast("long").alias("value"), "cell")
    members = cut_lineage(met.union(same))
    # A tile of many vectors is cut into chunks, each pair of chunks a task of its own.
    sizes = members.join(cells.select("cell", "size"), "cell").groupBy("tile", "seg").agg(F.ceil(F.sum("size") / TILE).cast("int").alias("chunks"))
    rows = members.join(sizes, ["tile", "seg"]).join(coded.drop("grp"), "cell")
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("p", F.least("chunk", "other")).withColumn("q", F.greatest("chunk", "other")).select("tile", "seg", "value", "p", "q", "chunk", "node", "n", "code", "emb")
    compared = cut_lineage(rows.groupBy("tile", "seg", "p", "q").applyInArrow(lambda _key, t: _compare(t, bits, cosine), "node long, root long, links long"))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    return links, compared.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
