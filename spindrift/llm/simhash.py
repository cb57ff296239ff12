"""Near duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints come from one pass over the texts. Distinct fingerprints are cut into segments; two fingerprints within
the wanted distance agree in one segment up to one bit, so each is stored under its own segment values and looked up
under all values one bit away. Matches are verified on the whole fingerprint inside the bucket, which hands on a
spanning forest instead of pairs, and components are joined by star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut_lineage

from .buffers import mix, slices, take, text_bytes, trimmed, unsigned, word_spans
from .graph import bucket_count, bucket_cuts, by_group, components, local_components

#: Candidate pairs verified at once inside a bucket.
PAIRS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For each byte value its eight bits, one in each byte of a 64-bit lane vector.
_LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], dtype=np.uint64)


def majority_bits(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each range of hashes, the 64-bit value whose bits are set in over half of them. Empty ranges give zero."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    counts = np.diff(offsets)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    first = np.cumsum(pieces) - pieces
    heads = np.repeat(offsets[:-1][full] - 255 * first, pieces) + 255 * np.arange(int(pieces.sum()))
    for k in range(8):
        lanes = np.add.reduceat(_LANES[(h >> np.uint64(8 * k)) & np.uint64(255)], heads).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        bits = (2 * ones > counts[full][:, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
        out[full] |= bits.sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def text_fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text over its word shingles; see :func:`fingerprints`."""
    body, offsets = text_bytes(column)
    body = _LOWER[body]
    starts, ends, firsts = word_spans(body, offsets)
    sizes = ends - starts
    places = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    heads = np.cumsum(sizes) - sizes
    inner = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    joined[inner + np.repeat(places, sizes)] = body[inner + np.repeat(starts, sizes)]
    words = np.diff(firsts)
    counts = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    begin = np.repeat(firsts[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    last = begin + np.repeat(np.minimum(words, shingle), counts) - 1
    data = joined.tobytes()
    spans = zip(places[begin].tolist(), (places + sizes)[last].tolist(), strict=True)
    h = np.fromiter(map(xxhash.xxh64_intdigest, (data[s:e] for s, e in spans), repeat(42)), np.uint64, len(begin))
    return majority_bits(h, np.concatenate([[0], np.cumsum(counts)]))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, hashed: bool = False) -> DataFrame:
    """(doc_id, fp): the SimHash of each row's text as a long; with ``hashed`` also ``hash``, XXH64 of the text.

    Texts are lower-cased (A-Z), cut at ASCII white space, and shingled by ``shingle`` words, repeats included; a text
    of fewer words is one shingle, a text without words or null has fingerprint zero. A shingle hashes by XXH64 with
    seed 42 over its words joined by single spaces.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = text_fingerprints(batch.column(1), shingle).view(np.int64)
            more = [batch.column(2)] if hashed else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *more], ["doc_id", "fp", "hash"][: 2 + len(more)])

    plain = take(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    if hashed:
        plain = plain.withColumn("hash", F.xxhash64("text"))
    return plain.mapInArrow(trimmed(work), "doc_id long, fp long" + ", hash long" * hashed)


def _deal(batches: Iterable[pa.RecordBatch], buckets: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Segment entries of each fingerprint, packed by bucket: its own value, and each value with one more bit set."""
    cuts = np.linspace(0, 64, segments + 1).astype(int)
    for batch in batches:
        fps = unsigned(batch.column(0).to_numpy(zero_copy_only=False))
        keys, values, homes = [], [], []
        for s in range(segments):
            width = int(cuts[s + 1] - cuts[s])
            part = (fps >> np.uint64(cuts[s])) & np.uint64((1 << width) - 1)
            for bit in [None, *range(width)]:
                flip = np.uint64(0 if bit is None else 1 << bit)
                use = (part & flip) == 0
                keys.append(mix((part[use] | flip) * np.uint64(segments) + np.uint64(s)))
                values.append(fps[use])
                homes.append(np.full(int(use.sum()), bit is None))
        key, fp, home = np.concatenate(keys), np.concatenate(values), np.concatenate(homes)
        order = np.argsort(key)
        key, fp, home = key[order], fp[order], home[order]
        at, _ = bucket_cuts(key, buckets)
        used = np.flatnonzero(np.diff(at))
        pack = [np.uint64([at[i + 1] - at[i]]).tobytes() + key[at[i] : at[i + 1]].tobytes() + fp[at[i] : at[i + 1]].tobytes() + home[at[i] : at[i + 1]].tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(pack, pa.binary())], ["bucket", "payload"])


def _links(table: pa.Table, max_bits: int) -> pa.Table:
    """A spanning forest of all verified links inside one bucket."""
    keys, values, homes = [], [], []
    for data in table.column("payload").to_pylist():
        n = int(np.frombuffer(data, np.uint64, 1)[0])
        keys.append(np.frombuffer(data, np.uint64, n, 8))
        values.append(np.frombuffer(data, np.uint64, n, 8 + 8 * n))
        homes.append(np.frombuffer(data, bool, n, 8 + 16 * n))
    key, fp, home = np.concatenate(keys), np.concatenate(values), np.concatenate(homes)
    order = np.lexsort((fp, ~home, key))
    key, fp, home = key[order], fp[order], home[order]
    nodes, index = np.unique(fp, return_inverse=True)
    ends = np.searchsorted(key, key, "right")
    partners = np.where(home, ends - np.arange(len(key)) - 1, 0)
    rows = np.flatnonzero(partners)
    label = np.arange(len(nodes))
    total = np.cumsum(partners[rows])
    first = 0
    while first < len(rows):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        # One entry with more partners than a chunk holds is cut too.
        for low in range(0, int(partners[rows[first]]) if last == first + 1 else 1, PAIRS):
            n = np.minimum(partners[rows[first:last]] - low, PAIRS) if last == first + 1 else partners[rows[first:last]]
            left = np.repeat(rows[first:last], n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + left + 1 + low
            close = np.bitwise_count(fp[left] ^ fp[right]) <= max_bits
            label = local_components(label[index[left[close]]], label[index[right[close]]], len(nodes))[label]
        first = last
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"a": nodes[label[moved]].view(np.int64), "b": nodes[moved].view(np.int64)})


def fingerprint_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints that differ in at most ``max_bits`` bits.

    ``fps`` has one long column of distinct fingerprints. ``max_bits // 2 + 1`` segments make sure that a pair agrees
    in one segment up to one bit.
    """
    buckets, segments = bucket_count(fps), max_bits // 2 + 1
    dealt = fps.mapInArrow(trimmed(lambda batches: _deal(batches, buckets, segments)), "bucket int, payload binary")
    return by_group(dealt, "bucket", lambda table: _links(table, max_bits), "a long, b long").distinct()


def _groups(classes: DataFrame, max_bits: int) -> DataFrame:
    """``classes``, one row for each fingerprint, with the component of each."""
    linked = components(fingerprint_links(classes.select("fp"), max_bits))
    return classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: near-duplicate groups over linked fingerprints.

    ``component_id`` is the smallest doc_id of the group. Rows without a doc_id belong to their group but never name
    it: a group of such rows alone has a null component_id. Repeated rows fall in one group; an empty table gives none.
    """
    rows = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    named = _groups(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), max_bits)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each near-duplicate group, the one with the smallest doc_id.

    Among several of that id, or in a group without any id, the text with the smallest hash stays, once. Texts of one
    id that are in different groups are different documents.
    """
    rows = cut_lineage(fingerprints(docs, doc_id, text, hashed=True))
    named = _groups(rows.select("fp").distinct(), max_bits)
    choice = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash")
    best = rows.join(named, "fp").groupBy("component").agg(F.min(choice).alias("best"))
    found = best.select(F.col("best.doc_id").alias("_id"), F.col("best.hash").alias("_hash")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    id_, body = f"_c{names.index(doc_id)}", f"_c{names.index(text)}"
    plain = plain.withColumns({"_key": F.col(id_).cast("long"), "_text": F.xxhash64(body)})
    kept = plain.join(found, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_key", "_text"]).drop("_key", "_text").toDF(*names)
