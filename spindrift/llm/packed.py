"""Documents dealt to slots, and the packed questions that slots ask of hash buckets.

A slot is a share of the documents small enough for one group. It asks each bucket about its distinct hashes in one
binary row and gets back one binary row in the same order, so that a value repeated within a slot crosses the network
once and a value that a third of all documents hold reaches its bucket once for each slot. The documents are shuffled
to slots once; all passes over them read that exchange again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .graph import bucket_count, bucket_cuts

LATE = np.iinfo(np.int64).max

QUESTION = "slot int, bucket int, payload binary"


def slotted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(slot, doc_id, text, turn, rest): rows of one id share a slot; rows without an id are spread by their text.

    ``turn`` orders the rows without an id, by a hash of their text; ``rest`` holds all other columns.
    """
    names = docs.columns
    other = [i for i, name in enumerate(names) if name not in (doc_id, text)]
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    core = {"doc_id": F.col(f"_c{names.index(doc_id)}").cast("long"), "text": F.col(f"_c{names.index(text)}")}
    rest = F.struct(*[F.col(f"_c{i}") for i in other]) if other else F.lit(None).cast("int")
    turn = F.when(core["doc_id"].isNull(), F.xxhash64(core["text"])).otherwise(F.lit(0))
    slot = F.pmod(F.xxhash64(F.coalesce(core["doc_id"], turn)), F.lit(bucket_count(docs))).cast("int")
    return plain.select(slot.alias("slot"), core["doc_id"].alias("doc_id"), core["text"].alias("text"), turn.alias("turn"), rest.alias("rest"))


def with_made(rows: DataFrame, made: str) -> StructType:
    """The schema of a last pass: what it hands back of the slotted rows, and the columns that it makes."""
    kept = [StructField(c, rows.schema[c].dataType) for c in ("doc_id", "text", "rest")]
    return StructType(kept + StructType.fromDDL(made).fields)


def unslotted(result: DataFrame, docs: DataFrame, doc_id: str, text: str, *made: str) -> DataFrame:
    """Undo :func:`slotted`: the columns of ``docs`` as they were, then those that the passes made."""
    names = docs.columns
    back = []
    for i, name in enumerate(names):
        kind = docs.schema.fields[i].dataType
        first = name in (doc_id, text) and names.index(name) == i
        back.append((F.col("doc_id" if name == doc_id else "text").cast(kind) if first else F.col(f"rest._c{i}")).alias(name))
    return result.select(*back, *[F.col(c) for c in made])


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows of a slot by doc_id, then turn and text, ids first; and for each row the number of its document in the slot."""
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("turn", "ascending"), ("text", "ascending")], null_placement="at_end"))
    doc, turn = document_keys(table)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (turn[1:] != turn[:-1])
    return table, np.cumsum(fresh) - 1


def document_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The order of documents over all slots: (doc_id, turn), rows without an id last."""
    doc = pc.fill_null(table.column("doc_id"), LATE).to_numpy().astype(np.int64)
    return doc, table.column("turn").to_numpy().astype(np.int64)


def pack(slot: int, buckets: int, h: np.ndarray, *arrays: np.ndarray) -> pa.Table:
    """Questions of a slot: for ascending ``h``, the slices of h and of the arrays beside it, by bucket."""
    cuts, _ = bucket_cuts(h, buckets)
    used = np.flatnonzero(np.diff(cuts))
    data = [b"".join(x[cuts[i] : cuts[i + 1]].tobytes() for x in (h, *arrays)) for i in used]
    return pa.table({"slot": pa.array(np.full(len(used), slot), pa.int32()), "bucket": pa.array(used, pa.int32()), "payload": pa.array(data, pa.binary())})


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of one question or reply, all of the same length."""
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def unpack_all(table: pa.Table, *kinds: type) -> tuple[list[np.ndarray], np.ndarray]:
    """All questions of a bucket joined, and the ends of the single questions."""
    parts = [unpack(x, *kinds) for x in table.column("payload").to_pylist()]
    return [np.concatenate(x) for x in zip(*parts, strict=True)], np.cumsum([len(p[0]) for p in parts])


def answer(table: pa.Table, flags: np.ndarray, ends: np.ndarray, stage: int) -> pa.Table:
    """Replies: for each question, one bit for each hash asked, in the order asked."""
    bits = [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])]
    return pa.table({"slot": table.column("slot"), "bucket": table.column("bucket"), "stage": pa.array(np.full(len(bits), stage), pa.int32()), "payload": pa.array(bits, pa.binary())})


REPLY = "slot int, bucket int, stage int, payload binary"


def replies_of(replies: pa.Table, stage: int) -> dict[int, bytes]:
    """Payload by bucket of the replies of one stage."""
    return {b: p for b, s, p in zip(*(replies.column(c).to_pylist() for c in ("bucket", "stage", "payload")), strict=True) if s == stage}


def flags_for(h: np.ndarray, buckets: int, replies: dict[int, bytes]) -> np.ndarray:
    """The bits that buckets sent back, for ascending ``h`` as it was asked."""
    cuts, _ = bucket_cuts(h, buckets)
    out = np.zeros(len(h), bool)
    for i in np.flatnonzero(np.diff(cuts)):
        out[cuts[i] : cuts[i + 1]] = np.unpackbits(np.frombuffer(replies[i], np.uint8), count=int(cuts[i + 1] - cuts[i])).astype(bool)
    return out


def in_several(table: pa.Table, stage: int) -> pa.Table:
    """Bucket side of the first question: is a hash held by several slots, or marked as repeated by one?"""
    (h, twice), ends = unpack_all(table, np.uint64, bool)
    values, index, counts = np.unique(h, return_inverse=True, return_counts=True)
    several = counts > 1
    several |= np.bincount(index, twice, len(values)) > 0
    return answer(table, several[index], ends, stage)
