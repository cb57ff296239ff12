"""Packing token streams into fixed-length sequences by cutting-stock column generation.

Documents are cut into whole sequences, an aligned rest and a crumb, so that all pieces have one of a few dozen lengths.
The histogram of lengths goes to a linear program over patterns (how many pieces of each length share a sequence): a
knapsack by dynamic programming prices new patterns until none helps. Rounded patterns are dealt to the pieces of each
length by rank, which needs no shuffle of tokens and no pass over a pattern's pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import cut_lineage

from .buffers import slices, take, trimmed
from .tokens import SLICE_BYTES, Encoder


@lru_cache(2)
def library_encoder(path: str) -> Encoder:
    """The encoder over the tokenizers library; one for each worker."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    special = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
    model.encode_special_tokens = True  # the encoder cuts them out itself

    def merge_all(pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in model.encode_batch_fast(pieces, add_special_tokens=False)]

    return Encoder(merge_all, special)


def cut_lengths(total: int, capacity: int, grain: int) -> list[int]:
    """Piece lengths of a document, in order: whole sequences, a multiple of ``grain``, the crumb."""
    whole, rest = divmod(total, capacity)
    crumb = rest % grain
    return [capacity] * whole + [x for x in (rest - crumb, crumb) if x]


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths that fits, as counts."""
    useful = np.flatnonzero(values > 1e-12)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = useful[np.argsort(lengths[useful])]
    size, worth = lengths[order], values[order]
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(size, room, "right"))
        best[room] = best[room - 1]
        if fits:
            total = best[room - size[:fits]] + worth[:fits]
            top = int(np.argmax(total))
            if total[top] > best[room] + 1e-12:
                best[room], choice[room] = total[top], order[top]
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(lengths[choice[room]])
    return float(best[capacity]), counts


def generate_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts) and how often each is used (fractional), covering the demand exactly.

    Revised simplex from one-length patterns; every basis on the way is feasible, so ``rounds`` bounds the time only.
    """
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(basis)) if m else np.zeros((0, 0))
    used = inverse @ demand
    for _ in range(rounds if m else 0):
        dual = np.ones(m) @ inverse
        value, pattern = best_pattern(dual, lengths, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        limit = np.full(m, np.inf)
        np.divide(used, step, out=limit, where=step > 1e-9)
        leave = int(np.argmin(limit))
        if not np.isfinite(limit[leave]):
            break
        basis[:, leave] = pattern
        inverse[leave] /= step[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
        used = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64), used


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences), using up the histogram exactly.

    The linear program's patterns are rounded down; what is left, at most a few sequences for each length, is filled
    largest length first.
    """
    lengths = np.array(sorted((n for n in histogram if n < capacity), reverse=True), np.int64)
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    patterns, used = generate_patterns(lengths, left.astype(float), capacity)
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    for pattern, times in sorted(zip(patterns.tolist(), used.tolist(), strict=True), key=lambda x: -x[1]):
        counts = np.array(pattern)
        room = left[counts > 0] // counts[counts > 0]
        n = min(int(times + 1e-9), int(room.min()) if len(room) else 0)
        if n > 0:
            out.append(({int(a): int(c) for a, c in zip(lengths, counts, strict=True) if c}, n))
            left -= n * counts
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), capacity
        for i, n in enumerate(lengths.tolist()):
            counts[i] = min(int(left[i]), room // n)
            room -= n * int(counts[i])
        n = int((left[counts > 0] // counts[counts > 0]).min())
        out.append(({int(a): int(c) for a, c in zip(lengths, counts, strict=True) if c}, n))
        left -= n * counts
    return out


def cut_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, grain: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, rank, doc_id, start, length, ids_crc32, doc_tokens) of all pieces; rank counts a length within its part.

    ``part`` is the task that made the piece, so the result must be written before ranks are compared.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, offsets = encoder.encode(batch.column(1))
            ids, ends = ids.astype("<u4"), offsets.tolist()
            rows: list[tuple[int, ...]] = []
            tail = np.array([end_id], "<u4").tobytes()
            for row, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                data, start = ids[a:b].tobytes() + tail, 0
                for n in cut_lengths(b - a + 1, capacity, grain):
                    rows.append((row, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), b - a + 1, seen[n]))
                    seen[n] += 1
                    start += n
            row, start, length, crc, total, rank = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part), pa.int32()), rank, batch.column(0).take(row), start, length.cast(pa.int32()), crc, total],
                ["part", "rank", "doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    plain = take(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return plain.mapInArrow(trimmed(work), "part int, rank long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long")


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, its runs of ranks: (first rank, pieces in a sequence, first sequence, first offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            count = pattern[length]
            out.setdefault(length, []).append((taken.get(length, 0), count, sequence, offset))
            taken[length] = taken.get(length, 0) + count * times
            offset += count * length
        sequence += times
    return {n: np.array(runs, np.int64) for n, runs in out.items()}


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, grain: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece and its place.

    A document's ids are those of the tokenizers library for its whole text, without added special tokens, and then
    ``end_id``; a null or empty text has that id alone. Every row of ``docs`` is packed, rows without an id and repeated
    rows too. Pieces of one sequence follow each other without gaps from offset 0. An empty table has no pieces.
    ``grain`` is the alignment of a document's last cut: smaller crumbs for a smaller linear program. At most
    capacity / grain + grain counts reach the driver.
    """
    pieces = cut_lineage(cut_pieces(docs, path, end_id, capacity, grain, doc_id, text))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_patterns(histogram, capacity))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("rank", "length"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own, runs = np.flatnonzero(length == n), places[n]
                run = runs[np.searchsorted(runs[:, 0], rank[own], "right") - 1]
                inside = rank[own] - run[:, 0]
                sequence[own] = run[:, 2] + inside // run[:, 1]
                offset[own] = run[:, 3] + inside % run[:, 1] * n
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            kept[2] = kept[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(counts.select("part", "length", before.alias("base")), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.drop("part", "base").mapInArrow(trimmed(work), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(tokens: DataFrame, plan: DataFrame, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from (doc_id, ids) and the plan; doc_id must be unique."""
    whole = tokens.select("doc_id", F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end_id))).alias("ids"))
    parts = plan.join(whole, "doc_id").select("sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("piece"))
    return parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select("sequence_id", F.flatten("pieces.ids").alias("ids"))
