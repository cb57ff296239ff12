"""Vectorised text helpers that run inside tasks: words, lines and their hashes over one byte buffer."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task, with some fifty times as much in arrays beside them; a longer single text
#: is handled alone.
SLICE_BYTES = 1 << 20

#: The word separators of the contracts: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The C library's call that hands free memory back; only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(20240502)).integers(0, 2**64, 1024, dtype=np.uint64) | np.uint64(1)


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Pick columns by exact name, whatever else the frame holds.

    Further columns may repeat a name or differ from it by case only; the first exact match counts.
    """
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(old)}").alias(new) for new, old in columns.items()])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one buffer, and the row offsets in it. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def give_back() -> None:
    """Hand the memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trimmed(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after whose last batch a worker gives free memory back: it stays alive beside the JVM's own stages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def word_spans(body: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    inside = np.zeros(len(body) + 2, dtype=bool)
    inside[1:-1] = ~outside[body]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(body))]
    opens[edge] = inside[1:-1][edge]
    closes[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    """At least ``n`` odd multipliers, one for each place in a span."""
    global _PLACE
    while len(_PLACE) < n:
        more = np.random.Generator(np.random.PCG64(len(_PLACE))).integers(0, 2**64, len(_PLACE), dtype=np.uint64)
        _PLACE = np.concatenate([_PLACE, more | np.uint64(1)])
    return _PLACE


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty, non-overlapping span of the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    heads = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(heads, sizes)
    h = _BYTE[body[place + np.repeat(starts, sizes)]]
    h *= _places(int(sizes.max()))[place]
    return mix(np.add.reduceat(h, heads) + sizes.astype(np.uint64))


def window_hashes(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values, by doubling. Shorter input has none."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    total, done, part, size, rest = None, 0, mix(h + np.uint64(salt * 2 + 1)), 1, width
    count = len(h) - width + 1
    while rest:
        if rest & 1:
            piece = part[done : done + count]
            total = piece.copy() if total is None else mix(total * _MIX2 + piece)
            done += size
        rest >>= 1
        if rest:
            part = mix(part[:-size] * _MIX1 + part[size:])
            size *= 2
    return total


def window_rows(firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Global word index of each window start that stays inside its row, and the row of each."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    heads = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(heads - firsts[:-1], counts), rows


def covered(starts: np.ndarray, widths: np.ndarray | int, n: int) -> np.ndarray:
    """True at each of ``n`` places that lies in a span [start, start + width)."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + widths, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive offsets; empty ranges give zero."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def unsigned(values: np.ndarray) -> np.ndarray:
    """The same bits as unsigned 64-bit values."""
    return np.ascontiguousarray(values).view(np.uint64)
