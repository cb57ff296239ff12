"""Byte-level BPE over columns of texts: cut to pieces, merge each distinct piece once, put the ids together again.

Cutting and assembling work on whole arrays. Merging follows the textbook form for one piece: symbols in a doubly
linked list, candidate merges in a heap by rank, entries that no longer match the list skipped.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import _places, mix, slices, take, text_bytes, trimmed

#: Distinct pieces that one worker remembers; beyond that it starts afresh. The worker keeps them while other stages run.
CACHE = 1 << 19

#: Pieces merged at once, as the library's results are many times as large as their ids.
MERGE_PIECES = 2048

#: Text bytes encoded at once; a longer single text is encoded alone.
SLICE_BYTES = 1 << 20

LETTER, NUMBER, OTHER, WHITE = 1, 2, 0, 3

#: The contractions that the pre-tokenizer splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class, and a random 64-bit value."""
    kinds = np.zeros(0x110000, np.uint8)
    # No surrogates; one string, as a million small ones would stay in the worker's memory.
    text = np.delete(np.arange(0x110000, dtype="<u4"), slice(0xD800, 0xE000)).tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for found in regex.finditer(pattern, text):
            kinds[ord(text[found.start()]) : ord(text[found.end() - 1]) + 1] = kind
    kinds[0xD800:0xE000] = OTHER
    values = np.random.Generator(np.random.PCG64(20240503)).integers(0, 2**64, 0x110000, dtype=np.uint64)
    return kinds, values


def cut_points(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of all pieces of the byte-level pre-tokenizer; ``edges`` are the places where a new text starts."""
    n = len(points)
    kind = _tables()[0][points]
    start = np.zeros(n + 1, bool)
    start[edges] = True
    start[n] = True
    inner = ~start[1:n]
    change = np.flatnonzero((kind[1:] != kind[:-1]) & inner) + 1
    start[change] = True
    # The last white space before other text stands alone, or joins that text if it is a space.
    after = change[(kind[change - 1] == WHITE)]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # Contractions: an apostrophe that starts a piece, then letters.
    quote = np.flatnonzero((points[:-1] == 39) & start[:n][: n - 1] & ~_edge(edges, n)[1:n] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, int)
    if len(quote):
        edge = _edge(edges, n)
        room = np.concatenate([points, np.zeros(3, points.dtype)])
        for ending in CONTRACTIONS:
            fits = np.ones(len(quote), bool)
            for j, letter in enumerate(ending):
                fits &= (room[quote + 1 + j] == ord(letter)) & ~edge[np.minimum(quote + 1 + j, n)]
            at = quote[fits]
            start[at + 1] = False
            start[at + 1 + len(ending)] = _after(at + 1 + len(ending), n, kind, start)
            quote = quote[~fits]
    return np.flatnonzero(start[:n])


def _edge(edges: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[edges] = True
    out[n] = True
    return out


def _after(at: np.ndarray, n: int, kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    """After a contraction a new piece starts, unless a space there already joined what follows."""
    return np.where(at < n, (kind[np.minimum(at, n - 1)] == LETTER) | start[at], True)


class Vocabulary:
    """Symbols, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # The file writes bytes as printable characters: printable ones as themselves, the others from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*model["vocab"].values(), *self.special.values(), 0) + 1
        self.strings = [b""] * size
        for token, number in model["vocab"].items():
            self.strings[number] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, number in self.special.items():
            self.strings[number] = token.encode()
        self.bytes = [0] * 256
        for c, b in to_byte.items():
            self.bytes[b] = model["vocab"][c]
        #: (left << 20 | right) to rank, and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[model["vocab"][left] << 20 | model["vocab"][right]] = len(self.made)
            self.made.append(model["vocab"][left + right])
        self.ends = np.cumsum([len(s) for s in self.strings])
        self.sizes = np.array([len(s) for s in self.strings])
        self.body = np.frombuffer(b"".join(self.strings), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: pop the lowest rank, leftmost first; skip an entry whose pair is no longer there."""
        ranks, made = self.ranks.get, self.made
        symbol = [self.bytes[b] for b in piece]
        n = len(symbol)
        heap = []
        for i in range(n - 1):
            rank = ranks(symbol[i] << 20 | symbol[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        if not heap:
            return symbol
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbol[i] < 0 or ranks(symbol[i] << 20 | symbol[j]) != rank:
                continue
            symbol[i] = new = made[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks(new << 20 | symbol[k])
                if found is not None:
                    push(heap, found << 32 | i)
            h = before[i]
            if h >= 0:
                found = ranks(symbol[h] << 20 | new)
                if found is not None:
                    push(heap, found << 32 | h)
        return [s for s in symbol if s >= 0]

    def merge_all(self, pieces: list[str]) -> list[list[int]]:
        return [self.merge(p.encode()) for p in pieces]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the offsets of the texts in them."""
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.body[ragged(self.ends[ids] - sizes, sizes)], total[offsets]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, joined."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of whole texts from the ids of their distinct pieces, remembered between batches."""

    def __init__(self, merge_all: Callable[[list[str]], list[list[int]]], special: dict[str, int]):
        self.merge_all, self.special = merge_all, special
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts in them. Null counts as empty."""
        body, offsets = text_bytes(column)
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        text = body.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        places = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        edges, marked = [places[offsets[:-1]]], {}
        for token, number in self.special.items():
            found = self._find(body, offsets, token.encode())
            low = places[found]
            edges += [low, low + len(token)]
            marked |= dict.fromkeys(low.tolist(), number)
        edge = np.unique(np.concatenate(edges))
        edge = edge[edge < len(points)]
        starts = cut_points(points, edge)
        if marked:
            # A special token is one piece, whatever it is made of.
            inside = np.zeros(len(points), bool)
            for low, number in marked.items():
                size = next(len(t) for t, k in self.special.items() if k == number)
                inside[low + 1 : low + size] = True
            starts = starts[~inside[starts]]
        sizes = np.diff(np.concatenate([starts, [len(points)]]))
        keys = self._keys(points, starts, sizes)
        unique, first, index = np.unique(keys, return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, unique)
        fresh = np.ones(len(unique), bool)
        inside = known < len(self.keys)
        fresh[inside] = self.keys[known[inside]] != unique[inside]
        if fresh.any():
            if len(self.keys) + int(fresh.sum()) > CACHE:
                self._clear()
                fresh[:] = True
            pick = first[fresh]
            pieces = [text[a : a + n] for a, n in zip(starts[pick].tolist(), sizes[pick].tolist(), strict=True)]
            made = [ids for a in range(0, len(pieces), MERGE_PIECES) for ids in self.merge_all(pieces[a : a + MERGE_PIECES])]
            for i, a in enumerate(starts[pick].tolist()) if marked else ():
                if a in marked:
                    made[i] = [marked[a]]
            counts = np.fromiter(map(len, made), np.int64, len(made))
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(counts) - counts])
            self.pool = np.concatenate([self.pool, np.fromiter((x for m in made for x in m), np.int32, int(counts.sum()))])
            self.sizes = np.concatenate([self.sizes, counts])
            self.keys = np.concatenate([self.keys, unique[fresh]])
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.at, self.sizes = self.keys[order], self.at[order], self.sizes[order]
            known = np.searchsorted(self.keys, unique)
        chosen = known[index]
        counts = self.sizes[chosen]
        ids = self.pool[ragged(self.at[chosen], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, places[offsets])]

    @staticmethod
    def _find(body: np.ndarray, offsets: np.ndarray, token: bytes) -> np.ndarray:
        """Byte places of a special token inside single texts."""
        data, found, at = body.tobytes(), [], 0
        while (at := data.find(token, at)) >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            inside = at + len(token) <= offsets[row + 1]
            found += [at] if inside else []
            at += len(token) if inside else 1
        return np.array(found, np.int64)

    @staticmethod
    def _keys(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = _tables()[1][points]
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        h *= _places(int(sizes.max()))[place]
        return mix(np.add.reduceat(h, starts) + sizes.astype(np.uint64))


@lru_cache(2)
def own_encoder(path: str) -> Encoder:
    """The encoder over this module's own merges; one for each worker."""
    words = vocabulary(path)
    return Encoder(words.merge_all, words.special)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of each row's whole text, without added special tokens.

    A special token's string inside a text is that token. Null and empty texts have no ids. ``path`` names a
    byte-level BPE file that every worker can read.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = own_encoder(path)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, offsets = encoder.encode(batch.column(1))
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "ids"])

    return take(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(trimmed(work), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``rows`` and ``decoded``: the vocabulary strings of the ids joined, special tokens included.

    Bytes that are no UTF-8 become U+FFFD. Null ids count as none.
    """
    names = [*rows.columns, "decoded"]
    at = rows.columns.index(ids)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                column = part.column(at)
                sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                body, ends = words.decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
                made = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
                try:
                    texts = made.cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names)

    return rows.mapInArrow(trimmed(work), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", decoded string")
