"""Repeated byte strings by suffix arrays, sorted in two stages.

Every string of the wanted length carries one minimizer: the smallest hash of its short windows, wherever the string
stands. The bytes around a minimizer that several documents share form a segment, and equal strings lie in segments of
the same minimizer, so each bucket of minimizers can be sorted alone. A bucket's segments are sorted in two stages: only
suffixes smaller than their successors are compared directly, the others are induced by scanning buckets of first
symbols in ascending order. Adjacent common prefixes then give the groups of equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import _BYTE, covered, mix, slices, text_bytes
from .graph import bucket_count, by_group, with_replies
from .packed import QUESTION, REPLY, document_keys, flags_for, in_order, in_several, pack, replies_of, slotted, unslotted, with_made

#: Bytes of a hashed window inside a string; a power of two.
GRAM = 16

#: Bytes that are sorted at once.
SORT_BYTES = 1 << 20

#: A pair of random values for each byte.
_VALUE = np.random.Generator(np.random.PCG64(20240503)).integers(0, 2**64, (2, 256), dtype=np.uint64)


def two_stage_sort(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of small non-negative integers, right up to ``depth`` symbols of each suffix.

    The end of the text counts as smaller than any symbol.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    size = int(symbols.max()) + 1
    text = symbols.astype(np.int64)
    # A suffix is smaller than its successor if the next different symbol is larger.
    turn = np.flatnonzero(text[1:] != text[:-1])
    rises = np.zeros(n, bool)
    if len(turn):
        ahead = np.searchsorted(turn, np.arange(n))
        known = ahead < len(turn)
        at = turn[np.minimum(ahead, len(turn) - 1)]
        rises = known & (text[np.minimum(at + 1, n - 1)] > text[at])
    direct = _sort_directly(text, np.flatnonzero(rises), depth, size)
    heads = np.searchsorted(text[direct], np.arange(size + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(size)]
    induced[int(text[-1])].append(np.array([n - 1]))
    out = []
    for c in range(size):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        scanned = []
        while len(front):
            scanned.append(front)
            before = front[front > 0] - 1
            front = before[text[before] == c]
        scanned.append(direct[heads[c] : heads[c + 1]])
        bucket = np.concatenate(scanned)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        first = text[before]
        order = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        for part in np.split(before[order], cuts):
            if len(part):
                induced[int(text[part[0]])].append(part)
    return np.concatenate(out)


class _Keys:
    """Several symbols of a suffix in one integer, for any depth."""

    def __init__(self, text: np.ndarray, size: int):
        self.bits = max(1, int(size).bit_length())
        self.step = 63 // self.bits
        padded = np.concatenate([text + 1, np.zeros(self.step, np.int64)])
        self.key = np.zeros(len(text), np.int64)
        for j in range(self.step):
            self.key = (self.key << self.bits) | padded[j : j + len(text)]

    def at(self, suffixes: np.ndarray, depth: int) -> np.ndarray:
        place = suffixes + depth
        return np.where(place < len(self.key), self.key[np.minimum(place, len(self.key) - 1)], 0)


def _sort_directly(text: np.ndarray, suffixes: np.ndarray, depth: int, size: int) -> np.ndarray:
    """Sort the given suffixes by their first ``depth`` symbols, refining only what is still tied."""
    if len(suffixes) < 2:
        return suffixes
    keys = _Keys(text, size)
    first = keys.at(suffixes, 0)
    order = np.argsort(first, kind="stable")
    out, key = suffixes[order], first[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    places = np.arange(len(out))
    done = keys.step
    while done < depth:
        tied = np.zeros(len(group), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if not tied.any():
            break
        places, group = places[tied], group[tied]
        key = keys.at(out[places], done)
        order = np.lexsort((key, group))
        out[places] = out[places][order]
        group, key = group[order], key[order]
        group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (key[1:] != key[:-1]))])
        done += keys.step
    return out


def common_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``, counted up to ``limit``; zero for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    keys = _Keys(symbols.astype(np.int64), int(symbols.max()) + 1)
    live = np.arange(1, len(order))
    depth = 0
    while len(live) and depth < limit:
        differ = keys.at(order[live], depth) ^ keys.at(order[live - 1], depth)
        equal = differ == 0
        out[live] = depth
        for j in range(1, keys.step + 1):
            out[live] += differ >> (keys.bits * (keys.step - j)) == 0
        live = live[equal]
        depth += keys.step
    return np.minimum(out, limit)


def repeated_starts(segments: list[bytes], ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every string of ``length`` bytes that also starts in a segment of a smaller rank."""
    if not segments:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in segments], np.int64)
    body = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    heads = np.cumsum(sizes + 1) - sizes - 1
    used = np.unique(body)
    symbols = np.searchsorted(used, body) + 1
    symbols[heads + sizes] = 0
    order = two_stage_sort(symbols, length)
    prefix = common_prefixes(symbols, order, length)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)[order]
    offset = order - heads[owner]
    whole = offset + length <= sizes[owner]
    # Runs of whole strings with a common prefix of the full length hold one string each.
    fresh = prefix < length
    fresh[0] = True
    group = np.cumsum(fresh) - 1
    group, owner, offset = group[whole], owner[whole], offset[whole]
    if not len(group):
        return owner, offset
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ranks[owner])
    later = ranks[owner] > least[group]
    return owner[later], offset[later]


#: Odd numbers, so that each has an inverse among 64-bit numbers.
_POWER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def content_hashes(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """128 bits of each range [low, high) of the bytes, as two columns, from differences of prefix sums."""
    out = np.empty((len(low), 2), np.uint64)
    for k, base in enumerate(_POWER):
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_VALUE[k][body] * _powers(base, len(body)), out=sums[1:])
        # Divided by the power of the range's place, equal ranges give equal differences wherever they stand.
        back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(body) + 1)
        out[:, k] = mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))
    return out


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def minimizer_runs(body: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive string starts that share a minimizer: (key, row, first byte, end byte of the last string)."""
    reach = length - GRAM
    none = np.zeros(0, np.int64)
    if len(body) < length:
        return none.astype(np.uint64), none, none, none
    h, width, salt = _BYTE[body], 1, 3
    while width < GRAM:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + h[width:]
        width, salt = width * 2, salt + 5
    least, span = mix(h), 1
    while span * 2 <= reach + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach + 1:
        least = np.minimum(least[: len(h) - reach], least[reach + 1 - span :])
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        return none.astype(np.uint64), none, none, none
    at = np.arange(len(rows)) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    key = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(fresh)
    last = np.concatenate([begin[1:], [len(at)]]) - 1
    # Minima crowd near zero; mixed again they fill the buckets evenly.
    return mix(key[begin]), rows[begin], at[begin], at[last] + length


class _Slot:
    """The bytes of a slot's documents and their minimizer runs. Equal in every pass."""

    def __init__(self, table: pa.Table, length: int):
        self.table, self.row_doc = in_order(table)
        self.length = length
        self.parts = []
        keys, rows, lows, highs, done, at = [], [], [], [], 0, 0
        for batch in slices(self.table.to_batches(), "text", 1 << 20):
            body, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            key, row, low, high = minimizer_runs(body, offsets, length)
            self.parts.append((body, offsets, at))
            keys.append(key)
            rows.append((row + done).astype(np.int32))
            lows.append(low + at)
            highs.append(high + at)
            done, at = done + len(offsets) - 1, at + len(body)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.key, self.row = join(keys, np.uint64), join(rows, np.int32)
        self.low, self.high = join(lows, np.int64), join(highs, np.int64)
        self.asked, self.index = np.unique(self.key, return_inverse=True)
        doc = self.row_doc[self.row]
        least = np.full(len(self.asked), np.iinfo(np.int64).max)
        most = np.full(len(self.asked), -1)
        np.minimum.at(least, self.index, doc)
        np.maximum.at(most, self.index, doc)
        self.twice = least != most

    def segments(self, shared: np.ndarray) -> None:
        """Number the distinct segments around shared minimizers; all but the first document's are known repeats."""
        self.runs = np.flatnonzero(shared[self.index])
        low, high = self.low[self.runs], self.high[self.runs]
        content = np.empty((len(self.runs), 2), np.uint64)
        for body, _, at in self.parts:
            a, b = np.searchsorted(low, [at, at + len(body)])
            content[a:b] = content_hashes(body, low[a:b] - at, high[a:b] - at)
        order = np.lexsort((content[:, 1], content[:, 0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(content[order], axis=0) != 0).any(axis=1)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        # The sort is stable and runs follow the documents, so the first of equal ones is the earliest.
        self.opener = self.runs[order[fresh]]
        doc = self.row_doc[self.row]
        self.known = doc[self.runs] > doc[self.opener][self.number]

    def gathered(self, low: np.ndarray, high: np.ndarray) -> bytes:
        """The bytes of some ranges, one after the other."""
        starts = np.array([at for _, _, at in self.parts])
        out = []
        for part, a, b in zip((np.searchsorted(starts, low, "right") - 1).tolist(), low.tolist(), high.tolist(), strict=True):
            body, _, at = self.parts[part]
            out.append(body[a - at : b - at])
        return np.concatenate(out).tobytes() if out else b""


def _ask_keys(table: pa.Table, buckets: int, length: int) -> pa.Table:
    slot = _Slot(table, length)
    return pack(table.column("slot")[0].as_py(), buckets, slot.asked, slot.twice)


def _ask_segments(table: pa.Table, replies: pa.Table, buckets: int, length: int) -> pa.Table:
    """One question for each bucket: documents, minimizers, sizes and bytes of the slot's segments there."""
    slot = _Slot(table, length)
    slot.segments(flags_for(slot.asked, buckets, replies_of(replies, 1)))
    doc, turn = document_keys(slot.table)
    chosen, data = _by_bucket(slot, buckets), []
    for part in chosen.values():
        run = slot.opener[part]
        rows, low, high = slot.row[run], slot.low[run], slot.high[run]
        arrays = doc[rows], turn[rows], slot.key[run], (high - low).astype(np.int32)
        data.append(b"".join([np.int64(len(part)).tobytes(), *(x.tobytes() for x in arrays), slot.gathered(low, high)]))
    return pa.table({"slot": pa.array(np.full(len(data), table.column("slot")[0].as_py()), pa.int32()), "bucket": pa.array(list(chosen), pa.int32()), "payload": pa.array(data, pa.binary())})


def _by_bucket(slot: _Slot, buckets: int) -> dict[int, np.ndarray]:
    """Numbers of the slot's segments by the bucket of their minimizer, in a fixed order."""
    key = slot.key[slot.opener]
    order = np.argsort(key, kind="stable")
    step = np.uint64((1 << 64) // buckets + 1)
    bucket = (key[order] // step).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return {int(key[p[0]] // step): p for p in np.split(order, cuts) if len(p)}


def _hashes_in_parts(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Content hashes of adjacent segments, for about :data:`SORT_BYTES` of them at a time."""
    out, first = np.empty((len(low), 2), np.uint64), 0
    while first < len(low):
        last = max(first + 1, int(np.searchsorted(high, low[first] + SORT_BYTES, "right")))
        a, b = low[first], high[last - 1]
        out[first:last] = content_hashes(body[a:b], low[first:last] - a, high[first:last] - a)
        first = last
    return out


class _Segments:
    """The questions of a bucket: what describes each segment, joined, and views of the bytes."""

    def __init__(self, payloads: pa.ChunkedArray):
        buffers = [x.as_buffer() for x in payloads]
        self.counts = [int(np.frombuffer(x, np.int64, 1)[0]) for x in buffers]
        columns = []
        self.bodies = []
        for data, n in zip(buffers, self.counts, strict=True):
            held = [np.frombuffer(data, kind, n, 8 + 8 * n * k) for k, kind in enumerate((np.int64, np.int64, np.uint64, np.int32))]
            body = np.frombuffer(data, np.uint8, -1, 8 + 28 * n)
            ends = np.cumsum(held[-1], dtype=np.int64)
            columns.append([*held, *_hashes_in_parts(body, ends - held[-1], ends).T, ends - held[-1]])
            self.bodies.append(body)
        self.doc, self.turn, self.key, self.size, self.high, self.low, self.start = (np.concatenate(c) for c in zip(*columns, strict=True))
        self.part = np.repeat(np.arange(len(buffers)), self.counts)

    def content(self, i: int) -> bytes:
        a = self.start[i]
        return self.bodies[self.part[i]][a : a + self.size[i]].tobytes()


def _batches(order: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Cut segments, ordered by group, into runs of whole groups with at most :data:`SORT_BYTES`, or one group."""
    total = np.cumsum(sizes[order], dtype=np.int64)
    ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1 if len(order) else np.zeros(0, np.int64)
    first = 0
    while first < len(order):
        done = int(total[first - 1]) if first else 0
        fit = ends[(ends > first) & (total[ends - 1] <= done + SORT_BYTES)]
        last = int(fit[-1]) if len(fit) else int(ends[ends > first][0])
        yield order[first:last]
        first = last


def _repeats(table: pa.Table, length: int) -> pa.Table:
    """Bucket side of the second question: which bytes of each segment repeat an earlier document?

    A segment that an earlier document holds whole is marked so. Of the others, each distinct one is sorted once, unless
    its minimizer has no second one: then no other segment can share a string with it.
    """
    held = _Segments(table.column("payload"))
    doc, turn = held.doc, held.turn
    rank_order = np.lexsort((turn, doc))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (np.diff(doc[rank_order]) != 0) | (np.diff(turn[rank_order]) != 0)
    rank = np.empty(len(doc), np.int64)
    rank[rank_order] = np.cumsum(fresh) - 1
    same = np.lexsort((held.low, held.high))
    fresh[0] = True
    fresh[1:] = (np.diff(held.high[same]) != 0) | (np.diff(held.low[same]) != 0)
    number = np.empty(len(doc), np.int64)
    number[same] = np.cumsum(fresh) - 1
    opener = same[fresh]
    least = np.full(len(opener), np.iinfo(np.int64).max)
    np.minimum.at(least, number, rank)
    key = held.key[opener]
    _, index, times = np.unique(key, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(times[index] > 1)
    found = []
    for part in _batches(mixed[np.argsort(index[mixed], kind="stable")], index, held.size[opener]):
        owner, offset = repeated_starts([held.content(i) for i in opener[part].tolist()], least[part], length)
        found.append((part[owner], offset))
    owner, offset = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (np.diff(owner) != 0) | (np.diff(offset) != 1)
    begin = np.flatnonzero(fresh)
    last = np.concatenate([begin[1:], [len(owner)]]).astype(np.int64) - 1
    spans = {}
    for o, a, b in zip(owner[begin].tolist(), offset[begin].tolist(), offset[last].tolist() if len(begin) else [], strict=True):
        spans.setdefault(o, []).append((a, b + length))
    out, at = [], 0
    for n in held.counts:
        numbers = number[at : at + n]
        whole = rank[at : at + n] > least[numbers]
        mine = [[] if w else spans.get(k, []) for k, w in zip(numbers.tolist(), whole.tolist(), strict=True)]
        out.append(whole.tobytes() + np.array([len(m) for m in mine], np.int32).tobytes() + np.array([x for m in mine for s in m for x in s], np.int32).tobytes())
        at += n
    return pa.table({"slot": table.column("slot"), "bucket": table.column("bucket"), "stage": pa.array(np.full(len(out), 2), pa.int32()), "payload": pa.array(out, pa.binary())})


def _remove(table: pa.Table, replies: pa.Table, buckets: int, length: int) -> pa.Table:
    slot = _Slot(table, length)
    slot.segments(flags_for(slot.asked, buckets, replies_of(replies, 1)))
    whole = np.zeros(len(slot.opener), bool)
    partly: list[tuple[int, int, int]] = []
    second = replies_of(replies, 2)
    for bucket, part in _by_bucket(slot, buckets).items():
        data, n = second[bucket], len(part)
        whole[part] = np.frombuffer(data, bool, n)
        counts = np.frombuffer(data, np.int32, n, n)
        spans = np.frombuffer(data, np.int32, -1, 5 * n).reshape(-1, 2)
        partly += zip(np.repeat(part, counts).tolist(), spans[:, 0].tolist(), spans[:, 1].tolist(), strict=True)
    gone = slot.known | whole[slot.number]
    lows, highs = [slot.low[slot.runs[gone]]], [slot.high[slot.runs[gone]]]
    if partly:
        # A partly repeated segment may stand at several places of its first document.
        number, a, b = np.array(partly, np.int64).T
        order = np.argsort(slot.number, kind="stable")
        left, right = np.searchsorted(slot.number[order], number), np.searchsorted(slot.number[order], number, "right")
        times = right - left
        pick = np.arange(int(times.sum())) + np.repeat(left - (np.cumsum(times) - times), times)
        run = slot.runs[order[pick]]
        lows.append(slot.low[run] + np.repeat(a, times))
        highs.append(slot.low[run] + np.repeat(b, times))
    low, high = np.concatenate(lows), np.concatenate(highs)
    order = np.argsort(low, kind="stable")
    low, width = low[order], (high - low)[order]
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    for body, offsets, at in slot.parts:
        first, last = np.searchsorted(low, [at, at + len(body)])
        gone = covered(low[first:last] - at, width[first:last], len(body))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(body))]
        opens[edge] = gone[edge]
        cut = np.concatenate([[0], np.cumsum(gone)])[offsets], np.concatenate([[0], np.cumsum(opens)])[offsets]
        n_bytes.append(np.diff(offsets))
        n_removed.append(np.diff(cut[0]))
        n_spans.append(np.diff(cut[1]))
        data, ends = body[~gone].tobytes(), (offsets - cut[0]).tolist()
        kept += [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.table({"doc_id": slot.table.column("doc_id"), "text": slot.table.column("text"), "rest": slot.table.column("rest"), "n_bytes": join(n_bytes), "n_removed": join(n_removed), "n_spans": join(n_spans), "kept": pa.array(kept, pa.binary())})


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """All rows and columns of ``docs`` with n_bytes, n_removed, n_spans and kept (the bytes that stay).

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input and never cross documents. ``n_spans`` counts maximal removed runs.
    Null text is empty. Rows with one doc_id are one document and do not repeat each other; rows without an id come
    after all others, ordered by a hash of their text. Shorter documents stay whole; an empty table gives none.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings must have at least {2 * GRAM} bytes")
    rows, buckets = slotted(docs, doc_id, text), bucket_count(docs)
    shared = by_group(by_group(rows, "slot", lambda t: _ask_keys(t, buckets, length), QUESTION), "bucket", lambda t: in_several(t, 1), REPLY)
    asked = with_replies(rows, shared, lambda t, r: _ask_segments(t, r, buckets, length), QUESTION)
    repeated = by_group(asked, "bucket", lambda t: _repeats(t, length), REPLY)
    result = with_replies(rows, shared.union(repeated), lambda t, r: _remove(t, r, buckets, length), with_made(rows, "n_bytes long, n_removed long, n_spans long, kept binary"))
    return unslotted(result, docs, doc_id, text, "n_bytes", "n_removed", "n_spans", "kept")
