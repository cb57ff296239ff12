"""Repeated word windows by difference-cover anchors.

A set D is a difference cover modulo v if every pair of residues can be moved into D by one common shift below v. So
two equal windows of w words, wherever they start, share an anchor: some v' < v words into both, the positions of both
documents modulo v lie in D. Hashing short windows only at such positions, and asking which of these hashes occur twice,
finds every place that a repeated window can hold. Around shared anchors the match is extended: whole windows are
compared by a 96-bit key, and all but the earliest are repeats.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import covered, slices, span_hashes, sums, text_bytes, window_hashes, window_rows, word_spans
from .graph import bucket_count, by_group, with_replies
from .packed import QUESTION, REPLY, answer, document_keys, flags_for, in_order, in_several, pack, replies_of, slotted, unpack_all, unslotted, with_made

PERIOD = 13

#: Text bytes handled at once, with some ten times as much in arrays beside them.
SLICE = 1 << 20


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set whose differences reach every residue modulo ``period``."""
    for size in range(1, period + 1):
        for found in combinations(range(period), size):
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError("the period must be positive")


class _Slot:
    """Words of a slot's documents, and the anchors and windows drawn from them. Equal in every pass."""

    def __init__(self, table: pa.Table, window: int, period: int, cover: tuple[int, ...]):
        self.table, self.row_doc = in_order(table)
        self.window, self.reach = window, period - 1
        hashes, counts = [], []
        for batch in slices(self.table.to_batches(), "text", SLICE):
            body, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            starts, ends, firsts = word_spans(body, offsets)
            hashes.append(span_hashes(body, starts, ends))
            counts.append(np.diff(firsts))
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.firsts = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        width = window - self.reach
        at, rows = window_rows(self.firsts, width)
        use = np.isin(np.arange(period), cover)[(at - self.firsts[:-1][rows]) % period]
        self.anchors = at[use]
        self.anchor_row = rows[use]
        self.keys = window_hashes(self.h, width)[self.anchors] if len(self.anchors) else np.zeros(0, np.uint64)
        self.asked, self.index, times = np.unique(self.keys, return_inverse=True, return_counts=True)
        self.twice = times > 1

    def windows(self, shared: np.ndarray) -> None:
        """Find the windows that contain a shared anchor; in ``order`` equal ones follow each other, earliest first."""
        hit = shared[self.index]
        at, row = self.anchors[hit], self.anchor_row[hit]
        low = np.maximum(at - self.reach, self.firsts[row])
        starts, rows = window_rows(self.firsts, self.window)
        use = covered(low, at - low + 1, len(self.h))[starts]
        self.starts, self.rows = starts[use], rows[use]
        g = window_hashes(self.h, self.window)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        k = (window_hashes(self.h, self.window, 1)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)).astype(np.uint32)
        self.order = np.lexsort((k, g))
        g, k = g[self.order], k[self.order]
        self.first = np.ones(len(g), bool)
        self.first[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        self.g, self.k = g[self.first], k[self.first]


def _ask_anchors(table: pa.Table, buckets: int, window: int, period: int, cover: tuple[int, ...]) -> pa.Table:
    slot = _Slot(table, window, period, cover)
    return pack(table.column("slot")[0].as_py(), buckets, slot.asked, slot.twice)


def _ask_windows(table: pa.Table, replies: pa.Table, buckets: int, window: int, period: int, cover: tuple[int, ...]) -> pa.Table:
    slot = _Slot(table, window, period, cover)
    slot.windows(flags_for(slot.asked, buckets, replies_of(replies, 1)))
    doc, turn = document_keys(slot.table)
    rows = slot.rows[slot.order][slot.first]
    return pack(table.column("slot")[0].as_py(), buckets, slot.g, slot.k, doc[rows], turn[rows])


def _earliest(table: pa.Table) -> pa.Table:
    """Bucket side of the second question: does an equal window start in an earlier document?"""
    (g, k, doc, turn), ends = unpack_all(table, np.uint64, np.uint32, np.int64, np.int64)
    order = np.lexsort((turn, doc, k, g))
    later = np.zeros(len(g), bool)
    a, b = order[:-1], order[1:]
    later[b] = (g[a] == g[b]) & (k[a] == k[b])
    return answer(table, later, ends, 2)


def _remove(table: pa.Table, replies: pa.Table, buckets: int, window: int, period: int, cover: tuple[int, ...]) -> pa.Table:
    slot = _Slot(table, window, period, cover)
    slot.windows(flags_for(slot.asked, buckets, replies_of(replies, 1)))
    repeat = ~slot.first
    repeat[slot.first] = flags_for(slot.g, buckets, replies_of(replies, 2))
    gone = covered(slot.starts[slot.order[repeat]], window, len(slot.h))
    texts, at = [], 0
    for batch in slices(slot.table.to_batches(), "text", SLICE):
        body, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        starts, ends, firsts = word_spans(body, offsets)
        stays = ~gone[at : at + len(starts)]
        at += len(starts)
        kept = sums(stays, firsts)
        starts, sizes = starts[stays], (ends - starts)[stays]
        places = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[inner + np.repeat(places, sizes)] = body[inner + np.repeat(starts, sizes)]
        lows = np.concatenate([places, [len(joined)]])[np.cumsum(kept) - kept].tolist()
        highs = np.concatenate([[0], places + sizes])[np.cumsum(kept)].tolist()
        data = joined.tobytes()
        texts += [data[a:b] if n else b"" for a, b, n in zip(lows, highs, kept.tolist(), strict=True)]
    return pa.table(
        {
            "doc_id": slot.table.column("doc_id"),
            "text": slot.table.column("text"),
            "rest": slot.table.column("rest"),
            "n_words": pa.array(np.diff(slot.firsts), pa.int64()),
            "n_removed": pa.array(sums(gone, slot.firsts), pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, period: int = PERIOD) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if it lies in a run of ``window`` words of its document that also starts earlier: in a document with a
    smaller doc_id, or further up in the same one. Words are cut at ASCII white space; runs are judged on the input.
    Null text has no words. Rows with one doc_id count as one document in text order, so a repeated row is removed;
    rows without an id come after all others. A document shorter than the window keeps all; an empty table gives none.
    ``period`` must be below ``window``.
    """
    if not 0 < period <= window:
        raise ValueError("the period must lie between 1 and the window")
    rows = slotted(docs, doc_id, text)
    buckets, cover = bucket_count(docs), difference_cover(period)
    how = (buckets, window, period, cover)
    shared = by_group(by_group(rows, "slot", lambda t: _ask_anchors(t, *how), QUESTION), "bucket", lambda t: in_several(t, 1), REPLY)
    asked = with_replies(rows, shared, lambda t, r: _ask_windows(t, r, *how), QUESTION)
    repeated = by_group(asked, "bucket", _earliest, REPLY)
    result = with_replies(rows, shared.union(repeated), lambda t, r: _remove(t, r, *how), with_made(rows, "n_words long, n_removed long, kept_text string"))
    return unslotted(result, docs, doc_id, text, "n_words", "n_removed", "kept_text")
