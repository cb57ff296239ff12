"""License notices: exact phrases, and short notices with a few edits.

A notice that matches with at most k edits holds one of k + 1 pieces of it unchanged. Texts are reduced to lower-case
words joined by spaces; all pieces are searched in them as plain bytes, and only around such seeds does a bounded-error
pattern verify the notice and report its span.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import slices, take, text_bytes, word_spans

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10

#: Length of the grams that a candidate must share with its notice before it is verified.
GRAM = 4

#: Verified windows that a worker remembers.
CACHE = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False


def split_seeds(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 pieces of a notice with their offsets: one of them survives any ``edits`` edits."""
    cuts = np.linspace(0, len(notice), edits + 2).astype(int)
    return [(int(a), notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    """Finds phrases and notices in normalised texts."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], chars_per_edit: int):
        self.phrases = [(p.encode(), label) for p, label in phrases.items()]
        self.notices = []
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices.items()):
            body = notice.encode()
            edits = len(body) // chars_per_edit
            pattern = regex.compile(b"(?b)(?:" + regex.escape(body) + b"){e<=" + str(edits).encode() + b"}")
            grams = {body[i : i + GRAM] for i in range(len(body) - GRAM + 1)}
            self.notices.append((len(body), edits, label, pattern, grams))
            for offset, seed in split_seeds(body, edits):
                self.seeds.setdefault(seed, []).append((number, offset))
        self.held: dict[tuple[int, bytes], tuple[int, int, int] | None] = {}

    def exact(self, data: bytes) -> list[tuple[int, str]]:
        """(place, label) of every phrase between word ends."""
        out = []
        for phrase, label in self.phrases:
            at = data.find(phrase)
            while at >= 0:
                if data[at - 1 : at] in (b" ", b"\n", b"") and data[at + len(phrase) : at + len(phrase) + 1] in (b" ", b"\n"):
                    out.append((at, label))
                at = data.find(phrase, at + 1)
        return out

    def fuzzy(self, data: bytes, heads: list[int]) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, notice length) of verified notices that do not overlap.

        ``heads`` are the places where texts start; a notice never crosses texts.
        """
        wanted: set[tuple[int, int, int]] = set()
        for seed, uses in self.seeds.items():
            at = data.find(seed)
            while at >= 0:
                row = bisect_right(heads, at) - 1
                for number, offset in uses:
                    # Aligned starts that differ by edits only are one candidate.
                    wanted.add((number, row, (at - offset) // (2 * self.notices[number][1] + 2)))
                at = data.find(seed, at + 1)
        found: dict[tuple[int, int, str], tuple[int, int]] = {}
        for number, row, cell in wanted:
            size, edits, label, _, _ = self.notices[number]
            width = 2 * edits + 2
            low = max(heads[row], cell * width - edits)
            high = min((cell + 1) * width + size + 2 * edits, heads[row + 1] - 1 if row + 1 < len(heads) else len(data) - 1)
            hit = self._verify(number, data[low:high])
            if hit:
                start, end, errors = hit
                key = (low + start, low + end, label)
                found[key] = min(found.get(key, (errors, size)), (errors, size))
        # Of overlapping hits the one with the smallest share of edits stays, then the longest.
        out: list[tuple[int, int, str, int, int]] = []
        last = -1
        for (start, end, label), (errors, size) in sorted(found.items()):
            if out and start < last:
                kept = out[-1]
                if (errors / size, -size) < (kept[3] / kept[4], -kept[4]):
                    out[-1] = (start, end, label, errors, size)
                    last = end
                continue
            out.append((start, end, label, errors, size))
            last = end
        return out

    def _verify(self, number: int, window: bytes) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match. An edit touches at most GRAM grams, so most candidates fail early."""
        _, edits, _, pattern, grams = self.notices[number]
        missing = 0
        for gram in grams:
            if gram not in window:
                missing += 1
                if missing > GRAM * edits:
                    return None
        key = (number, window)
        if key not in self.held:
            if len(self.held) >= CACHE:
                self.held.clear()
            hit = pattern.search(window)
            self.held[key] = (hit.start(), hit.end(), sum(hit.fuzzy_counts)) if hit else None
        return self.held[key]


@lru_cache(4)
def _scanner(phrases: tuple, notices: tuple, chars_per_edit: int) -> Scanner:
    return Scanner(dict(phrases), dict(notices), chars_per_edit)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, base, found) for every row.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all characters beyond ASCII. ``base`` lists <label, word> for each
    place where a phrase's words follow each other; ``found`` lists <label, first_word, last_word, edits, chars> for each
    notice with at most one edit for ``chars_per_edit`` characters; edits are bytes of the normalised text. Null and
    empty texts have no words; repeated rows and rows without an id get a row each; an empty table gives none.
    """
    how = (tuple(phrases.items()), tuple(notices.items()), chars_per_edit)
    base_kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("chars", pa.int32())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*how)
        for batch in slices(batches, "text"):
            body, offsets = text_bytes(batch.column(1))
            body = _LOWER[body]
            starts, ends, firsts = word_spans(body, offsets, _BREAK)
            sizes = ends - starts
            places = np.cumsum(sizes + 1) - sizes - 1
            joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
            inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            joined[inner + np.repeat(places, sizes)] = body[inner + np.repeat(starts, sizes)]
            lasts = firsts[1:][np.diff(firsts) > 0] - 1
            joined[places[lasts] + sizes[lasts]] = 10
            data = joined.tobytes()
            rows = batch.num_rows
            base: list[list[dict]] = [[] for _ in range(rows)]
            found: list[list[dict]] = [[] for _ in range(rows)]
            for place, label in scanner.exact(data):
                word = int(np.searchsorted(places, place))
                row = int(np.searchsorted(firsts, word, "right")) - 1
                base[row].append({"label": label, "word": word - int(firsts[row])})
            heads = places[firsts[:-1][np.diff(firsts) > 0]].tolist()
            for start, end, label, errors, size in scanner.fuzzy(data, heads):
                word = int(np.searchsorted(places, start, "right")) - 1
                last = int(np.searchsorted(places, end - 1, "right")) - 1
                row = int(np.searchsorted(firsts, word, "right")) - 1
                found[row].append({"label": label, "first_word": word - int(firsts[row]), "last_word": last - int(firsts[row]), "edits": errors, "chars": size})
            columns = [batch.column(0), pa.array(np.diff(firsts), pa.int64()), pa.array(base, base_kind), pa.array(found, found_kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "found"])

    plain = take(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return plain.mapInArrow(work, "doc_id long, n_words long, base array<struct<label:string,word:long>>, found array<struct<label:string,first_word:long,last_word:long,edits:int,chars:int>>")
