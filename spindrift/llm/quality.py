"""Quality rules with an isolation forest over the rule statistics.

One pass over the texts gives a row of statistics for each document. Two fixed rules reject on their own; the forest
rejects documents whose statistics are isolated by few random splits. Trees are grown from a bounded sample of the
documents labelled good; the score limit is calibrated on all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut_lineage

from .buffers import covered, mix, slices, span_hashes, sums, take, text_bytes, trimmed, window_hashes, window_rows, word_spans

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_short", "n_twins")

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _flags(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


_SYMBOL = _flags(SYMBOLS)
_NEWLINE = _flags(b"\n")
_UPPER = _flags(bytes(range(65, 91)))
_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0x100)))
_MARK = _flags(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)))


def _per_row(chosen: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(chosen), offsets))


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of :data:`COUNTS` for each text."""
    body, offsets = text_bytes(column)
    starts, ends, firsts = word_spans(body, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    sizes = ends - starts
    characters = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    chars = characters[ends] - characters[starts]
    h = span_hashes(body, starts, ends)
    # Repeated windows of eight words; the row is mixed in, so that rows stay apart.
    at, window_row = window_rows(firsts, 8)
    g = window_hashes(h, 8)[at] if len(at) else np.zeros(0, np.uint64)
    _, index, times = np.unique(mix(g + window_row.astype(np.uint64) * _STEP), return_inverse=True, return_counts=True)
    repeat = covered(at[times[index] > 1], 8, len(starts))
    twins = np.zeros(len(h), bool)
    twins[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    distinct = np.unique(mix(h + rows.astype(np.uint64) * _STEP), return_index=True)[1]
    # Lines that hold a word.
    low, high, lines = word_spans(body, offsets, _NEWLINE)
    line_row = np.repeat(np.arange(len(offsets) - 1), np.diff(lines))
    worded = np.searchsorted(starts, low) < np.searchsorted(starts, high)
    line_hash = span_hashes(body, low, high)[worded]
    line_row = line_row[worded]
    new_lines = np.unique(mix(line_hash + line_row.astype(np.uint64) * _STEP), return_index=True)[1]
    n = len(offsets) - 1
    n_lines = np.bincount(line_row, minlength=n)
    return {
        "n_words": np.diff(firsts),
        "word_chars": sums(chars, firsts),
        "n_symbols": _per_row(_SYMBOL[body], offsets),
        "n_dup_lines": n_lines - np.bincount(line_row[new_lines], minlength=n),
        "n_repeat_words": sums(repeat, firsts),
        "n_lines": n_lines,
        "n_upper": _per_row(_UPPER[body], offsets),
        "n_letters": _per_row(_LETTER[body], offsets),
        "n_marks": _per_row(_MARK[body], offsets),
        "n_distinct": np.bincount(rows[distinct], minlength=n),
        "n_short": sums(chars <= 3, firsts),
        "n_twins": sums(twins, firsts),
    }


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id and the counts of :data:`COUNTS` for every row; a null text has no words. With ``hashed`` also ``hash``, XXH64 of the text."""
    more = ["hash"] * hashed

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = text_statistics(batch.column(1))
            made = [pa.array(found[c], pa.int64()) for c in COUNTS] + [batch.column(2) for _ in more]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *COUNTS, *more])

    plain = take(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    if hashed:
        plain = plain.withColumn("hash", F.xxhash64("text"))
    return plain.mapInArrow(trimmed(work), "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *more)))


def features(batch: pa.RecordBatch) -> np.ndarray:
    """The matrix that the forest sees: shares, so that long texts are not anomalous as such."""
    c = {name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float) for name in COUNTS}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / chars,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / np.maximum(c["n_letters"], 1),
            c["n_marks"] / chars,
            c["n_short"] / words,
            c["n_twins"] / words,
        ]
    )


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a failed search among ``n`` points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees as arrays [tree, node]; ``path`` is a node's depth with the expected rest, if it is a leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    depth: int
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: near 1 if few splits isolate it, below 0.5 if it is like the sample."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > split[node]))
            total += path[node]
        return np.power(2.0, -total / len(self.feature) / self.scale)


def grow_forest(sample: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, size: int = 256, seed: int = 11) -> Forest:
    """Isolation trees over random subsamples of ``size`` rows.

    Splits are random places of random features inside a node's box, which starts as [low, high]: the sample of good
    documents leaves most of that box empty, and whatever falls there is isolated after few splits.
    """
    rng = np.random.default_rng(seed)
    size = min(size, len(sample))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature, split, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: (sample[rng.choice(len(sample), size, replace=False)], low, high)}
        for node in range(nodes):
            if node not in held:
                continue
            (x, low_side, high_side), level = held.pop(node), int(np.log2(node + 1))
            open_ = np.flatnonzero(high_side > low_side)
            if level == depth or len(x) < 2 or not len(open_):
                path[t, node] = level + _expected(len(x))
                continue
            f = int(rng.choice(open_))
            at = rng.uniform(low_side[f], high_side[f])
            right = x[:, f] > at
            feature[t, node], split[t, node] = f, at
            below, above = high_side.copy(), low_side.copy()
            below[f] = above[f] = at
            held[2 * node + 1], held[2 * node + 2] = (x[~right], low_side, below), (x[right], above, high_side)
    return Forest(feature, split, path, depth, float(max(_expected(size), 1e-9)))


def _scored(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """All columns and ``score``; without a forest every score is zero."""
    names = [*rows.columns, "score"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.scores(features(batch)) if forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, 6))], names)

    return rows.mapInArrow(trimmed(work), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", score double")


def calibrate(scores: list[tuple[float, int, int]], loss: float) -> float:
    """The score limit from (score, good, bad) counts: documents above it go.

    Of all limits that reject at most the share ``loss`` of the good documents, the one that rejects most bad ones;
    among equals, the highest. Without bad documents nothing is rejected.
    """
    good, limit, best = sum(g for _, g, _ in scores), np.inf, 0
    lost = caught = 0
    for score, g, b in sorted(scores, reverse=True):
        lost, caught = lost + g, caught + b
        if lost > loss * good:
            break
        if caught > best:
            best, limit = caught, score
    return limit


def _fit(labelled: DataFrame, sample: int, trees: int) -> Forest | None:
    """The forest over good documents, in the box of all drawn ones; None without good documents."""
    drawn = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("quality", *COUNTS).toArrow().to_batches()
    if not any(b.num_rows for b in drawn):
        return None
    x, good = np.concatenate([features(b) for b in drawn]), np.concatenate([b.column(0).to_numpy() for b in drawn]) == 1
    return grow_forest(x[good], x.min(axis=0), x.max(axis=0), trees) if good.any() else None


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, trees: int = 100, loss: float = 0.002, base_words: int = 20, base_repeats: int = 30, hashed: bool = False
) -> DataFrame:
    """(doc_id, the counts, base_failed, score, kept) for every row of ``docs``.

    base_failed: fewer than ``base_words`` words, or more than ``base_repeats`` percent of the words lie in repeated
    windows of eight. kept: neither that nor a score at or above the calibrated limit. The forest is grown from at most
    ``sample`` labelled documents that pass the base rules, chosen by a hash of their id; the limit comes from all
    labelled ones. Labels of unknown documents and rows without an id have no effect; without labels only the
    base rules count. Repeated rows get the same verdict each; a null text fails.
    """
    failed = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > base_repeats * F.col("n_words"))
    rows = cut_lineage(statistics(docs, doc_id, text, hashed).withColumn("base_failed", failed))
    known = take(labels, doc_id="doc_id", quality="quality").where("quality is not null")
    labelled = rows.where(~F.col("base_failed")).join(known, "doc_id")
    forest = _fit(labelled, sample, trees)
    bins = _scored(labelled, forest).groupBy(F.round("score", 3).alias("score")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    limit = calibrate([(r.score, r.good, r.bad) for r in bins.collect()], loss) if forest else np.inf
    return _scored(rows, forest).withColumn("kept", ~F.col("base_failed") & (F.round("score", 3) < F.lit(float(limit))))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, each by its own text, also where an id is null or stands twice."""
    kept = judge(docs, labels, doc_id, text, hashed=True).where("kept").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    same = F.col(f"_c{names.index(doc_id)}").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(f"_c{names.index(text)}") == F.col("_hash"))
    return plain.join(kept, same, "left_semi").toDF(*names)
