"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams that occur in it, each once. Every n-gram gets the log ratio of its smoothed
shares in toxic and in other labelled texts; a ratio that lies within a few standard errors of zero counts as zero, so
that what chance alone explains takes no part. A logistic regression over the features times their ratios is then fitted
by full gradients: each step is one job over the sample's packed features, and only sums return to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut_lineage

from .buffers import mix, slices, take

#: Characters of the shortest and the longest n-gram.
ORDERS = (3, 4, 5)

#: N-grams are hashed to two to this power of features.
BITS = 18

#: Text bytes handled at once: few enough that the arrays stay in a core's cache.
SLICE = 1 << 17

#: Tasks over the sample, whose size is bounded.
SAMPLE_TASKS = 8

_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts in one array, each text between blanks, and the row offsets in it.

    Runs of white space are one blank. Null is an empty text.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"\s+", " ")
    rows = plain.to_pylist()
    text = " " + "  ".join(rows) + " " if rows else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(r) + 2 for r in rows], np.int64)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def present(column: pa.Array, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all different n-grams of each text, in order; with ``use`` only of the features it marks."""
    points, offsets = characters(column)
    h = mix(points.astype(np.uint64) + _FIRST)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    last = offsets[1:][rows] if len(rows) else rows
    found, gram, width = [], h, 1
    for order in ORDERS:
        while width < order:
            gram = gram[:-1] * _NEXT + h[width:] if len(gram) > 1 else gram[:0]
            width += 1
        feature = (mix(gram) >> np.uint64(64 - BITS)).astype(np.int32)
        chosen = np.arange(width, width + len(gram)) <= last[: len(gram)]
        if use is not None:
            chosen &= use[feature]
        found.append((rows[: len(gram)][chosen], feature[chosen]))
    if use is not None:
        keys = np.unique(np.concatenate([(r << BITS) | f for r, f in found]))
        return keys >> BITS, keys & ((1 << BITS) - 1)
    return _distinct(found, len(column))


def _distinct(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once, from lists of (row, feature) in order of the row, without sorting."""
    cuts = [np.searchsorted(r, np.arange(n + 1)) for r, _ in found]
    place, out = np.zeros(1 << BITS, np.int32), [np.zeros(0, np.int32)]
    for i in range(n):
        features = np.concatenate([f[c[i] : c[i + 1]] for (_, f), c in zip(found, cuts, strict=True)])
        at = np.arange(len(features), dtype=np.int32)
        place[features] = at
        out.append(features[place[features] == at])
    return np.repeat(np.arange(n), [len(x) for x in out[1:]]), np.concatenate(out)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold each feature, for all rows of a task: (label, texts, counts)."""
    counts, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for batch in slices(batches, "text", SLICE):
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.int64)
        row, feature = present(batch.column(batch.schema.get_field_index("text")))
        for c in (0, 1):
            counts[c] += np.bincount(feature[label[row] == c], minlength=1 << BITS).astype(np.int32)
        texts += np.bincount(label, minlength=2)
    yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts), pa.array([c.tobytes() for c in counts], pa.binary())], ["label", "texts", "counts"])


def log_count_ratios(counts: np.ndarray, texts: np.ndarray, smooth: float = 1.0, errors: float = 3.0) -> np.ndarray:
    """Naive Bayes log ratio of each feature: log of its share among toxic texts over that among the others.

    Ratios within ``errors`` standard errors of zero are zero.
    """
    share = (counts + smooth) / (texts[:, None] + 2 * smooth)
    ratio = np.log(share[1] / share[0])
    deviation = np.sqrt(((1 - share) / (counts + smooth)).sum(axis=0))
    return np.where(np.abs(ratio) > errors * deviation, ratio, 0.0)


@dataclass
class Classifier:
    """The value of each feature, which is its ratio times its weight, and the intercept."""

    value: np.ndarray
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability that a text is toxic; an empty one has none of the features."""
        row, feature = present(column, self.value != 0)
        return logistic(np.bincount(row, self.value[feature], len(column)) + self.intercept)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def loss_and_gradient(number: np.ndarray, ends: np.ndarray, label: np.ndarray, scaled: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss, summed, and its gradient for rows whose feature numbers end at ``ends``; the last weight is the intercept.

    ``scaled`` holds the ratios of the numbered features.
    """
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    z = np.bincount(row, (scaled * weight[:-1])[number], len(ends)) + weight[-1]
    loss = float(np.sum(np.logaddexp(0, z) - label * z))
    slope = logistic(z) - label
    return loss, np.append(np.bincount(number, slope[row], len(scaled)) * scaled, slope.sum())


def minimise(start: np.ndarray, value: Callable[[np.ndarray], tuple[float, np.ndarray]], steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving until the value falls; ends where the gradient is flat."""
    x = start
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, alphas = -g, []
        for s, y in reversed(past):
            a = (s @ direction) / (y @ s)
            alphas.append(a)
            direction = direction - a * y
        if past:
            s, y = past[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            direction = direction + s * (a - (y @ direction) / (y @ s))
        slope, size = float(g @ direction), 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(g)))
        if slope > -1e-9:
            break
        while True:
            new = x + size * direction
            f_new, g_new = value(new)
            if f_new <= f + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if f_new >= f:
            break
        if (new - x) @ (g_new - g) > 1e-12:
            past = [*past, (new - x, g_new - g)][-memory:]
        done = f - f_new < 1e-5 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def train(texts: DataFrame, penalty: float = 1.0, steps: int = 30) -> Classifier:
    """Fit the classifier to (text, label) rows, of which there must be a bounded number; see :func:`toxicity`.

    Without rows of both classes every score is the share of toxic rows, one half without any row.
    """
    size = 1 << BITS
    counts, held = np.zeros((2, size)), np.zeros(2)
    for r in texts.mapInArrow(_counts, "label long, texts long, counts binary").collect():
        counts[r.label] += np.frombuffer(r.counts, np.int32)
        held[r.label] += r.texts
    ratio = log_count_ratios(counts, held)
    prior = math.log((held[1] + 0.5) / (held[0] + 0.5))
    if not held.all() or not ratio.any():
        return Classifier(np.zeros(size), prior)
    used = np.flatnonzero(ratio)
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(len(used))

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            row, feature = present(batch.column(batch.schema.get_field_index("text")), number >= 0)
            label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            ends = np.searchsorted(row, np.arange(batch.num_rows), "right")
            packed = [x.astype(kind).tobytes() for x, kind in ((label, np.int8), (ends, np.int32), (number[feature], np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["labels", "ends", "numbers"])

    rows = cut_lineage(texts.mapInArrow(numbered, "labels binary, ends binary, numbers binary"))
    scaled = ratio[used]

    def value(weight: np.ndarray) -> tuple[float, np.ndarray]:
        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, gradient = 0.0, np.zeros(len(weight))
            for batch in batches:
                for packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    label, ends, numbers = (np.frombuffer(x, kind) for x, kind in zip(packed, (np.int8, np.int32, np.int32), strict=True))
                    more, part = loss_and_gradient(numbers, ends, label, scaled, weight)
                    loss, gradient = loss + more, gradient + part
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "gradient"])

        parts = sorted(rows.mapInArrow(partial, "loss double, gradient binary").collect())
        # The penalty holds the weights of the scaled features near zero, not the intercept.
        loss = sum(p.loss for p in parts) + penalty / 2 * float(weight[:-1] @ weight[:-1])
        return loss, sum(np.frombuffer(p.gradient) for p in parts) + penalty * np.append(weight[:-1], 0)

    best = minimise(np.append(np.zeros(len(used)), prior), value, steps)
    found = np.zeros(size)
    found[used] = scaled * best[:-1]
    return Classifier(found, float(best[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int) -> DataFrame:
    """(text, label) of at most ``sample`` labelled documents that are not held out, chosen by a hash of their id.

    An id with several labels is toxic if one says so. The chosen ids are at most ``sample`` rows, so they are
    broadcast, and no text is shuffled but those of the sample.
    """
    known = take(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null").where(~held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("long")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", (F.col("label") > 0).cast("long").alias("label")).repartition(SAMPLE_TASKS)


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    return F.crc32(doc_id.cast("long").cast("string")) % divisor


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 4, fold: int = 2, sample: int = 20_000, penalty: float = 1.0, limit: float = 0.3
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; labels come as (doc_id, toxic).

    A row is held out if crc32 of its id as text leaves ``fold`` modulo ``folds``; its label is never read. At most
    ``sample`` of the other labelled rows are learnt from. The score is the probability of being toxic, from the whole
    text alone; ``predicted`` is 1 from ``limit`` on. A null or empty text scores by the intercept. Rows without an id
    are not held out and not learnt from; labels without a document or value have no effect. Repeated rows score the
    same each. Without labels of both classes all scores are equal; an empty table gives no rows.
    """
    plain = take(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), folds) == fold, F.lit(False))
    model = train(cut_lineage(labelled_sample(plain, labels, held_out, sample)), penalty)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            score = np.round(model.scores(batch.column(1)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["doc_id", "held_out", "score"])

    scored = plain.withColumn("held_out", held_out).mapInArrow(work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))
