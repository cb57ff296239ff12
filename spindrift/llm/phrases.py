"""Phrase collocations from an FM-index per shard over word ids.

Documents are dealt to shards. A shard keeps its words as numbers and indexes them twice, forwards and backwards: the
Burrows-Wheeler transform of each direction holds the words beside every occurrence. A phrase is a pair of intervals, one
in each index, and reading one transform inside its interval gives all its extensions on that side with their counts and
intervals. Counts are summed across shards in hash buckets, which tell each shard what can be frequent before it goes
deeper: first words, then pairs of such words; what remains of the texts are chains of such pairs, in which the longer
phrases are enumerated by turns to the left and to the right. Until then sums by hash suffice, as a collision only adds;
at last the phrases travel as text and their sums are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.session import cut_lineage

from .buffers import mix, slices, span_hashes, take, text_bytes, word_spans
from .graph import bucket_count, bucket_cuts, by_group, with_replies
from .packed import QUESTION, REPLY, answer, flags_for, replies_of, unpack_all

#: Characters that end a piece, and those that end a word inside one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"

ASK = "slot int, bucket int, keys array<string>, counts array<long>"

#: Occurrences that are extended at once.
OCCURRENCES = 1 << 19

#: The group of asks that holds the shards' word counts by language.
TOTALS = -1


def _flags(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


_PIECE, _OUTSIDE = _flags(PIECE_ENDS), _flags(PIECE_ENDS + WORD_ENDS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def context_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an integer text in the order of their first ``depth`` symbols; zeros follow its end."""
    bits = max(1, int(text.max(initial=0)).bit_length())
    step = 63 // bits
    keys = []
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    for first in range(0, depth, step):
        key = np.zeros(len(text), np.int64)
        for j in range(first, min(first + step, depth)):
            key = (key << bits) | padded[j : j + len(text)]
        keys.append(key)
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


class Transform:
    """The Burrows-Wheeler transform of one direction: beside each sorted suffix the symbol before it, and its place.

    Suffixes are sorted by ``depth`` symbols only. The intervals of phrases of up to that many symbols are still exact.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.symbol = text[context_order(text, depth) - 1]
        order = np.argsort(self.symbol, kind="stable")
        self.place = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
        self.place[order] = np.arange(len(order))


@dataclass
class Phrases:
    """Phrases of one length: symbols, first places of their intervals in both indexes, and occurrences."""

    symbols: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray


class BidirectionalIndex:
    """Both transforms of a text of positive symbols, in which zeros stand before, after and between the pieces."""

    def __init__(self, text: np.ndarray, depth: int):
        if len(text) and (text[0] or text[-1]):
            raise ValueError("the text must begin and end with a zero")
        self.text, self.depth, self.size = text, depth, int(text.max(initial=0)) + 1
        self.counts = np.bincount(text, minlength=self.size)

    @cached_property
    def forward(self) -> Transform:
        return Transform(self.text, self.depth)

    @cached_property
    def backward(self) -> Transform:
        return Transform(self.text[::-1], self.depth)

    def words(self) -> Phrases:
        """The phrases of one symbol."""
        symbol = np.flatnonzero(self.counts[1:]) + 1
        low = (np.cumsum(self.counts) - self.counts)[symbol]
        return Phrases(symbol[:, None], low, low.copy(), self.counts[symbol])

    def left(self, phrases: Phrases) -> Phrases:
        """All phrases with one more symbol in front, and how often each occurs."""
        owner, symbol, count, own, other = self._extend(self.forward, phrases.forward, phrases.backward, phrases.count)
        return Phrases(np.column_stack([symbol, phrases.symbols[owner]]), own, other, count)

    def right(self, phrases: Phrases) -> Phrases:
        """All phrases with one more symbol at the end, and how often each occurs."""
        owner, symbol, count, own, other = self._extend(self.backward, phrases.backward, phrases.forward, phrases.count)
        return Phrases(np.column_stack([phrases.symbols[owner], symbol]), other, own, count)

    def _extend(self, side: Transform, low: np.ndarray, other: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Backward search with every symbol that stands in the intervals [low, low + count) of one transform.

        In the other direction's index the new intervals lie side by side inside the old ones, in order of the symbol.
        """
        total, first, parts = np.cumsum(count), 0, [tuple(np.zeros(0, np.int64) for _ in range(5))]
        while first < len(low):
            last = max(first + 1, int(np.searchsorted(total, total[first] - count[first] + OCCURRENCES, "right")))
            owner, *found = self._extend_some(side, low[first:last], other[first:last], count[first:last])
            parts.append((owner + first, *found))
            first = last
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _extend_some(self, side: Transform, low: np.ndarray, other: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        heads = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(low)), count)
        at = np.arange(len(owner)) + np.repeat(low - heads, count)
        key = owner * np.int64(self.size) + side.symbol[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        found = np.diff(np.append(fresh, len(key)))
        owner, symbol = key[fresh] // self.size, key[fresh] % self.size
        own = side.place[at[order[fresh]]].astype(np.int64)
        beside = other[owner] + fresh - heads[owner]
        inside = symbol > 0
        return owner[inside], symbol[inside], found[inside], own[inside], beside[inside]


class _Shard:
    """Words of a shard: distinct (language, word) keys in a fixed order, their counts, and the texts as their numbers.

    Equal in every pass but for the order of pieces, which no count depends on.
    """

    def __init__(self, table: pa.Table):
        words, langs, sequence, opens = [], [], [], []
        code = pc.fill_null(table.column("lang"), "und").combine_chunks().dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        table = pa.table({"text": table.column("text"), "code": code.indices})
        for batch in slices(table.to_batches(), "text", 1 << 20):
            body, offsets = text_bytes(batch.column(0))
            body = _LOWER[body]
            starts, ends, firsts = word_spans(body, offsets, _OUTSIDE)
            if not len(starts):
                continue
            cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            data = pa.py_buffer(body[~_OUTSIDE[body]])
            words.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), data).dictionary_encode())
            piece = np.searchsorted(np.flatnonzero(_PIECE[body]), starts)
            row = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            opens.append((np.diff(piece, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            langs.append(batch.column(1).to_numpy()[row])
        if not words:
            words, langs, opens = [pa.array([], pa.string()).dictionary_encode()], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
        merged = pa.chunked_array(words).unify_dictionaries()
        names = merged.chunk(0).dictionary
        number = np.concatenate([c.indices.to_numpy() for c in merged.chunks]).astype(np.int64)
        lang, opens = np.concatenate(langs), np.concatenate(opens)
        pairs, sequence, count = np.unique(lang * np.int64(max(1, len(names))) + number, return_inverse=True, return_counts=True)
        self.words = names.take(pa.array(pairs % max(1, len(names))))
        keys = pc.binary_join_element_wise(code.dictionary.cast(pa.string()).take(pa.array(pairs // max(1, len(names)))), self.words, "\n")
        body, offsets = text_bytes(keys)
        h = span_hashes(body, offsets[:-1], offsets[1:])
        order = _ordered(keys, h)
        self.h = h[order]
        self.keys, self.words, self.counts = keys.take(order), self.words.take(order), count[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        # One zero before every piece and one after the last.
        place = np.arange(len(sequence)) + np.cumsum(opens)
        self.text = np.zeros(len(sequence) + int(opens.sum()) + 1, np.int32)
        self.text[place] = rank[sequence]
        self.totals = dict(zip(code.dictionary.to_pylist(), np.bincount(lang, minlength=len(code.dictionary)).tolist(), strict=True))

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, hashes and counts of all pairs of frequent words, in a fixed order."""
        known = np.concatenate([[False], frequent])
        self.text = _tidy(np.where(known[self.text], self.text, 0))
        used = np.unique(self.text)
        dense = np.searchsorted(used, self.text).astype(np.int32)
        index = BidirectionalIndex(dense, 2)
        found = index.right(index.words())
        return self.in_order(used[found.symbols], found.count)

    def in_order(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of one length, their hashes and counts in an order that depends on nothing but the phrases."""
        h = self.h[symbols[:, 0] - 1]
        for c in symbols.T[1:]:
            h = mix(h * _STEP + self.h[c - 1])
        order = np.argsort(h, kind="stable")
        if (h[order][1:] == h[order][:-1]).any():
            order = _ordered(self.phrase_keys(symbols), h)
        return symbols[order], h[order], counts[order]

    def longer(self, pairs: np.ndarray, frequent: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Symbols, hashes and counts of the phrases of 3 to ``longest`` words all of whose pairs are frequent, by length."""
        base = np.int64(len(self.keys) + 1)
        wanted = np.sort(pairs[frequent, 0] * base + pairs[frequent, 1])
        here = self.text[:-1] * base + self.text[1:]
        at = np.minimum(np.searchsorted(wanted, here), max(0, len(wanted) - 1))
        joined = wanted[at] == here if len(wanted) else np.zeros(len(here), bool)
        # A zero goes between two words that are no frequent pair.
        opens = np.concatenate([[False], ~joined])
        place = np.arange(len(self.text)) + np.cumsum(opens)
        chains = np.zeros(len(self.text) + int(opens.sum()) + 1, np.int64)
        chains[place] = self.text
        chains = _tidy(chains)
        used = np.unique(chains)
        index = BidirectionalIndex(np.searchsorted(used, chains).astype(np.int32), longest)
        found, out = index.right(index.words()), []
        for n in range(3, longest + 1):
            found = index.left(found) if n % 2 else index.right(found)
            out.append(self.in_order(used[found.symbols], found.count))
        return out

    def phrase_keys(self, symbols: np.ndarray) -> pa.Array:
        """The language, a line break, and the words joined by spaces."""
        first, *rest = (pa.array(c - 1) for c in symbols.T)
        return pc.binary_join_element_wise(self.keys.take(first), *[self.words.take(c) for c in rest], " ")


def _tidy(text: np.ndarray) -> np.ndarray:
    """The text without words that stand alone, runs of zeros cut to one; it begins and ends with a zero."""
    inside = np.concatenate([[0], text, [0]])
    alone = (inside[:-2] == 0) & (inside[2:] == 0)
    text = np.where(alone, 0, text)
    keep = (text > 0) | (np.concatenate([[1], text[:-1]]) > 0)
    text = text[keep]
    if not len(text) or text[0]:
        text = np.concatenate([[0], text])
    return text if not text[-1] else np.concatenate([text, [0]])


def _ordered(keys: pa.Array, h: np.ndarray) -> np.ndarray:
    """The order of distinct keys by hash, and of those with one hash by themselves."""
    return pc.sort_indices(pa.table({"h": pa.array(h), "key": keys}), [("h", "ascending"), ("key", "ascending")]).to_numpy()


def _slot(table: pa.Table) -> int:
    return table.column("slot")[0].as_py()


def _ask_sums(slot: int, buckets: int, h: np.ndarray, counts: np.ndarray) -> pa.Table:
    """One row for each bucket: 32 bits of its hashes, which are in order, and their counts."""
    cuts, _ = bucket_cuts(h, buckets)
    used = np.flatnonzero(np.diff(cuts))
    low, counts = h.astype(np.uint32), counts.astype(np.int32)
    data = [low[cuts[i] : cuts[i + 1]].tobytes() + counts[cuts[i] : cuts[i + 1]].tobytes() for i in used]
    return pa.table({"slot": pa.array(np.full(len(used), slot), pa.int32()), "bucket": pa.array(used, pa.int32()), "payload": pa.array(data, pa.binary())})


def _ask_words(table: pa.Table, buckets: int) -> pa.Table:
    shard = _Shard(table)
    return _ask_sums(_slot(table), buckets, shard.h, shard.counts)


def _ask_pairs(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    shard = _Shard(table)
    _, h, counts = shard.pairs(flags_for(shard.h, buckets, replies_of(replies, 1)))
    return _ask_sums(_slot(table), buckets, h, counts)


def _reply(table: pa.Table, least: int, stage: int) -> pa.Table:
    """Bucket side: can what was asked be frequent over all shards? Sums by hash are never too small."""
    (low, counts), ends = unpack_all(table, np.uint32, np.int32)
    _, index = np.unique(low, return_inverse=True)
    return answer(table, np.bincount(index, counts)[index] >= least, ends, stage)


def _ask_phrases(table: pa.Table, replies: pa.Table, buckets: int, longest: int) -> pa.Table:
    """Words, pairs and longer phrases that can be frequent, one row for each length and bucket; words by language."""
    shard = _Shard(table)
    words = flags_for(shard.h, buckets, replies_of(replies, 1))
    symbols, h, counts = shard.pairs(words)
    pairs = flags_for(h, buckets, replies_of(replies, 2))
    found = [(np.flatnonzero(words)[:, None] + 1, shard.h[words], shard.counts[words]), (symbols[pairs], h[pairs], counts[pairs])]
    found += shard.longer(symbols, pairs, longest)
    slot, rows = _slot(table), []
    for symbols, h, counts in found:
        cuts, _ = bucket_cuts(h, buckets)
        used = np.flatnonzero(np.diff(cuts))
        ends = pa.array(np.append(cuts[used], len(h)), pa.int32())
        keys = pa.ListArray.from_arrays(ends, shard.phrase_keys(symbols))
        rows.append(pa.table({"slot": pa.array(np.full(len(used), slot), pa.int32()), "bucket": pa.array(used, pa.int32()), "keys": keys, "counts": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))}))
    totals = {"slot": [slot], "bucket": [TOTALS], "keys": [list(shard.totals)], "counts": [list(shard.totals.values())]}
    return pa.concat_tables([*rows, pa.table(totals, schema=rows[0].schema)])


def _frequent(table: pa.Table, least: int) -> pa.Table:
    """Keys with at least that many occurrences over all shards; of the totals by language, all."""
    code = table.column("keys").combine_chunks().flatten().dictionary_encode()
    sums = np.zeros(len(code.dictionary), np.int64)
    np.add.at(sums, code.indices.to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy())
    totals = table.column("bucket")[0].as_py() == TOTALS
    kept = np.flatnonzero((sums >= least) | totals)
    return pa.table({"total": pa.array(np.full(len(kept), totals)), "key": code.dictionary.take(pa.array(kept)), "n": pa.array(sums[kept], pa.int64())})


def phrase_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, words, n, total): all phrases of up to ``longest`` words that occur at least ``least`` times.

    Texts are lower-cased (A-Z), split into pieces at :data:`PIECE_ENDS` and those into words; counts are by language
    (null: ``und``), inside pieces, overlaps included. ``words`` is the phrase as a list, ``total`` the number of all
    words of the language. Null text has no words; repeated rows count each; an empty table gives no rows.
    """
    plain = take(docs, id_=doc_id, text=text, lang=lang)
    buckets = bucket_count(docs)
    slot = F.pmod(F.xxhash64("id_", "text", "lang"), F.lit(buckets)).cast("int").alias("slot")
    rows = plain.select(slot, F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    known = by_group(by_group(rows, "slot", lambda t: _ask_words(t, buckets), QUESTION), "bucket", lambda t: _reply(t, least, 1), REPLY)
    pairs = with_replies(rows, known, lambda t, r: _ask_pairs(t, r, buckets), QUESTION)
    both = known.union(by_group(pairs, "bucket", lambda t: _reply(t, least, 2), REPLY))
    asked = with_replies(rows, both, lambda t, r: _ask_phrases(t, r, buckets, longest), ASK)
    found = cut_lineage(by_group(asked, "bucket", lambda t: _frequent(t, least), "total boolean, key string, n long"))
    phrase = F.substring_index("key", "\n", -1)
    split = found.where("not total").select(F.left("key", F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), F.split(phrase, " ").alias("words"), "n")
    # A language may hold most phrases, so each total is dealt to as many parts.
    totals = found.where("total").select(F.col("key").alias("lang"), F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("part"))
    return split.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(buckets)).cast("int")).join(totals, ["lang", "part"]).drop("part")


def extensions(counts: DataFrame) -> DataFrame:
    """(lang, phrase, left, right): the most frequent extension by one word on each side, where there is one."""
    n = F.size("words")
    ends = counts.where(n > 1).select(
        "lang",
        F.explode(
            F.array(
                F.struct(F.array_join(F.slice("words", 2, n - 1), " ").alias("phrase"), F.col("n").alias("left"), F.lit(None).cast("long").alias("right")),
                F.struct(F.array_join(F.slice("words", 1, n - 1), " ").alias("phrase"), F.lit(None).cast("long").alias("left"), F.col("n").alias("right")),
            )
        ).alias("e"),
    )
    return ends.groupBy("lang", "e.phrase").agg(F.max("e.left").alias("left"), F.max("e.right").alias("right"))


def collocations(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, covered: int = 100, top: int = 2000
) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score, left, right).

    Candidates are the phrases of 2 to ``longest`` words with a >= ``least`` occurrences. A cut after the first words
    gives l = occurrences of the first part, r = of the rest, and floor(1000 a n / (l r)) with n all words of the
    language; the cut with the lowest score counts, among equals the earliest. A candidate goes if a longer one that
    holds its words has at least ``covered`` percent of its occurrences: the extension by one word has no fewer than any
    longer one, so ``left`` and ``right``, the most frequent such extensions among candidates, decide. Ordered by score,
    then a, both descending, then phrase; see :func:`phrase_counts` for edge rows.
    """
    counts = phrase_counts(docs, doc_id, text, lang, longest, least)
    n = F.size("words")
    parts = counts.where(n > 1).select("lang", "phrase", "words", F.col("n").alias("a"), F.col("total").alias("n"), F.explode(F.sequence(F.lit(1), n - 1)).alias("cut"))
    rest = F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut"))
    parts = parts.select("lang", "phrase", "a", "n", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(rest, " ").alias("rest"))
    heads = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    scored = parts.join(heads, ["lang", "first"]).join(tails, ["lang", "rest"]).select("lang", "phrase", "a", "n", "cut", "l", "r", *[v.alias(f"{c}_") for c, v in wide.items()])
    score = F.expr("(1000BD * a_ * n_) div (l_ * r_)").alias("score")
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score, "cut", "l", "r")).alias("best"))
    kept = lowest.join(extensions(counts), ["lang", "phrase"], "left").where(F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))) * 100 < F.col("a") * covered)
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score", "left", "right")
