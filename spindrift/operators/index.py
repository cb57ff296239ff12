"""A stored inverted index with block maxima, and top-k search that skips blocks.

Documents are dealt to shards and numbered there. A shard keeps, for each term, its postings cut at fixed ranges of
document numbers, and for each such block the highest impact in it. A query adds these maxima up to a bound for every
range, visits ranges from the highest bound down, and ends as soon as the next bound lies under its k-th best score: all
further blocks are skipped unread. Results equal those of scoring every posting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, tokens
from ..session import cut_lineage
from .ranking import SCORE_DIGITS

#: Documents of one range; a block holds the postings of one term in one range.
RANGE_DOCS = 64
#: Documents of one shard, at most about.
SHARD_DOCS = 16_384
#: Words that one task numbers at once, and a range of documents more.
SLICE_WORDS = 1 << 20
#: Queries that one task scores at most about, for one shard.
QUERY_PART = 500

POSTINGS = "shard int, term string, df long, ranges array<int>, peaks array<double>, starts array<int>, docs array<int>, impacts array<double>"

FOUND = "kind string, query_id long, key long, name string, value string, score double, n long, skipped long"


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def shard_postings(table: pa.Table, average: float, k1: float, b: float, range_docs: int) -> pa.Table:
    """Postings of one slice of a shard, a row for each term, from rows (shard, local, words)."""
    local = table.column("local").to_numpy().astype(np.int64)
    words = table.column("words").combine_chunks()
    length = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    code = words.flatten().dictionary_encode()
    n = int(local.max(initial=-1)) + 1
    sizes = np.zeros(n, np.int64)
    sizes[local] = length
    pairs, tf = np.unique(code.indices.to_numpy().astype(np.int64) * n + np.repeat(local, length), return_counts=True)
    term, doc = pairs // max(n, 1), pairs % max(n, 1)
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / average))
    opens = np.flatnonzero(np.diff(term * (n // range_docs + 1) + doc // range_docs, prepend=-1))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    block_ends = np.searchsorted(opens, np.append(first[1:], len(term)))
    starts = opens - np.repeat(first, np.diff(block_ends, prepend=0))
    ends = np.append(first[1:], len(term))
    return pa.table(
        {
            "shard": pa.array(np.full(len(first), table.column("shard")[0].as_py()), pa.int32()),
            "term": code.dictionary.take(pa.array(term[first])),
            "df": pa.array(np.diff(ends, prepend=0), pa.int64()),
            "ranges": _lists(block_ends, doc[opens] // range_docs, pa.int32()),
            "peaks": _lists(block_ends, np.maximum.reduceat(impact, opens) if len(opens) else impact, pa.float64()),
            "starts": _lists(block_ends, starts, pa.int32()),
            "docs": _lists(ends, doc, pa.int32()),
            "impacts": _lists(ends, impact, pa.float64()),
        }
    )


@dataclass(frozen=True)
class SearchIndex:
    """Where an index lies and the figures its scores depend on."""

    path: str
    documents: int
    range_docs: int
    attributes: tuple[str, ...]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def build_index(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    attributes: Sequence[str] = (),
    k1: float = 1.2,
    b: float = 0.75,
    stop_words: Sequence[str] = STOP_WORDS,
    range_docs: int = RANGE_DOCS,
    shards: int | None = None,
) -> SearchIndex:
    """Write the index of ``docs`` under ``path``: documents with their attributes, postings, terms.

    Numbers follow the length of a document inside its shard, so short documents, whose impacts are high, share ranges.
    ``shards`` follows the number of rows and the shuffle partitions. Postings are made by slices of a shard, which hold
    whole ranges and a bounded number of words, so a term has a row for each slice.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or max(least, -(-docs.count() // SHARD_DOCS))
    rows = docs.select(F.col(key).cast("long").alias("key"), tokens(F.col(text), stop_words).alias("words"), *attributes)
    # A null text has no length and takes no part in the average.
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"), "length": F.size("words")})
    rows = rows.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    order = Window.partitionBy("shard").orderBy("length", "key")
    before = F.coalesce(F.sum(F.size("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"local": F.row_number().over(order) - 1, "before": before})
    opened = F.last(F.when(F.col("local") % range_docs == 0, F.col("before")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = cut_lineage(rows.withColumn("slice", F.floor(opened / SLICE_WORDS).cast("int")).drop("before"))
    stats = numbered.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).first()
    numbered.drop("words", "slice").write.parquet(f"{path}/documents")
    average = stats["average"] or 1.0
    postings = numbered.select("shard", "slice", "local", "words").groupBy("shard", "slice").applyInArrow(lambda t: shard_postings(t, average, k1, b, range_docs), POSTINGS)
    # Rows by term inside each file, so that a scan for a few terms skips row groups.
    postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    index = SearchIndex(path, stats["n"], range_docs, tuple(attributes))
    index.table(spark, "postings").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/terms")
    return index


@dataclass
class _Term:
    ranges: np.ndarray
    peaks: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray

    def inside(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the blocks in the chosen ranges, which ascend."""
        at = np.minimum(np.searchsorted(self.ranges, chosen), len(self.ranges) - 1)
        at = at[self.ranges[at] == chosen]
        low, high = self.starts[at], np.append(self.starts[1:], len(self.docs))[at]
        sizes = high - low
        place = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        return self.docs[place], self.impacts[place]


def best_of_shard(parts: list[tuple[_Term, float]], allowed: np.ndarray, k: int, range_docs: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(documents, scores, visited blocks, blocks) of the k best allowed documents; ties fall to the smaller key."""
    n_ranges = -(-len(allowed) // range_docs)
    bound, blocks = np.zeros(n_ranges), np.zeros(n_ranges, np.int64)
    for term, weight in parts:
        bound[term.ranges] += weight * term.peaks
        blocks[term.ranges] += 1
    opens = np.add.reduceat(allowed, np.arange(0, len(allowed), range_docs)) > 0 if len(allowed) else np.zeros(0, bool)
    order = np.argsort(-bound, kind="stable")
    order = order[(bound[order] > 0) & opens[order]]
    docs, scores = np.zeros(0, np.int64), np.zeros(0)
    first, step, visited = 0, 4, 0
    # Scores are compared rounded, so a bound must lie under the last one by more than that.
    slack = 10.0**-SCORE_DIGITS
    while first < len(order):
        if len(docs) == k:
            step = min(step, int(np.count_nonzero(bound[order[first : first + step]] >= scores[-1] - slack)))
            if not step:
                break
        chosen = np.sort(order[first : first + step])
        first, step = first + step, 2 * step
        visited += int(blocks[chosen].sum())
        total = np.zeros(len(chosen) * range_docs)
        for term, weight in parts:
            doc, impact = term.inside(chosen)
            total += np.bincount(np.searchsorted(chosen, doc // range_docs) * range_docs + doc % range_docs, weight * impact, len(total))
        place = np.flatnonzero(total)
        doc = chosen[place // range_docs] * range_docs + place % range_docs
        use = allowed[doc]
        docs, scores = np.append(docs, doc[use]), np.append(scores, np.round(total[place[use]], SCORE_DIGITS))
        best = np.lexsort((keys[docs], -scores))[:k]
        docs, scores = docs[best], scores[best]
    return docs, scores, visited, int(blocks.sum())


def _search_shard(hits: pa.Table, documents: pa.Table, k: int, range_docs: int, facets: Sequence[str], order: str | None, descending: bool, counted: bool) -> pa.Table:
    """Scores all queries of a part over one shard, given its allowed documents and the postings of the queries' terms."""
    found = {c: [] for c in ("kind", "query_id", "key", "name", "value", "score", "n", "skipped")}

    def add(kind: str, query: int, **values: object) -> None:
        for name, column in found.items():
            column.append(values.get(name))
        found["kind"][-1], found["query_id"][-1] = kind, query

    local = documents.column("local").to_numpy()
    postings = {name: hits.column(name).to_pylist() if name == "users" else hits.column(name).combine_chunks() for name in ("users", "ranges", "peaks", "starts", "docs", "impacts")}
    size = int(local.max(initial=-1)) + 1
    queries: dict[int, list[tuple[_Term, float]]] = {}
    for i, users in enumerate(postings["users"]):
        term = _Term(*(postings[c][i].values.to_numpy() for c in ("ranges", "peaks", "starts", "docs", "impacts")))
        size = max(size, int(term.docs[-1]) + 1)
        for user in users:
            queries.setdefault(user["query_id"], []).append((term, user["idf"]))
    allowed, keys = np.zeros(size, bool), np.zeros(size, np.int64)
    allowed[local], keys[local] = True, documents.column("key").to_numpy()
    values = {}
    for name in facets:
        code = documents.column(name).combine_chunks().dictionary_encode()
        values[name] = code.dictionary.to_pylist(), np.full(size, -1)
        values[name][1][local] = code.indices.fill_null(-1).to_numpy()
    if order:
        sort = np.full(size, np.nan)
        sort[local] = documents.column(order).to_numpy()
    for query, parts in sorted(queries.items()):
        if counted:
            matched = np.zeros(size, bool)
            for term, _ in parts:
                matched[term.docs] = True
            matched = np.flatnonzero(matched & allowed)
            add("total", query, n=len(matched))
            for name, (names, code) in values.items():
                held = code[matched]
                for v, n in enumerate(np.bincount(held[held >= 0], minlength=len(names)).tolist()):
                    if n:
                        add("facet", query, name=name, value=names[v], n=n)
        if order:
            # Rows without a value come last either way.
            by = np.where(np.isnan(sort[matched]), np.inf, -sort[matched] if descending else sort[matched])
            for doc in matched[np.lexsort((keys[matched], by))[:k]].tolist():
                value = sort[doc]
                add("hit", query, key=int(keys[doc]), score=None if np.isnan(value) else float(value))
        else:
            docs, scores, visited, blocks = best_of_shard(parts, allowed, k, range_docs, keys)
            for doc, score in zip(docs.tolist(), scores.tolist(), strict=True):
                add("hit", query, key=int(keys[doc]), score=score)
            add("blocks", query, n=visited, skipped=blocks - visited)
    kinds = {"query_id": pa.int64(), "key": pa.int64(), "score": pa.float64(), "n": pa.int64(), "skipped": pa.int64()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.string())) for c, v in found.items()})


@dataclass(frozen=True)
class Found:
    """What a batch of requests returns."""

    hits: DataFrame
    totals: DataFrame
    facets: DataFrame
    blocks: DataFrame


def search_index(
    index: SearchIndex,
    queries: DataFrame,
    top: int = 10,
    skip: int = 0,
    where: Column | None = None,
    facets: Sequence[str] = (),
    order_by: str | None = None,
    descending: bool = True,
    total: bool = False,
    query_key: str = "query_id",
    query_text: str = "query",
    stop_words: Sequence[str] = STOP_WORDS,
) -> Found:
    """Requests for a batch of queries over the documents that pass ``where``, a condition on the index's attributes.

    ``hits``: (query_id, key, score, rank), the rows ``skip + 1`` to ``skip + top`` by score, ties by key; with
    ``order_by`` by that numeric attribute, which is then the score, rows without one last. ``totals``: (query_id, total)
    of all documents that hold a term; ``facets``: (query_id, facet, value, count) of these. ``blocks``: (query_id,
    visited, skipped) of posting blocks. Totals and facets read the document numbers of all blocks, scores do not.

    Term statistics are those of the whole index, whatever the filter. A query without a known term has no row.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_key).cast("long").alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text), stop_words))).alias("term")).distinct()
    idf = F.log((index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")
    parts = -(-queries.count() // QUERY_PART) or 1
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    weighted = asked.join(index.table(spark, "terms"), "term").select("query_id", "term", idf, part)
    # A part holds a bounded number of queries, and so does the list beside a posting row.
    users = weighted.groupBy("part", "term").agg(F.collect_list(F.struct("query_id", "idf")).alias("users"))
    hits = index.table(spark, "postings").join(users, "term")
    documents = index.table(spark, "documents")
    documents = documents.filter(where) if where is not None else documents
    attributes = [F.col(f).cast("string").alias(f) for f in facets]
    attributes += [F.col(order_by).cast("double").alias("_order")] if order_by else []
    side = documents.select("shard", "local", "key", *attributes).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    counted, order = bool(total or facets or order_by), "_order" if order_by else None
    names, k, width = list(facets), skip + top, index.range_docs
    work = lambda h, d: _search_shard(h, d, k, width, names, order, descending, counted)
    found = cut_lineage(hits.groupBy("shard", "part").cogroup(side.groupBy("shard", "part")).applyInArrow(work, T.StructType.fromDDL(FOUND)))
    best = F.desc_nulls_last("score") if descending or not order_by else F.asc_nulls_last("score")
    ranking = Window.partitionBy("query_id").orderBy(best, "key")
    ranked = found.filter("kind = 'hit'").select("query_id", "key", "score").withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank").between(skip + 1, k))
    sums = found.groupBy("query_id", "kind", "name", "value").agg(F.sum("n").alias("n"), F.sum("skipped").alias("skipped"))
    return Found(
        ranked,
        sums.filter("kind = 'total'").select("query_id", F.col("n").alias("total")),
        sums.filter("kind = 'facet'").select("query_id", F.col("name").alias("facet"), "value", F.col("n").alias("count")),
        sums.filter("kind = 'blocks'").select("query_id", F.col("n").alias("visited"), "skipped"),
    )
