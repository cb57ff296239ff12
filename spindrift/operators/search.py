"""Keyword search (BM25), rank fusion and prefix suggestions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, tokens
from .ranking import SCORE_DIGITS


def text_search(
    docs: DataFrame,
    queries: DataFrame,
    n: int = 10,
    key: str = "doc_id",
    text: str = "text",
    query_key: str = "query_id",
    query_text: str = "query",
    k1: float = 1.2,
    b: float = 0.75,
    stop_words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """BM25 ranking of documents for a batch of queries: (query_id, doc_id, score, rank).

    Only postings of query terms survive the semi-join in front of the count.
    Scores are summed per (query, document) with a partial aggregate, and the
    top-n filter prunes each query's list before its shuffle. The term join is
    left to Spark: a small query batch becomes a broadcast, and AQE splits a
    term shared by much of the corpus.
    """
    words = docs.select(key, tokens(F.col(text), stop_words).alias("w"))
    wanted = queries.select(
        query_key, F.explode(F.array_distinct(tokens(F.col(query_text), stop_words))).alias("term")
    )
    stats = words.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg"))).scalar()
    matched = (
        words.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
        .join(wanted.select("term").distinct(), "term", "left_semi")
        .groupBy(key, "length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    frequency = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = frequency.select(
        "term", F.log((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")
    )
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / stats["avg"]))
    scored = (
        matched.join(wanted.join(weights, "term"), "term")
        .groupBy(query_key, key)
        .agg(F.round(F.sum(F.col("idf") * saturation), SCORE_DIGITS).alias("score"))
    )
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def reciprocal_rank_fusion(
    first: DataFrame, second: DataFrame, query_key: str = "query_id", key: str = "doc_id", n: int = 10, c: int = 60
) -> DataFrame:
    """Fuse two ranked lists: the score of a row is the sum of 1 / (c + rank) over the lists that hold it."""
    keys = [query_key, key]
    both = first.select(*keys, F.col("rank").alias("text_rank")).join(
        second.select(*keys, F.col("rank").alias("vector_rank")), keys, "full_outer"
    )
    score = F.coalesce(1 / (c + F.col("text_rank")), F.lit(0.0)) + F.coalesce(
        1 / (c + F.col("vector_rank")), F.lit(0.0)
    )
    scored = both.withColumn("score", F.round(score, SCORE_DIGITS))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def prefix_table(counted: DataFrame, n: int) -> DataFrame:
    """Add ``prefix`` and ``rank``: the ``n`` most frequent values of every prefix, of any length.

    ``counted`` has one row per distinct value, so prefixes fan out from distinct
    values only, and the window prunes each prefix to ``n`` in the map tasks.
    """
    lengths = F.sequence(F.lit(1), F.length("value"))
    fanned = counted.filter(F.length("value") > 0).withColumn(
        "prefix", F.explode(F.transform(lengths, lambda i: F.substring("value", 1, i)))
    )
    order = Window.partitionBy("prefix").orderBy(F.desc("count"), F.asc("value"))
    return (
        fanned.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("prefix", *counted.columns, "rank")
    )


def suggest(items: DataFrame, title: str = "title", n: int = 5, key: str = "item_id", category: str = "category") -> DataFrame:
    """Top titles for every title prefix, case-insensitive, with the smallest id of the title and its category."""
    first = F.min(F.struct(F.col(key), F.col(category)))
    counted = items.groupBy(F.lower(title).alias("value")).agg(F.count(F.lit(1)).alias("count"), first.alias("_f"))
    return prefix_table(counted.select("value", "count", f"_f.{key}", f"_f.{category}"), n)


def autocomplete(docs: DataFrame, text: str = "text", n: int = 5) -> DataFrame:
    """Most frequent completions of every term prefix of the corpus."""
    terms = docs.select(F.explode(tokens(F.col(text), ())).alias("value"))
    return prefix_table(terms.groupBy("value").agg(F.count(F.lit(1)).alias("count")), n)
