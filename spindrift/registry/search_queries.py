"""TF-IDF, content similarity, content recommendations, search, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, combined_text
from ..functions.catalog import document_predicate
from ..operators import features, index, search, similarity, tfidf, vectors
from ..sources import tables
from .base import add_view, query
from .cleaning_queries import clean
from .source_queries import scratch

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens_sql(text: str) -> str:
    return (
        "list_filter(regexp_extract_all(lower(" + text + r"), '[\p{L}\p{N}_]{2,}'), "
        f"lambda x: NOT list_contains({STOP}, x))"
    )


add_view(
    "terms",
    f"""
SELECT item_id, term, count(*) AS tf FROM (
  SELECT item_id, unnest(w || CASE WHEN len(w) > 1
           THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS term
  FROM (SELECT item_id, {tokens_sql("title || ' ' || description || ' ' || genre || ' ' || tags")} AS w FROM content))
GROUP BY item_id, term""",
)
add_view(
    "vocab",
    """
SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1 AS idf FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM terms GROUP BY term)
WHERE df >= 5 AND df <= 0.8 * (SELECT count(*) FROM part) ORDER BY total DESC, term LIMIT 5000""",
)
add_view(
    "weights",
    """
SELECT item_id, t.term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS w
FROM terms t JOIN vocab v ON t.term = v.term""",
)
add_view(
    "content_sim",
    """
SELECT item_id, similar_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id)
         AS INTEGER) AS rank FROM (
  SELECT a.item_id, b.item_id AS similar_id, round(sum(a.w * b.w), 6) AS score
  FROM weights a JOIN weights b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY 1, 2)
WHERE score >= 0.1 QUALIFY rank <= 10""",
)
add_view(
    "content_rec20",
    """
SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER)
         AS rank FROM (
  SELECT p.user_id, v.item_id, round(sum(p.w * v.w), 6) AS score
  FROM (SELECT r.user_id, w.term, sum(r.rating * w.w) AS w FROM ratings r JOIN weights w ON r.item_id = w.item_id
        WHERE r.rating > 3 GROUP BY 1, 2) p
  JOIN weights v ON p.term = v.term GROUP BY 1, 2) s
WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = s.user_id AND r.item_id = s.item_id)
QUALIFY rank <= 20""",
)


def item_vectors(spark, sf):
    """TF-IDF rows of the catalogue with the whole description texts."""
    items = tables.content(spark, sf, with_text=True)
    return tfidf.tfidf_vectors(
        items.select("item_id", combined_text("title", "description", "genre", "tags").alias("text"))
    )


def ratings(spark, sf):
    return features.interaction_matrix(clean(spark, sf))


@query("tfidf", "SELECT item_id AS id, term, round(w, 6) AS weight FROM weights")
def _(spark, sf):
    items = tables.content(spark, sf, with_text=True)
    docs = items.select("item_id", combined_text("title", "description", "genre", "tags").alias("text"))
    return tfidf.tfidf(docs)


@query(
    "tfidf_discovery",
    f"""
WITH t AS (SELECT item_id, term, count(*) AS tf FROM (
  SELECT item_id, unnest({tokens_sql("title || ' ' || description || ' ' || genre || ' ' || array_to_string(keywords, ' ')")})
         AS term FROM content) GROUP BY item_id, term),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1 AS idf FROM (
        SELECT term, count(*) AS df, sum(tf) AS total FROM t GROUP BY term) ORDER BY total DESC, term LIMIT 1000)
SELECT item_id AS id, t.term,
       round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)), 6) AS weight
FROM t JOIN v ON t.term = v.term""",
)
def _(spark, sf):
    items = tables.content(spark, sf, with_text=True)
    text = F.concat_ws(" ", "title", "description", "genre", F.array_join("keywords", " "))
    docs = items.select("item_id", text.alias("text"))
    return tfidf.tfidf(docs, bigrams=False, min_df=1, max_df=1.0, max_terms=1000)


def named_similarity(df):
    return df.select(F.col("left_id").alias("item_id"), F.col("right_id").alias("similar_id"), "score", "rank")


@query("content_similarity", "SELECT item_id, similar_id, score, rank FROM content_sim")
def _(spark, sf):
    return named_similarity(tfidf.content_similarity(item_vectors(spark, sf)))


@query(
    "similar_by_content",
    """
SELECT s.item_id, s.similar_id, s.score, s.rank, i.title, i.category, i.genre
FROM content_sim s JOIN items i ON s.similar_id = i.item_id WHERE s.rank <= 5""",
)
def _(spark, sf):
    pairs = named_similarity(tfidf.content_similarity(item_vectors(spark, sf), k=5))
    items = tables.content(spark, sf).select(F.col("item_id").alias("similar_id"), "title", "category", "genre")
    return pairs.join(items, "similar_id")


@query("content_recs", "SELECT user_id, item_id, score, rank FROM content_rec20 WHERE rank <= 10")
def _(spark, sf):
    return tfidf.content_recs(ratings(spark, sf), item_vectors(spark, sf))


@query(
    "discover_similar",
    """
SELECT c.user_id, c.item_id, c.score, c.rank, i.title, i.genre, i.popularity
FROM content_rec20 c JOIN items i ON c.item_id = i.item_id""",
)
def _(spark, sf):
    recs = tfidf.content_recs(ratings(spark, sf), item_vectors(spark, sf), n=20)
    return recs.join(tables.content(spark, sf).select("item_id", "title", "genre", "popularity"), "item_id")


add_view(
    "rating_sim",
    """
WITH n AS (SELECT item_id, sqrt(sum(rating * rating)) AS norm FROM ratings GROUP BY item_id)
SELECT item_id, similar_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id)
         AS INTEGER) AS rank FROM (
  SELECT a.item_id, b.item_id AS similar_id,
         round(sum(a.rating * b.rating) / (any_value(na.norm) * any_value(nb.norm)), 6) AS score
  FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id <> b.item_id
  JOIN n na ON a.item_id = na.item_id JOIN n nb ON b.item_id = nb.item_id GROUP BY 1, 2)
QUALIFY rank <= 10""",
)


@query("item_item_cosine", "SELECT item_id, similar_id, score, rank FROM rating_sim")
def _(spark, sf):
    return similarity.item_item_cosine(ratings(spark, sf))


@query(
    "similar_items_api",
    """
SELECT item_id, similar_id, score, rank, 'content' AS similarity_type FROM content_sim
UNION ALL SELECT item_id, similar_id, score, rank, 'collaborative' FROM rating_sim WHERE score >= 0.1""",
)
def _(spark, sf):
    text = named_similarity(tfidf.content_similarity(item_vectors(spark, sf), threshold=0.1))
    taste = similarity.item_item_cosine(ratings(spark, sf), threshold=0.1)
    return text.withColumn("similarity_type", F.lit("content")).unionByName(
        taste.withColumn("similarity_type", F.lit("collaborative"))
    )


add_view(
    "bm25",
    f"""
WITH d AS (SELECT doc_id, {tokens_sql("text")} AS w FROM documents),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (
  SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql("text")}) AS term FROM benchmark),
f AS (SELECT term, ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(len(w)) FROM d)))), 6) AS score
      FROM q JOIN p ON q.term = p.term JOIN f ON q.term = f.term GROUP BY 1, 2)
SELECT query_id, doc_id, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s
QUALIFY rank <= 50""",
)


def benchmark_queries(spark, sf):
    return tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def search_batch(spark, sf, n):
    built = index.build_index(tables.table(spark, sf, "documents"), scratch(spark, "index"))
    return index.search_index(built, benchmark_queries(spark, sf), n).hits.withColumnRenamed("key", "doc_id")


@query("text_search", "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def _(spark, sf):
    return search_batch(spark, sf, 10)


# One request for every benchmark text: filters as in a search form, a page, the total and facets.
REQUEST = {"category": ["Brand#11", "Brand#13", "Brand#22", "Brand#34", "Brand#45"], "year": {"min": 1960, "max": 2010}}
add_view(
    "matched",
    f"""
WITH d AS (SELECT item_id AS doc_id, {tokens_sql("title || ' ' || description")} AS w,
                  category, genre, language, year, rating FROM content),
q AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql("text")}) AS term FROM benchmark),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (
  SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
f AS (SELECT term, ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p GROUP BY term)
SELECT query_id, doc_id, any_value(category) AS category, any_value(genre) AS genre, any_value(language) AS language,
       any_value(rating) AS rating, round(sum(idf * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(len(w)) FROM d)))), 6) AS score
FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id)
WHERE category IN ('Brand#11', 'Brand#13', 'Brand#22', 'Brand#34', 'Brand#45') AND year BETWEEN 1960 AND 2010
GROUP BY query_id, doc_id""",
)


def search_catalog(spark, sf, **request):
    items = tables.content(spark, sf, with_text=True).withColumn("text", combined_text("title", "description"))
    built = index.build_index(items, scratch(spark, "catalog"), "item_id", attributes=("category", "genre", "language", "year", "rating"))
    return index.search_index(built, benchmark_queries(spark, sf), where=document_predicate(REQUEST, ()), **request)


@query(
    "search_request",
    """
SELECT query_id, doc_id, score, rank, total FROM (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total FROM matched) WHERE rank BETWEEN 6 AND 25""",
)
def _(spark, sf):
    """The second page of filtered requests with the total of each."""
    found = search_catalog(spark, sf, top=20, skip=5, total=True)
    return found.hits.join(found.totals, "query_id").withColumnRenamed("key", "doc_id")


@query(
    "search_request_facets",
    """
SELECT query_id, facet, value, count(*) AS count FROM (
  SELECT query_id, unnest(['genre', 'language', 'category']) AS facet, unnest([genre, language, category]) AS value FROM matched)
WHERE value IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    """Facet counts over all matches of each request."""
    return search_catalog(spark, sf, facets=("genre", "language", "category")).facets


@query(
    "search_request_by_rating",
    """
SELECT query_id, doc_id, rating AS score, CAST(row_number() OVER (
         PARTITION BY query_id ORDER BY rating DESC NULLS LAST, doc_id) AS INTEGER) AS rank FROM matched QUALIFY rank <= 20""",
)
def _(spark, sf):
    """Requests sorted by an attribute instead of the score."""
    return search_catalog(spark, sf, top=20, order_by="rating").hits.withColumnRenamed("key", "doc_id")


add_view(
    "nearest",
    """
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
         AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id,
         round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
               / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
               / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
  FROM embeddings a, embeddings b)
QUALIFY rank <= 50""",
)


def embedding_rows(spark, sf):
    return vectors.dense(tables.table(spark, sf, "embeddings"), "vec_id", "embedding")


def nearest(spark, sf, k):
    rows = embedding_rows(spark, sf)
    return vectors.vector_topk(rows, rows, k).select(
        F.col("left_id").alias("query_id"), F.col("right_id").alias("vec_id"), "score", "rank"
    )


@query("vector_topk", "SELECT query_id, vec_id, score, rank FROM nearest WHERE rank <= 10")
def _(spark, sf):
    return nearest(spark, sf, 10)


@query(
    "similar_by_vector",
    """
SELECT item_id, similar_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id)
         AS INTEGER) AS rank FROM (SELECT query_id AS item_id, vec_id AS similar_id, score FROM nearest
                                   WHERE query_id <> vec_id AND score >= 0.4) QUALIFY rank <= 10""",
)
def _(spark, sf):
    return named_similarity(vectors.similar_by_vector(embedding_rows(spark, sf), k=10, threshold=0.4))


@query(
    "hybrid_search",
    """
SELECT query_id, doc_id, text_rank, vector_rank, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
  SELECT coalesce(b.query_id, n.query_id) AS query_id, coalesce(b.doc_id, n.vec_id) AS doc_id,
         b.rank AS text_rank, n.rank AS vector_rank,
         round(coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + n.rank), 0), 6) AS score
  FROM bm25 b FULL JOIN nearest n ON b.query_id = n.query_id AND b.doc_id = n.vec_id) QUALIFY rank <= 10""",
)
def _(spark, sf):
    found = nearest(spark, sf, 50).withColumnRenamed("vec_id", "doc_id")
    return search.reciprocal_rank_fusion(search_batch(spark, sf, 50), found)


@query(
    "suggest",
    """
WITH c AS (SELECT lower(title) AS value, count(*) AS count, min(item_id) AS item_id, arg_min(category, item_id) AS category
           FROM items GROUP BY 1),
f AS (SELECT *, left(value, i) AS prefix FROM (SELECT *, unnest(range(1, length(value) + 1)) AS i FROM c))
SELECT prefix, value, count, item_id, category, CAST(row_number() OVER (PARTITION BY prefix ORDER BY count DESC, value) AS INTEGER) AS rank
FROM f QUALIFY rank <= 5""",
)
def _(spark, sf):
    return search.suggest(tables.content(spark, sf))


@query(
    "autocomplete",
    r"""
WITH c AS (SELECT value, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS value FROM documents) GROUP BY 1),
f AS (SELECT value, count, left(value, i) AS prefix FROM (
  SELECT value, count, unnest(range(1, length(value) + 1)) AS i FROM c))
SELECT prefix, value, count, CAST(row_number() OVER (PARTITION BY prefix ORDER BY count DESC, value) AS INTEGER) AS rank
FROM f QUALIFY rank <= 5""",
)
def _(spark, sf):
    return search.autocomplete(tables.table(spark, sf, "documents"))
