"""Discovery, list merging and list scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, documents, ranking, store
from ..sources import tables
from .base import add_view, query
from .cleaning_queries import FILTER_SQL, FILTERS


def as_of():
    return F.lit("2001-08-01").cast("date")


FACET_SQL = """
WITH f AS (SELECT * FROM items WHERE {where}),
pairs AS (
  SELECT 'category' AS facet, category AS value FROM f UNION ALL
  SELECT 'genre', genre FROM f UNION ALL
  SELECT 'language', language FROM f UNION ALL
  SELECT 'decade', CAST((year // 10) * 10 AS VARCHAR) || 's' FROM f UNION ALL
  SELECT 'rating_range', CASE WHEN rating <> 0 THEN CAST(CAST(floor(rating) AS BIGINT) AS VARCHAR) || '-'
         || CAST(CAST(floor(rating) AS BIGINT) + 1 AS VARCHAR) END FROM f UNION ALL
  SELECT 'duration_range', CASE WHEN duration IS NULL OR duration = 0 THEN NULL WHEN duration < 60 THEN 'Under 1 hour'
         WHEN duration < 120 THEN '1-2 hours' WHEN duration < 180 THEN '2-3 hours' ELSE 'Over 3 hours' END FROM f)
SELECT facet, value, count(*) AS count, round(count(*) / (SELECT count(*) FROM f) * 100, 6) AS percentage
FROM pairs WHERE value IS NOT NULL GROUP BY facet, value"""


@query("facet_counts", FACET_SQL.format(where="true"))
def _(spark, sf):
    return discovery.facet_counts(tables.content(spark, sf))


@query("facet_counts_filtered", FACET_SQL.format(where=FILTER_SQL))
def _(spark, sf):
    return discovery.facet_counts_filtered(tables.content(spark, sf), FILTERS)


@query(
    "search_facets",
    """
WITH pairs AS (SELECT 'category' AS facet, category AS value FROM items UNION ALL SELECT 'genre', genre FROM items
  UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM items UNION ALL SELECT 'language', language FROM items
  UNION ALL SELECT 'rating', CAST(rating AS VARCHAR) FROM items)
SELECT facet, value, count(*) AS count, round(count(*) / (SELECT count(*) FROM items) * 100, 6) AS percentage
FROM pairs WHERE value IS NOT NULL GROUP BY facet, value""",
)
def _(spark, sf):
    return discovery.facet_counts(tables.content(spark, sf), discovery.search_facet_columns())


@query(
    "collections",
    """
WITH m AS (SELECT item_id, popularity, 'genre' AS type, genre AS value FROM items
           UNION ALL SELECT item_id, popularity, 'decade', CAST((year // 10) * 10 AS VARCHAR) || 's' FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY type, value ORDER BY popularity DESC, item_id) AS rn,
             count(*) OVER (PARTITION BY type, value) AS n FROM m)
SELECT CASE WHEN type = 'genre' THEN 'genre-' || lower(replace(value, ' ', '-')) ELSE 'decade-' || value END AS id,
       CASE WHEN type = 'genre' THEN 'Best of ' || value ELSE value || ' Classics' END AS title, type,
       max(n) AS item_count, string_agg(CAST(item_id AS VARCHAR), '|' ORDER BY rn) AS items
FROM r WHERE n >= 5 AND rn <= 10 GROUP BY type, value""",
)
def _(spark, sf):
    return discovery.collections(tables.content(spark, sf))


AGE = "date_diff('day', created_date, DATE '2001-08-01')"
TRENDING_SQL = f"""popularity * CASE WHEN created_date IS NULL THEN 1.0
  ELSE greatest(0.1, 1.0 - {AGE} / 365) END"""
RECENT_SQL = f"CASE WHEN created_date IS NULL THEN 0.0 ELSE greatest(0.0, 1.0 - {AGE} / 30) END"
MIXED_SQL = f"0.4 * ({TRENDING_SQL}) + 0.3 * popularity + 0.3 * ({RECENT_SQL})"


@query("discover_trending", f"SELECT item_id, round({TRENDING_SQL}, 6) AS score FROM items")
def _(spark, sf):
    return tables.content(spark, sf).select("item_id", discovery.mode_score("trending", as_of()).alias("score"))


@query("discover_popular", "SELECT item_id, round(popularity, 6) AS score FROM items")
def _(spark, sf):
    return tables.content(spark, sf).select("item_id", discovery.mode_score("popular", as_of()).alias("score"))


@query("discover_recent", f"SELECT item_id, round(CAST({RECENT_SQL} AS DOUBLE), 6) AS score FROM items")
def _(spark, sf):
    return tables.content(spark, sf).select("item_id", discovery.mode_score("recent", as_of()).alias("score"))


@query("discover_mixed", f"SELECT item_id, round({MIXED_SQL}, 6) AS score FROM items")
def _(spark, sf):
    return tables.content(spark, sf).select("item_id", discovery.mode_score("mixed", as_of()).alias("score"))


@query(
    "sort_catalog",
    """
SELECT item_id, title, coalesce(rating, 0) AS sort_rating,
       CAST(row_number() OVER (ORDER BY coalesce(rating, 0) DESC, item_id) AS INTEGER) AS position FROM items
QUALIFY position <= 100""",
)
def _(spark, sf):
    items = tables.content(spark, sf)
    top = ranking.global_top(items, 100, discovery.sort_order("rating"), rank="position")
    return top.select("item_id", "title", F.coalesce("rating", F.lit(0.0)).alias("sort_rating"), "position")


@query("paginate", "SELECT item_id, title FROM items ORDER BY title, item_id LIMIT 25 OFFSET 50")
def _(spark, sf):
    page = discovery.paginate(tables.content(spark, sf), discovery.sort_order("title", "asc"), 25, 50)
    return page.select("item_id", "title")


@query(
    "page_after",
    """
SELECT item_id, popularity FROM items WHERE popularity < 0.95 OR (popularity = 0.95 AND item_id > 100)
ORDER BY popularity DESC, item_id LIMIT 25""",
)
def _(spark, sf):
    page = discovery.page_after(tables.content(spark, sf), F.col("popularity"), 0.95, 100, 25)
    return page.select("item_id", "popularity")


@query(
    "discover",
    f"""
SELECT item_id, title, genre, popularity, round({MIXED_SQL}, 6) AS discovery_score,
       (SELECT count(*) FROM items WHERE {FILTER_SQL}) AS total
FROM items WHERE {FILTER_SQL} ORDER BY popularity DESC, item_id LIMIT 20 OFFSET 20""",
)
def _(spark, sf):
    page = discovery.discover(tables.content(spark, sf), as_of(), FILTERS, limit=20, offset=20)
    return page.select("item_id", "title", "genre", "popularity", "discovery_score", "total")


THEMES = {"spring": ["that", "ring", "ous"], **{k: v for k, v in discovery.SEASONAL_THEMES.items() if k != "spring"}}


def seasonal_sql(words):
    score = " + ".join(f"CASE WHEN contains(b, '{w}') THEN 1.0 ELSE 0.0 END" for w in words)
    return f"""
WITH t AS (SELECT item_id, title, category, genre,
             lower(title || ' ' || description || ' ' || array_to_string(keywords, ' ')) AS b FROM content),
s AS (SELECT item_id, title, category, genre, CAST({score} AS DOUBLE) AS seasonal_score FROM t)
SELECT *, 'spring' AS season,
       CAST(row_number() OVER (ORDER BY seasonal_score DESC, item_id) AS INTEGER) AS rank FROM s
WHERE seasonal_score > 0 QUALIFY rank <= 20"""


@query("seasonal", seasonal_sql(THEMES["spring"]))
def _(spark, sf):
    return discovery.seasonal(tables.content(spark, sf, with_text=True), "spring", themes=THEMES)


def all_seasons_sql():
    parts = [seasonal_sql(words).replace("'spring' AS season", f"'{season}' AS season") for season, words in discovery.SEASONAL_THEMES.items()]
    return " UNION ALL ".join(f"SELECT * FROM ({part})" for part in parts)


@query("seasonal_all", all_seasons_sql())
def _(spark, sf):
    """The best items of all four seasons by their own theme words."""
    items = tables.content(spark, sf, with_text=True)
    first, *others = (discovery.seasonal(items, season) for season in discovery.SEASONAL_THEMES)
    for found in others:
        first = first.unionByName(found)
    return first


DOC_SQL = """
SELECT CAST(item_id AS VARCHAR) AS id, title, description, category, genre, year AS release_year,
       coalesce(rating, 0) AS rating, duration AS duration_minutes, array_to_string(keywords, '|') AS "cast",
       '' AS director, popularity AS popularity_score,
       'Title: ' || title || CASE WHEN description <> '' THEN ' Description: ' || description ELSE '' END
         || ' Genres: ' || genre || ' Category: ' || category
         || ' Cast: ' || array_to_string(keywords[1:5], ', ') AS combined_features FROM content"""


def docs(spark, sf):
    return documents.build_documents(tables.content(spark, sf, with_text=True))


@query("build_documents", DOC_SQL)
def _(spark, sf):
    return docs(spark, sf)


@query(
    "upsert_documents",
    """
SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN genre = 'PROMO' THEN 'new ' || title ELSE title END AS title
FROM items WHERE genre <> 'SMALL'
UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier""",
)
def _(spark, sf):
    items = tables.content(spark, sf)
    text_id = F.col("item_id").cast("string").alias("id")
    old = items.filter("genre <> 'SMALL'").select(text_id, "title")
    changed = items.filter("genre = 'PROMO'").select(text_id, F.concat(F.lit("new "), "title").alias("title"))
    added = tables.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title")
    )
    return documents.upsert_documents(old, changed.unionByName(added))


@query(
    "document_store",
    """
SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN genre = 'PROMO' THEN 'new ' || title ELSE title END AS title
FROM items WHERE genre <> 'SMALL' AND item_id % 50 <> 7
UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier""",
)
def _(spark, sf):
    """The catalogue in a bucketed store: one merge with changes and additions, one with deletions, and a replay."""
    from .source_queries import scratch

    items = tables.content(spark, sf)
    text_id = F.col("item_id").cast("string").alias("id")
    held = store.DocumentStore(scratch(spark, "store"), buckets=16)
    held.create(items.filter("genre <> 'SMALL'").select(text_id, "title"))
    changed = items.filter("genre = 'PROMO'").select(text_id, F.concat(F.lit("new "), "title").alias("title"))
    added = tables.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title")
    )
    held.merge(changed.unionByName(added), batch="changes")
    held.merge(changed.limit(0), items.filter("item_id % 50 = 7").select(text_id), batch="removals")
    held.merge(changed.unionByName(added), batch="changes")
    return held.read(spark)


@query(
    "delete_documents",
    "SELECT CAST(item_id AS VARCHAR) AS id, title FROM items WHERE genre <> 'SMALL'",
)
def _(spark, sf):
    items = tables.content(spark, sf).withColumn("id", F.col("item_id").cast("string"))
    return documents.delete_documents(items, items.filter("genre = 'SMALL'").select("id")).select("id", "title")


@query("table_stats", "SELECT count(*) AS document_count FROM content")
def _(spark, sf):
    return documents.table_stats(docs(spark, sf))


@query(
    "merge_scored_lists",
    """
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.item_id, b.item_id) AS item_id,
       round(coalesce(a.score, 0), 6) AS vector_score, round(coalesce(b.score, 0), 6) AS preference_score,
       CASE WHEN a.user_id IS NULL THEN 'preference' WHEN b.user_id IS NULL THEN 'vector' ELSE 'hybrid' END AS source
FROM list_a a FULL JOIN list_b b ON a.user_id = b.user_id AND a.item_id = b.item_id""",
)
def _(spark, sf):
    return ranking.merge_scored_lists(*tables.scored_lists(spark, sf))


TOP = "row_number() OVER (PARTITION BY user_id ORDER BY round({s}, 6) DESC, item_id)"
RANKED = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY round({s}, 6) DESC, item_id) AS INTEGER) AS rank"

HYBRID_SQL = f"""
WITH a AS (SELECT *, {TOP.format(s="score")} AS rn FROM {{a}} QUALIFY rn <= 20),
b AS (SELECT *, {TOP.format(s="score")} AS rn FROM {{b}} QUALIFY rn <= 20),
na AS (SELECT user_id, item_id, 0.7 * CASE WHEN max(score) OVER w > min(score) OVER w
         THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s
       FROM a WINDOW w AS (PARTITION BY user_id)),
nb AS (SELECT user_id, item_id, 0.3 * CASE WHEN max(score) OVER w > min(score) OVER w
         THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s
       FROM b WINDOW w AS (PARTITION BY user_id)),
m AS (SELECT coalesce(na.user_id, nb.user_id) AS user_id, coalesce(na.item_id, nb.item_id) AS item_id,
             coalesce(na.s, 0) AS collaborative_score, coalesce(nb.s, 0) AS content_score,
             CASE WHEN na.user_id IS NULL THEN 'content' WHEN nb.user_id IS NULL THEN 'collaborative'
                  ELSE 'hybrid' END AS source
      FROM na FULL JOIN nb ON na.user_id = nb.user_id AND na.item_id = nb.item_id)
SELECT user_id, item_id, source, round(collaborative_score, 6) AS collaborative_score,
       round(content_score, 6) AS content_score, round(collaborative_score + content_score, 6) AS score,
       {RANKED.format(s="(collaborative_score + content_score)")} FROM m QUALIFY rank <= 10"""


@query("hybrid_recs", HYBRID_SQL.format(a="list_a", b="list_b"))
def _(spark, sf):
    return ranking.hybrid_recs(*tables.scored_lists(spark, sf))


@query(
    "vector_preference_hybrid",
    f"""
WITH a AS (SELECT *, {TOP.format(s="score")} AS rn FROM list_a QUALIFY rn <= 15),
b AS (SELECT *, {TOP.format(s="score")} AS rn FROM list_b QUALIFY rn <= 15),
na AS (SELECT user_id, item_id, score * 0.7
         + (count(*) OVER (PARTITION BY user_id) - rn + 1) / count(*) OVER (PARTITION BY user_id) * 0.1 AS s FROM a),
nb AS (SELECT user_id, item_id, score * 0.3
         + (count(*) OVER (PARTITION BY user_id) - rn + 1) / count(*) OVER (PARTITION BY user_id) * 0.1 AS s FROM b),
m AS (SELECT coalesce(na.user_id, nb.user_id) AS user_id, coalesce(na.item_id, nb.item_id) AS item_id,
             coalesce(na.s, 0) AS vector_score, coalesce(nb.s, 0) AS preference_score,
             CASE WHEN na.user_id IS NULL THEN 'preference' WHEN nb.user_id IS NULL THEN 'vector'
                  ELSE 'hybrid' END AS source
      FROM na FULL JOIN nb ON na.user_id = nb.user_id AND na.item_id = nb.item_id)
SELECT user_id, item_id, source, round(vector_score, 6) AS vector_score,
       round(preference_score, 6) AS preference_score, round(vector_score + preference_score, 6) AS score,
       {RANKED.format(s="(vector_score + preference_score)")} FROM m QUALIFY rank <= 10""",
)
def _(spark, sf):
    return ranking.vector_preference_hybrid(*tables.scored_lists(spark, sf))


@query(
    "exclude_items",
    """
SELECT user_id, item_id, round(score, 6) AS score FROM list_a
WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM list_b)""",
)
def _(spark, sf):
    first, second = tables.scored_lists(spark, sf)
    return ranking.exclude_items(first, second)


@query(
    "unseen_candidates",
    """
SELECT u.user_id, i.item_id FROM (SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM clean) u, items i
WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.user_id = u.user_id AND c.item_id = i.item_id)""",
)
def _(spark, sf):
    """All items that a user has no rating for, one row each; users without ratings included."""
    from .cleaning_queries import clean

    users, items = tables.users(spark, sf).select("user_id"), tables.content(spark, sf).select("item_id")
    return ranking.unseen_in_groups(clean(spark, sf), items, users=users)


@query(
    "unseen_lists",
    """
SELECT u.c_custkey AS user_id, i.item_id // 1024 AS block, count(*) AS unseen,
       md5(string_agg(CAST(i.item_id AS VARCHAR), ',' ORDER BY i.item_id)) AS items
FROM customer u, items i WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.user_id = u.c_custkey AND c.item_id = i.item_id)
GROUP BY 1, 2""",
)
def _(spark, sf):
    """All items that each user has no rating for, users without ratings included, in blocks of 1,024 ids."""
    from .cleaning_queries import clean

    users, items = tables.users(spark, sf).select("user_id"), tables.content(spark, sf).select("item_id")
    return ranking.unseen_lists(users, items, clean(spark, sf), 1024, digest=True)


@query(
    "enrich_items",
    """
SELECT a.user_id, a.item_id, round(a.score, 6) AS score, i.title, i.genre
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rn FROM list_a
      QUALIFY rn <= 5) a JOIN items i ON a.item_id = i.item_id""",
)
def _(spark, sf):
    top = ranking.top_n_per_user(tables.scored_lists(spark, sf)[0], 5).drop("rank")
    return top.join(tables.content(spark, sf).select("item_id", "title", "genre"), "item_id")


add_view(
    "boosts",
    """
SELECT a.user_id, a.item_id, a.score, i.genre, i.popularity, least(1.0,
    CASE WHEN len(preferences) > 0 THEN 0.5 * CASE WHEN list_contains(preferences, genre) THEN 1 ELSE 0 END
         / len(preferences) ELSE 0 END
  + CASE WHEN coalesce(rating, 0) >= min_rating THEN 0.2 ELSE 0 END
  + CASE WHEN abs(duration - preferred_duration) / preferred_duration < 0.3 THEN 0.1 ELSE 0 END) AS boost
FROM list_a a JOIN items i ON a.item_id = i.item_id JOIN people p ON a.user_id = p.user_id""",
)


def boosts(spark, sf):
    first = tables.scored_lists(spark, sf)[0]
    joined = first.join(tables.content(spark, sf), "item_id").join(
        tables.users(spark, sf).select("user_id", "preferences", "min_rating", "preferred_duration"), "user_id"
    )
    boost = ranking.personalization_boost(
        F.array("genre"), F.col("preferences"), F.col("rating"), F.col("min_rating"),
        F.col("duration"), F.col("preferred_duration"),
    )
    return joined.select("user_id", "item_id", "score", "genre", "popularity", boost.alias("boost"))


@query("personalization_boost", "SELECT user_id, item_id, round(boost, 6) AS boost FROM boosts")
def _(spark, sf):
    return boosts(spark, sf).select("user_id", "item_id", "boost")


@query(
    "popularity_boost",
    f"""
SELECT user_id, item_id, round(s, 6) AS score, {RANKED.format(s="s")} FROM (
  SELECT user_id, item_id, score + least(popularity * 0.1, 0.2) AS s FROM boosts) QUALIFY rank <= 10""",
)
def _(spark, sf):
    raised = boosts(spark, sf).select(
        "user_id", "item_id", ranking.popularity_boost(F.col("score"), F.col("popularity")).alias("score")
    )
    return ranking.top_n_per_user(raised, 10)


@query(
    "combine_and_rank",
    f"""
WITH m AS (
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.item_id, b.item_id) AS item_id,
         coalesce(a.score, 0) AS content_score, coalesce(b.score, 0) AS ai_score,
         CASE WHEN a.user_id IS NULL THEN 'ai' WHEN b.user_id IS NULL THEN 'content' ELSE 'hybrid' END AS source
  FROM list_a a FULL JOIN list_b b ON a.user_id = b.user_id AND a.item_id = b.item_id),
s AS (SELECT m.*, coalesce(boost, 0) AS boost, content_score * 0.6 + ai_score * 0.3 + coalesce(boost, 0) * 0.1 AS t
      FROM m LEFT JOIN boosts x ON m.user_id = x.user_id AND m.item_id = x.item_id
      WHERE m.item_id NOT IN (SELECT item_id FROM items WHERE genre = 'PROMO'))
SELECT user_id, item_id, source, round(content_score, 6) AS content_score, round(ai_score, 6) AS ai_score,
       round(boost, 6) AS boost, round(t, 6) AS score, {RANKED.format(s="t")} FROM s QUALIFY rank <= 10""",
)
def _(spark, sf):
    first, second = tables.scored_lists(spark, sf)
    promo = tables.content(spark, sf).filter("genre = 'PROMO'").select("item_id")
    kept = [ranking.exclude_items(rows, promo, ["item_id"]) for rows in (first, second)]
    return ranking.combine_and_rank(*kept, boosts(spark, sf))


add_view(
    "top10_genres",
    """
SELECT user_id, item_id, score, genre, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id)
  AS rank FROM boosts QUALIFY rank <= 10""",
)


def top10_genres(spark, sf):
    first = tables.scored_lists(spark, sf)[0]
    genres = tables.content(spark, sf).select("item_id", "genre")
    return ranking.top_n_per_user(first.join(genres, "item_id"), 10)


@query(
    "top3_stats",
    """
SELECT user_id, round(avg(score), 6) AS top_mean, round(var_pop(score), 6) AS top_variance
FROM top10_genres WHERE rank <= 3 GROUP BY user_id""",
)
def _(spark, sf):
    return ranking.confidence_score(top10_genres(spark, sf)).drop("confidence")


@query(
    "confidence_score",
    """
SELECT user_id, round(greatest(0, least(1, avg(score) + greatest(0, 0.2 - var_pop(score)))), 6) AS confidence
FROM top10_genres WHERE rank <= 3 GROUP BY user_id""",
)
def _(spark, sf):
    return ranking.confidence_score(top10_genres(spark, sf)).select("user_id", "confidence")


@query(
    "diversity_score",
    """
SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE least(1, count(DISTINCT genre) / count(*)) END, 6) AS diversity
FROM top10_genres GROUP BY user_id""",
)
def _(spark, sf):
    return ranking.diversity_score(top10_genres(spark, sf))


@query(
    "genre_overlap",
    """
SELECT a.user_id, a.item_id, CAST(CASE WHEN list_contains(preferences, genre) THEN 1
         WHEN preferences IS NULL THEN NULL ELSE 0 END AS INTEGER) AS shared
FROM list_a a JOIN items i ON a.item_id = i.item_id JOIN people p ON a.user_id = p.user_id""",
)
def _(spark, sf):
    first = tables.scored_lists(spark, sf)[0]
    users = tables.users(spark, sf).select("user_id", "preferences")
    joined = first.join(tables.content(spark, sf).select("item_id", "genre"), "item_id").join(users, "user_id")
    return joined.select(
        "user_id", "item_id", F.size(F.array_intersect(F.array("genre"), "preferences")).alias("shared")
    )


@query(
    "distinct_union",
    "SELECT item_id FROM list_a UNION SELECT item_id FROM list_b",
)
def _(spark, sf):
    first, second = tables.scored_lists(spark, sf)
    return first.select("item_id").union(second.select("item_id")).distinct()


@query(
    "difference",
    """
SELECT item_id FROM items WHERE item_id NOT IN (
  SELECT c.item_id FROM clean c JOIN people p ON c.user_id = p.user_id WHERE p.country = 'NATION_7')""",
)
def _(spark, sf):
    from .cleaning_queries import clean

    people = tables.users(spark, sf).filter("country = 'NATION_7'").select("user_id")
    seen = clean(spark, sf).join(people, "user_id", "left_semi").select("item_id")
    return tables.content(spark, sf).select("item_id").join(seen, "item_id", "left_anti")


@query(
    "concat_samples",
    """
SELECT user_id, item_id, CAST(1 AS INTEGER) AS label FROM list_a WHERE score > 0.6
UNION ALL SELECT user_id, item_id, CAST(0 AS INTEGER) FROM list_a WHERE score <= 0.6""",
)
def _(spark, sf):
    rows = tables.scored_lists(spark, sf)[0]
    liked = rows.filter("score > 0.6").select("user_id", "item_id", F.lit(1).alias("label"))
    rest = rows.filter("score <= 0.6").select("user_id", "item_id", F.lit(0).alias("label"))
    return liked.unionByName(rest)


@query(
    "diversify",
    f"""
WITH d AS (SELECT user_id, item_id, genre, score, score - 0.3 * (row_number() OVER (PARTITION BY user_id, genre
        ORDER BY round(score, 6) DESC, item_id) - 1) AS adjusted FROM boosts)
SELECT user_id, item_id, genre, round(score, 6) AS score, round(adjusted, 6) + 0.0 AS adjusted,
       {RANKED.format(s="adjusted")} FROM d QUALIFY rank <= 10""",
)
def _(spark, sf):
    first = tables.scored_lists(spark, sf)[0]
    return ranking.diversify(first.join(tables.content(spark, sf).select("item_id", "genre"), "item_id"))


@query(
    "batch_recs",
    f"""
WITH r AS (SELECT user_id, item_id, score, {RANKED.format(s="score")} FROM list_a QUALIFY rank <= 5)
SELECT q.c_custkey AS user_id, item_id, round(score, 6) AS score, rank,
       CASE WHEN item_id IS NULL THEN 'failed' ELSE 'ok' END AS status
FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT -s_suppkey - 1 FROM supplier) q
LEFT JOIN r ON q.c_custkey = r.user_id""",
)
def _(spark, sf):
    wanted = tables.users(spark, sf).filter("segment = 'BUILDING'").select("user_id")
    unknown = tables.table(spark, sf, "supplier").select((-F.col("s_suppkey") - 1).alias("user_id"))
    return ranking.batch_recs(tables.scored_lists(spark, sf)[0], wanted.union(unknown), 5)


@query(
    "fallback_lists",
    """
WITH t AS (SELECT * FROM list_a WHERE user_id IN (SELECT user_id FROM people WHERE is_premium))
SELECT user_id, item_id, round(score, 6) AS score, 'primary' AS served_from FROM t
UNION ALL SELECT user_id, item_id, round(score, 6), 'backup' FROM list_b
WHERE user_id NOT IN (SELECT user_id FROM t) AND user_id IN (SELECT user_id FROM people)""",
)
def _(spark, sf):
    first, second = tables.scored_lists(spark, sf)
    users = tables.users(spark, sf)
    treated = first.join(users.filter("is_premium").select("user_id"), "user_id", "left_semi")
    return ranking.fallback_lists(treated, second, users)


@query(
    "cold_start",
    f"""
WITH personal AS (SELECT user_id, item_id, score, {RANKED.format(s="score")} FROM list_a
                  WHERE user_id IN (SELECT user_id FROM people WHERE is_premium) QUALIFY rank <= 10),
pop AS (SELECT item_id, popularity AS score, CAST(row_number() OVER (ORDER BY popularity DESC, item_id) AS INTEGER) AS rank
        FROM items QUALIFY rank <= 10)
SELECT user_id, item_id, round(score, 6) AS score, rank, 'personal' AS served_from FROM personal
UNION ALL SELECT p.user_id, pop.item_id, round(pop.score, 6), pop.rank, 'popular' FROM people p, pop
WHERE p.user_id NOT IN (SELECT user_id FROM personal)""",
)
def _(spark, sf):
    first = tables.scored_lists(spark, sf)[0]
    users = tables.users(spark, sf)
    known = first.join(users.filter("is_premium").select("user_id"), "user_id", "left_semi")
    popular = ranking.global_top(tables.content(spark, sf), 10, discovery.sort_order("popularity")).select(
        "item_id", F.col("popularity").alias("score"), "rank"
    )
    return ranking.cold_start(ranking.top_n_per_user(known, 10), popular, users)
