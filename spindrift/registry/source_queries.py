"""Readers, sinks and the feature build, each through a write and a read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cleaning, discovery
from ..plans import build
from ..session import shared_dir
from ..sources import readers, sinks, tables
from .base import query
from .catalog_queries import FACET_SQL
from .cleaning_queries import clean


def scratch(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "ingest",
    """
SELECT 'nation' AS source, n_nationkey AS key, n_name AS name FROM nation
UNION ALL SELECT 'region', r_regionkey, r_name FROM region
UNION ALL SELECT 'customer', c_custkey, c_name FROM customer""",
)
def _(spark, sf):
    """A CSV, a JSON and a parquet source; an unknown suffix and a missing file are skipped."""
    root = scratch(spark, "ingest")
    tables.table(spark, sf, "nation").write.option("header", True).csv(f"{root}/nation.csv")
    tables.table(spark, sf, "region").write.json(f"{root}/region.json")
    nation = "n_nationkey int, n_name string, n_regionkey int"
    found = readers.ingest(
        spark,
        {
            "nation": f"{root}/nation.csv",
            "region": f"{root}/region.json",
            "customer": f"{sf}/customer.parquet",
            "odd": f"{root}/notes.xyz",
            "gone": f"{root}/gone.parquet",
        },
        {"nation": nation, "region": "r_regionkey int, r_name string"},
    )
    prefix = {"nation": ("n_nationkey", "n_name"), "region": ("r_regionkey", "r_name"), "customer": ("c_custkey", "c_name")}
    parts = [
        df.select(F.lit(n).alias("source"), F.col(prefix[n][0]).cast("bigint").alias("key"), F.col(prefix[n][1]).alias("name"))
        for n, df in found.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LOADED = "SELECT user_id, item_id, rating, CAST(timestamp AS VARCHAR) AS timestamp FROM interactions"


def with_time(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@query("load_interactions", LOADED)
def _(spark, sf):
    path = f"{scratch(spark, 'load')}.csv"
    sinks.write_single(with_time(tables.interactions(spark, sf)), path)
    return readers.load_interactions(spark, f"{path}.missing.parquet", path)


@query(
    "load_content",
    """
SELECT item_id, title, description, genre, NULL::VARCHAR AS content_type, tags,
       duration AS duration_minutes, year AS release_year, round(rating, 6) AS imdb_rating FROM content""",
)
def _(spark, sf):
    path = f"{scratch(spark, 'load')}.parquet"
    items = tables.content(spark, sf, with_text=True).select(
        "item_id", "title", "description", "genre",
        F.lit(None).cast("string").alias("content_type"), "tags", F.col("duration").alias("duration_minutes"),
        F.col("year").alias("release_year"), F.col("rating").alias("imdb_rating"),
    )
    sinks.write_single(items, path)
    return readers.load_content(spark, path)


@query(
    "load_users",
    "SELECT user_id, country AS location, is_premium FROM people",
)
def _(spark, sf):
    path = f"{scratch(spark, 'load')}.parquet"
    sinks.write_single(tables.users(spark, sf).select("user_id", F.col("country").alias("location"), "is_premium"), path)
    return readers.load_users(spark, path).select("user_id", "location", "is_premium")


def movie_rows(spark, sf):
    items = tables.content(spark, sf).select(
        F.col("item_id").alias("movieId"),
        "title",
        F.when(F.col("item_id") % 7 == 0, "(no genres listed)")
        .otherwise(F.concat_ws("|", "genre", "category"))
        .alias("genres"),
    )
    rated = tables.interactions(spark, sf).select(
        F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating",
        F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("timestamp"),
    )
    return items, rated


RATED = """
SELECT 'user_' || user_id AS user_id, 'movie_' || item_id AS product_id, 'rating' AS type, rating,
       CAST(epoch(timestamp) AS BIGINT) AS timestamp FROM interactions"""
PRODUCTS = """
SELECT 'movie_' || item_id AS product_id, title AS name, 'movies' AS category,
       CASE WHEN item_id % 7 = 0 THEN '' ELSE genre || '|' || category END AS genres,
       'Movie: ' || title AS description FROM items"""


def movielens_csv(spark, sf):
    root = scratch(spark, "movies")
    items, rated = movie_rows(spark, sf)
    items.write.option("header", True).csv(f"{root}/movies.csv")
    rated.write.option("header", True).csv(f"{root}/ratings.csv")
    return readers.read_movielens_csv(spark, root)


@query("read_movielens_csv", PRODUCTS)
def _(spark, sf):
    return movielens_csv(spark, sf)["products"]


@query("ratings_to_interactions", RATED)
def _(spark, sf):
    return readers.ratings_to_interactions(movielens_csv(spark, sf)["interactions"])


@query(
    "dataset_summary",
    """
SELECT 'movies' AS dataset, (SELECT count(DISTINCT user_id) FROM interactions) AS num_users,
       (SELECT count(*) FROM part) AS num_products, (SELECT count(*) FROM interactions) AS num_interactions""",
)
def _(spark, sf):
    return readers.dataset_summary(movielens_csv(spark, sf), "movies")


@query("read_movielens_dat", RATED)
def _(spark, sf):
    """``::`` files with a short line per user mixed in, which the reader drops."""
    root = scratch(spark, "dat")
    items, rated = movie_rows(spark, sf)
    items.select(F.concat_ws("::", "movieId", "title", "genres")).write.text(f"{root}/movies.dat")
    lines = rated.select(F.concat_ws("::", "userId", "movieId", F.col("rating").cast("string"), "timestamp"))
    short = rated.select("userId").distinct().select(F.concat_ws("::", "userId", F.lit("1")))
    lines.union(short).write.text(f"{root}/ratings.dat")
    return readers.ratings_to_interactions(readers.read_movielens_dat(spark, root)["interactions"])


@query(
    "read_bookcrossing",
    """
SELECT 'user_' || user_id AS user_id, 'book_' || item_id AS product_id, rating - 1 AS rating FROM interactions
WHERE rating > 1""",
)
def _(spark, sf):
    root = scratch(spark, "books")
    _, rated = movie_rows(spark, sf)
    quote = {"sep": ";", "quoteAll": True, "header": True, "encoding": "ISO-8859-1"}
    rated.select("userId", "movieId", (F.col("rating") - 1).cast("int")).write.options(**quote).csv(
        f"{root}/BX-Book-Ratings.csv"
    )
    books = tables.content(spark, sf).select(
        "item_id", "title", "category", "year", "genre", *[F.lit("x").alias(c) for c in "sml"]
    )
    books.write.options(**quote).csv(f"{root}/BX-Books.csv")
    return readers.read_bookcrossing(spark, root)["interactions"].drop("timestamp")


@query(
    "write_processed",
    "SELECT user_id, item_id, rating, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS rating_date FROM clean",
)
def _(spark, sf):
    root = scratch(spark, "processed")
    rows = cleaning.temporal_features(clean(spark, sf)).select("user_id", "item_id", "rating", "rating_date")
    by_month = rows.withColumn("rating_month", F.date_format("rating_date", "yyyy-MM"))
    sinks.write_processed({"interactions": by_month}, root, {"interactions": "rating_month"})
    return spark.read.schema(by_month.schema).parquet(f"{root}/interactions").drop("rating_month")


@query("write_single", "SELECT item_id, title, genre, year FROM items")
def _(spark, sf):
    path = f"{scratch(spark, 'single')}.csv"
    rows = tables.content(spark, sf).select("item_id", "title", "genre", "year")
    sinks.write_single(rows, path)
    return spark.read.csv(path, header=True, schema=rows.schema)


@query(
    "export_flat",
    """
SELECT user_id, username, '[' || list_aggregate(list_transform(preferences, lambda p: '"' || p || '"'), 'string_agg', ',')
       || ']' AS preferences FROM people""",
)
def _(spark, sf):
    path = f"{scratch(spark, 'flat')}.parquet"
    sinks.export_flat(tables.users(spark, sf).select("user_id", "username", "preferences"), path)
    return spark.read.parquet(path)


def snapshots(spark, sf):
    """Daily snapshots with counts by algorithm and type as maps."""
    log = tables.requests(spark, sf).withColumn("timestamp", F.to_date("timestamp"))

    def as_map(column, name):
        counted = log.groupBy("timestamp", column).agg(F.count(F.lit(1)).alias("n"))
        entries = F.sort_array(F.collect_list(F.struct(column, "n")))
        return counted.groupBy("timestamp").agg(F.map_from_entries(entries).alias(name))

    totals = log.groupBy("timestamp").agg(
        F.count(F.lit(1)).alias("total_requests"), F.avg("duration_ms").alias("avg_response_time")
    )
    return totals.join(as_map("algorithm", "by_algorithm"), "timestamp").join(as_map("event_type", "by_type"), "timestamp")


@query(
    "export_bi_tables",
    """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS timestamp, 'algorithm' AS kind, algorithm AS name, count(*) AS count
FROM requests GROUP BY 1, 3
UNION ALL SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR), 'type', event_type, count(*) FROM requests GROUP BY 1, 3""",
)
def _(spark, sf):
    root = scratch(spark, "bi")
    sinks.export_bi_tables(snapshots(spark, sf), root, "csv")
    schema = "timestamp date, name string, count bigint"
    parts = [
        spark.read.csv(f"{root}/{folder}", header=True, schema=schema).select(
            "timestamp", F.lit(kind).alias("kind"), "name", "count"
        )
        for folder, kind in (("algorithms", "algorithm"), ("types", "type"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "write_metrics_snapshot",
    """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS timestamp, count(*) AS total_requests,
       round(avg(duration_ms), 6) AS avg_response_time FROM requests GROUP BY 1""",
)
def _(spark, sf):
    path = scratch(spark, "snapshots")
    sinks.write_metrics_snapshot(snapshots(spark, sf), path)
    return spark.read.schema("timestamp date, total_requests bigint, avg_response_time double").json(path).drop("run_date")


@query(
    "export_facets",
    f"""
SELECT facet AS name, CASE facet WHEN 'rating_range' THEN 'Rating' WHEN 'duration_range' THEN 'Duration'
         ELSE upper(facet[1]) || facet[2:] END AS display_name,
       CASE WHEN facet LIKE '%range' THEN 'range' ELSE 'terms' END AS facet_type, value, count
FROM ({FACET_SQL.format(where="true")})""",
)
def _(spark, sf):
    path = scratch(spark, "facets")
    sinks.export_facets(discovery.facet_documents(discovery.facet_counts(tables.content(spark, sf))), path)
    schema = (
        "name string, display_name string, facet_type string, "
        "values array<struct<value: string, count: bigint, percentage: double>>"
    )
    nested = spark.read.schema(schema).json(path)
    return nested.select("name", "display_name", "facet_type", F.explode("values").alias("v")).select(
        "name", "display_name", "facet_type", "v.value", "v.count"
    )


@query(
    "feature_build",
    """
WITH u AS (SELECT user_id FROM clean GROUP BY 1 HAVING count(*) >= 30),
i AS (SELECT item_id FROM clean GROUP BY 1 HAVING count(*) >= 30),
k AS (SELECT * FROM clean WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i)),
t AS (SELECT DISTINCT item_id FROM k WHERE timestamp >= (SELECT max(timestamp) FROM k) - INTERVAL 90 DAY)
SELECT 'interactions' AS "table", count(*) AS rows FROM k
UNION ALL SELECT 'user_features', count(DISTINCT user_id) FROM k
UNION ALL SELECT 'item_features', count(*) FROM part
UNION ALL SELECT 'interaction_matrix', count(*) FROM (SELECT DISTINCT user_id, item_id FROM k)
UNION ALL SELECT 'trending', least(count(*), 100) FROM t""",
)
def _(spark, sf):
    """The whole build from raw files to saved tables; the row counts of what was saved."""
    root = scratch(spark, "build")
    with_time(tables.interactions(spark, sf)).write.parquet(f"{root}/interactions.parquet")
    items = tables.content(spark, sf, with_text=True).select("item_id", "title", "description", "genre", "tags")
    items.write.parquet(f"{root}/content.parquet")
    paths = {"interactions": f"{root}/interactions.parquet", "content": f"{root}/content.parquet"}
    built = build.run_build(spark, paths, f"{root}/out", "rating_month", min_interactions=30, trending_days=90)
    return build.summary({name: spark.read.parquet(f"{root}/out/{name}") for name in built})
