"""Readers: suffix-driven ingest, table loaders and public rating data sets."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

INTERACTION_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
CONTENT_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("duration_minutes", T.IntegerType()),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("imdb_rating", T.DoubleType()),
    ]
)
USER_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("age_group", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("preferred_genre", T.StringType()),
        T.StructField("avg_rating", T.DoubleType()),
        T.StructField("total_ratings", T.IntegerType()),
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("is_premium", T.BooleanType()),
    ]
)


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV with header, or JSON, chosen by the path's suffix.

    Pass a schema for text formats: inference reads the data twice.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix == "csv":
        reader = reader.option("header", True).option("escape", '"')
        return reader.csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if suffix == "json":
        return reader.json(path)
    raise ValueError(f"unsupported file format: {path}")


def ingest(
    spark: SparkSession, sources: Mapping[str, str], schemas: Mapping[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """Read every source and tag rows with ``ingestion_timestamp`` and ``source_file``.

    Unknown suffixes and unreadable sources are logged and skipped.
    """
    found = {}
    for name, path in sources.items():
        try:
            df = read_by_suffix(spark, path, (schemas or {}).get(name))
        except (ValueError, PySparkException) as error:
            log.warning("source %s skipped: %s", name, error)
            continue
        found[name] = df.withColumns({"ingestion_timestamp": F.current_timestamp(), "source_file": F.lit(path)})
    return found


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system its scheme names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)


def load_table(spark: SparkSession, candidates: Iterable[str], schema: T.StructType | None = None) -> DataFrame:
    """The first existing path wins; no path is an error, and so is an unknown suffix."""
    tried = list(candidates)
    for path in tried:
        if path_exists(spark, path):
            return read_by_suffix(spark, path, schema)
    raise FileNotFoundError(f"none of {tried} exists")


def load_interactions(spark: SparkSession, *candidates: str) -> DataFrame:
    return load_table(spark, candidates, INTERACTION_SCHEMA)


def load_content(spark: SparkSession, *candidates: str) -> DataFrame:
    return load_table(spark, candidates, CONTENT_SCHEMA)


def load_users(spark: SparkSession, *candidates: str) -> DataFrame:
    return load_table(spark, candidates, USER_SCHEMA)


def _users_of(ratings: DataFrame) -> DataFrame:
    return ratings.select("user_id").distinct().withColumn("created_at", F.lit(None).cast("timestamp"))


def _prefixed(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _movies(df: DataFrame) -> DataFrame:
    genres = F.when(F.col("genres") == "(no genres listed)", F.array().cast("array<string>")).otherwise(
        F.split("genres", r"\|")
    )
    return df.select(
        _prefixed("movie_", "movieId").alias("product_id"),
        F.col("title").alias("name"),
        F.lit("movies").alias("category"),
        genres.alias("genres"),
        F.concat(F.lit("Movie: "), F.col("title")).alias("description"),
    )


def _ratings(df: DataFrame) -> DataFrame:
    return df.select(
        _prefixed("user_", "userId").alias("user_id"),
        _prefixed("movie_", "movieId").alias("product_id"),
        F.col("rating").cast("double").alias("rating"),
        F.col("timestamp").cast("bigint").alias("timestamp"),
    )


def read_movielens_csv(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Users, products and ratings from movies.csv and ratings.csv."""
    movies = spark.read.csv(f"{folder}/movies.csv", header=True, schema="movieId string, title string, genres string")
    ratings = spark.read.csv(
        f"{folder}/ratings.csv", header=True, schema="userId string, movieId string, rating double, timestamp bigint"
    )
    rated = _ratings(ratings)
    return {"users": _users_of(rated), "products": _movies(movies), "interactions": rated}


def _read_dat(spark: SparkSession, path: str, schema: str, needed: str) -> DataFrame:
    """``::``-separated latin-1 text; lines with too few fields are dropped."""
    rows = spark.read.option("sep", "::").option("encoding", "ISO-8859-1").option("quote", "").schema(schema).csv(path)
    return rows.filter(F.col(needed).isNotNull())


def read_movielens_dat(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Users, products and ratings from the ``.dat`` layout; demographics if users.dat is there."""
    movies = _read_dat(spark, f"{folder}/movies.dat", "movieId string, title string, genres string", "genres")
    rated = _ratings(
        _read_dat(
            spark, f"{folder}/ratings.dat", "userId string, movieId string, rating string, timestamp string", "timestamp"
        )
    )
    users = _users_of(rated)
    if path_exists(spark, f"{folder}/users.dat"):
        people = "userId string, gender string, age string, occupation string, zip string"
        users = _read_dat(spark, f"{folder}/users.dat", people, "zip").select(
            _prefixed("user_", "userId").alias("user_id"), "gender", "age", "occupation", F.col("zip").alias("zip_code")
        )
    return {"users": users, "products": _movies(movies), "interactions": rated}


def _read_quoted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.option("sep", ";").option("quote", '"').option("escape", "\\").option("encoding", "ISO-8859-1")
        .option("header", True).schema(schema).csv(path)
    )


def read_bookcrossing(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Books and ratings of the ``;``-separated layout; short book rows and zero ratings are dropped."""
    books = _read_quoted(
        spark, f"{folder}/BX-Books.csv",
        "isbn string, title string, author string, year string, publisher string, s string, m string, l string",
    ).filter(F.col("l").isNotNull())
    ratings = _read_quoted(spark, f"{folder}/BX-Book-Ratings.csv", "user string, isbn string, rating string")
    rated = ratings.select(
        _prefixed("user_", "user").alias("user_id"),
        _prefixed("book_", "isbn").alias("product_id"),
        F.col("rating").try_cast("double").alias("rating"),
        F.lit(None).cast("bigint").alias("timestamp"),
    ).filter(F.col("rating") > 0)
    products = books.select(
        _prefixed("book_", "isbn").alias("product_id"), F.col("title").alias("name"), F.lit("books").alias("category"),
        "author", F.col("year").try_cast("int").alias("year"), "publisher",
    )
    return {"users": _users_of(rated), "products": products, "interactions": rated}


def ratings_to_interactions(ratings: DataFrame) -> DataFrame:
    """Ratings as interaction rows of type ``rating``."""
    return ratings.select("user_id", "product_id", F.lit("rating").alias("type"), "rating", "timestamp")


def dataset_summary(parts: Mapping[str, DataFrame], name: str) -> DataFrame:
    """One row of counts of a data set's users, products and interactions."""
    counts = {f"num_{k}": df.agg(F.count(F.lit(1))).scalar() for k, df in parts.items()}
    first = next(iter(parts.values()))
    return first.agg(F.lit(name).alias("dataset")).withColumns(counts)
