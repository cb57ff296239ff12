"""Logical entities (interactions, content, users, requests) over the given tables.

The test tables are a star schema, so each entity is a declarative view:
order lines are interactions, parts are the catalogue, customers are the users
and the event stream is the request log. Attributes the star schema lacks
(year, language, creation day) are arithmetic on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENRES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
LANGUAGES = ("English", "Spanish", "French", "German")
ALGORITHMS = ("hybrid", "collaborative", "content")
ERROR_TYPES = ("timeout", "validation", "external_service")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """``values[index mod n]``; stays a literal array lookup in the plan."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating 1-5, timestamp): order lines joined to their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        ((F.floor("l_quantity") - 1) % 5 + 1).cast("double").alias("rating"),
        F.col("o_orderdate").alias("timestamp"),
    )


def content(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """The catalogue: one row per part; ``with_text`` joins the document as description."""
    key = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(
        key.alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("genre"),
        F.col("p_brand").alias("category"),
        F.concat_ws(",", F.lower("p_type"), F.lower("p_brand")).alias("tags"),
        F.split("p_name", " ").alias("keywords"),
        (F.lit(1950) + key * 31 % 75).cast("int").alias("year"),
        (F.col("p_size") * 5).cast("int").alias("duration"),
        F.when(key % 17 != 0, key * 7 % 101 / F.lit(10.0)).alias("rating"),
        (F.col("p_retailprice") % 1000 / 1000).alias("popularity"),
        pick(LANGUAGES, key).alias("language"),
        F.when(
            key % 19 != 0, F.date_sub(F.lit("2001-08-01").cast("date"), (key * 13 % 500).cast("int"))
        ).alias("created_date"),
    )
    if not with_text:
        return items
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return items.join(docs, items.item_id == docs.doc_id, "left").select(
        *items.columns, F.coalesce("text", F.lit("")).alias("description")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with country and region; preferences derived from the key."""
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            key.alias("user_id"),
            F.col("c_name").alias("username"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            (F.col("c_acctbal") > 5000).alias("is_premium"),
            F.when(
                key % 23 != 0,
                F.array_distinct(F.array(pick(GENRES, key), pick(GENRES, F.floor(key / 6)))),
            ).alias("preferences"),
            (key % 5).cast("double").alias("min_rating"),
            (F.lit(30) + key % 10 * 20).cast("double").alias("preferred_duration"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with the JSON property ``k`` lifted to a column."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream read as a recommendation request log."""
    k = F.col("k")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        "timestamp",
        "user_id",
        "event_type",
        k.alias("k"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("value") * 20).alias("duration_ms"),
        pick(ALGORITHMS, k).alias("algorithm"),
        F.when(k % 4 == 0, "CacheMiss").otherwise("CacheHit").alias("cache_event"),
        F.when(F.col("event_type") == "error", pick(ERROR_TYPES, k)).alias("error_type"),
    )


def recommendation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served recommendations: item, list position and whether it was acted on."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        "timestamp",
        "user_id",
        (F.col("event_id") % 200).alias("item_id"),
        (F.col("k") % 10 + 1).cast("int").alias("position"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("clicked"),
        pick(ALGORITHMS, F.col("k")).alias("algorithm"),
        pick(GENRES, F.col("event_id") % 200).alias("genre"),
    )


def scored_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping scored candidate lists (user_id, item_id, score).

    The first holds mean ratings of orders before 1999, the second mean line
    values of orders from 1998 on, so 1998 gives pairs present in both.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    pair = (F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
    first = (
        rows.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
        .groupBy(*pair)
        .agg((F.avg((F.floor("l_quantity") - 1) % 5 + 1) / 5).alias("score"))
    )
    second = (
        rows.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
        .groupBy(*pair)
        .agg(F.round(F.avg("l_quantity") / 50, 6).alias("score"))
    )
    return first, second
