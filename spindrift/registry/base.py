"""``@query`` registers a Spark query together with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_INTERACTIONS = """
SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
       CAST((CAST(floor(l.l_quantity) AS BIGINT) - 1) % 5 + 1 AS DOUBLE) AS rating, o.o_orderdate AS timestamp
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

# SQL text of the logical views; a view may use the ones above it.
VIEWS: dict[str, str] = {
    "interactions": _INTERACTIONS,
    "clean": """
SELECT user_id, item_id, timestamp, min(rating) AS rating FROM interactions
WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND timestamp IS NOT NULL AND rating BETWEEN 1 AND 5
GROUP BY user_id, item_id, timestamp""",
    "ratings": "SELECT user_id, item_id, avg(rating) AS rating FROM clean GROUP BY user_id, item_id",
    "items": """
SELECT p_partkey AS item_id, p_name AS title, p_type AS genre, p_brand AS category,
       lower(p_type) || ',' || lower(p_brand) AS tags, string_split(p_name, ' ') AS keywords,
       CAST(1950 + p_partkey * 31 % 75 AS INTEGER) AS year, CAST(p_size * 5 AS INTEGER) AS duration,
       CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 7 % 101) / 10.0::DOUBLE END AS rating,
       (p_retailprice % 1000) / 1000 AS popularity,
       ['English', 'Spanish', 'French', 'German'][p_partkey % 4 + 1] AS language,
       CASE WHEN p_partkey % 19 <> 0
            THEN DATE '2001-08-01' - CAST(p_partkey * 13 % 500 AS INTEGER) END AS created_date
FROM part""",
    "content": """
SELECT i.*, coalesce(d.text, '') AS description FROM items i LEFT JOIN documents d ON i.item_id = d.doc_id""",
    "people": """
SELECT c_custkey AS user_id, c_name AS username, n_name AS country, r_name AS region,
       c_mktsegment AS segment, c_acctbal > 5000 AS is_premium,
       CASE WHEN c_custkey % 23 <> 0 THEN
         CASE WHEN c_custkey % 6 = (c_custkey // 6) % 6
              THEN [['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][c_custkey % 6 + 1]]
              ELSE [['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][c_custkey % 6 + 1],
                    ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][(c_custkey // 6) % 6 + 1]] END
       END AS preferences,
       CAST(c_custkey % 5 AS DOUBLE) AS min_rating,
       CAST(30 + c_custkey % 10 * 20 AS DOUBLE) AS preferred_duration
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ev": """
SELECT event_id, ts AS timestamp, user_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "requests": """
SELECT event_id AS request_id, timestamp, user_id, event_type, k, event_type <> 'error' AS success,
       value * 20 AS duration_ms, ['hybrid', 'collaborative', 'content'][k % 3 + 1] AS algorithm,
       CASE WHEN k % 4 = 0 THEN 'CacheMiss' ELSE 'CacheHit' END AS cache_event,
       CASE WHEN event_type = 'error' THEN ['timeout', 'validation', 'external_service'][k % 3 + 1] END AS error_type
FROM ev""",
    "reclog": """
SELECT event_id AS request_id, timestamp, user_id, event_id % 200 AS item_id, k % 10 + 1 AS position,
       CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS clicked,
       ['hybrid', 'collaborative', 'content'][k % 3 + 1] AS algorithm,
       ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'][event_id % 200 % 6 + 1] AS genre
FROM ev""",
    "list_a": """
SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
       avg((CAST(floor(l.l_quantity) AS BIGINT) - 1) % 5 + 1) / 5 AS score
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2""",
    "list_b": """
SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, round(avg(l.l_quantity) / 50, 6) AS score
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2""",
}


def add_view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(body: str) -> str:
    """Prepend the logical views that ``body`` uses, in definition order."""
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        text = frontier.pop()
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(sql)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in VIEWS.items() if name in needed)
    body = body.strip()
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def present(df: DataFrame) -> DataFrame:
    """Flat, engine-neutral columns: dates as text, doubles at six digits, arrays joined."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its twin, if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
