"""Next items from contexts of variable length.

The tree holds, for each run of items that was seen often enough, what followed it. It is grown by rounds: only rows whose
context was kept look one event further back, so rare contexts are never extended. A prediction takes the longest kept
context of a history and falls back to shorter ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .sessions import sessionize


def session_positions(df: DataFrame, item: str, gap_minutes: float = 30, user: str = "user_id", ts: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """(user, session, place, item): events numbered inside their sessions from 0."""
    order = Window.partitionBy(user, "session_no").orderBy(ts, tie)
    numbered = sessionize(df, gap_minutes, user, ts, tie).withColumn("place", F.row_number().over(order) - 1)
    return numbered.select(F.col(user).alias("user"), F.col("session_no").alias("session"), "place", F.col(item).cast("bigint").alias("item"))


def context_tree(events: DataFrame, depth: int = 3, least: int = 5) -> DataFrame:
    """(context, next_item, n, total): how often an item followed each context of up to ``depth`` items.

    ``events`` are those of :func:`session_positions`. A context lists the latest item first; the empty one counts all
    events. A context with fewer than ``least`` followers is dropped, and so is every longer one that contains it as its
    latest part. Each round joins one earlier event by place and writes its rows, so a lost executor costs one round.
    """
    events = cut_lineage(events)
    rows = events.select("user", "session", "place", F.col("item").alias("next_item"), F.array().cast("array<bigint>").alias("context"))
    levels = []
    for back in range(depth + 1):
        if back:
            earlier = events.select("user", "session", (F.col("place") + back).cast("int").alias("place"), "item")
            rows = rows.join(earlier, ["user", "session", "place"]).withColumn("context", F.array_append("context", F.col("item"))).drop("item")
        counts = rows.groupBy("context", "next_item").agg(F.count(F.lit(1)).alias("n"))
        totals = counts.groupBy("context").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
        level = cut_lineage(counts.join(totals, "context"))
        levels.append(level)
        if back < depth:
            rows = cut_lineage(rows.join(level.select("context").distinct(), "context", "left_semi"))
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    return tree


def latest_contexts(events: DataFrame, depth: int = 3) -> DataFrame:
    """(user, session, context): the last ``depth`` items of each session, latest first."""
    last = events.groupBy("user", "session").agg(F.max("place").alias("end"))
    near = events.join(last, ["user", "session"]).filter(F.col("place") > F.col("end") - depth)
    items = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("o"), "item")))
    return near.groupBy("user", "session").agg(F.transform(items, lambda x: x["item"]).alias("context"))


def predict_next(tree: DataFrame, histories: DataFrame, top: int = 5) -> DataFrame:
    """(user, session, item, length, rank): the ``top`` items after each history, longest context first.

    Inside a context the more frequent item wins, then the smaller id. A list takes at most ``top`` items from a context,
    so a context hands on no more.
    """
    order = Window.partitionBy("context").orderBy(F.desc("n"), "next_item")
    best = tree.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).select("context", F.col("next_item").alias("item"), "n")
    lengths = F.sequence(F.lit(0), F.size("context"))
    asked = histories.select("user", "session", F.explode(F.transform(lengths, lambda k: F.slice("context", 1, k))).alias("context"))
    found = asked.join(best, "context").groupBy("user", "session", "item").agg(F.max(F.struct(F.size("context").alias("length"), "n")).alias("b"))
    ranking = Window.partitionBy("user", "session").orderBy(F.desc("b.length"), F.desc("b.n"), "item")
    ranked = found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= top)
    return ranked.select("user", "session", "item", "b.length", "rank")


def hit_rate(tree: DataFrame, events: DataFrame, depth: int = 3, top: int = 5) -> DataFrame:
    """One row: sessions, and the share whose last item is among the ``top`` predicted from the items before it."""
    last = events.groupBy("user", "session").agg(F.max_by("item", "place").alias("wanted"), F.max("place").alias("end"))
    before = events.join(last, ["user", "session"]).filter(F.col("place") < F.col("end")).drop("wanted", "end")
    hits = predict_next(tree, latest_contexts(before, depth), top).join(last, ["user", "session"]).filter(F.col("item") == F.col("wanted"))
    sessions = last.filter("end > 0").agg(F.count(F.lit(1))).scalar()
    return hits.agg(F.count(F.lit(1)).alias("hits")).select(sessions.alias("sessions"), (F.col("hits") / sessions).alias("hit_rate"))
