"""Exploration policies and off-policy estimates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import md5_uniform
from .ranking import global_top, top_n_per_user


def epsilon_greedy(requests: DataFrame, lists: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """Serve each request the user's best item, or with probability ``epsilon`` another one of the list.

    The draw is a hash of the request id, so a retried task draws the same. The
    lists (user_id, item_id, rank) are top-n lists; the explored place is picked
    by a second hash over the list length.
    """
    sizes = lists.groupBy("user_id").agg(F.max("rank").alias("n"))
    explore = md5_uniform(F.concat(F.lit("e"), F.col("request_id").cast("string"))) < epsilon
    pick = md5_uniform(F.concat(F.lit("p"), F.col("request_id").cast("string")))
    chosen = F.when(explore & (F.col("n") > 1), F.floor(pick * (F.col("n") - 1)) + 2).otherwise(1).cast("int")
    return (
        requests.join(sizes, "user_id")
        .select("request_id", "user_id", explore.alias("explored"), chosen.alias("rank"))
        .join(lists.select("user_id", "rank", "item_id"), ["user_id", "rank"])
    )


def arm_counts(log: DataFrame, item: str = "item_id", reward: str = "clicked") -> DataFrame:
    """Trials, successes and failures per item."""
    return log.groupBy(item).agg(
        F.count(F.lit(1)).alias("trials"), F.sum(F.when(F.col(reward) > 0, 1).otherwise(0)).alias("successes")
    ).withColumn("failures", F.col("trials") - F.col("successes"))


def ucb_score(counts: DataFrame, beta: float = 1.0, n: int = 10) -> DataFrame:
    """mean + beta x sqrt(ln(total) / trials); the best ``n`` items."""
    total = counts.agg(F.sum("trials")).scalar()
    scored = counts.withColumn(
        "score", F.col("successes") / F.col("trials") + beta * F.sqrt(F.log(total) / F.col("trials"))
    )
    return global_top(scored, n, [F.round("score", 6).desc(), F.col("item_id").asc()])


def gamma_draw(shape: Column, key: Column, tries: int = 8) -> Column:
    """A Gamma(shape, 1) draw for a shape of at least one, from hashed uniforms of ``key`` by Marsaglia and Tsang's test.

    A try passes with a probability of over 0.95. Should all fail, about once in 10^10 draws, the middle of the
    distribution stands in.
    """
    d = shape - 1.0 / 3

    def attempt(t: int) -> Column:
        u, angle, test = (md5_uniform(F.concat_ws("|", key, F.lit(f"{t}{part}"))) for part in "xyz")
        x = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * angle)
        v = F.pow(1 + x / F.sqrt(9 * d), F.lit(3.0))
        passes = (v > 0) & (F.log(1 - test) < x * x / 2 + d - d * v + d * F.log(v))
        return F.when(passes, d * v)

    return F.coalesce(*[attempt(t) for t in range(tries)], d)


def thompson_sampling(counts: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """One Beta(successes + 1, failures + 1) draw per item; the best ``n``.

    A Beta draw is the share of one Gamma draw in two. Uniforms are hashes of (seed, item), so draws do not depend on
    how the rows are partitioned or on retries, and ids may have any type; everything is a column function.
    """
    wins, losses = (
        gamma_draw(F.col(c) + 1.0, F.concat_ws("|", F.lit(f"{seed}{c}"), F.col("item_id").cast("string"))) for c in ("successes", "failures")
    )
    drawn = counts.select("item_id", "successes", "failures", wins.alias("_w"), losses.alias("_l"))
    sampled = drawn.withColumn("score", F.col("_w") / (F.col("_w") + F.col("_l"))).drop("_w", "_l")
    return global_top(sampled, n, [F.round("score", 6).desc(), F.col("item_id").asc()])


def update_counts(counts: DataFrame, rewards: DataFrame) -> DataFrame:
    """Old counts plus the counts of a new reward log."""
    columns = ["item_id", "trials", "successes", "failures"]
    return (
        counts.select(*columns)
        .unionByName(arm_counts(rewards).select(*columns))
        .groupBy("item_id")
        .agg(*[F.sum(c).alias(c) for c in columns[1:]])
    )


def propensity(log: DataFrame) -> DataFrame:
    """Clicks over impressions per item."""
    return log.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("clicked").alias("clicks")
    ).withColumn("propensity", F.try_divide("clicks", "impressions"))


def position_debias(log: DataFrame) -> DataFrame:
    """Relevance per item: mean of click / P(examine | position).

    Examination is the click rate of the position relative to the best one. The
    position table has one row per list place, so it is broadcast; a shuffle on
    so few keys would not spread.
    """
    ctr = log.groupBy("position").agg(F.avg("clicked").alias("ctr"))
    best = ctr.agg(F.max("ctr")).scalar()
    examined = ctr.select("position", (F.col("ctr") / best).alias("examine"))
    return (
        log.join(F.broadcast(examined), "position")
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("impressions"), F.avg(F.try_divide("clicked", "examine")).alias("relevance"))
    )


def calibrated_score(df: DataFrame, popularity: Column, weight: float = 0.1, n: int = 10) -> DataFrame:
    """score - weight x ln(1 + popularity), re-ranked per user."""
    adjusted = df.withColumn("calibrated", F.col("score") - weight * F.log(1 + popularity))
    return top_n_per_user(adjusted, n, score="calibrated")


def ips_evaluate(log: DataFrame, policy: DataFrame) -> DataFrame:
    """Self-normalised inverse-propensity value of a policy (user_id, new_item) on a log with p and reward."""
    matched = log.join(policy, "user_id").filter(F.col("item_id") == F.col("new_item"))
    return matched.agg(
        F.count(F.lit(1)).alias("matched"),
        F.try_divide(F.sum(F.try_divide("reward", "p")), F.sum(F.try_divide(F.lit(1.0), F.col("p")))).alias("value"),
    )


def doubly_robust(log: DataFrame, policy: DataFrame) -> DataFrame:
    """Mean of prediction + matched x (reward - prediction) / p."""
    joined = log.join(policy, "user_id")
    correction = F.when(
        F.col("item_id") == F.col("new_item"), F.try_divide(F.col("reward") - F.col("predicted"), F.col("p"))
    ).otherwise(0.0)
    return joined.agg(
        F.count(F.lit(1)).alias("interactions"), F.avg(F.col("predicted") + correction).alias("value")
    )


def engagement_metrics(log: DataFrame, catalog_size: Column, watch: Column, retention: DataFrame) -> DataFrame:
    """One row: click rate, watch time, catalogue coverage, exploration rate, mean daily and weekly retention."""
    kept = retention.agg(
        F.struct(
            F.avg(F.when(F.col("granularity") == "daily", F.col("retention"))).alias("d"),
            F.avg(F.when(F.col("granularity") == "weekly", F.col("retention"))).alias("w"),
        )
    ).scalar()
    new_pairs = log.select("user_id", "genre").distinct().agg(F.count(F.lit(1))).scalar()
    return log.agg(
        F.avg("clicked").alias("ctr"),
        F.avg(watch).alias("watch_time"),
        (F.count_distinct("item_id") / catalog_size).alias("coverage"),
        (new_pairs / F.count(F.lit(1))).alias("exploration_rate"),
    ).withColumns({"daily_retention": kept["d"], "weekly_retention": kept["w"]})


def list_quality(log: DataFrame, lists: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row: mean NDCG of the served lists that hold a click.

    A list is all rows with the same ``lists`` columns in the given order; a click gains 1 / log2(place + 1), and the
    best order has its clicks first. The ideal sum depends on the number of clicks alone.
    """
    place = F.row_number().over(Window.partitionBy(*lists).orderBy(*order))
    gains = log.withColumn("_place", place).groupBy(*lists).agg(
        F.sum(F.col("clicked") / F.log2(F.col("_place") + 1)).alias("dcg"), F.sum("clicked").cast("int").alias("clicks")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("clicks")), F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1))
    return gains.filter("clicks > 0").agg(F.avg(F.col("dcg") / ideal).alias("ndcg"))


def return_rates(activity: DataFrame, days: Sequence[int] = (7, 30), ts: str = "timestamp") -> DataFrame:
    """One row: the share of users who come back within so many days after their first day, ``retention_<n>d``.

    Days are made distinct per user first; the first day meets the others through an aggregate, not a join.
    """
    day = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).alias("day")
    active = activity.select("user_id", day).distinct()
    first = active.groupBy("user_id").agg(F.min("day").alias("first"))
    later = active.join(first, "user_id").groupBy("user_id").agg(F.min(F.when(F.col("day") > F.col("first"), F.col("day") - F.col("first"))).alias("gap"))
    return later.agg(*[(F.count_if(F.col("gap") <= n) / F.count(F.lit(1)) * 100).alias(f"retention_{n}d") for n in days])


def watch_figures(watched: DataFrame, items: DataFrame) -> DataFrame:
    """One row: minutes watched in all, and the mean share of the item's duration that was watched, at most one."""
    share = F.when(F.col("duration").isNotNull(), F.least(F.col("minutes") / F.col("duration"), F.lit(1.0)))
    joined = watched.join(items.filter("duration > 0").select("item_id", "duration"), "item_id", "left")
    return joined.agg(F.sum("minutes").alias("watch_time"), F.avg(share).alias("completion_rate"))
