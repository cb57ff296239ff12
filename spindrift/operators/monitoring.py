"""Request, engagement and experiment monitoring rollups, KPIs and alerts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ranking import global_top

# Metric, comparison, threshold, alert type, severity, message start, unit.
ALERT_RULES = (
    ("recommendation_error_rate", ">", 5.0, "error_rate", "high", "Recommendation error rate", "%"),
    ("recommendation_response_time", ">", 2000.0, "performance", "medium", "Average response time", "ms"),
    ("cache_hit_rate", "<", 70.0, "performance", "low", "Cache hit rate", "%"),
    ("cpu_utilization", ">", 80.0, "system", "high", "CPU utilization", "%"),
    ("memory_utilization", ">", 85.0, "system", "high", "Memory utilization", "%"),
    ("system_availability", "<", 99.0, "availability", "critical", "System availability", "%"),
)
BOUNCE_MS = 30_000


def last_hours(df: DataFrame, hours: float, as_of: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``hours`` up to ``as_of`` (default: the latest row)."""
    end = df.agg(F.max(ts)).scalar() if as_of is None else as_of
    return df.filter((F.col(ts) > end - F.make_dt_interval(hours=F.lit(0), secs=F.lit(hours * 3600.0))) & (F.col(ts) <= end))


def _rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)) * 100


def request_metrics(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: totals, failures, mean duration, users and success rate."""
    users = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return df.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
        F.avg("duration_ms").alias("avg_response_time"),
        users.alias("unique_users"),
    ).withColumn("success_rate", _rate(F.col("successful_requests"), F.col("total_requests")))


def algorithm_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("algorithm").agg(F.count(F.lit(1)).alias("requests"))


def cache_hit_rate(df: DataFrame) -> DataFrame:
    """One row: hits, misses and hits / (hits + misses) in percent, null without cache events."""
    return df.agg(
        F.count_if(F.col("cache_event") == "CacheHit").alias("cache_hits"),
        F.count_if(F.col("cache_event") == "CacheMiss").alias("cache_misses"),
    ).withColumn(
        "cache_hit_rate", F.try_divide(F.col("cache_hits") * 100.0, F.col("cache_hits") + F.col("cache_misses"))
    )


def interactions_by_type(df: DataFrame) -> DataFrame:
    """Interactions and users per type, with the overall row (type ``all``) from one grouping-sets pass."""
    kind = F.when(F.grouping("event_type") == 1, "all").otherwise(F.col("event_type"))
    return (
        df.rollup("event_type")
        .agg(
            kind.alias("kind"), F.count(F.lit(1)).alias("interactions"), F.count_distinct("user_id").alias("users")
        )
        .select(F.col("kind").alias("event_type"), "interactions", "users")
    )


def session_metrics(sessions: DataFrame) -> DataFrame:
    """One row: sessions, mean duration and the share of sessions shorter than 30 s."""
    short = F.count_if(F.col("duration_ms") < BOUNCE_MS)
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg("duration_ms").alias("avg_session_duration"),
        F.try_divide(short * 100.0, F.count(F.lit(1))).alias("bounce_rate"),
    )


def retention(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Share of users active in a day, week or month who are active in the next one.

    (user, period) pairs are made distinct first, so a busy user is one row per
    period before the equi-join on the following period.
    """
    day = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    kinds = F.array(
        F.struct(F.lit("daily").alias("granularity"), day.alias("period")),
        F.struct(F.lit("weekly").alias("granularity"), F.floor(day / 7).cast("int").alias("period")),
        F.struct(F.lit("monthly").alias("granularity"), (F.year(ts) * 12 + F.month(ts)).alias("period")),
    )
    active = df.select("user_id", F.inline(kinds)).distinct()
    following = active.select("user_id", "granularity", (F.col("period") - 1).alias("period"), F.lit(1).alias("back"))
    return (
        active.join(following, ["user_id", "granularity", "period"], "left")
        .groupBy("granularity", "period")
        .agg(F.count(F.lit(1)).alias("active_users"), F.count("back").alias("retained_users"))
        .withColumn("retention", F.col("retained_users") / F.col("active_users") * 100)
    )


def peak_hours_days(df: DataFrame, n: int = 3, ts: str = "timestamp") -> DataFrame:
    """Busiest hours and weekdays (1 = Sunday) by interactions."""
    kinds = F.array(
        F.struct(F.lit("hour").alias("unit"), F.hour(ts).alias("value")),
        F.struct(F.lit("weekday").alias("unit"), F.dayofweek(ts).alias("value")),
    )
    counted = df.select(F.inline(kinds)).groupBy("unit", "value").agg(F.count(F.lit(1)).alias("interactions"))
    w = Window.partitionBy("unit").orderBy(F.desc("interactions"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Bits of a digit in the radix selection; 64 bits are four rounds.
DIGIT_BITS = 16


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles: NaN last, both zeros equal."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_ordered_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.uint64(raw).view(np.float64))


def _digit_counts(values: DataFrame, prefixes: Sequence[int], rest: int) -> dict[int, np.ndarray]:
    """For each prefix of the ordered bits the counts of the next digit, ``rest`` bits being left below it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {p: np.zeros(1 << DIGIT_BITS, np.int64) for p in prefixes}
        for batch in batches:
            bits = ordered_bits(batch.column(0).to_numpy(zero_copy_only=False))
            digit = (bits >> np.uint64(rest)) & np.uint64((1 << DIGIT_BITS) - 1)
            # A shift by all 64 bits is not defined, so the first round has one empty prefix.
            head = bits >> np.uint64(rest + DIGIT_BITS) if rest + DIGIT_BITS < 64 else np.zeros(len(bits), np.uint64)
            for p, total in totals.items():
                total += np.bincount(digit[head == np.uint64(p)].astype(np.int64), minlength=1 << DIGIT_BITS)
        for p, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([str(p)] * len(used), pa.string()), pa.array(used), pa.array(total[used])], ["prefix", "digit", "n"])

    counted = values.mapInArrow(count, "prefix string, digit long, n long").groupBy("prefix", "digit").agg(F.sum("n").alias("n"))
    out = {p: np.zeros(1 << DIGIT_BITS, np.int64) for p in prefixes}
    for row in counted.collect():  # one row for each digit and prefix at most
        out[int(row["prefix"])][row["digit"]] = row["n"]
    return out


def exact_percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact, interpolated percentiles by radix selection; all null without values.

    Each round counts the next 16 bits of all values that share the bits found so far, for every wanted rank at once,
    so four passes over one written column find all of them. No task sees the values in order, and the driver holds one
    count for each digit.
    """
    values = cut_lineage(df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull()))
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * q for q in shares]
    # Each wanted rank has the bits found so far and its place among the values that share them.
    found = {rank: (0, rank) for place in places for rank in (math.floor(place), math.ceil(place))}
    for rest in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        counts = _digit_counts(values, sorted({prefix for prefix, _ in found.values()}), rest)
        for rank, (prefix, inside) in found.items():
            running = np.cumsum(counts[prefix])
            digit = int(np.searchsorted(running, inside, "right"))
            found[rank] = prefix << DIGIT_BITS | digit, inside - int(running[digit] - counts[prefix][digit])
    exact = {rank: from_ordered_bits(bits) for rank, (bits, _) in found.items()}
    out = []
    for place in places:
        low, high = exact[math.floor(place)], exact[math.ceil(place)]
        out.append(low + (high - low) * (place - math.floor(place)) if high != low else low)
    return out


def response_time_stats(df: DataFrame) -> DataFrame:
    """One row: mean, exact median and 95th percentile, and the direction between the two halves of the period."""
    ends = df.agg(
        F.struct(
            F.unix_micros(F.min("timestamp").cast("timestamp")).alias("a"),
            F.unix_micros(F.max("timestamp").cast("timestamp")).alias("b"),
        )
    ).scalar()
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    early = at * 2 < ends["a"] + ends["b"]
    change = F.avg(F.when(~early, F.col("duration_ms"))) - F.avg(F.when(early, F.col("duration_ms")))
    median, p95 = exact_percentiles(df, "duration_ms", (0.5, 0.95))
    return df.agg(
        F.avg("duration_ms").alias("average"),
        F.when(change > 0, "worsening").when(change < 0, "improving").otherwise("stable").alias("trend"),
    ).withColumns({"median": F.lit(median).cast("double"), "p95": F.lit(p95).cast("double")})


#: Sizes of the sketches: about 0.8 % standard error for distinct users, about 0.4 % in rank for quantiles.
USERS_LG_K, TIMES_K = 14, 800


def sketch_rollup(df: DataFrame, ts: str = "timestamp", unit: str = "hour") -> DataFrame:
    """Per hour (or other unit): counts, and sketches of the distinct users and of the response times.

    Unlike a count of distinct users or a percentile, sketches can be merged, so days and weeks come from stored hours.
    """
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("period")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("success").alias("successful"),
        F.hll_sketch_agg(F.col("user_id").cast("string"), F.lit(USERS_LG_K)).alias("users"),
        F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(TIMES_K)).alias("times"),
    )


def merge_rollup(rollup: DataFrame, unit: str) -> DataFrame:
    """A coarser rollup from a finer one; merging in steps gives what one step gives, within the sketches' error."""
    return rollup.groupBy(F.date_trunc(unit, "period").alias("period")).agg(
        F.sum("requests").alias("requests"),
        F.sum("successful").alias("successful"),
        F.hll_union_agg("users").alias("users"),
        F.kll_merge_agg_double("times").alias("times"),
    )


def rollup_figures(rollup: DataFrame, shares: Mapping[str, float] = {"median": 0.5, "p95": 0.95}) -> DataFrame:
    """Figures of every period: counts, success rate, estimated users and quantiles."""
    quantiles = [F.kll_sketch_get_quantile_double("times", F.lit(q)).alias(name) for name, q in shares.items()]
    return rollup.select("period", "requests", _rate(F.col("successful"), F.col("requests")).alias("success_rate"), F.hll_sketch_estimate("users").alias("users"), *quantiles)


def error_analysis(df: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent error types with the total and the error rate in percent."""
    totals = df.agg(
        F.struct(F.count_if(~F.col("success")).alias("errors"), F.count(F.lit(1)).alias("n"))
    ).scalar()
    counted = df.filter(~F.col("success")).groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))
    top = global_top(counted, n, [F.desc("errors"), F.asc("error_type")])
    return top.withColumns(
        {"total_errors": totals["errors"], "error_rate": _rate(totals["errors"], totals["n"])}
    )


def executive_summary(df: DataFrame, days: int = 7, as_of: Column | None = None) -> DataFrame:
    """One row over the last ``days`` and the growth in interactions over the ``days`` before."""
    end = df.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    span = F.make_dt_interval(days=F.lit(days))
    now = F.col("timestamp") > end - span
    both = df.filter((F.col("timestamp") > end - span - span) & (F.col("timestamp") <= end))
    return (
        both.agg(
            F.count_if(now).alias("total_recommendations"),
            F.count_distinct(F.when(now, F.col("user_id"))).alias("unique_users"),
            F.count_if(now & F.col("success")).alias("successes"),
            F.count_if(~now).alias("previous"),
        )
        .select(
            "total_recommendations",
            "unique_users",
            (F.col("total_recommendations") / days).alias("avg_daily_requests"),
            _rate(F.col("successes"), F.col("total_recommendations")).alias("success_rate"),
            (F.try_divide(F.col("total_recommendations") - F.col("previous"), F.col("previous")) * 100).alias(
                "engagement_growth"
            ),
        )
    )


def algorithm_effectiveness(log: DataFrame, catalog_size: Column, daily: bool = False) -> DataFrame:
    """Per algorithm (and day): hit share, share of the catalogue served, genres per served item."""
    keys: list[Column] = [F.col("algorithm")]
    if daily:
        keys.insert(0, F.to_date("timestamp").alias("date"))
    return (
        log.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg("clicked").alias("accuracy"),
            F.count_distinct("item_id").alias("_items"),
            F.count_distinct("genre").alias("_genres"),
        )
        .withColumns(
            {
                "coverage": F.col("_items") / catalog_size,
                "diversity": F.least(F.lit(1.0), F.col("_genres") / F.col("_items")),
            }
        )
        .drop("_items", "_genres")
    )


def _hour_columns(hour: Column) -> list[Column]:
    return [hour.alias("timestamp"), F.hour(hour).alias("hour"), F.weekday(hour).alias("day_of_week")]


def hourly_rollup(df: DataFrame) -> DataFrame:
    """Request facts per hour; day_of_week counts from Monday = 0."""
    return (
        df.groupBy(F.date_trunc("hour", "timestamp").alias("h"))
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            _rate(F.count_if("success"), F.count(F.lit(1))).alias("success_rate"),
            F.avg("duration_ms").alias("response_time"),
            _rate(F.count_if(F.col("cache_event") == "CacheHit"), F.count(F.lit(1))).alias("cache_hit_rate"),
            F.count_distinct("user_id").alias("unique_users"),
        )
        .select(*_hour_columns(F.col("h")), "total_requests", "success_rate", "response_time", "cache_hit_rate", "unique_users")
    )


def hourly_engagement(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Engagement facts per hour; a session counts in the hour it starts."""
    acts = df.groupBy(F.date_trunc("hour", "timestamp").alias("h")).agg(
        F.count(F.lit(1)).alias("total_interactions"), F.count_distinct("user_id").alias("unique_users")
    )
    stays = sessions.groupBy(F.date_trunc("hour", "session_start").alias("h")).agg(
        F.avg("duration_ms").alias("avg_session_duration"),
        _rate(F.count_if(F.col("duration_ms") < BOUNCE_MS), F.count(F.lit(1))).alias("bounce_rate"),
    )
    return acts.join(stays, "h", "left").select(
        *_hour_columns(F.col("h")), "total_interactions", "unique_users", "avg_session_duration", "bounce_rate"
    )


def hourly_perf_x_engagement(performance: DataFrame, engagement: DataFrame) -> DataFrame:
    """The two hourly fact tables joined on the hour; hours missing on one side are kept."""
    right = engagement.select("timestamp", "total_interactions", "avg_session_duration", "bounce_rate")
    return performance.join(right, "timestamp", "full_outer")


def daily_algorithm_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("timestamp").alias("date"), "algorithm").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_distinct("user_id").alias("unique_users"),
        F.avg("duration_ms").alias("response_time"),
        _rate(F.count_if("success"), F.count(F.lit(1))).alias("success_rate"),
    )


def engagement_heatmap(df: DataFrame) -> DataFrame:
    """Interactions by hour and weekday (Monday = 0), long form."""
    return df.groupBy(F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("day_of_week")).agg(
        F.count(F.lit(1)).alias("interactions")
    )


def bi_measures(performance: DataFrame, engagement: DataFrame) -> DataFrame:
    """One row of report measures over the hourly facts."""
    sums = engagement.agg(
        F.struct(F.sum("total_interactions").alias("i"), F.max("unique_users").alias("u"))
    ).scalar()
    return performance.agg(
        F.sum("total_requests").alias("total_requests"),
        F.avg("success_rate").alias("avg_success_rate"),
        F.avg("response_time").alias("avg_response_time"),
    ).withColumns({"total_interactions": sums["i"], "max_users": sums["u"]})


SEVERITIES = ("critical", "high", "medium", "low")


def dashboard_kpis(df: DataFrame, sessions: DataFrame, health: DataFrame | None = None, rules: Sequence[tuple] = ()) -> DataFrame:
    """One row joining request, cache and engagement figures with the alert inputs.

    ``health`` has rows (metric, value) of the hosts, such as cpu_utilization; each becomes a column. They and the
    request figures are held against the alert rules, whose hits are counted by severity.
    """
    cache = cache_hit_rate(df).select("cache_hit_rate").scalar()
    stay = session_metrics(sessions).select(F.struct("avg_session_duration", "bounce_rate")).scalar()
    row = request_metrics(df).withColumns(
        {
            "cache_hit_rate": cache,
            "avg_session_duration": stay["avg_session_duration"],
            "bounce_rate": stay["bounce_rate"],
            "interactions_per_user": F.try_divide("total_requests", "unique_users"),
        }
    )
    if health is None:
        return row
    own = {
        "recommendation_error_rate": 100 - F.col("success_rate"),
        "recommendation_response_time": F.col("avg_response_time"),
        "cache_hit_rate": F.col("cache_hit_rate"),
    }
    health = health.select("metric", F.col("value").cast("double").alias("value"))
    found = alerts(metric_rows(row, own).unionByName(health), rules or ALERT_RULES)
    counts = found.agg(F.struct(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])).scalar()
    hosts = [rule[0] for rule in (rules or ALERT_RULES) if rule[0] not in own]
    values = health.agg(F.struct(*[F.max(F.when(F.col("metric") == h, F.col("value"))).alias(h) for h in hosts])).scalar()
    return row.withColumns({h: values[h] for h in hosts} | {f"{s}_alerts": counts[s] for s in SEVERITIES})


def realtime_kpis(df: DataFrame, minutes: int = 5) -> DataFrame:
    """KPIs per tumbling window of ``minutes``."""
    return (
        df.groupBy(F.window(F.col("timestamp").cast("timestamp"), f"{minutes} minutes").alias("w"))
        .agg(
            (F.count(F.lit(1)) / minutes).alias("requests_per_minute"),
            _rate(F.count_if("success"), F.count(F.lit(1))).alias("success_rate"),
            F.avg("duration_ms").alias("average_response_time"),
            _rate(F.count_if(F.col("cache_event") == "CacheHit"), F.count(F.lit(1))).alias("cache_hit_rate"),
        )
        .select(F.col("w.start").alias("window_start"), *KPI_COLUMNS)
    )


KPI_COLUMNS = ("requests_per_minute", "success_rate", "average_response_time", "cache_hit_rate")


def metric_rows(df: DataFrame, metrics: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot metric columns to (metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])
    return df.select(*keep, F.inline(pairs))


def alerts(metrics: DataFrame, rules: Sequence[tuple] = ALERT_RULES) -> DataFrame:
    """Metric rows (metric, value) that break a rule; comparisons are strict."""
    schema = "metric string, op string, threshold double, type string, severity string, label string, unit string"
    table = metrics.sparkSession.createDataFrame(list(rules), schema)
    over = (F.col("op") == ">") & (F.col("value") > F.col("threshold"))
    under = (F.col("op") == "<") & (F.col("value") < F.col("threshold"))
    relation = F.when(F.col("op") == ">", "exceeds").otherwise("below")
    return (
        metrics.join(F.broadcast(table), "metric")
        .filter(over | under)
        .withColumn(
            "message",
            F.concat(
                "label", F.lit(" "), F.format_string("%.1f", F.col("value")), "unit", F.lit(" "), relation,
                F.lit(" threshold "), F.col("threshold").cast("string"), "unit",
            ),
        )
        .drop("op", "label", "unit")
    )


def alert_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def value_counts(df: DataFrame, columns: Sequence[str], dataset: str) -> DataFrame:
    """Long rows (dataset, field, value, count) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs))
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit(dataset).alias("dataset"), "field", "value", "count")
    )


def table_profile(df: DataFrame, measures: Mapping[str, Column], dataset: str) -> DataFrame:
    """Long rows (dataset, measure, value): row and column counts and the given aggregates."""
    row = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.lit(float(len(df.columns))).alias("columns"),
        *[c.cast("double").alias(n) for n, c in measures.items()],
    )
    names = ["rows", "columns", *measures]
    return metric_rows(row, {n: F.col(n) for n in names}).select(
        F.lit(dataset).alias("dataset"), F.col("metric").alias("measure"), "value"
    )


def trending_searches(df: DataFrame, query: str, hours: int = 24, n: int = 10, as_of: Column | None = None) -> DataFrame:
    """Top queries of the window with their growth over the window before, in percent."""
    end = df.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    span = F.make_dt_interval(hours=F.lit(hours))
    now = F.col("timestamp") > end - span
    counted = (
        df.filter((F.col("timestamp") > end - span - span) & (F.col("timestamp") <= end))
        .groupBy(F.col(query).alias("query"))
        .agg(F.count_if(now).alias("searches"), F.count_if(~now).alias("previous"))
        .filter(F.col("searches") > 0)
        .withColumn("growth", F.try_divide(F.col("searches") - F.col("previous"), F.col("previous")) * 100)
    )
    return global_top(counted, n, [F.desc("searches"), F.asc("query")])


def consumption_metrics(log: DataFrame, completion: Column) -> DataFrame:
    """One row: mean completion, share of rows on a genre new to the user, share of served rows acted on.

    A genre is new on the user's first row of it; the first rows come from a
    (user, genre) aggregate, so no per-user window is needed.
    """
    served = log.agg(
        F.struct(F.avg(completion).alias("c"), F.avg("clicked").alias("a"), F.count(F.lit(1)).alias("n"))
    ).scalar()
    firsts = log.groupBy("user_id", "genre").agg(F.min("timestamp").alias("first"))
    return firsts.agg(F.count(F.lit(1)).alias("discoveries")).select(
        (served["c"] * 100).alias("consumption_rate"),
        (F.col("discoveries") / served["n"] * 100).alias("discovery_rate"),
        (served["a"] * 100).alias("acceptance_rate"),
    )


def hourly_durations(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.avg("duration_ms").alias("avg_duration"), F.count(F.lit(1)).alias("requests")
    )


def union_metrics(*parts: DataFrame) -> DataFrame:
    """Union of differently shaped results; missing columns are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
