"""Sessions and sequences over a per-user event order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds with the microseconds kept."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def with_previous(
    df: DataFrame, values: list[str], user: str = "user_id", ts: str = "timestamp", tie: str = "event_id",
    chunk: str = "day",
) -> DataFrame:
    """Add ``prev_<value>``: the value of the user's preceding row.

    ``lag`` over a whole user would sort a hot user in one task. The order is cut
    into (user, time chunk) windows instead, and the row before each chunk comes
    from a table with one row per chunk.
    """
    carried = F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"), *[F.col(v).alias(f"c_{v}") for v in values])
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    edges = rows.groupBy(user, "_chunk").agg(F.max(carried).alias("_last"))
    edges = edges.select(
        user, "_chunk", F.lag("_last").over(Window.partitionBy(user).orderBy("_chunk")).alias("_before")
    )
    order = Window.partitionBy(user, "_chunk").orderBy(ts, tie)
    joined = rows.join(edges, [user, "_chunk"])
    first = F.row_number().over(order) == 1
    return joined.withColumns(
        {
            f"prev_{v}": F.when(first, F.col(f"_before.c_{v}")).otherwise(F.lag(v).over(order))
            for v in values
        }
    ).drop("_before")


def running_groups(
    df: DataFrame, flag: Column, out: str, user: str = "user_id", ts: str = "timestamp", tie: str = "event_id"
) -> DataFrame:
    """Number the groups a user's rows fall into, a true ``flag`` starting a new one.

    Running sums are taken per chunk and shifted by the sum of the chunks before.
    """
    rows = df.withColumn("_f", flag.cast("int"))
    sums = rows.groupBy(user, "_chunk").agg(F.sum("_f").alias("_s"))
    before = Window.partitionBy(user).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(user, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    order = Window.partitionBy(user, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(sums, [user, "_chunk"])
        .withColumn(out, F.col("_o") + F.sum("_f").over(order))
        .drop("_f", "_o")
    )


def sessionize(
    df: DataFrame, gap_minutes: float = 30, user: str = "user_id", ts: str = "timestamp", tie: str = "event_id",
    chunk: str = "day",
) -> DataFrame:
    """Number each user's sessions from 1; a new one starts after a gap longer than ``gap_minutes``."""
    linked = with_previous(df, [ts], user, ts, tie, chunk)
    previous = F.col(f"prev_{ts}")
    starts = previous.isNull() | (seconds_between(F.col(ts), previous) > gap_minutes * 60)
    return running_groups(linked, starts, "session_no", user, ts, tie).drop("_chunk", f"prev_{ts}")


def session_table(df: DataFrame, gap_minutes: float = 30, user: str = "user_id", ts: str = "timestamp") -> DataFrame:
    """One row per session: start, end, events and duration in milliseconds."""
    return (
        sessionize(df, gap_minutes, user, ts)
        .groupBy(user, "session_no")
        .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"))
        .withColumn("duration_ms", seconds_between(F.col("session_end"), F.col("session_start")) * 1000)
    )


def next_item_counts(df: DataFrame, item: str, top: int = 5, gap_minutes: float = 30) -> DataFrame:
    """Transition table: how often an item follows another within a session, best ``top`` per item."""
    linked = with_previous(df, ["timestamp", item])
    gap = seconds_between(F.col("timestamp"), F.col("prev_timestamp"))
    pairs = linked.filter(F.col("prev_timestamp").isNotNull() & (gap <= gap_minutes * 60))
    counted = pairs.groupBy(F.col(f"prev_{item}").alias("item"), F.col(item).alias("next_item")).agg(
        F.count(F.lit(1)).alias("transitions")
    )
    w = Window.partitionBy("item").orderBy(F.desc("transitions"), F.asc("next_item"))
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def binge_runs(df: DataFrame, genre: str, min_length: int = 3) -> DataFrame:
    """Runs of consecutive rows with the same genre per user, at least ``min_length`` long."""
    linked = with_previous(df, [genre])
    starts = F.col(f"prev_{genre}").isNull() | (F.col(f"prev_{genre}") != F.col(genre))
    runs = running_groups(linked, starts, "run_no")
    return (
        runs.groupBy("user_id", "run_no", genre)
        .agg(F.count(F.lit(1)).alias("length"), F.min("timestamp").alias("run_start"))
        .filter(F.col("length") >= min_length)
    )


def context_features(df: DataFrame) -> DataFrame:
    """Time-of-day class, weekday, weekend flag, season and seconds since the user's last event."""
    from .discovery import season_of

    hour = F.hour("timestamp")
    day = F.dayofweek("timestamp")
    linked = with_previous(df, ["timestamp"])
    return linked.select(
        *df.columns,
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 16), "afternoon")
        .when(hour.between(17, 22), "evening")
        .otherwise("late_night")
        .alias("time_of_day"),
        day.alias("day_of_week"),
        day.isin(1, 7).alias("weekend"),
        season_of(F.col("timestamp")).alias("season"),
        seconds_between(F.col("timestamp"), F.col("prev_timestamp")).alias("seconds_since_last"),
    )


def exploration_mode(df: DataFrame, genre: str = "genre", days: int = 7, as_of: Column | None = None) -> DataFrame:
    """Users whose distinct genres of the last ``days`` exceed their usual count over equal periods."""
    end = df.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    age = F.floor(seconds_between(end, F.col("timestamp")) / (days * 86400))
    per_period = df.groupBy("user_id", age.alias("period")).agg(F.count_distinct(genre).alias("genres"))
    return (
        per_period.groupBy("user_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("period") == 0, F.col("genres"))), F.lit(0)).alias("recent_genres"),
            F.avg(F.when(F.col("period") > 0, F.col("genres"))).alias("usual_genres"),
        )
        .withColumn("exploration_mode", F.coalesce(F.col("recent_genres") > F.col("usual_genres"), F.lit(False)))
    )
