"""Streaming forms of intake, dedup, windowed KPIs, trending, sessions and user state.

Every function takes a streaming DataFrame, so the source stays pluggable: files
here, Kafka or another connector on a cluster.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.cleaning import validate_events
from ..operators.monitoring import alerts, metric_rows
from ..session import shared_dir


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


#: Rows of one file of an ordered feed, at most about.
FEED_ROWS = 2_000_000


def ordered_feed(df: DataFrame, path: str, ts: str = "timestamp", batches: int = 4) -> DataFrame:
    """The rows of ``df`` as a stream of at least ``batches`` files in the order of ``ts``, one file a micro-batch.

    A file source takes files by their time of change, so the ranges of one sorted table are appended one by one.
    """
    spark = df.sparkSession
    staged = f"{path}-staged-{uuid.uuid4().hex}"
    batches = max(batches, -(-df.count() // FEED_ROWS))
    df.repartitionByRange(batches, ts).sortWithinPartitions(ts).write.parquet(staged)
    for file in sorted(spark.read.schema(df.schema).parquet(staged).inputFiles()):
        spark.read.schema(df.schema).parquet(file).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, df.schema, 1)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Cast to an instant (watermarks refuse zone-less timestamps) and set the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process what is available into parquet files and stop."""
    query = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available batch by batch and stop."""
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def collect_stream(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over the available input and return its output as a table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    run_to_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def ingest_events(stream: DataFrame, valid_path: str, rejected_path: str, checkpoint: str, **rules: object) -> StreamingQuery:
    """Validate, add the id user_item_epoch, append valid rows and quarantine the rest.

    Each batch overwrites its own batch folder, so a replayed batch does not
    double its rows.
    """
    checked = validate_events(stream, **rules).withColumn(
        "interaction_id",
        F.concat_ws("_", "user_id", "item_id", F.unix_timestamp(F.col("timestamp").cast("timestamp"))),
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # both writes read one validated batch
        good = batch.filter("reason IS NULL").drop("reason")
        good.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        batch.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        batch.unpersist()

    return run_batches(checked, store, checkpoint)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state variables and timers need."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class FirstRows(StatefulProcessor):
    """Per bucket of keys: the first row of each key, and every late row, marked.

    The state of a bucket lists its keys with the time until which they are remembered. It is read once and written once
    a batch. The next batch's watermark is at least this bucket's latest time less the delay, so what that passes is not
    written at all. An event-time timer at the latest of these times forgets what has passed.
    """

    def __init__(self, delay_micros: int):
        self.delay = delay_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "key string, until long")

    def _remembered(self, watermark: int) -> dict[str, int]:
        return {key: until for key, until in self.seen.get() if until > watermark} if self.seen.exists() else {}

    def _remember(self, known: dict[str, int]) -> None:
        if known:
            self.seen.put(list(known.items()))
        else:
            self.seen.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        known, next_watermark = self._remembered(watermark), watermark
        for part in rows:
            if part["micros"].notna().any():
                next_watermark = max(next_watermark, int(part["micros"].max()) // 1000 * 1000 - self.delay)
            late = part["micros"] <= watermark
            timely = part[~late].sort_values("micros", kind="stable").drop_duplicates("key")
            first = timely[~timely["key"].isin(known.keys())]
            known |= dict(zip(first["key"], (first["micros"] + self.delay).tolist(), strict=True))
            yield pd.concat([first.assign(late=False), part[late].assign(late=True)]).drop(columns=["bucket", "key"])
        known = {key: until for key, until in known.items() if until > next_watermark}
        self._remember(known)
        if known:
            self.handle.registerTimer(max(known.values()) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self._remember(self._remembered(timerValues.getCurrentWatermarkInMs() * 1000))
        return iter(())

    def close(self) -> None:
        pass


def first_rows(
    stream: DataFrame, keys: Sequence[str] = ("user_id", "item_id", "timestamp"), delay: str = "10 minutes", ts: str = "timestamp", buckets: int = 64
) -> DataFrame:
    """All columns and ``late``: the first row of each key, and the rows that come behind the watermark, repeats included.

    A key is remembered until the watermark passes its first row's time by ``delay``. Spark's own operators drop late
    rows; here the watermark column stays out of the operator, which gets the time as a number and marks them. Keys share
    ``buckets`` states, a number that is fixed for the life of a checkpoint. Start the query inside :func:`rocks_state`.
    """
    names = stream.columns
    kind = stream.schema[ts].dataType
    timed = event_time(stream, ts, delay)
    micros = F.unix_micros(F.col(ts))
    key = F.to_json(F.struct(*[micros.alias(k) if k == ts else F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    plain = timed.select(micros.alias("micros"), key.alias("key"), *[c for c in names if c != ts]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    made = T.StructType([T.StructField("micros", T.LongType()), *[stream.schema[c] for c in names if c != ts], T.StructField("late", T.BooleanType())])
    found = plain.groupBy("bucket").transformWithStateInPandas(FirstRows(_micros(stream.sparkSession, delay)), made, "Append", "EventTime")
    return found.withColumn(ts, F.timestamp_micros("micros").cast(kind)).select(*names, "late")


def split_late(marked: DataFrame, kept_path: str, late_path: str, checkpoint: str) -> StreamingQuery:
    """Run :func:`first_rows`: first rows to one table, late ones to another, a folder for each batch.

    A replayed batch overwrites its folders, so no row is doubled.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # both writes read one batch
        for late, path in ((False, kept_path), (True, late_path)):
            batch.filter(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    with rocks_state(marked.sparkSession):
        return run_batches(marked, store, checkpoint)


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT CAST(unix_micros(timestamp_seconds(0) + INTERVAL {interval}) AS BIGINT)").first()[0]


class WindowUsers(StatefulProcessor):
    """Per bucket of (item, user) keys: rows, rating sum and distinct users of each item in every window that closes.

    The state holds one entry per item, user and pane, the largest spans of time that no window cuts, until the last
    window of the pane closes. A user counts in a window at the first pane there, so a row is never copied into windows:
    equal spans of windows are counted first. A timer behind the watermark notes each of its steps, so that a row counts
    in the windows that were open when its batch began.
    """

    PANES = ["item", "user", "pane"]

    def __init__(self, window: int, slide: int):
        self.window, self.slide, self.span = window, slide, math.gcd(window, slide)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "panes binary, closed long")

    def _panes(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(self.PANES, dropna=False, sort=False)[["n", "r"]].sum(min_count=1).reset_index()

    def _spans(self, panes: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
        """Numbers of the first and last window that hold a pane."""
        return -((self.window - self.span - panes["pane"]) // self.slide), panes["pane"] // self.slide

    def _advance(self, panes: pd.DataFrame, closed: int, watermark: int) -> Iterator[pd.DataFrame]:
        """Sums of the windows that end after ``closed`` and not after ``watermark``; what open windows need is kept."""
        first, last = (closed - self.window) // self.slide + 1, (watermark - self.window) // self.slide
        panes = panes.sort_values("pane", kind="stable")
        low, high = self._spans(panes)
        before = high.groupby([panes["item"], panes["user"]], dropna=False).shift(fill_value=-(2**62))
        base = pd.DataFrame({"item": panes["item"], "low": low.clip(lower=first), "high": high.clip(upper=last), "n": panes["n"], "users": 0, "r": panes["r"]})
        new = base.assign(low=np.maximum(base["low"], before + 1), n=0, users=1, r=np.nan)
        spans = pd.concat([base, new])
        spans = spans[spans["low"] <= spans["high"]]
        if len(spans):
            spans = spans.groupby(["item", "low", "high"], dropna=False)[["n", "users", "r"]].sum(min_count=1).reset_index()
            size = (spans["high"] - spans["low"] + 1).to_numpy()
            rows = spans.loc[spans.index.repeat(size)]
            rows = rows.assign(number=rows["low"] + np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size))
            found = rows.groupby(["number", "item"], dropna=False)[["n", "users", "r"]].sum(min_count=1).reset_index()
            closes = pd.to_datetime(found["number"] * self.slide + self.window, unit="us")
            yield found.assign(closes=closes)[["closes", "item", "n", "users", "r"]]
        kept = panes[high > last]
        data = pa.Table.from_pandas(kept, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, data.schema) as writer:
            writer.write_table(data)
        self.held.update((sink.getvalue().to_pybytes(), watermark))
        self.handle.registerTimer(watermark // 1000 + 1)

    def _read(self) -> tuple[list[pd.DataFrame], int | None]:
        if not self.held.exists():
            return [], None
        panes, closed = self.held.get()
        return [pa.ipc.open_stream(panes).read_pandas()], closed

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        parts, closed = self._read()
        for part in rows:
            part = part.assign(pane=part["micros"] // self.span * self.span, n=1, r=part["rating"].astype(float))
            parts.append(self._panes([part]))
        yield from self._advance(self._panes(parts), watermark if closed is None else closed, watermark)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        (panes,), closed = self._read()
        if watermark > closed:
            yield from self._advance(panes, closed, watermark)

    def close(self) -> None:
        pass


def trending(
    stream: DataFrame, item: str = "item_id", window: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour", buckets: int = 64
) -> DataFrame:
    """Trend score per sliding window and item, emitted when the window closes.

    Distinct users are exact: (item, user) keys share ``buckets`` states, a number that is fixed for the life of a
    checkpoint, each of which counts its users per window once; the windows' sums are added up over the buckets. A hot
    item is spread over its users, and no row is copied for each of its windows. Start the query inside
    :func:`rocks_state`.
    """
    kind = stream.schema[item].dataType
    timed = event_time(stream, "timestamp", delay).filter(F.col("timestamp").isNotNull())
    plain = timed.select(
        F.unix_micros("timestamp").alias("micros"), F.col(item).cast("string").alias("item"), F.col("user_id").cast("string").alias("user"),
        F.col("rating").cast("double").alias("rating"), F.pmod(F.xxhash64(item, "user_id"), F.lit(buckets)).alias("bucket"),
    )
    width, step = (_micros(stream.sparkSession, x) for x in (window, slide))
    made = "closes timestamp, item string, n long, users long, r double"
    found = plain.groupBy("bucket").transformWithStateInPandas(WindowUsers(width, step), made, "Append", "EventTime", eventTimeColumnName="closes")
    per_item = found.groupBy("closes", "item").agg(
        F.sum("n").alias("interaction_count"), F.sum("users").alias("unique_users"), F.sum("r").alias("r")
    )
    score = F.col("r") * F.log(F.col("unique_users") + 1)
    return per_item.select(
        F.timestamp_micros(F.unix_micros("closes") - width).alias("window_start"), F.col("item").cast(kind).alias("item_id"),
        "interaction_count", "unique_users", score.alias("trending_score"),
    )


def kpis(stream: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Requests per minute, success, latency and hit rate per closed tumbling window."""
    n = F.count(F.lit(1))
    return (
        event_time(stream, "timestamp", delay)
        .groupBy(F.window("timestamp", f"{minutes} minutes"))
        .agg(
            (n / minutes).alias("requests_per_minute"),
            (F.count_if("success") / n * 100).alias("success_rate"),
            F.avg("duration_ms").alias("average_response_time"),
            (F.count_if(F.col("cache_event") == "CacheHit") / n * 100).alias("cache_hit_rate"),
        )
        .select(
            F.col("window.start").alias("window_start"), "requests_per_minute", "success_rate",
            "average_response_time", "cache_hit_rate",
        )
    )


def window_alerts(stream: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Alert rules applied to every closed KPI window."""
    values = {
        "recommendation_error_rate": 100 - F.col("success_rate"),
        "recommendation_response_time": F.col("average_response_time"),
        "cache_hit_rate": F.col("cache_hit_rate"),
    }
    return alerts(metric_rows(kpis(stream, minutes, delay), values, keep=["window_start"]))


def session_windows(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions closed by a gap, with their event counts."""
    return (
        event_time(stream, "timestamp", delay)
        .groupBy("user_id", F.session_window("timestamp", gap))
        .agg(F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("session_end"))
        .select("user_id", F.col("session_window.start").alias("session_start"), "session_end", "events")
    )


STATE_SCHEMA = "items array<bigint>, micros array<bigint>"


def user_state(stream: DataFrame, item: str = "item_id", n: int = 5) -> DataFrame:
    """Each user's last ``n`` items, updated per batch; the state never exceeds ``n`` entries.

    A user's rows arrive as a series of Arrow batches and each is cut to ``n``
    at once, so a busy user is never held whole.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, micros = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [])))
        for rows in batches:
            items, micros = np.append(items, rows["item"].to_numpy()), np.append(micros, rows["micros"].to_numpy())
            last = np.lexsort((items, micros))[-n:]
            items, micros = items[last], micros[last]
        state.update((items.tolist(), micros.tolist()))
        yield pd.DataFrame({"user_id": [key[0]], "items": [items.tolist()]})

    rows = stream.select(
        "user_id", F.col(item).cast("bigint").alias("item"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"),
    )
    return rows.groupBy("user_id").applyInPandasWithState(
        update, "user_id bigint, items array<bigint>", STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )
