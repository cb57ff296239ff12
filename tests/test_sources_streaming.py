import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.sources import readers, sinks
from spindrift.streaming import jobs


def test_ingest_skips_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    found = readers.ingest(spark, {"a": f"{tmp_path}/a.csv", "b": f"{tmp_path}/b.txt", "c": f"{tmp_path}/c.parquet"})
    assert set(found) == {"a"} and {"ingestion_timestamp", "source_file"} <= set(found["a"].columns)


def test_loader_takes_the_first_existing_path(spark, tmp_path):
    (tmp_path / "b.csv").write_text("user_id,item_id,rating,timestamp\n1,2,3.5,2024-01-01 00:00:00\n")
    row = readers.load_interactions(spark, f"{tmp_path}/a.csv", f"{tmp_path}/b.csv").first()
    assert (row.user_id, row.rating) == (1, 3.5)
    with pytest.raises(FileNotFoundError):
        readers.load_interactions(spark, f"{tmp_path}/a.csv")


def test_dat_layout(spark, tmp_path):
    (tmp_path / "movies.dat").write_bytes("1::Amélie (2001)::Comedy|Romance\n2::Short\n3::X::(no genres listed)\n".encode("latin-1"))
    (tmp_path / "ratings.dat").write_text("1::1::4::978300760\n1::2\n")
    (tmp_path / "users.dat").write_text("1::F::25::10::48067\n2::M\n")
    got = readers.read_movielens_dat(spark, str(tmp_path))
    names = {r.product_id: (r.name, r.genres) for r in got["products"].collect()}
    assert names == {"movie_1": ("Amélie (2001)", ["Comedy", "Romance"]), "movie_3": ("X", [])}
    assert [r.user_id for r in got["users"].collect()] == ["user_1"]
    assert [(r.rating, r.timestamp) for r in got["interactions"].collect()] == [(4.0, 978300760)]


def test_book_layout(spark, tmp_path):
    (tmp_path / "BX-Books.csv").write_text('"I";"T";"A";"Y";"P";"S";"M";"L"\n"1";"One; two";"a";"1999";"p";"s";"m";"l"\n"2";"cut"\n')
    (tmp_path / "BX-Book-Ratings.csv").write_text('"U";"I";"R"\n"7";"1";"0"\n"8";"1";"6"\n')
    got = readers.read_bookcrossing(spark, str(tmp_path))
    assert [(r.product_id, r.name) for r in got["products"].collect()] == [("book_1", "One; two")]
    assert [(r.user_id, r.rating) for r in got["interactions"].collect()] == [("user_8", 6.0)]


def test_flat_export_keeps_nested_values_as_json(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, array('a', 'b') AS tags, named_struct('x', 1) AS s, map('k', 2) AS m")
    sinks.export_flat(df, f"{tmp_path}/o.csv")
    row = spark.read.csv(f"{tmp_path}/o.csv", header=True, escape='"').first()
    assert (row.tags, row.s, row.m) == ('["a","b"]', '{"x":1}', '{"k":2}')


def test_partitioned_write_reads_back(spark, tmp_path):
    df = spark.range(100).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("d"))
    sinks.write_processed({"t": df}, str(tmp_path), {"t": "d"})
    assert spark.read.parquet(f"{tmp_path}/t").filter("d = '2024-01-02'").count() == 33


def feed(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    return jobs.file_stream(spark, f"{tmp_path}/feed", spark.createDataFrame([], schema).schema)


def test_replayed_intake_does_not_double_rows(spark, tmp_path):
    schema = "user_id long, item_id long, event_type string, rating double, timestamp timestamp"
    t = datetime.datetime.fromisoformat("2024-01-01 00:00:10")
    stream = feed(spark, tmp_path, [(1, 2, "view", None, t), (1, 2, "odd", None, t)], schema)
    paths = (f"{tmp_path}/ok", f"{tmp_path}/bad")
    for checkpoint in ("one", "two"):
        jobs.ingest_events(stream, *paths, f"{tmp_path}/{checkpoint}")
    assert [r.interaction_id for r in spark.read.parquet(paths[0]).collect()] == ["1_2_1704067210"]
    assert spark.read.parquet(paths[1]).count() == 1


def test_user_state_keeps_the_last_items_over_batches(spark, tmp_path):
    schema = "user_id long, item_id long, timestamp timestamp"
    times = [datetime.datetime.fromisoformat("2024-01-01") + datetime.timedelta(hours=h) for h in range(6)]
    out = {}

    def store(batch, _):
        out.update({r.user_id: r["items"] for r in batch.collect()})

    for part in (range(0, 4), range(4, 6)):
        stream = feed(spark, tmp_path, [(1, i, times[i]) for i in part], schema)
        jobs.run_batches(jobs.user_state(stream, n=3), store, f"{tmp_path}/cp", "update")
    assert out == {1: [3, 4, 5]}


def moments(events):
    return [(i, datetime.datetime.fromisoformat(t)) for i, t in events]


def test_first_and_late_rows_over_batches(spark, tmp_path):
    schema = "event_id long, timestamp timestamp"
    batches = [
        [(1, "2024-01-02 00:00"), (2, "2024-01-02 05:00"), (2, "2024-01-02 05:00")],
        [(3, "2024-01-01 00:00"), (3, "2024-01-01 00:00"), (2, "2024-01-02 04:30"), (4, "2024-01-02 05:10")],
        [(1, "2024-01-02 08:00"), (5, "2024-01-02 04:10")],
        [(2, "2024-01-02 07:30"), (None, "2024-01-02 07:40"), (None, "2024-01-02 07:50")],
    ]
    for events in batches:
        feed(spark, tmp_path, moments(events), schema)
    stream = jobs.file_stream(spark, f"{tmp_path}/feed", spark.createDataFrame([], schema).schema, 1)
    paths = [f"{tmp_path}/{name}" for name in ("kept", "late", "checkpoint")]
    before = spark.conf.get(jobs.STATE_STORE, None)
    query = jobs.split_late(jobs.first_rows(stream, ["event_id"], "1 hour"), *paths)
    assert spark.conf.get(jobs.STATE_STORE, None) == before and len(query.recentProgress) >= 4
    kept, late = ([(r.batch, r.event_id, str(r.timestamp)[5:16]) for r in spark.read.parquet(p).orderBy("batch", "event_id", "timestamp").collect()] for p in paths[:2])
    # A first row stands for its key until the watermark, an hour behind, has passed it by an hour; a null key is a key.
    assert kept == [
        (0, 1, "01-02 00:00"), (0, 2, "01-02 05:00"), (1, 4, "01-02 05:10"), (2, 1, "01-02 08:00"), (3, None, "01-02 07:40"), (3, 2, "01-02 07:30"),
    ]
    assert late == [(1, 3, "01-01 00:00")] * 2 + [(2, 5, "01-02 04:10")]


def test_ordered_feed_comes_in_order_one_file_a_batch(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds((F.col("id") * 7919) % 1000 * 60).alias("timestamp")).repartition(7)
    stream = jobs.ordered_feed(rows, f"{tmp_path}/feed", batches=5)
    spans = []

    def note(batch, _):
        r = batch.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n")).first()
        spans.append((r.a, r.b, r.n))

    jobs.run_batches(stream, note, f"{tmp_path}/cp")
    assert len(spans) == 5 and sum(n for *_, n in spans) == 1000
    assert all(before[1] < after[0] for before, after in zip(spans, spans[1:]))


def test_restarted_dedup_goes_on_from_its_state(spark, tmp_path):
    schema = "event_id long, timestamp timestamp"
    paths = [f"{tmp_path}/{name}" for name in ("kept", "late", "checkpoint")]
    for events in ([(1, "2024-01-02 00:00")], [(1, "2024-01-02 00:20"), (2, "2024-01-02 00:30")], [(3, "2024-01-01 23:00")]):
        stream = feed(spark, tmp_path, moments(events), schema)
        jobs.split_late(jobs.first_rows(stream, ["event_id"], "1 hour"), *paths)
    assert sorted(r.event_id for r in spark.read.parquet(paths[0]).collect()) == [1, 2]
    assert [r.event_id for r in spark.read.parquet(paths[1]).collect()] == [3]


def test_trending_counts_every_row_in_its_open_windows(spark, tmp_path):
    schema = "user_id long, item_id long, rating double, timestamp timestamp"
    rows = [
        [(1, 7, 1.0, "00:10"), (2, 7, 2.0, "00:50"), (1, 7, 1.0, "02:20"), (1, 8, None, "02:30"), (1, 7, 4.0, "05:40")],
        [(3, 7, 1.0, "04:59"), (2, 7, 1.0, "01:30"), (None, 7, 1.0, "05:10"), (1, 9, 1.0, "10:00")],
        [(1, 7, 1.0, "03:00"), (1, None, 1.0, "20:00")],
    ]
    for part in rows:
        feed(spark, tmp_path, [(u, i, r, datetime.datetime.fromisoformat(f"2024-01-02 {t}")) for u, i, r, t in part], schema)
    stream = jobs.file_stream(spark, f"{tmp_path}/feed", spark.createDataFrame([], schema).schema, 1)
    with jobs.rocks_state(spark):
        got = jobs.collect_stream(jobs.trending(stream, window="3 hours", slide="1 hour"), "trending")
        got = {(str(r.window_start)[5:13], r.item_id): (r.interaction_count, r.unique_users, r.trending_score and round(r.trending_score / np.log(r.unique_users + 1), 6)) for r in got.collect()}
    # The second batch finds every window open; before the third those up to 04:40 are closed, so 03:00 counts from 02:00 on.
    day = "01-0"
    want = {
        (f"{day}1 22", 7): (2, 2, 3.0), (f"{day}1 23", 7): (3, 2, 4.0), (f"{day}2 00", 7): (4, 2, 5.0), (f"{day}2 00", 8): (1, 1, None),
        (f"{day}2 01", 7): (2, 2, 2.0), (f"{day}2 01", 8): (1, 1, None), (f"{day}2 02", 7): (3, 2, 3.0), (f"{day}2 02", 8): (1, 1, None),
        (f"{day}2 03", 7): (4, 3, 7.0), (f"{day}2 04", 7): (3, 3, 6.0), (f"{day}2 05", 7): (2, 2, 5.0),
        **{(f"{day}2 {h:02}", 9): (1, 1, 1.0) for h in (8, 9, 10)},
    }
    assert got == want


def test_trending_state_has_one_entry_per_user_item_and_pane():
    hour = 3_600_000_000

    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        held = Held()
        getValueState = lambda self, *_: self.held
        registerTimer = lambda self, _: None

    class Times:
        getCurrentWatermarkInMs = lambda self: 40 * hour // 1000

    counter, handle = jobs.WindowUsers(24 * hour, hour), Handle()
    counter.init(handle)
    rows = pd.DataFrame({"micros": [41 * hour, 41 * hour + 5, 30 * hour], "item": "a", "user": ["u", "u", "v"], "rating": 1.0})
    assert list(counter.handleInputRows((0,), iter([rows]), Times())) == []
    (panes,), closed = counter._read()
    assert closed == 40 * hour and sorted(panes[["user", "n"]].itertuples(index=False, name=None)) == [("u", 2), ("v", 1)]
    Times.getCurrentWatermarkInMs = lambda self: 54 * hour // 1000
    (found,) = counter.handleExpiredTimer((0,), Times(), None)
    assert found["users"].max() == 2 and found["n"].max() == 3 and len(found) == 14
    assert counter._read()[0][0]["user"].tolist() == ["u"]


def test_dedup_state_holds_only_what_the_next_batch_can_need():
    minute = 60_000_000

    class Seen:
        rows = []
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        clear = lambda self: self.put([])

        def put(self, rows):
            self.rows = rows

    class Handle:
        seen = Seen()
        getListState = lambda self, *_: self.seen
        registerTimer = lambda self, _: None

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    first, handle = jobs.FirstRows(10 * minute), Handle()
    first.init(handle)
    rows = pd.DataFrame({"micros": np.arange(1, 101) * minute, "key": [str(i) for i in range(1, 101)], "bucket": 0})
    (found,) = first.handleInputRows((0,), iter([rows]), Times())
    # The watermark will be at minute 90, where rows up to minute 80 are forgotten.
    assert len(found) == 100 and sorted(int(key) for key, _ in handle.seen.rows) == list(range(81, 101))
