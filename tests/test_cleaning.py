import pytest
from pyspark.sql import functions as F

from spindrift.functions import catalog
from spindrift.operators import cleaning


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_missing_column_fails_while_planning(spark):
    with pytest.raises(ValueError, match="rating"):
        cleaning.clean_interactions(frame(spark, [(1, 2, "x")], "user_id int, item_id int, timestamp string"))


def test_rating_bounds_and_duplicates(spark, rows):
    data = [(1, 1, r, "t") for r in (None, 0.99, 5.01)] + [(1, 2, 1.0, "t"), (1, 3, 5.0, "t"), (1, 3, 2.0, "t"), (None, 3, 2.0, "t")]
    df = frame(spark, data, "user_id int, item_id int, rating double, timestamp string")
    assert rows(cleaning.clean_interactions(df), "item_id") == [(1, 2, 1.0, "t"), (1, 3, 2.0, "t")]


def test_latest_variant_dedupes_before_the_range_check(spark, rows):
    data = [(1, 1, 9.0, "2024-01-01"), (1, 1, 4.0, "2024-01-02"), (1, 2, 4.0, "2024-01-02")]
    df = frame(spark, data, "user_id int, item_id int, rating double, timestamp string")
    assert rows(cleaning.clean_interactions_latest(df, 1).select("item_id", "rating")) == [(2, 4.0)]


def test_k_core_counts_both_sides_once(spark, rows):
    df = frame(spark, [(1, 1), (1, 2), (2, 1), (3, 3)], "user_id int, item_id int")
    assert rows(cleaning.k_core_filter(df, 2)) == [(1, 1)]


def test_timestamp_formats(spark):
    df = frame(spark, [("2024-01-02 03:04:05",), ("2024-01-02",), ("nonsense",)], "t string")
    got = [r[0] for r in df.select(cleaning.parse_timestamp(F.col("t"))).collect()]
    assert [str(x) for x in got] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "None"]


def test_content_text_and_features(spark):
    df = frame(spark, [(1, " a!b ", None, "Drama,Crime", ""), (1, "zz", None, "x", ""), (None, "q", "q", "q", "q")],
               "item_id int, title string, description string, genre string, tags string")
    row = cleaning.content_features(cleaning.clean_content(df)).first()
    assert (row.title, row.description, row.genre_primary, row.tag_count, row.has_description) == ("ab", "", "Drama", 1, 0)


@pytest.mark.parametrize("minutes,kept", [(0, None), (1, 1), (1000, 1000), (1001, None)])
def test_duration_guard(spark, minutes, kept):
    df = frame(spark, [(minutes, 1899)], "duration_minutes int, release_year int")
    row = cleaning.content_range_guard(df, 2024).first()
    assert row.duration_minutes == kept and row.release_year is None and row.content_age is None


def test_event_reasons(spark):
    data = [(1, 1, "view", None, "t"), (1, 1, "nod", 3.0, "t"), (1, 1, "like", 6.0, "t"), (None, 1, "view", 3.0, "t"), (1, 1, "view", 3.0, None)]
    df = frame(spark, data, "user_id int, item_id int, event_type string, rating double, timestamp string")
    got = [r.reason for r in cleaning.validate_events(df).collect()]
    assert got == [None, "unknown type", "rating out of range", "missing id", "missing timestamp"]


def test_insights_defaults(spark):
    df = frame(spark, [("{}",), ("[1]",), ("{bad",), (None,), ('{"summary": "s", "user_segment": "u"}',)], "response string")
    got = [(r.summary, r.user_segment) for r in cleaning.parse_insights_json(df).collect()]
    assert got == [("", "general"), ("Invalid AI response format", "general"), ("AI analysis completed", "general"),
                   ("AI analysis completed", "general"), ("s", "u")]


def test_catalog_filter_rules(spark):
    df = frame(spark, [(1, 0.0, 10), (2, None, 10), (3, 5.0, None), (4, 5.0, 300)], "item_id int, rating double, duration int")
    kept = df.filter(catalog.catalog_predicate({"rating_min": 0.0, "duration_max": 200, "other": 1}))
    assert [r.item_id for r in kept.collect()] == [3]


def test_duration_labels(spark):
    df = frame(spark, [(m,) for m in (0, 59, 60, 119, 120, 179, 180, None)], "m int")
    got = [r[0] for r in df.select(catalog.duration_range(F.col("m"))).collect()]
    assert got == [None, "Under 1 hour", "1-2 hours", "1-2 hours", "2-3 hours", "2-3 hours", "Over 3 hours", None]
