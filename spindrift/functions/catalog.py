"""Catalogue predicates and bucket labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def rating_range(rating: Column) -> Column:
    """``n-(n+1)``; null for a null or zero rating."""
    low = F.floor(rating)
    return F.when(rating != 0, F.concat(low.cast("string"), F.lit("-"), (low + 1).cast("string")))


def duration_range(minutes: Column) -> Column:
    """The four duration labels; null for a null or zero duration."""
    return (
        F.when((minutes == 0) | minutes.isNull(), None)
        .when(minutes < 60, "Under 1 hour")
        .when(minutes < 120, "1-2 hours")
        .when(minutes < 180, "2-3 hours")
        .otherwise("Over 3 hours")
    )



def _matches(name: str, value: object, is_array: bool) -> Column:
    """Scalar equals, list is any-of, dict is a range with min/gte/gt and max/lte/lt."""
    column = F.col(name)
    if isinstance(value, dict):
        tests = {
            "gte": column.__ge__, "min": column.__ge__, "gt": column.__gt__,
            "lte": column.__le__, "max": column.__le__, "lt": column.__lt__,
        }
        unknown = set(value) - set(tests)
        if unknown:
            raise ValueError(f"unknown range keys for {name}: {sorted(unknown)}")
        return reduce(lambda a, b: a & b, [tests[k](v) for k, v in value.items()])
    if is_array:
        wanted = list(value) if isinstance(value, (list, tuple, set)) else [value]
        return F.arrays_overlap(column, F.array(*map(F.lit, wanted)))
    if isinstance(value, (list, tuple, set)):
        return column.isin(*value)
    return column == value


def catalog_predicate(filters: dict[str, object] | None) -> Column:
    """One pushable predicate for the discovery filter keys; unknown keys are ignored.

    ``rating_min`` drops null and zero ratings, ``duration_max`` keeps null durations.
    """
    test = F.lit(True)
    for key, value in (filters or {}).items():
        if key in ("category", "genre", "language"):
            test = test & (F.col(key) == value)
        elif key == "year_min":
            test = test & (F.col("year") >= value)
        elif key == "year_max":
            test = test & (F.col("year") <= value)
        elif key == "rating_min":
            test = test & (F.col("rating") >= value) & (F.col("rating") != 0)
        elif key == "duration_max":
            test = test & (F.col("duration").isNull() | (F.col("duration") <= value))
    return test


def document_predicate(filters: dict[str, object], array_columns: tuple[str, ...] = ("genre",)) -> Column:
    """AND of per-column tests for index documents: equals, any-of, or range dicts."""
    tests = [_matches(name, value, name in array_columns) for name, value in filters.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
