"""A/B assignment, test windows, metrics and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket

# Critical value at 95 %, least users per arm, least effect in percent.
CRITICAL_VALUE = 1.96
MIN_USERS_PER_ARM = 1000
MIN_EFFECT_PERCENT = 5.0


def variant(user: Column, split: float | Column = 0.3) -> Column:
    """``treatment`` when the user's hash bucket / 10000 is below ``split``, else ``control``."""
    share = md5_bucket(user, 10_000) / 10_000
    return F.when(share < (F.lit(split) if isinstance(split, float) else split), "treatment").otherwise("control")


def ab_assign(df: DataFrame, user: str = "user_id", split: float = 0.3) -> DataFrame:
    """Add bucket and variant; a pure expression, so assignment needs no shuffle or state."""
    return df.withColumns({"bucket": md5_bucket(F.col(user)), "variant": variant(F.col(user), split)})


def active_tests(tests: DataFrame, as_of: Column) -> DataFrame:
    """Tests that are enabled and whose period, open ends allowed, holds ``as_of``."""
    return tests.filter(
        F.col("enabled")
        & (F.col("start_date").isNull() | (F.col("start_date") <= as_of))
        & (F.col("end_date").isNull() | (F.col("end_date") >= as_of))
    )


def validate_tests(tests: DataFrame) -> DataFrame:
    """Add ``reason`` (null for a valid test) and ``warning`` (both arms alike)."""
    return tests.withColumns(
        {
            "reason": F.when(~F.col("traffic_split").between(0.0, 1.0), "traffic split out of range").when(
                F.col("start_date") >= F.col("end_date"), "start not before end"
            ),
            "warning": F.when(F.col("control_algorithm") == F.col("treatment_algorithm"), "same algorithm in both arms"),
        }
    )


def test_results(
    results: DataFrame, test_name: str | None = None, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Result rows of a test and period; every part of the filter is optional."""
    if test_name is not None:
        results = results.filter(F.col("test_name") == test_name)
    if start is not None:
        results = results.filter(F.col("timestamp") >= start)
    if end is not None:
        results = results.filter(F.col("timestamp") <= end)
    return results


def _arm(name: str) -> Column:
    return F.col("variant") == name


def _improvement(before: Column, after: Column) -> Column:
    return F.when(before > 0, after / before * 100).otherwise(F.lit(0.0))


def ab_metrics(results: DataFrame, days: int = 7, as_of: Column | None = None) -> DataFrame:
    """One row of traffic, latency, error and confidence figures per arm over the last ``days``.

    ``recommendations`` is an array of structs with ``confidence_score``. A
    missing response time counts 0. ``*_avg_confidence`` divides by all results,
    ``*_mean_confidence`` only by those with recommendations.
    """
    end = results.agg(F.max("timestamp")).scalar() if as_of is None else as_of
    recent = test_results(results, start=end - F.make_dt_interval(days=F.lit(days)), end=end)
    scores = F.transform("recommendations", lambda r: r["confidence_score"])
    mean = F.when(
        F.size("recommendations") > 0,
        F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size("recommendations"),
    )
    rows = recent.select(
        "variant", "user_id", F.coalesce("response_time_ms", F.lit(0.0)).alias("ms"),
        F.col("error_occurred").cast("int").alias("err"), mean.alias("conf"),
    )
    columns = []
    for arm in ("control", "treatment"):
        mine = _arm(arm)
        n = F.greatest(F.count_if(mine), F.lit(1))
        columns += [
            F.count_if(mine).alias(f"{arm}_requests"),
            F.count_distinct(F.when(mine, F.col("user_id"))).alias(f"{arm}_users"),
            (F.coalesce(F.sum(F.when(mine, F.col("ms"))), F.lit(0.0)) / n).alias(f"_{arm}_ms"),
            (F.coalesce(F.sum(F.when(mine, F.col("err"))), F.lit(0)) / n).alias(f"_{arm}_err"),
            (F.coalesce(F.sum(F.when(mine, F.col("conf"))), F.lit(0.0)) / n).alias(f"_{arm}_conf"),
            F.avg(F.when(mine, F.col("conf"))).alias(f"_{arm}_mean"),
        ]
    row = rows.agg(F.count(F.lit(1)).alias("total_requests"), *columns)
    c, t = F.col("_control_ms"), F.col("_treatment_ms")
    cc, tc = F.col("_control_conf"), F.col("_treatment_conf")
    return row.select(
        "total_requests", "control_requests", "treatment_requests", "control_users", "treatment_users",
        (F.col("treatment_requests") / F.greatest("total_requests", F.lit(1))).alias("actual_treatment_split"),
        F.round(c, 2).alias("control_avg_response_time_ms"),
        F.round(t, 2).alias("treatment_avg_response_time_ms"),
        F.round(_improvement(c, c - t), 2).alias("response_time_improvement"),
        F.round(F.col("_control_err") * 100, 2).alias("control_error_rate"),
        F.round(F.col("_treatment_err") * 100, 2).alias("treatment_error_rate"),
        F.round(cc, 3).alias("control_avg_confidence"),
        F.round(tc, 3).alias("treatment_avg_confidence"),
        F.round(_improvement(cc, tc - cc), 2).alias("confidence_improvement"),
        F.round("_control_mean", 3).alias("control_mean_confidence"),
        F.round("_treatment_mean", 3).alias("treatment_mean_confidence"),
    )


def variant_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("variant").agg(F.count(F.lit(1)).alias("requests"))


def ab_significance(
    df: DataFrame,
    converted: Column,
    measure: Column,
    min_users: int = MIN_USERS_PER_ARM,
    critical: float = CRITICAL_VALUE,
    min_effect: float = MIN_EFFECT_PERCENT,
) -> DataFrame:
    """One row: two-proportion z on conversion and Welch t on a measure, with the validity checks.

    All that is needed per arm is a count, a mean and a variance, so the data
    are reduced in one partial aggregation.
    """
    rows = df.select("variant", "user_id", converted.cast("int").alias("hit"), measure.cast("double").alias("m"))
    columns = []
    for arm, short in (("control", "c"), ("treatment", "t")):
        mine = _arm(arm)
        columns += [
            F.count_if(mine).alias(f"{short}_n"),
            F.count_distinct(F.when(mine, F.col("user_id"))).alias(f"{short}_users"),
            F.avg(F.when(mine, F.col("hit"))).alias(f"{short}_rate"),
            F.avg(F.when(mine, F.col("m"))).alias(f"{short}_mean"),
            F.var_samp(F.when(mine, F.col("m"))).alias(f"{short}_var"),
        ]
    row = rows.agg(*columns)
    cn, tn = F.col("c_n"), F.col("t_n")
    pooled = (F.col("c_rate") * cn + F.col("t_rate") * tn) / (cn + tn)
    z = F.try_divide(F.col("t_rate") - F.col("c_rate"), F.sqrt(pooled * (1 - pooled) * (1 / cn + 1 / tn)))
    welch = F.try_divide(
        F.col("t_mean") - F.col("c_mean"), F.sqrt(F.col("c_var") / cn + F.col("t_var") / tn)
    )
    effect = F.try_divide(F.col("t_rate") - F.col("c_rate"), F.col("c_rate")) * 100
    return row.withColumns(
        {
            "z": z,
            "welch_t": welch,
            "effect_percent": effect,
            "enough_users": (F.col("c_users") >= min_users) & (F.col("t_users") >= min_users),
            "significant": (F.abs(z) > critical),
            "large_enough": F.abs(effect) >= min_effect,
        }
    )
