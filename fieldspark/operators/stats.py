"""Aggregate expressions: finite statistics and linear-fit slopes.

All take columns in which missing values are NULL. With ``finite_only=False`` a
single missing value makes the statistic missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import finite_or_null, relative_difference

# The time window of the slope fits.
SLOPE_TMIN = 3.0
SLOPE_TMAX = 12.0


def _stat(value: Column, aggregate: Column, finite_only: bool) -> Column:
    if finite_only:
        return aggregate
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def mean(value: Column, finite_only: bool = True) -> Column:
    return _stat(value, F.avg(value), finite_only)


def mean_abs(value: Column, finite_only: bool = True) -> Column:
    return _stat(value, F.avg(F.abs(value)), finite_only)


def max_abs(value: Column, finite_only: bool = True) -> Column:
    return _stat(value, F.max(F.abs(value)), finite_only)


def rms(value: Column, finite_only: bool = True) -> Column:
    return _stat(value, F.sqrt(F.avg(value * value)), finite_only)


def slope(time: Column, value: Column) -> Column:
    """Least-squares slope of value on time; NULL below two points."""
    both = time.isNotNull() & value.isNotNull()
    return F.when(F.count(F.when(both, 1)) >= 2, F.regr_slope(value, time))


def in_window(time: str, tmin: float, tmax: float) -> Column:
    return F.col(time).between(tmin, tmax)


def window_slope_columns(
    time: str, value: str, tmin: float = SLOPE_TMIN, tmax: float = SLOPE_TMAX
) -> tuple[Column, Column]:
    """Point count and slope over the closed window."""
    inside = in_window(time, tmin, tmax)
    t, v = F.when(inside, F.col(time)), F.when(inside, F.col(value))
    return F.count_if(inside), slope(t, v)


def finite_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = finite_or_null(value)
    cleaned = df.withColumn("_v", v)
    x = F.col("_v")
    return cleaned.groupBy(*keys).agg(
        mean(x).alias("finite_mean"),
        mean_abs(x).alias("mean_abs"),
        max_abs(x).alias("max_abs"),
        rms(x).alias("rms"),
        mean_abs(x, finite_only=False).alias("mean_abs_all"),
        max_abs(x, finite_only=False).alias("max_abs_all"),
        rms(x, finite_only=False).alias("rms_all"),
    )


def window_slopes(
    df: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    tmin: float = SLOPE_TMIN,
    tmax: float = SLOPE_TMAX,
) -> DataFrame:
    n, fit = window_slope_columns(time, value, tmin, tmax)
    return df.groupBy(*keys).agg(
        slope(F.col(time), F.col(value)).alias("slope_all"),
        n.alias("n_window_points"),
        fit.alias("slope_window"),
    )


def slope_comparison_columns(
    time: str,
    compared: str,
    label: str,
    reference: str = "paper_x",
    tmin: float = SLOPE_TMIN,
    tmax: float = SLOPE_TMAX,
    with_error_stats: bool = False,
) -> list[Column]:
    """Slopes of both curves in the window, their difference and the errors there."""
    inside = in_window(time, tmin, tmax)
    n, own = window_slope_columns(time, compared, tmin, tmax)
    _, ref = window_slope_columns(time, reference, tmin, tmax)
    columns = [
        n.alias("n_slumping_points"),
        ref.alias("paper_slumping_velocity"),
        own.alias(f"{label}_slumping_velocity"),
        (own - ref).alias("slumping_velocity_difference"),
        relative_difference(own, ref).alias("slumping_velocity_relative_difference"),
    ]
    if with_error_stats:
        error = F.when(inside, F.col("relative_error"))
        enough = n >= 2
        columns += [
            F.when(enough, mean_abs(error)).alias("slumping_mean_abs_relative_error"),
            F.when(enough, max_abs(error)).alias("slumping_max_abs_relative_error"),
        ]
    return columns
