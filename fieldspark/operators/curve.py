"""Compare series with an external curve at the curve's own time points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import log_ratio
from fieldspark.operators.ordered import TILE_SIZE, nearest_marked, tile_rows
from fieldspark.operators.stats import (
    SLOPE_TMAX,
    SLOPE_TMIN,
    in_window,
    max_abs,
    mean,
    mean_abs,
    rms,
    slope_comparison_columns,
)
from fieldspark.plans.scale import attach, durable

# The curve's times are cut into 2^LEVELS bins of about equal counts.
LEVELS = 6
# Ranges of one time stretch that are met in one place, at least; more are dealt out, so that none holds above this share.
STRETCH_ROWS = 64
STRETCH_SHARE = 1 / 200


def time_bins(curve: DataFrame, time: str, levels: int = LEVELS) -> list[float]:
    """Bounds between the bins: quantiles of the curve's times."""
    shares = [k / (1 << levels) for k in range(1, 1 << levels)]
    found = curve.agg(F.percentile_approx(time, F.array(*map(F.lit, shares)), 10_000)).first()[0]
    return sorted(set(found or []))


def _bin_of(value: Column, bounds: Sequence[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value)) if bounds else F.lit(0)


def range_stretches(ranges: DataFrame, bounds: Sequence[float], levels: int = LEVELS) -> DataFrame:
    """The ranges (_lo, _hi) with the stretches (_level, _node) that they consist of.

    A stretch of level k is 2^k bins, aligned. Every range is the union of at most two stretches a level, whatever its
    length, and every bin lies in one stretch a level.
    """
    low, after = _bin_of(F.col("_lo"), bounds), _bin_of(F.col("_hi"), bounds) + 1
    cut = ranges.withColumns({"_first": low, "_after": after})
    stretches = []
    for k in range(levels + 1):
        left, right = F.ceil(F.col("_first") / (1 << k)), F.floor(F.col("_after") / (1 << k))
        there = left < right
        top = F.lit(k == levels)
        for node, here in ((left, (left % 2 == 1) | top), (right - 1, (right % 2 == 1) & ~top)):
            stretches.append(F.when(there & here, F.struct(F.lit(k).alias("_level"), node.cast("int").alias("_node"))))
    return cut.select(*ranges.columns, F.inline(F.array_compact(F.array(*stretches))))


def met_ranges(curve: DataFrame, ranges: DataFrame, time: str, share: float = STRETCH_SHARE) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join of curve points with the ranges around them, on (_level, _node, _salt).

    Stretches with many ranges are salted: their ranges are dealt out and the few points of the curve are repeated.
    """
    bounds = time_bins(curve, time)
    pieces = durable(range_stretches(ranges, bounds))
    counts = durable(pieces.groupBy("_level", "_node").agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    salts = counts.select("_level", "_node", F.ceil(F.col("_rows") / max(STRETCH_ROWS, int(total * share))).cast("int").alias("_salts"))
    place = ["_level", "_node"]
    keys = [c for c in ranges.columns if c not in ("_lo", "_hi")]
    dealt = attach(pieces, salts, place).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.col("_salts").cast("long")).cast("int")).drop("_salts")
    at = curve.withColumn("_bin", _bin_of(F.col(time), bounds))
    at = at.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("_node", F.expr("shiftright(_bin, _level)"))
    repeated = attach(at.drop("_bin"), salts, place).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt, repeated


def curve_for_each_key(curve: DataFrame, series: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Give every key the curve points inside its own time range.

    Ranges consist of few aligned stretches of time bins, so points meet ranges by an equi-join on the stretch and no
    point is paired with a key it does not overlap, but at the two ends of a range.
    """
    ranges = durable(series.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).filter("_lo is not null"))
    dealt, repeated = met_ranges(curve, ranges, time)
    met = repeated.join(dealt, ["_level", "_node", "_salt"]).filter(F.col(time).between(F.col("_lo"), F.col("_hi")))
    return met.drop("_level", "_node", "_salt", "_lo", "_hi")


def interpolate_at_curve(
    series: DataFrame,
    curve: DataFrame,
    keys: Sequence[str] = ("case",),
    time: str = "time",
    value: str = "x_front",
    curve_value: str = "x",
    interpolated: str = "simulation_x_interp",
    error: str = "x_error",
    tile_size: int = TILE_SIZE,
) -> DataFrame:
    """Linear interpolation of each series at the curve times within its range, with errors."""
    knots = series.select(
        *keys, time, F.lit(0).alias("_kind"), F.col(value).alias("_x"), F.lit(None).cast("double").alias("_curve")
    )
    points = curve_for_each_key(curve.select(time, F.col(curve_value).alias("_curve")), series, keys, time)
    points = points.select(*keys, time, F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_x"), "_curve")
    # A knot at the very time of a curve point sorts before it, so it brackets from below.
    tiles = tile_rows(knots.unionByName(points), keys, [time, "_kind"], 0, tile_size)
    knot = F.struct(F.col(time).alias("t"), F.col("_x").alias("x"))
    rows = nearest_marked(tiles, F.col("_kind") == 0, knot, "_left", "_right").rows.filter("_kind = 1")

    left_t, left_x = F.col("_left.t"), F.col("_left.x")
    run, rise = F.col("_right.t") - left_t, F.col("_right.x") - left_x
    at = F.when(F.col(time) == left_t, left_x).otherwise(left_x + rise * F.try_divide(F.col(time) - left_t, run))
    return (
        rows.select(*keys, time, F.col("_curve").alias("paper_x"), at.alias(interpolated))
        .withColumn(error, F.col(interpolated) - F.col("paper_x"))
        .withColumn("relative_error", F.try_divide(error, "paper_x"))
        .withColumn("log_error", log_ratio(interpolated, "paper_x"))
    )


def slope_comparison(
    comparison: DataFrame,
    keys: Sequence[str] = ("case",),
    compared: str = "simulation_x_interp",
    label: str = "simulation",
    tmin: float = SLOPE_TMIN,
    tmax: float = SLOPE_TMAX,
    with_error_stats: bool = False,
) -> DataFrame:
    columns = slope_comparison_columns(
        "time", compared, label, tmin=tmin, tmax=tmax, with_error_stats=with_error_stats
    )
    return comparison.groupBy(*keys).agg(*columns)


def overlay_summary_raw(comparison: DataFrame, keys: Sequence[str] = ("case",)) -> DataFrame:
    """Summary of a raw series against the curve; missing errors are skipped."""
    error, relative, log = F.col("x_error"), F.col("relative_error"), F.col("log_error")
    return comparison.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_comparison_points"),
        F.min("time").alias("time_min_compared"),
        F.max("time").alias("time_max_compared"),
        mean(error).alias("mean_signed_error"),
        mean_abs(error).alias("mean_abs_error"),
        rms(error).alias("rms_error"),
        mean(relative).alias("mean_signed_relative_error"),
        mean_abs(relative).alias("mean_abs_relative_error"),
        max_abs(relative).alias("max_abs_relative_error"),
        rms(log).alias("rms_log_error"),
        *slope_comparison_columns("time", "simulation_x_interp", "simulation", with_error_stats=True),
    )


def overlay_summary_processed(
    comparison: DataFrame, shifts: DataFrame, keys: Sequence[str] = ("case",)
) -> DataFrame:
    """Summary of a processed series; ``shifts`` holds ``processed_x0_shift`` per key.

    Plain errors count every point, so one missing value makes the figure missing.
    """
    error, relative = F.col("error"), F.col("relative_error")
    summary = comparison.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_comparison_points"),
        F.min("time").alias("time_min_compared"),
        F.max("time").alias("time_max_compared"),
        mean_abs(error, finite_only=False).alias("mean_abs_error"),
        rms(error, finite_only=False).alias("rms_error"),
        mean_abs(relative, finite_only=False).alias("mean_abs_relative_error"),
        max_abs(relative, finite_only=False).alias("max_abs_relative_error"),
        rms(F.col("log_error")).alias("rms_log_error"),
        *slope_comparison_columns("time", "processed_x_interp", "processed"),
    )
    return summary.join(shifts, list(keys))


def overlay_points(
    df: DataFrame, time: str, value: str, loglog: bool = False, window: tuple[float, float] | None = None
) -> DataFrame:
    """Rows an overlay draws: positive ones on log axes, those in the window if given."""
    if loglog:
        df = df.filter((F.col(time) > 0.0) & (F.col(value) > 0.0))
    if window is not None:
        df = df.filter(in_window(time, *window))
    return df
