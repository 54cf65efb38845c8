"""Flatten snapshots to points, cut slices through them and describe both."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import finite, finite_or_null, half_even, speed
from fieldspark.functions.numeric import nan_to_null, strict
from fieldspark.plans.scale import attach, durable, spooled

# Defaults that decide the results.
Y_ROUND_DECIMALS = 10
SLAB_RATIO = 0.01
HISTOGRAM_BINS = 80


# --- snapshots -------------------------------------------------------------------


def concentration_source(temp: str = "temp", scal: str = "scal") -> Column:
    """Which element array holds the concentration: the first of temp, else of scal."""
    return F.when(F.size(temp) > 0, "temp[0]").when(F.size(scal) > 0, "scal[0]").otherwise("missing")


def concentration(temp: str = "temp", scal: str = "scal") -> Column:
    return F.coalesce(F.get(temp, F.lit(0)), F.get(scal, F.lit(0)))


def flatten_elements(elements: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per point from the element arrays ``pos``, ``vel``, ``pres``, ``temp``, ``scal``.

    Each holds one flat array per component; they are raveled in step. An element that lacks an array, or
    whose arrays differ in length, fails the job.
    """
    parts = {
        "x": F.col("pos")[0],
        "y": F.col("pos")[1],
        "z": F.col("pos")[2],
        "C": concentration(),
        "u": F.col("vel")[0],
        "v": F.col("vel")[1],
        "w": F.col("vel")[2],
        "p": F.col("pres")[0],
    }
    arrays = elements.select(*carry, *(c.alias(n) for n, c in parts.items()))
    sizes = [F.size(n) for n in parts]
    whole = F.coalesce(reduce(and_, [n.isNotNull() & (n == sizes[0]) & (n >= 0) for n in sizes]), F.lit(False))
    whole = whole & reduce(and_, [F.col(n).isNotNull() for n in parts])
    zipped = strict(whole, "Element without one of pos, vel, pres, temp or scal, or with arrays of unequal length.", F.arrays_zip(*parts))
    return arrays.select(*carry, F.inline(zipped))


def snapshot_profile(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element count, which arrays exist, the points per element and the concentration source."""
    parts = ["pos", "vel", "pres", "temp", "scal"]
    points = F.size(F.col("pos")[0])
    return elements.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("element_count"),
        *(F.max(F.col(p).isNotNull() & (F.size(p) > 0)).alias(f"has_{p}") for p in parts),
        F.min(points).alias("min_points"),
        F.max(points).alias("max_points"),
        F.min(concentration_source()).alias("concentration_source"),
    )


# --- slices ----------------------------------------------------------------------


def extent(points: DataFrame, keys: Sequence[str], axis: str = "y") -> DataFrame:
    return points.groupBy(*keys).agg(F.min(axis).alias(f"{axis}_min"), F.max(axis).alias(f"{axis}_max"))


def level_table(points: DataFrame, keys: Sequence[str], decimals: int = Y_ROUND_DECIMALS) -> DataFrame:
    """The rounded y levels of each snapshot with their points and y range; a missing or non-finite y fails the job.

    One pass over the points, kept: the target plane, the selected level and the counts all follow from it.
    """
    level = strict(finite("y"), "Non-finite y in a snapshot.", half_even("y", decimals))
    levels = points.groupBy(*keys, level.alias("level"))
    return durable(levels.agg(F.count(F.lit(1)).alias("points"), F.min("y").alias("y_min"), F.max("y").alias("y_max")))


def select_plane(
    points: DataFrame,
    keys: Sequence[str],
    y0: float | None = None,
    decimals: int = Y_ROUND_DECIMALS,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Per snapshot: target y0, the nearest level (lowest on a tie), the level count and the points on the level."""
    levels = level_table(points, keys, decimals) if levels is None else levels
    if y0 is None:
        # Both sides are small tables; the running job sees their sizes.
        middle = levels.groupBy(*keys).agg((0.5 * (F.min("y_min") + F.max("y_max"))).alias("y0"))
        levels = levels.join(middle, list(keys))
    else:
        levels = levels.withColumn("y0", F.lit(float(y0)))
    nearest = F.min(F.struct(F.abs(F.col("level") - F.col("y0")).alias("d"), F.col("level").alias("l"), "points"))
    return levels.groupBy(*keys).agg(
        F.first("y0").alias("y0"),
        nearest["l"].alias("selected_y"),
        F.count(F.lit(1)).alias("rounded_unique_y_count_before_selection"),
        nearest["points"].alias("point_count"),
    )


def slice_plane(
    points: DataFrame,
    keys: Sequence[str],
    y0: float | None = None,
    decimals: int = Y_ROUND_DECIMALS,
    with_selection: bool = False,
) -> DataFrame:
    """Keep the points whose rounded y is the level nearest to y0 (default: mid-range)."""
    chosen = select_plane(points, keys, y0, decimals).drop("point_count")
    kept = attach(points, chosen, keys).filter(half_even("y", decimals) == F.col("selected_y"))
    return kept if with_selection else kept.select(*points.columns)


def slab_bounds(
    points: DataFrame, keys: Sequence[str], y0: float | None = None, ratio: float = SLAB_RATIO
) -> DataFrame:
    ranges = extent(points, keys)
    target = F.lit(float(y0)) if y0 is not None else 0.5 * (F.col("y_min") + F.col("y_max"))
    width = F.lit(float(ratio)) * (F.col("y_max") - F.col("y_min"))
    return ranges.select(*keys, target.alias("y0"), width.alias("dy_tol"))


def slice_slab(
    points: DataFrame,
    keys: Sequence[str],
    y0: float | None = None,
    ratio: float = SLAB_RATIO,
    with_selection: bool = False,
) -> DataFrame:
    """Keep the points within ``ratio`` of the y range from y0, ends included."""
    bounds = slab_bounds(points, keys, y0, ratio)
    kept = attach(points, bounds, keys).filter(F.abs(F.col("y") - F.col("y0")) <= F.col("dy_tol"))
    return kept if with_selection else kept.select(*points.columns)


def slice_meta(
    points: DataFrame,
    keys: Sequence[str],
    mode: str = "nearest_plane",
    y0: float | None = None,
    ratio: float = SLAB_RATIO,
    decimals: int = Y_ROUND_DECIMALS,
) -> DataFrame:
    """One row per snapshot that describes its slice; mode-only columns are NULL otherwise."""
    facts = [F.lit(mode).alias("mode"), F.lit(float(ratio)).alias("slab_ratio"), F.lit(int(decimals)).alias("y_round_decimals")]
    names = ["y0", "selected_y", "dy_tol", "rounded_unique_y_count_before_selection"]
    if mode == "nearest_plane":
        # The levels say it all; the slice itself is not cut.
        described = select_plane(points, keys, y0, decimals).withColumn("dy_tol", F.lit(None).cast("double"))
    elif mode == "slab":
        bounds = attach(points.select(*keys, "y"), slab_bounds(points, keys, y0, ratio), keys)
        described = bounds.filter(F.abs(F.col("y") - F.col("y0")) <= F.col("dy_tol")).groupBy(*keys).agg(
            F.first("y0").alias("y0"),
            F.lit(None).cast("double").alias("selected_y"),
            F.first("dy_tol").alias("dy_tol"),
            F.lit(None).cast("long").alias("rounded_unique_y_count_before_selection"),
            F.count(F.lit(1)).alias("point_count"),
        )
    else:
        raise ValueError(f"Unknown slice mode {mode!r}.")
    return described.select(*keys, facts[0], *names, *facts[1:], "point_count")


# --- descriptions ------------------------------------------------------------------


def slice_summary(points: DataFrame, keys: Sequence[str], decimals: int = Y_ROUND_DECIMALS) -> DataFrame:
    """Point count, distinct rounded y levels and the finite range of every column and of speed."""
    columns = ["x", "y", "z", "C", "u", "v", "w", "p"]
    with_speed = points.withColumn("speed", speed())
    ranges = [
        f(finite_or_null(c)).alias(f"{c}_{n}") for c in [*columns, "speed"] for n, f in (("min", F.min), ("max", F.max))
    ]
    flat = with_speed.groupBy(*keys, half_even("y", decimals).alias("_level")).agg(
        F.count(F.lit(1)).alias("_rows"), *ranges
    )
    # The first grouping is by level, so the distinct count is a plain count here.
    return flat.groupBy(*keys).agg(
        F.sum("_rows").alias("point_count"),
        F.count("_level").alias("rounded_unique_y_count"),
        *(F.min(f"{c}_min").alias(f"{c}_min") for c in [*columns, "speed"]),
        *(F.max(f"{c}_max").alias(f"{c}_max") for c in [*columns, "speed"]),
    )


def value_histogram(
    points: DataFrame, keys: Sequence[str], value: str = "y", bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width counts between the smallest and largest finite value; the last bin is closed."""
    v = finite_or_null(value)
    bounds = points.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    # A constant column gets a unit-wide range around its value.
    flat = F.col("_lo") == F.col("_hi")
    bounds = bounds.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    placed = attach(points.select(*keys, v.alias("_v")).filter("_v IS NOT NULL"), bounds, keys)
    # The share of the range first, then the bin: a value on an edge falls by the rounding of this order.
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    number = F.least(F.floor(share * bins) + 1, F.lit(bins)).cast("int")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return placed.groupBy(*keys, number.alias("bin")).agg(
        F.first(F.col("_lo") + width * (number - 1)).alias("bin_low"),
        F.first(F.col("_lo") + width * number).alias("bin_high"),
        F.count(F.lit(1)).alias("point_count"),
    )


def plane_distance(points: DataFrame, keys: Sequence[str], meta: DataFrame | None = None) -> DataFrame:
    """Smallest and largest distance from the slice plane: recorded y0, else mid-range.

    The y values are kept once, so whatever ``points`` is made of is read once.
    """
    points = spooled(points.select(*keys, "y"))
    mid = points.groupBy(*keys).agg(
        (0.5 * (F.min(nan_to_null("y")) + F.max(nan_to_null("y")))).alias("_mid")
    )
    if meta is not None:
        mid = mid.join(meta.select(*keys, F.col("y0").alias("_y0")), list(keys), "left")
        plane = mid.select(*keys, F.coalesce("_y0", "_mid").alias("y_midspan"))
    else:
        plane = mid.select(*keys, F.col("_mid").alias("y_midspan"))
    distance = finite_or_null(F.abs(F.col("y") - F.col("y_midspan")))
    return (
        attach(points, plane, keys)
        .groupBy(*keys)
        .agg(
            F.first("y_midspan").alias("y_midspan"),
            F.min(distance).alias("distance_min"),
            F.max(distance).alias("distance_max"),
        )
    )


def minus_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Subtract the plain mean of each key."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return attach(df, means, keys).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")
