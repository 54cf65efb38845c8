"""Common domains and grids; merging of points that share a rounded position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import finite, finite_or_null, half_even, strict
from fieldspark.functions.numeric import nan_to_null

# Defaults that decide the results.
GRID_NX = 500
GRID_NZ = 200
DEDUP_DECIMALS = 10


def common_domain(points: DataFrame, sets: Sequence[str], case: str = "case") -> DataFrame:
    """The x-z box that all cases of a set share; fails when there is none."""
    ranges = [
        f(nan_to_null(axis)).alias(f"{axis}{n}") for axis in ("x", "z") for n, f in (("min", F.min), ("max", F.max))
    ]
    per_case = points.groupBy(*sets, case).agg(*ranges)
    box = per_case.groupBy(*sets).agg(
        F.max("xmin").alias("xmin"), F.min("xmax").alias("xmax"), F.max("zmin").alias("zmin"), F.min("zmax").alias("zmax")
    )
    overlaps = (F.col("xmin") < F.col("xmax")) & (F.col("zmin") < F.col("zmax"))
    message = "The cases do not share an overlapping x-z domain."
    return box.withColumn("xmin", strict(F.coalesce(overlaps, F.lit(False)), message, F.col("xmin")))


def own_domain(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The x-z box of each key on its own."""
    return points.groupBy(*keys).agg(
        F.min(nan_to_null("x")).alias("xmin"),
        F.max(nan_to_null("x")).alias("xmax"),
        F.min(nan_to_null("z")).alias("zmin"),
        F.max(nan_to_null("z")).alias("zmax"),
    )


def _spaced(lo: str, hi: str, index: Column, n: int) -> Column:
    """Evenly spaced coordinate whose last value is exactly the upper end."""
    step = (F.col(hi) - F.col(lo)) / F.lit(float(max(n - 1, 1)))
    return F.when(index == n - 1, F.col(hi)).otherwise(F.col(lo) + index * step) if n > 1 else F.col(lo)


def make_grid(domain: DataFrame, keys: Sequence[str], nx: int = GRID_NX, nz: int = GRID_NZ) -> DataFrame:
    """All nodes of an nx by nz grid on each domain; rows are spread before the second expansion."""
    lines = domain.withColumn("iz", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))))
    lines = lines.repartition(*keys, "iz")
    nodes = lines.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return nodes.select(
        *keys,
        "iz",
        "ix",
        _spaced("xmin", "xmax", F.col("ix"), nx).alias("x"),
        _spaced("zmin", "zmax", F.col("iz"), nz).alias("z"),
    )


def average_duplicates(
    points: DataFrame, keys: Sequence[str], values: Sequence[str], decimals: int = DEDUP_DECIMALS
) -> DataFrame:
    """Merge points with equal rounded (x, z): means of the unrounded finite rows.

    Only rows in which x, z and all ``values`` are finite take part.
    """
    usable = points.filter(finite("x", "z", *values))
    return usable.groupBy(*keys, half_even("x", decimals).alias("xr"), half_even("z", decimals).alias("zr")).agg(
        F.avg("x").alias("x"),
        F.avg("z").alias("z"),
        *(F.avg(v).alias(v) for v in values),
        F.count(F.lit(1)).alias("multiplicity"),
    )


def average_fields_per_node(
    points: DataFrame, keys: Sequence[str], values: Sequence[str], decimals: int = DEDUP_DECIMALS
) -> DataFrame:
    """Node means where each field skips its own missing values; nodes are the rounded positions."""
    usable = points.filter(finite("x", "z"))
    return usable.groupBy(*keys, half_even("x", decimals).alias("x"), half_even("z", decimals).alias("z")).agg(
        *(F.avg(finite_or_null(v)).alias(v) for v in values)
    )


def merge_stats(
    points: DataFrame, keys: Sequence[str], value: str, decimals: int = DEDUP_DECIMALS
) -> DataFrame:
    """How many points the merge read, kept and joined."""
    usable = finite("x", "z", value)
    per_node = points.groupBy(
        *keys,
        F.when(usable, half_even("x", decimals)).alias("_x"),
        F.when(usable, half_even("z", decimals)).alias("_z"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    kept = F.col("_x").isNotNull()
    finite_rows = F.sum(F.when(kept, F.col("_n")).otherwise(0))
    return per_node.groupBy(*keys).agg(
        F.sum("_n").alias("original_point_count"),
        finite_rows.alias("finite_point_count"),
        F.count_if(kept).alias("unique_point_count"),
        (finite_rows - F.count_if(kept)).alias("duplicate_point_count"),
        F.max(F.when(kept, F.col("_n"))).alias("max_multiplicity"),
    )


def duplicate_counts(points: DataFrame, keys: Sequence[str], decimals: int = DEDUP_DECIMALS) -> DataFrame:
    """Repeated (x, z) positions, exact and rounded.

    The exact groups refine the rounded ones, so one pass over the points feeds both.
    """
    exact = points.groupBy(
        *keys, "x", "z", half_even("x", decimals).alias("_xr"), half_even("z", decimals).alias("_zr")
    ).agg(F.count(F.lit(1)).alias("_n"))
    rounded = exact.groupBy(*keys, "_xr", "_zr").agg(
        F.sum("_n").alias("_n"),
        F.count(F.lit(1)).alias("_exact"),
        F.count_if(F.col("_n") > 1).alias("_exact_groups"),
        F.max("_n").alias("_exact_max"),
    )
    total, n_exact, n_rounded = F.sum("_n"), F.sum("_exact"), F.count(F.lit(1))
    return rounded.groupBy(*keys).agg(
        total.alias("point_count"),
        n_exact.alias("exact_unique_pair_count"),
        (total - n_exact).alias("exact_duplicate_point_count"),
        F.sum("_exact_groups").alias("exact_duplicate_pair_group_count"),
        F.max("_exact_max").alias("exact_max_pair_multiplicity"),
        n_rounded.alias("rounded_unique_pair_count"),
        (total - n_rounded).alias("rounded_duplicate_point_count"),
        F.count_if(F.col("_n") > 1).alias("rounded_duplicate_pair_group_count"),
        F.max("_n").alias("rounded_max_pair_multiplicity"),
    )
