"""Data behind profiles, contours, colour ranges and error curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import finite_or_null
from fieldspark.plans.scale import attach

# Defaults that decide the results.
PROFILE_Z = 0.5
PROFILE_X = 0.0
CONTOUR_LEVEL = 0.01
SPARSE_SHARE = 0.25
SAMPLE_SIZE = 250_000
SAMPLE_SEED = 20260623


def profile(
    gridded: DataFrame,
    keys: Sequence[str],
    across: str,
    value: str,
    wanted: Sequence[float],
) -> DataFrame:
    """Nodes on the grid line nearest to each wanted coordinate (first line on a tie).

    ``across="z"`` gives x-profiles at the wanted z, ``across="x"`` z-profiles.
    Missing nodes stay, as NULL, for the sparsity report.
    """
    index = f"i{across}"
    lines = gridded.groupBy(*keys, index).agg(F.min(across).alias("_at"))
    asked = lines.withColumn("wanted", F.explode(F.array(*(F.lit(float(w)) for w in wanted))))
    nearest = asked.groupBy(*keys, "wanted").agg(
        F.min(F.struct(F.abs(F.col("_at") - F.col("wanted")).alias("d"), F.col(index).alias("i")))["i"].alias(index)
    )
    return attach(gridded, nearest, [*keys, index]).withColumn(value, finite_or_null(value))


def profile_points(profiles: DataFrame, keys: Sequence[str], along: str, value: str) -> DataFrame:
    """The finite part of a profile, as drawn."""
    return profiles.filter(F.col(value).isNotNull() & F.col(along).isNotNull()).select(
        *keys, "wanted", f"i{along}", along, value
    )


def profile_sparsity(profiles: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    n, total = F.count(value), F.count(F.lit(1))
    share = 1.0 - n / total
    return profiles.groupBy(*keys, "wanted").agg(
        n.alias("finite_count"),
        total.alias("node_count"),
        share.alias("missing_fraction"),
        (n == 0).alias("all_missing"),
        ((n > 0) & (share > SPARSE_SHARE)).alias("is_sparse"),
    )


def range_flags(
    df: DataFrame, keys: Sequence[str], value: str, vmin: Column, vmax: Column
) -> DataFrame:
    """Finite range of a field, its largest magnitude (1 when zero) and which bound it exceeds."""
    v = finite_or_null(value)
    ranged = df.groupBy(*keys).agg(F.min(v).alias("value_min"), F.max(v).alias("value_max"), F.max(F.abs(v)).alias("_m"))
    below, above = F.col("value_min") < vmin, F.col("value_max") > vmax
    return ranged.select(
        *keys,
        "value_min",
        "value_max",
        F.when(F.col("_m") == 0.0, 1.0).otherwise(F.col("_m")).alias("max_abs"),
        F.when(below & above, "both").when(below, "min").when(above, "max").otherwise("neither").alias("extend"),
    )


def iso_contour(
    gridded: DataFrame, keys: Sequence[str], value: str, level: float = CONTOUR_LEVEL
) -> DataFrame:
    """Line segments where the field crosses ``level``, cell by cell.

    Every node hands its value to the up to four cells it is a corner of; a cell
    with four finite corners yields no, one or two segments. In saddle cells the
    mean of the corners decides which corners stay connected.
    """
    corners = F.array(
        *(
            F.struct(
                (F.col("ix") - dx).alias("cx"), (F.col("iz") - dz).alias("cz"), F.lit(2 * dz + dx).alias("role")
            )
            for dz in (0, 1)
            for dx in (0, 1)
        )
    )
    spread = gridded.withColumn(value, finite_or_null(value)).withColumn("_c", F.explode(corners))
    cells = spread.groupBy(*keys, F.col("_c.cx").alias("cx"), F.col("_c.cz").alias("cz")).agg(
        *(
            F.max(F.when(F.col("_c.role") == r, F.struct("x", "z", F.col(value).alias("v")))).alias(f"k{r}")
            for r in range(4)
        )
    )
    cells = cells.filter(" AND ".join(f"k{r}.v IS NOT NULL" for r in range(4)))
    v = [F.col(f"k{r}.v") for r in range(4)]
    above = [corner > level for corner in v]

    def crossing(a: int, b: int) -> Column:
        """Where the edge between corners a and b meets the level."""
        share = F.try_divide(F.lit(level) - v[a], v[b] - v[a])
        xa, xb, za, zb = F.col(f"k{a}.x"), F.col(f"k{b}.x"), F.col(f"k{a}.z"), F.col(f"k{b}.z")
        return F.struct((xa + share * (xb - xa)).alias("x"), (za + share * (zb - za)).alias("z"))

    bottom, top, left, right = crossing(0, 1), crossing(2, 3), crossing(0, 2), crossing(1, 3)

    def segment(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("x1"), a["z"].alias("z1"), b["x"].alias("x2"), b["z"].alias("z2"))

    corner_bits = sum((F.when(above[r], 1 << r).otherwise(0) for r in range(4)), F.lit(0))
    cells = cells.withColumn("_case", corner_bits)
    around_0, around_1 = segment(left, bottom), segment(bottom, right)
    around_2, around_3 = segment(left, top), segment(top, right)
    across, upright = segment(left, right), segment(bottom, top)
    high_centre = (v[0] + v[1] + v[2] + v[3]) / 4 > level
    case = F.col("_case")
    found = (
        F.when(case.isin(1, 14), F.array(around_0))
        .when(case.isin(2, 13), F.array(around_1))
        .when(case.isin(4, 11), F.array(around_2))
        .when(case.isin(8, 7), F.array(around_3))
        .when(case.isin(3, 12), F.array(across))
        .when(case.isin(5, 10), F.array(upright))
        # Corners 0 and 3 are above: a high centre joins them and cuts off corners 1 and 2.
        .when((case == 9) == high_centre, F.array(around_1, around_2))
        .otherwise(F.array(around_0, around_3))
    )
    crossed = cells.filter(~case.isin(0, 15))
    return crossed.select(*keys, "cx", "cz", F.explode(found).alias("_s")).select(*keys, "cx", "cz", "_s.*")


def contour_range(gridded: DataFrame, keys: Sequence[str], value: str, level: float = CONTOUR_LEVEL) -> DataFrame:
    """Whether the level lies outside a case's finite range, so its contour may be absent."""
    v = finite_or_null(value)
    ranged = gridded.groupBy(*keys).agg(F.min(v).alias("value_min"), F.max(v).alias("value_max"))
    inside = F.lit(level).between(F.col("value_min"), F.col("value_max"))
    return ranged.withColumn("outside_range", ~F.coalesce(inside, F.lit(False)))


def downsample(df: DataFrame, keys: Sequence[str], id_column: str, size: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``size`` rows per key (all when fewer), chosen by the MD5 digest of seed and id.

    A threshold on the hash keeps little more than ``size`` rows per key before
    they are ranked; keys where chance left too few are ranked in full.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    hashed = df.withColumn("_u", unit)
    margin = size + 8.0 * size**0.5 + 64.0
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.withColumn("_limit", F.lit(margin) / F.col("_n"))
    near = attach(hashed, bounds, keys)
    kept = near.groupBy(*keys).agg(F.count_if(F.col("_u") <= F.col("_limit")).alias("_kept"), F.first("_n").alias("_n"))
    enough = kept.select(*keys, (F.col("_kept") >= F.least(F.lit(size), F.col("_n"))).alias("_enough"))
    candidates = attach(near, enough, keys).filter(~F.col("_enough") | (F.col("_u") <= F.col("_limit")))
    ranked = candidates.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_u", id_column))
    )
    return ranked.filter(F.col("_rank") <= size).select(*df.columns)


def error_vs_time(
    summary: DataFrame,
    metrics: Sequence[str],
    fields: Sequence[str] | None = None,
    orders: Sequence[int] | None = None,
) -> DataFrame:
    """Long form of the summary table: one row per field, metric, order and time."""
    rows = summary
    if fields is not None:
        rows = rows.filter(F.col("field").isin(*fields))
    if orders is not None:
        rows = rows.filter(F.col("order").isin(*orders))
    return rows.unpivot(["field", "order", "target_time"], list(metrics), "metric", "value")


def error_vs_order(errors: DataFrame, metric: str, keys: Sequence[str] = ("comparison_set",)) -> DataFrame:
    """Metric of each case beside its order, sorted by order at the sink."""
    return errors.select(*keys, "order", "case", F.col(metric).alias("value"))


def single_time_fields(summary: DataFrame) -> DataFrame:
    """Fields seen at one time only, for which a curve over time has a single point."""
    times = summary.groupBy("field").agg(F.countDistinct("target_time").alias("n_times"))
    return times.filter(F.col("n_times") == 1)
