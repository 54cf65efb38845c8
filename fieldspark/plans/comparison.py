"""From points to error tables: slice, common grid, interpolation, mask, errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import finite_or_null, speed
from fieldspark.operators import compare, grid, slicing
from fieldspark.operators.regrid import regrid
from fieldspark.plans.scale import attach, durable, spooled
from fieldspark.plans.selection import TIME_TOLERANCE, time_alignment

FIELDS = ("C", "u", "v", "w", "p")


KEYS = ["comparison_set", "case"]


@dataclass(frozen=True)
class FieldComparison:
    """Gridded fields and the tables measured on them; ``alignment`` is None where the points have no times."""

    gridded: DataFrame
    concentration: DataFrame
    fronts: DataFrame
    velocity: DataFrame
    pressure: DataFrame
    alignment: DataFrame | None


def snapshot_keys(points: DataFrame, index: str = "idx") -> list[str]:
    """What a slice is cut by: set and case, and the snapshot where the points say which they belong to."""
    return [*KEYS, index] if index in points.columns else list(KEYS)


def select_snapshots(points: DataFrame, selection: DataFrame, index: str = "idx") -> DataFrame:
    """The points of the snapshots that ``selection`` names, one for each set and case."""
    chosen = durable(selection)
    wanted = chosen.select(*KEYS)
    if index in points.columns:
        wanted = chosen.select(*KEYS, F.col("index").cast(points.schema[index].dataType).alias(index))
    return attach(points, wanted, wanted.columns, "left_semi")


def slice_points(
    points: DataFrame,
    mode: str = "nearest_plane",
    y0: float | None = None,
    ratio: float = slicing.SLAB_RATIO,
    decimals: int = slicing.Y_ROUND_DECIMALS,
    index: str = "idx",
) -> DataFrame:
    """A slice through every snapshot, each with a plane of its own."""
    keys = snapshot_keys(points, index)
    if mode == "nearest_plane":
        return slicing.slice_plane(points, keys, y0, decimals)
    if mode == "slab":
        return slicing.slice_slab(points, keys, y0, ratio)
    raise ValueError(f"Unknown slice mode {mode!r}.")


def align_times(
    points: DataFrame, selection: DataFrame, time: str = "time", tolerance: float = TIME_TOLERANCE, strict: bool = False
) -> DataFrame:
    """Distance of every selected snapshot's time from that of its set's reference; with ``strict`` a wide one is an error."""
    times = points.groupBy(*KEYS).agg(F.max(time).alias("time"))
    named = selection.select(*KEYS, "reference_case").join(times, KEYS, "left")
    aligned = durable(time_alignment(named, F.col("reference_case"), tolerance))
    off = aligned.filter("status != 'ok'").orderBy(*KEYS).limit(10).collect() if strict else []
    if off:
        raise ValueError("Snapshot times are not aligned: " + "; ".join(f"{r['comparison_set']}/{r['case']} {r['status']} ({r['time']})" for r in off))
    return aligned


def compare_fields(
    sliced: DataFrame,
    selection: DataFrame,
    nx: int = grid.GRID_NX,
    nz: int = grid.GRID_NZ,
    method: str = "linear",
    decimals: int = grid.DEDUP_DECIMALS,
    front_ratio: float = compare.FRONT_THRESHOLD_RATIO,
    index: str = "idx",
    time: str = "time",
    tolerance: float = TIME_TOLERANCE,
    strict_times: bool = False,
) -> FieldComparison:
    """Interpolate the sliced points of every selected case to its set's common grid and compare.

    Only points of the selected snapshot count: where the points have the column ``index``, it has to equal
    the selection's index, and the gridded fields carry it, with ``speed`` and the pressure fluctuation ``p_prime``.
    Where they have times, these are compared first. The gridded fields and the table of nodes are written once to the
    checkpoint folder, because every table reads them.
    """
    chosen = durable(selection)
    points = select_snapshots(sliced, chosen, index)
    alignment = align_times(points, chosen, time, tolerance, strict_times) if time in points.columns else None
    nodes = grid.make_grid(grid.common_domain(points, ["comparison_set"]), ["comparison_set"], nx, nz)
    gridded = spooled(regrid(points, nodes, FIELDS, method=method, decimals=decimals))
    measured = compare.node_table(gridded, chosen)
    facts = measured.facts.select(*KEYS, "_mean", F.col("index").alias(index))
    described = attach(gridded.withColumn("speed", speed()), facts, KEYS)
    return FieldComparison(
        gridded=described.withColumn("p_prime", finite_or_null("p") - F.col("_mean")).drop("_mean"),
        concentration=compare.concentration_table(measured),
        fronts=compare.front_table(measured, front_ratio),
        velocity=compare.velocity_table(measured),
        pressure=compare.pressure_table(measured),
        alignment=alignment,
    )


def compare_snapshots(
    points: DataFrame,
    selection: DataFrame,
    mode: str = "nearest_plane",
    y0: float | None = None,
    ratio: float = slicing.SLAB_RATIO,
    slice_decimals: int = slicing.Y_ROUND_DECIMALS,
    index: str = "idx",
    **options,
) -> FieldComparison:
    """Select, slice, compare: nothing but the selected snapshots is sliced. ``options`` are those of ``compare_fields``."""
    chosen = durable(selection)
    kept = select_snapshots(points, chosen, index)
    return compare_fields(slice_points(kept, mode, y0, ratio, slice_decimals, index), chosen, index=index, **options)
