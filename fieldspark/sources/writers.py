"""Parquet sinks for slices and grids, CSV sinks with fixed column orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The column order of every result table.
TABLE_COLUMNS = {
    "concentration_error": (
        "case",
        "order",
        "reference_case",
        "comparison_set",
        "index",
        "reference_index",
        "relative_L2_C",
        "mean_abs_error_C",
        "absolute_Linf_C",
        "relative_Linf_C",
        "valid_point_count",
        "total_grid_point_count",
    ),
    "front_position": ("case", "order", "comparison_set", "index", "threshold", "x_front"),
    "velocity_error": (
        "case",
        "order",
        "reference_case",
        "comparison_set",
        "index",
        "reference_index",
        "relative_L2_speed",
        "mean_abs_error_speed",
        "absolute_Linf_speed",
        "relative_Linf_speed",
        "relative_L2_u",
        "mean_abs_error_u",
        "relative_L2_v",
        "mean_abs_error_v",
        "relative_L2_w",
        "mean_abs_error_w",
        "valid_point_count",
        "total_grid_point_count",
    ),
    "pressure_error": (
        "case",
        "order",
        "reference_case",
        "comparison_set",
        "index",
        "reference_index",
        "relative_L2_p_prime",
        "mean_abs_error_p_prime",
        "absolute_Linf_p_prime",
        "relative_Linf_p_prime",
        "valid_point_count",
        "total_grid_point_count",
    ),
    "energy_timeseries": (
        "time",
        "E_k",
        "E_p",
        "E_total",
        "epsilon",
        "E_total_minus_Ek_Ep",
        "cumulative_epsilon",
        "energy_closure",
        "closure_residual_from_target",
        "closure_drift_from_initial",
        "dEtotal_dt",
        "differential_closure_residual",
        "energy_closure_minus",
    ),
    "energy_summary": (
        "case",
        "n_points",
        "time_start",
        "time_end",
        "E_total_initial",
        "E_total_final",
        "epsilon_min",
        "epsilon_max",
        "cumulative_epsilon_final",
        "energy_closure_initial",
        "energy_closure_final",
        "target",
        "max_abs_closure_residual_from_target",
        "mean_abs_closure_residual_from_target",
        "rms_closure_residual_from_target",
        "max_abs_closure_drift_from_initial",
        "final_closure_drift_from_initial",
        "max_abs_differential_closure_residual",
        "rms_differential_closure_residual",
        "max_abs_E_total_minus_Ek_Ep",
    ),
    "kinematics_timeseries": (
        "time",
        "x_front",
        "v_raw",
        "v_smooth",
        "x_reconstructed",
        "x_reconstruction_error",
    ),
    "kinematics_summary": (
        "case",
        "n_points",
        "time_start",
        "time_end",
        "x_start",
        "x_end",
        "v_raw_min",
        "v_raw_max",
        "v_smooth_min",
        "v_smooth_max",
        "mean_abs_reconstruction_error",
        "max_abs_reconstruction_error",
        "rms_reconstruction_error",
        "final_reconstruction_error",
        "slumping_velocity_raw_position_fit",
        "slumping_velocity_reconstructed_position_fit",
    ),
    "overlay_points": (
        "time",
        "paper_x",
        "simulation_x_interp",
        "x_error",
        "relative_error",
        "log_error",
    ),
    "overlay_summary_raw": (
        "case",
        "n_comparison_points",
        "time_min_compared",
        "time_max_compared",
        "mean_signed_error",
        "mean_abs_error",
        "rms_error",
        "mean_signed_relative_error",
        "mean_abs_relative_error",
        "max_abs_relative_error",
        "rms_log_error",
        "n_slumping_points",
        "paper_slumping_velocity",
        "simulation_slumping_velocity",
        "slumping_velocity_difference",
        "slumping_velocity_relative_difference",
        "slumping_mean_abs_relative_error",
        "slumping_max_abs_relative_error",
    ),
    "overlay_summary_processed": (
        "case",
        "n_comparison_points",
        "time_min_compared",
        "time_max_compared",
        "processed_x0_shift",
        "mean_abs_error",
        "rms_error",
        "mean_abs_relative_error",
        "max_abs_relative_error",
        "rms_log_error",
        "n_slumping_points",
        "paper_slumping_velocity",
        "processed_slumping_velocity",
        "slumping_velocity_difference",
        "slumping_velocity_relative_difference",
    ),
    "multitime_summary": (
        "comparison_set",
        "target_time",
        "field",
        "case",
        "order",
        "reference_case",
        "index",
        "reference_index",
        "relative_L2",
        "mean_abs_error",
        "max_abs_error",
        "relative_Linf",
        "valid_point_count",
        "total_grid_point_count",
    ),
    "order_pivot": (
        "target_time",
        "comparison_set",
        "field",
        "N5",
        "N7",
        "N9",
        "best_lower_order",
        "trend",
    ),
}


def write_csv(df: DataFrame, table: str, path: str, overwrite: bool = False, by: Sequence[str] = ()) -> None:
    """Write a result table in its fixed column order, optionally one folder per key."""
    columns = [c for c in TABLE_COLUMNS[table] if c not in by]
    writer = df.select(*by, *columns).write.mode("overwrite" if overwrite else "errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    writer.option("header", True).csv(path)


# --- the store of snapshots ------------------------------------------------------------
#
# Points of slices and gridded fields lie in partitions comparison_set / case / idx, so that a snapshot can be read,
# replaced or skipped alone. What describes them lies beside, in a table of one row per snapshot with the same partitions.


def meta_path(path: str) -> str:
    return f"{path.rstrip('/')}_meta"


def snapshot_partitions(df: DataFrame, index: str = "idx") -> list[str]:
    return ["comparison_set", "case", *([index] if index in df.columns else [])]


def write_slice(points: DataFrame, path: str, overwrite: bool = False, meta: DataFrame | None = None, index: str = "idx") -> None:
    """Points of slices by set, case and snapshot, and their metadata beside them.

    Overwriting replaces only the snapshots that are written. Without it a snapshot that is there already is an
    error, and others are added.
    """
    keys = snapshot_partitions(points, index)
    _write_partitions(points, path, keys, overwrite, points if meta is None else meta)
    if meta is not None:
        _write_partitions(meta, meta_path(path), keys, True)


def write_gridded(
    gridded: DataFrame, path: str, source: str, method: str = "linear", overwrite: bool = False, index: str = "idx"
) -> None:
    """A regridded field with its lineage: where its points came from and how it was interpolated.

    The lineage is in every row and, with the node count, beside the field as one row per snapshot.
    """
    keys = snapshot_partitions(gridded, index)
    lineage = {"source_slice": F.lit(source), "interpolation_method": F.lit(method)}
    _write_partitions(gridded.withColumns(lineage), path, keys, overwrite)
    described = gridded.groupBy(*keys).agg(F.count(F.lit(1)).alias("node_count")).withColumns(lineage)
    _write_partitions(described, meta_path(path), keys, True)


def produced_snapshots(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """The snapshots that a store holds, read off the names of its partitions; ``keys`` gives their types.

    Files are listed, not opened.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ", ".join(f"{k} {t}" for k, t in keys.items()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def part(key: str, kind: str) -> Column:
        name = F.regexp_extract("path", f"/{key}=([^/]*)/", 1)
        # A partition's name holds special characters as %XX, and a plus sign as itself.
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
        return F.when(name != "__HIVE_DEFAULT_PARTITION__", name).cast(kind).alias(key)

    return files.select(*[part(k, t) for k, t in keys.items()]).distinct()


def _write_partitions(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool, named: DataFrame | None = None) -> None:
    if not overwrite:
        spark = df.sparkSession
        kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
        there = produced_snapshots(spark, path, kinds)
        if not there.isEmpty():
            twice = (df if named is None else named).select(*keys).distinct().join(there, list(keys), "left_semi")
            if first := twice.first():
                raise FileExistsError(f"Snapshot exists already: {first.asDict()}")
    (
        df.write.mode("overwrite" if overwrite else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
