"""Snapshots stay apart: in slices, comparisons, sinks and the listing of what is there; and how often the source is read."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import compare, grid, slicing
from fieldspark.plans import comparison
from fieldspark.plans.selection import pending
from fieldspark.sources import writers

POINTS = "comparison_set string, case string, idx int, time double, x double, y double, z double, C double, u double, v double, w double, p double"
SELECTION = "comparison_set string, target_time double, case string, order int, index long, reference_case string, reference_index long, n_cases long"
KINDS = {"comparison_set": "string", "case": "string", "idx": "int"}


def two_snapshots():
    """Two cases, two snapshots each; planes of the second lie higher and its values differ."""
    rows = []
    for case, shift in (("N5", 1.0), ("N11", 0.0)):
        for idx, lift in ((1, 0.0), (2, 0.1)):
            for x in range(4):
                for z in range(4):
                    for y in (0.0, 1.0, 2.0):
                        value = 10.0 * idx + shift * idx + x + y
                        rows.append(("s", case, idx, 5.0 * idx + shift / 100, float(x), y + lift, float(z), value, 1.0 + shift, 2.0, 2.0, value * (z + 1)))
    return rows


def chosen(spark, n5=2, n11=2):
    rows = [("s", None, "N5", 5, n5, "N11", n11, 2), ("s", None, "N11", 11, n11, "N11", n11, 2)]
    return spark.createDataFrame(rows, SELECTION)


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(two_snapshots(), POINTS)


def test_every_snapshot_has_a_plane_of_its_own(points):
    rows = comparison.slice_points(points).groupBy("case", "idx").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    assert {(r["case"], r["idx"]): (r["n"], r["lo"], r["hi"]) for r in rows} == {(c, i): (16, y, y) for c in ("N5", "N11") for i, y in ((1, 1.0), (2, 1.1))}
    meta = slicing.slice_meta(points, comparison.snapshot_keys(points)).collect()
    assert {(r["idx"], r["selected_y"], r["point_count"], r["rounded_unique_y_count_before_selection"]) for r in meta} == {(1, 1.0, 16, 3), (2, 1.1, 16, 3)}


@pytest.mark.parametrize(("n5", "n11", "error"), [(1, 1, 1.0), (2, 2, 2.0), (2, 1, 12.0)])
def test_slices_of_all_snapshots_compare_the_selected_ones(spark, points, n5, n11, error):
    selection = chosen(spark, n5, n11)
    options = {"nx": 4, "nz": 4, "method": "nearest"}
    for result in (comparison.compare_fields(comparison.slice_points(points), selection, **options), comparison.compare_snapshots(points, selection, **options)):
        row = result.concentration.first()
        assert (row["case"], row["index"], row["reference_index"], row["valid_point_count"]) == ("N5", n5, n11, 16)
        assert row["mean_abs_error_C"] == pytest.approx(error)
        assert {(r["case"], r["idx"]) for r in result.gridded.select("case", "idx").distinct().collect()} == {("N5", n5), ("N11", n11)}


def test_gridded_fields_hold_speed_and_fluctuation(spark, points):
    result = comparison.compare_snapshots(points, chosen(spark), nx=4, nz=4, method="nearest")
    rows = result.gridded.collect()
    assert len(rows) == 32 and all(r["speed"] == pytest.approx((r["u"] ** 2 + r["v"] ** 2 + r["w"] ** 2) ** 0.5) for r in rows)
    for case in ("N5", "N11"):
        own = [r for r in rows if r["case"] == case]
        mean = sum(r["p"] for r in own) / len(own)
        assert all(r["p_prime"] == pytest.approx(r["p"] - mean) for r in own)


def test_times_are_aligned_before_the_comparison(spark, points):
    sliced = comparison.slice_points(points)
    options = {"nx": 4, "nz": 4, "method": "nearest"}
    near = comparison.compare_fields(sliced, chosen(spark, 2, 2), strict_times=True, **options)
    assert {(r["case"], r["status"]) for r in near.alignment.collect()} == {("N5", "ok"), ("N11", "ok")}
    apart = comparison.compare_fields(sliced, chosen(spark, 2, 1), **options).alignment.filter("case = 'N5'").first()
    assert apart["status"] == "exceeds" and apart["time_difference"] == pytest.approx(5.01)
    with pytest.raises(ValueError, match="not aligned: s/N5 exceeds"):
        comparison.compare_fields(sliced, chosen(spark, 2, 1), strict_times=True, **options)
    missing = sliced.withColumn("time", F.when(F.col("case") == "N11", F.lit(float("nan"))).otherwise(F.col("time")))
    with pytest.raises(ValueError, match="missing"):
        comparison.compare_fields(missing, chosen(spark, 2, 2), strict_times=True, **options)
    assert comparison.compare_fields(sliced.drop("time"), chosen(spark), strict_times=True, **options).alignment is None


def test_a_store_replaces_single_snapshots(spark, points, tmp_path):
    path = str(tmp_path / "slices")
    keys = comparison.snapshot_keys(points)
    assert writers.produced_snapshots(spark, path, KINDS).count() == 0
    for idx in (1, 2):
        some = points.filter(F.col("idx") == idx)
        writers.write_slice(comparison.slice_points(some), path, meta=slicing.slice_meta(some, keys))
    second = points.filter("idx = 2")
    with pytest.raises(FileExistsError, match="Snapshot exists already"):
        writers.write_slice(comparison.slice_points(second), path, meta=slicing.slice_meta(second, keys))
    writers.write_slice(comparison.slice_points(second, "slab", y0=0.1, ratio=0.0), path, overwrite=True, meta=slicing.slice_meta(second, keys, "slab", y0=0.1, ratio=0.0))
    there = {tuple(r) for r in writers.produced_snapshots(spark, path, KINDS).collect()}
    assert there == {("s", c, i) for c in ("N5", "N11") for i in (1, 2)}
    stored = spark.read.parquet(path).groupBy("idx").agg(F.count("*").alias("n"), F.min("y").alias("y")).collect()
    assert {tuple(r) for r in stored} == {(1, 32, 1.0), (2, 32, 0.1)}
    meta = spark.read.parquet(writers.meta_path(path)).select("case", "idx", "mode", "point_count").collect()
    assert {tuple(r) for r in meta} == {(c, i, m, 16) for c in ("N5", "N11") for i, m in ((1, "nearest_plane"), (2, "slab"))}


def test_names_of_partitions_are_read_back(spark, tmp_path):
    path = str(tmp_path / "odd")
    names = ["a b", "50%", "x/y", "k=v", "p+q", "é", None]
    rows = spark.createDataFrame([("s", n, k, 1.0) for k, n in enumerate(names)], "comparison_set string, case string, idx int, x double")
    writers.write_slice(rows, path)
    assert {(r["case"], r["idx"]) for r in writers.produced_snapshots(spark, path, KINDS).collect()} == {(n, k) for k, n in enumerate(names)}
    wanted = spark.createDataFrame([("s", "50%", 1), ("s", "50%", 9)], "comparison_set string, case string, idx int")
    todo = pending(wanted, writers.produced_snapshots(spark, path, KINDS), ["comparison_set", "case", "idx"])
    assert [tuple(r) for r in todo.collect()] == [("s", "50%", 9)]


def test_gridded_store_keeps_lineage_by_snapshot(spark, tmp_path):
    path = str(tmp_path / "grids")
    row = "comparison_set string, case string, idx int, ix int, iz int, C double"
    for idx in (1, 2):
        writers.write_gridded(spark.createDataFrame([("s", "N5", idx, 0, k, 1.5) for k in range(idx)], row), path, f"slices/{idx}", "nearest")
    lineage = spark.read.parquet(writers.meta_path(path)).select("idx", "source_slice", "interpolation_method", "node_count").collect()
    assert {tuple(r) for r in lineage} == {(1, "slices/1", "nearest", 1), (2, "slices/2", "nearest", 2)}


# --- how often the source is read -----------------------------------------------------------


def scans_of(spark, path, action) -> int:
    """Scans of the table at ``path`` in all executions that ``action`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = 0
    executions = store.executionsList()
    for k in range(int(before), executions.size()):
        plan = executions.apply(k).physicalPlanDescription()
        places = dict(re.findall(r"\n\((\d+)\) Scan parquet[^\n]*\n(.*?)\n\n", plan, re.S))
        # The tree of the plan as it ran comes before the one that it began with.
        ran = re.findall(r"Scan parquet\s+\((\d+)\)", plan.split("== Initial Plan ==")[0])
        found += sum(f"[file:{path}]" in places.get(number, "") for number in ran)
    return found


def run(df):
    df.write.format("noop").mode("overwrite").save()


def test_the_source_is_read_no_more_than_needed(spark, points, tmp_path):
    path = str(tmp_path / "points.parquet")
    points.filter("idx = 1").drop("idx", "time").write.parquet(path)
    source = spark.read.parquet(path)
    keys = ["comparison_set", "case"]
    selection = chosen(spark, 1, 1)
    merged = grid.average_fields_per_node(slicing.slice_plane(source, keys), keys, ["C", "u", "v", "w", "p"]).withColumns({"ix": F.col("x").cast("int"), "iz": F.col("z").cast("int")})
    assert scans_of(spark, path, lambda: run(source)) == 1
    assert scans_of(spark, path, lambda: run(slicing.slice_meta(source, keys))) == 1
    assert scans_of(spark, path, lambda: run(slicing.slice_plane(source, keys))) == 2
    # The slice above has read its levels already.
    for errors in (compare.concentration_errors, compare.velocity_errors, compare.pressure_errors, compare.front_positions):
        assert scans_of(spark, path, lambda f=errors: run(f(merged, selection))) == 1
    assert scans_of(spark, path, lambda: run(slicing.plane_distance(source, keys))) == 1
