"""Slices, merging, error tables, views and roll-ups on hand-computed inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from fieldspark.functions import half_even
from fieldspark.operators import compare, grid, slicing, views
from fieldspark.operators.regrid import regrid
from fieldspark.plans import rollup, selection

KEYS = ["case"]
COLUMNS = ["x", "y", "z", "C", "u", "v", "w", "p"]


def points_at(spark, ys, xs=None, case="N5"):
    xs = xs or list(range(len(ys)))
    rows = [(case, float(x), float(y), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for x, y in zip(xs, ys, strict=True)]
    return spark.createDataFrame(rows, "case string, " + ", ".join(f"{c} double" for c in COLUMNS))


# --- scalar ---------------------------------------------------------------------------


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,)], "v double")
    assert [r[0] for r in df.select(half_even("v", 2)).collect()] == [0.12, 0.38, -0.12]


# --- snapshots ---------------------------------------------------------------------------


def test_flatten_uses_scal_when_temp_is_absent(spark):
    element = ([[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]], [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]], [[7.0, 8.0]], None, [[9.0, 10.0]])
    nested = "array<array<double>>"
    df = spark.createDataFrame([("N5", *element)], f"case string, pos {nested}, vel {nested}, pres {nested}, temp {nested}, scal {nested}")
    rows = slicing.flatten_elements(df, ["case"]).orderBy("x").collect()
    assert [tuple(r) for r in rows] == [("N5", 0, 2, 4, 9, 1, 2, 3, 7), ("N5", 1, 3, 5, 10, 1, 2, 3, 8)]
    profile = slicing.snapshot_profile(df, ["case"]).first()
    assert (profile["element_count"], profile["has_temp"], profile["has_scal"]) == (1, False, True)
    assert profile["concentration_source"] == "scal[0]"


# --- slices ------------------------------------------------------------------------------


def test_nearest_plane(spark):
    ys = [0, 1.00000000004, 2, 1.00000000003, 3, 4, 1.00000000001, 5, 0, 1.00000000002]
    df = points_at(spark, ys, [10, 11, 12, 13, 14, 15, 20, 21, 22, 23])
    rows = slicing.slice_plane(df, KEYS, y0=1.1).collect()
    assert sorted(r["x"] for r in rows) == [11, 13, 20, 23]
    meta = slicing.slice_meta(df, KEYS, y0=1.1).first()
    assert (meta["selected_y"], meta["rounded_unique_y_count_before_selection"], meta["point_count"]) == (1.0, 6, 4)
    assert meta["dy_tol"] is None


@pytest.mark.parametrize(("decimals", "kept", "levels"), [(3, 2, 2), (5, 1, 3)])
def test_level_rounding(spark, decimals, kept, levels):
    df = points_at(spark, [1.0004, 1.00049, 2])
    meta = slicing.slice_meta(df, KEYS, y0=1.0, decimals=decimals).first()
    assert (meta["point_count"], meta["rounded_unique_y_count_before_selection"]) == (kept, levels)


def test_lowest_level_wins_a_tie(spark):
    df = points_at(spark, [0, 1, 2, 3])
    assert slicing.slice_meta(df, KEYS).first()["selected_y"] == 1.0


def test_slab_includes_its_edges(spark):
    df = points_at(spark, [0, 3.999, 4, 5.5, 6, 6.001, 10])
    assert sorted(r["y"] for r in slicing.slice_slab(df, KEYS, y0=5.0, ratio=0.1).collect()) == [4, 5.5, 6]
    assert slicing.slice_meta(df, KEYS, mode="slab", y0=5.0, ratio=0.1).first()["dy_tol"] == 1.0


def test_histogram_closes_the_last_bin(spark):
    df = points_at(spark, [0, 0.5, 1, 9.9, 10])
    rows = slicing.value_histogram(df, KEYS, "y", bins=10).orderBy("bin").collect()
    assert [(r["bin"], r["point_count"]) for r in rows] == [(1, 2), (2, 1), (10, 2)]


# --- merging -------------------------------------------------------------------------------


def merge_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = zip([0, 0, 1, 1.0004, nan, 2, 3], [0, 0, 1, 1.0004, 1, inf, 3], [2, 4, 10, 14, 5, 6, nan], strict=True)
    return spark.createDataFrame([("N5", *map(float, r)) for r in rows], "case string, x double, z double, v double")


def test_duplicate_averaging(spark):
    df = merge_input(spark)
    merged = {(r["x"], r["z"], r["v"]) for r in grid.average_duplicates(df, KEYS, ["v"], 3).collect()}
    assert {tuple(round(v, 10) for v in m) for m in merged} == {(0, 0, 3), (1.0002, 1.0002, 12)}
    assert tuple(grid.merge_stats(df, KEYS, "v", 3).first())[1:] == (7, 4, 2, 2, 2)
    assert grid.merge_stats(df, KEYS, "v", 4).first()["unique_point_count"] == 3


# --- comparison ----------------------------------------------------------------------------


def compared(spark, rows):
    """rows: (case, x, z, C, u, v, w, p) on unit-square corners, interpolated to a 2 by 2 grid."""
    names = ["x", "z", "C", "u", "v", "w", "p"]
    data = [("s", case, 1 if case == "N5" else 2, *map(float, r)) for case, *r in rows]
    points = spark.createDataFrame(data, "comparison_set string, case string, idx int, " + ", ".join(f"{n} double" for n in names))
    cases = spark.createDataFrame([("N5", 5), ("N11", 11)], "case string, order int")
    nodes = spark.createDataFrame(
        [("s", j, i, float(i), float(j)) for j in (0, 1) for i in (0, 1)],
        "comparison_set string, iz int, ix int, x double, z double",
    )
    chosen = selection.selection_from_points(points, cases, "N11")
    return points, nodes, chosen


def corners(case, c=lambda x, z: 0.0, u=lambda x, z: 0.0, p=lambda x, z: 0.0, skip=()):
    return [(case, x, z, c(x, z), u(x, z), 1.0, 0.0, p(x, z)) for x in (0, 1) for z in (0, 1) if (x, z) not in skip]


def test_concentration_errors_and_fronts(spark):
    rows = corners("N5", c=lambda x, z: 1 + 1.5 * x + z) + corners("N11", c=lambda x, z: 2 + x + 2 * z)
    points, nodes, chosen = compared(spark, rows)
    gridded = regrid(points, nodes, ["C"]).cache()
    table = compare.concentration_errors(gridded, chosen).collect()
    assert len(table) == 1
    row = table[0]
    assert (row["case"], row["order"], row["index"], row["reference_index"]) == ("N5", 5, 1, 2)
    assert (row["valid_point_count"], row["total_grid_point_count"]) == (4, 4)
    diffs = [-1 + 0.5 * x - z for x in (0, 1) for z in (0, 1)]
    refs = [2 + x + 2 * z for x in (0, 1) for z in (0, 1)]
    assert row["relative_L2_C"] == pytest.approx(math.sqrt(sum(d * d for d in diffs) / sum(r * r for r in refs)))
    assert row["mean_abs_error_C"] == pytest.approx(sum(map(abs, diffs)) / 4)
    assert row["absolute_Linf_C"] == pytest.approx(2)
    assert row["relative_Linf_C"] == pytest.approx(0.4)
    fronts = compare.front_positions(gridded, chosen, ratio=0.25).collect()
    assert {r["case"]: r["threshold"] for r in fronts} == {"N5": 1.25, "N11": 1.25}
    assert {r["x_front"] for r in fronts} == {1.0}


def test_velocity_mask_and_safe_ratio(spark):
    rows = corners("N5", u=lambda x, z: 1 + x, skip=[(1, 1)]) + corners("N11")
    points, nodes, chosen = compared(spark, rows)
    row = compare.velocity_errors(regrid(points, nodes, ["u", "v", "w"]), chosen).first()
    assert row["valid_point_count"] == 3
    assert row["total_grid_point_count"] == 4
    assert row["relative_L2_u"] is None
    assert row["mean_abs_error_u"] == pytest.approx((1 + 2 + 1) / 3)
    assert row["relative_L2_v"] == pytest.approx(0)


def test_pressure_is_centred_and_safe(spark):
    rows = corners("N5", p=lambda x, z: 8 + x + 2 * z) + corners("N11", p=lambda x, z: 7.0)
    points, nodes, chosen = compared(spark, rows)
    gridded = regrid(points, nodes, ["p"]).cache()
    row = compare.pressure_errors(gridded, chosen).first()
    assert (row["relative_L2_p_prime"], row["relative_Linf_p_prime"]) == (None, None)
    assert row["absolute_Linf_p_prime"] == pytest.approx(1.5)
    mean = compare.with_fluctuation(gridded, chosen).groupBy("case").agg(F.avg("p_prime").alias("m")).collect()
    assert all(r["m"] == pytest.approx(0, abs=1e-12) for r in mean)


def test_empty_mask_fails(spark):
    nan = float("nan")
    rows = [("N5", 0, 0, nan, 0, 0, 0, 0), ("N5", 1, 1, 1.0, 0, 0, 0, 0), ("N11", 0, 0, 1.0, 0, 0, 0, 0), ("N11", 1, 1, nan, 0, 0, 0, 0)]
    points, _, chosen = compared(spark, rows)
    gridded = points.withColumns({"ix": F.col("x").cast("int"), "iz": F.col("z").cast("int")})
    with pytest.raises(Exception, match="no node is valid"):
        compare.concentration_errors(gridded, chosen).collect()


def test_self_comparison_has_no_error(spark):
    same = dict(c=lambda x, z: 1 + x + z, u=lambda x, z: x, p=lambda x, z: x - z)
    points, nodes, chosen = compared(spark, corners("N5", **same) + corners("N11", **same))
    gridded = regrid(points, nodes, ["C", "u", "v", "w", "p"]).cache()
    for table in (compare.concentration_errors, compare.velocity_errors, compare.pressure_errors):
        row = table(gridded, chosen).first().asDict()
        assert row.pop("relative_L2_w", None) is None  # w is zero, so its ratio is missing
        assert all(v == 0 for k, v in row.items() if "error" in k or k.startswith(("relative_L", "absolute")))


# --- views ---------------------------------------------------------------------------------


def plane_grid(spark, n=5, value=lambda x, z: x + z):
    rows = [("s", "N5", i, j, float(i), float(j), float(value(i, j))) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "comparison_set string, case string, ix int, iz int, x double, z double, C double")


def test_contour_of_a_plane_is_straight(spark):
    segments = views.iso_contour(plane_grid(spark), ["case"], "C", 3.5).collect()
    assert len(segments) == 7
    for s in segments:
        assert s["x1"] + s["z1"] == pytest.approx(3.5)
        assert s["x2"] + s["z2"] == pytest.approx(3.5)


def test_saddle_gives_two_segments(spark):
    saddle = plane_grid(spark, 2, lambda x, z: 1.0 if x == z else 0.0)
    low = views.iso_contour(saddle, ["case"], "C", 0.4).collect()
    high = views.iso_contour(saddle, ["case"], "C", 0.6).collect()
    assert len(low) == len(high) == 2
    # A high centre joins the high corners, so the segments cut off the low ones.
    assert {(round(s["x1"], 6), round(s["z1"], 6)) for s in low} == {(0.6, 0.0), (0.0, 0.6)}
    assert {(round(s["x1"], 6), round(s["z1"], 6)) for s in high} == {(0.0, 0.4), (0.6, 1.0)}


def test_contour_skips_cells_with_gaps(spark):
    gap = plane_grid(spark, 3).withColumn("C", F.when(F.col("ix") + F.col("iz") > 0, F.col("C")))
    cells = {(s["cx"], s["cz"]) for s in views.iso_contour(gap, ["case"], "C", 1.5).collect()}
    assert (0, 0) not in cells and len(cells) == 2


def test_profiles_take_the_first_of_two_equal_lines(spark):
    profiles = views.profile(plane_grid(spark), ["case"], "z", "C", [1.5])
    assert {r["iz"] for r in profiles.collect()} == {1}
    assert [r["C"] for r in profiles.orderBy("ix").collect()] == [1, 2, 3, 4, 5]


def test_range_flags(spark):
    bounds = [(-1.0, 9.0, "neither"), (1.0, 9.0, "min"), (-1.0, 7.0, "max"), (1.0, 7.0, "both")]
    for low, high, want in bounds:
        row = views.range_flags(plane_grid(spark), ["case"], "C", F.lit(low), F.lit(high)).first()
        assert row["extend"] == want
    zero = plane_grid(spark, 2, lambda x, z: 0.0)
    assert views.range_flags(zero, ["case"], "C", F.lit(0.0), F.lit(0.0)).first()["max_abs"] == 1.0


def test_downsample_is_exact_and_repeatable(spark):
    ids = spark.range(5000).select("id", F.when(F.col("id") < 4000, "big").otherwise("small").alias("case"))
    first = views.downsample(ids, ["case"], "id", size=1500)
    counts = {r["case"]: r["count"] for r in first.groupBy("case").count().collect()}
    assert counts == {"big": 1500, "small": 1000}
    again = views.downsample(ids.repartition(7), ["case"], "id", size=1500)
    assert {r["id"] for r in first.collect()} == {r["id"] for r in again.collect()}
    assert first.select("id").distinct().count() == 2500


# --- roll-up -----------------------------------------------------------------------------------


def summary(spark, rows):
    return spark.createDataFrame(rows, "target_time string, comparison_set string, field string, order string, relative_L2 string, seq int")


def test_pivot_best_and_trend(spark):
    def cells(name, *values):
        return [("5.0", name, "velocity", o, v, i) for i, (o, v) in enumerate(zip(("5", "N7", "9"), values, strict=True))]

    rows = cells("down", "3", "2", "1") + cells("flat", "2", "2", "1") + cells("up", "1", "2", "1") + cells("gap", "1", " ", "2")
    rows += [("5.0", "down", "velocity", "11", "0", 9), ("5.0", "down", "other", "5", "0", 9)]
    rows += [("5.0", "up", "velocity", "5", "1.5", 8)]
    got = {r["comparison_set"]: r for r in rollup.order_pivot(summary(spark, rows), "relative_L2", "seq").collect()}
    assert got["down"]["trend"] == "N5 > N7 > N9" and got["down"]["best_lower_order"] == "N9"
    assert got["flat"]["trend"] == "mostly decreasing"
    assert got["up"]["N5"] == 1.5 and got["up"]["trend"] == "not monotonic" and got["up"]["best_lower_order"] == "N9"
    assert got["gap"]["trend"] == "NA" and got["gap"]["N7"] is None and got["gap"]["best_lower_order"] == "N5"
    counts = {r["best_lower_order"]: r["n"] for r in rollup.best_counts(spark.createDataFrame(list(got.values()))).collect()}
    assert counts == {"N9": 3, "N5": 1}


def test_best_order_tie_goes_to_the_earlier(spark):
    rows = [("1", "s", "pressure", o, "2", 0) for o in ("9", "7")]
    assert rollup.order_pivot(summary(spark, rows), "relative_L2").first()["best_lower_order"] == "N7"


def test_repeated_cells_need_a_sequence(spark):
    rows = [("1", "s", "pressure", "9", v, 0) for v in ("2", "3")]
    with pytest.raises(Exception, match="Several rows for one time"):
        rollup.order_pivot(summary(spark, rows), "relative_L2").collect()


def test_summary_order(spark):
    rows = [("x", "a", "velocity", "5"), ("2", "b", "pressure", "5"), ("2", "b", "concentration", "9"), ("2", "b", "concentration", "5")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "target_time string, comparison_set string, field string, order string, case string")
    got = [(r["target_time"], r["field"], r["order"]) for r in rollup.sorted_summary(df).collect()]
    assert got == [("2", "concentration", "5"), ("2", "concentration", "9"), ("2", "pressure", "5"), ("x", "velocity", "5")]


def test_front_position_reads_its_index_off_all_lines(spark, tmp_path):
    columns = "l_linestatus string, l_returnflag string, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    lines = [("F", flag, number, x, 100.0 + x, 0.05, 0.02) for flag, last in (("A", 5), ("N", 2), ("R", 4)) for number, x in ((1, 10.0), (last, 20.0))]
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = registered.queries()["front_position"](spark, str(tmp_path)).collect()
    assert {(r["case"], r["index"], r["x_front"]) for r in rows} == {("A", 5, 20.0), ("N", 2, 20.0), ("R", 4, 20.0)}
    assert {r["threshold"] for r in rows} == {96.0}
