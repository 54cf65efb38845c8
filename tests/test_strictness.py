"""Missing values fail or count by one rule, whatever the length of a key or the size of a tile."""

from __future__ import annotations

import pytest

from fieldspark.operators import series, slicing
from fieldspark.plans.comparison import compare_fields

ELEMENT = "case string, pos array<array<double>>, vel array<array<double>>, pres array<array<double>>, temp array<array<double>>, scal array<array<double>>"
POS, VEL, ONE = [[0.0, 1.0]] * 3, [[1.0, 1.0]] * 3, [[5.0, 6.0]]


@pytest.mark.parametrize(
    "row",
    [("a", POS, VEL, ONE, None, None), ("a", POS, None, ONE, ONE, None), ("a", POS, VEL, [[1.0]], ONE, None)],
    ids=["no concentration", "no velocity", "unequal length"],
)
def test_incomplete_elements_fail(spark, row):
    with pytest.raises(Exception, match="Element without"):
        slicing.flatten_elements(spark.createDataFrame([row], ELEMENT), ["case"]).collect()


def test_missing_y_fails(spark):
    points = spark.createDataFrame([("a", 1.0), ("a", None)], "case string, y double")
    with pytest.raises(Exception, match="Non-finite y"):
        slicing.slice_plane(points, ["case"]).collect()


def test_first_value_ignores_rows_without_time(spark):
    rows = spark.createDataFrame([("a", None, 99.0), ("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 4.0)], "case string, t double, v double")
    seen = []
    for size in (2, 1000):
        out = series.relative_to_initial(rows, ["case"], "t", "v", "d", tile_size=size).filter("t is not null")
        seen.append(sorted((r["t"], r["d"]) for r in out.collect()))
    assert seen[0] == seen[1] == [(0.0, 0.0), (1.0, 2.0), (2.0, 3.0)]


def test_integrals_refuse_missing_values(spark):
    columns = "case string, time double, E_k double, E_p double, E_total double, epsilon double"
    rows = spark.createDataFrame([("a", float(t), 1.0, 1.0, 2.0, None if t == 1 else 1.0) for t in range(4)], columns)
    with pytest.raises(Exception, match="Non-finite value in column epsilon"):
        series.energy_diagnostics(rows).collect()


def test_only_the_selected_snapshot_is_compared(spark):
    points = []
    for case, shift in (("N5", 1.0), ("N11", 0.0)):
        for idx in (1, 2):
            points += [("s", case, idx, float(x), 0.0, float(z), 10.0 * idx + shift * idx, 1.0, 0.0, 0.0, 1.0) for x in range(4) for z in range(4)]
    sliced = spark.createDataFrame(points, "comparison_set string, case string, idx int, x double, y double, z double, C double, u double, v double, w double, p double")
    for idx in (1, 2):
        chosen = spark.createDataFrame(
            [("s", None, c, o, idx, "N11", idx, 2) for c, o in (("N5", 5), ("N11", 11))],
            "comparison_set string, target_time double, case string, order int, index long, reference_case string, reference_index long, n_cases long",
        )
        row = compare_fields(sliced, chosen, nx=3, nz=3, method="nearest").concentration.filter("case = 'N5'").first()
        assert row["index"] == idx
        assert row["mean_abs_error_C"] == pytest.approx(idx)
