"""Selections, work lists and time alignment."""

from __future__ import annotations

import pytest

from fieldspark.plans import selection as sel


@pytest.fixture
def cases(spark):
    return spark.createDataFrame([("N5", 5), ("N7", 7), ("N11", 11)], "case string, order int")


@pytest.fixture
def sets(spark):
    return spark.createDataFrame(
        [
            ("t05", 5.0, None, {"N5": 21, "N7": 21, "N11": 11}, 0),
            ("t10", 10.0, "N7", {"N5": 41, "N7": 41, "N11": 11}, 1),
        ],
        "comparison_set string, target_time double, reference_case string, case_indices map<string,int>, position int",
    )


def by_case(df):
    return {r["case"]: r for r in df.collect()}


def test_named_set_wins(sets, cases):
    rows = by_case(sel.resolve_selection(sets, cases, "N11", comparison_set="t05", index=3))
    assert {c: r["index"] for c, r in rows.items()} == {"N5": 21, "N7": 21, "N11": 11}
    assert rows["N5"]["reference_case"] == "N11" and rows["N5"]["reference_index"] == 11
    assert rows["N5"]["target_time"] == 5.0 and rows["N5"]["n_cases"] == 3


def test_own_reference_of_a_set(sets, cases):
    rows = by_case(sel.resolve_selection(sets, cases, "N11", comparison_set="t10"))
    assert rows["N5"]["reference_case"] == "N7" and rows["N5"]["reference_index"] == 41


def test_map_then_index_then_last(sets, cases):
    chosen = sel.resolve_selection(sets, cases, "N11", case_indices={"N5": 79, "N7": 79, "N11": 40}, index=3)
    assert {c: r["index"] for c, r in by_case(chosen).items()} == {"N5": 79, "N7": 79, "N11": 40}
    assert {r["index"] for r in sel.resolve_selection(sets, cases, "N11", index=3).collect()} == {3}
    assert {r["index"] for r in sel.resolve_selection(sets, cases, "N11", file_indices=[1, 20]).collect()} == {20}


def test_invalid_selections_fail(sets, cases):
    with pytest.raises(ValueError, match="Unknown comparison set"):
        sel.resolve_selection(sets, cases, "N11", comparison_set="t99")
    with pytest.raises(Exception, match="all configured cases"):
        sel.resolve_selection(sets, cases, "N11", case_indices={"N5": 1}).collect()
    with pytest.raises(Exception, match="not a configured case"):
        sel.resolve_selection(sets, cases, "N13", index=1).collect()


def test_work_lists(sets):
    tasks = {(r["case"], r["index"]): r["first_position"] for r in sel.slice_tasks(sets).collect()}
    assert tasks == {("N5", 21): 0, ("N7", 21): 0, ("N11", 11): 0, ("N5", 41): 1, ("N7", 41): 1}
    assert sel.comparison_tasks(sets).count() == 6


def test_order_lookup(spark, cases, sets):
    chosen = sel.resolve_sets(sets, cases, "N11")
    requested = spark.createDataFrame([("t05", 5), ("t05", 9), ("t99", 7)], "comparison_set string, order int")
    got = {(r["comparison_set"], r["order"]): (r["case"], r["status"]) for r in sel.cases_for_orders(requested, cases, chosen).collect()}
    assert got == {("t05", 5): ("N5", "ok"), ("t05", 9): (None, "unknown_order"), ("t99", 7): ("N7", "not_in_set")}


def test_inventory(spark, cases):
    listing = spark.createDataFrame([("N5", 1), ("N7", 2), ("N5", 1)], "case string, index int")
    checked = sel.inventory(cases, [1, 2], listing)
    assert {(r["case"], r["index"]) for r in checked.filter("status = 'OK'").collect()} == {("N5", 1), ("N7", 2)}
    assert tuple(sel.inventory_totals(checked).first()) == (6, 2, 4)
    required = checked.select("case", "index")
    assert sel.missing_inputs(required, listing, ["case", "index"]).count() == 4
    with pytest.raises(FileNotFoundError):
        sel.require_inputs(required, listing, ["case", "index"])
    assert sel.pending(required, listing, ["case", "index"], overwrite=True).count() == 6


def test_locate_prefers_the_expected_path(spark):
    files = spark.createDataFrame(
        [("b", "N5", 1, "t05"), ("a", "N5", 1, "t10"), ("c", "N7", 1, None), ("d", "N7", 1, "")],
        "path string, case string, index int, comparison_set string",
    )
    wanted = spark.createDataFrame(
        [("t05", "N5", 1, "x"), ("t05", "N7", 1, "d"), ("t05", "N7", 1, "y"), ("t05", "N9", 1, "z")],
        "comparison_set string, case string, index int, expected_path string",
    )
    got = {(r["case"], r["expected_path"]): r["path"] for r in sel.locate(wanted, files).collect()}
    assert got == {("N5", "x"): "b", ("N7", "d"): "d", ("N7", "y"): "c", ("N9", "z"): None}


def test_time_alignment(spark):
    nan = float("nan")
    times = spark.createDataFrame(
        [("s", "N5", 19.48), ("s", "N7", 19.0), ("s", "N9", nan), ("s", "N11", 19.5), ("q", "N5", 1.0)],
        "comparison_set string, case string, time double",
    )
    aligned = sel.time_alignment(times, "N11")
    got = {(r["comparison_set"], r["case"]): r["status"] for r in aligned.collect()}
    assert got == {("s", "N5"): "ok", ("s", "N7"): "exceeds", ("s", "N9"): "missing", ("s", "N11"): "ok", ("q", "N5"): "missing"}
    with pytest.raises(Exception, match="not aligned"):
        sel.require_alignment(aligned).collect()
