"""Readers and writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import series
from fieldspark.sources import readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def test_energy_series_reader(spark, tmp_path):
    write(tmp_path / "case_N5" / "energy.dat", "# time Ek Ep Et eps\n 1 2 3 5 0.5 99\n\n0  2 3 5 1e-1 # first\n")
    write(tmp_path / "case_N7" / "energy.dat", "0 1 1 2 0\n1 1 1 2 0\n")
    rows = readers.read_energy_series(spark, f"{tmp_path}/case_*/energy.dat").orderBy("case", "time").collect()
    assert [tuple(r) for r in rows][:2] == [("N5", 0, 2, 3, 5, 0.1), ("N5", 1, 2, 3, 5, 0.5)]
    assert len(rows) == 4


def test_short_or_unreadable_lines_fail(spark, tmp_path):
    short = write(tmp_path / "case_N5" / "short.dat", "0 1\n1\n")
    with pytest.raises(Exception, match="fewer than 2 columns"):
        readers.read_front(spark, str(short)).collect()
    text = write(tmp_path / "case_N5" / "text.dat", "0 1\n1 abc\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_front(spark, str(text)).collect()


def test_curve_reader(spark, tmp_path):
    path = write(tmp_path / "curve.csv", "t,x\r\n# note\r\n\r\n3, 4\r\n5\r\n1,2,9\r\nnan,7\r\n0,1\r\n")
    rows = readers.read_curve(spark, str(path)).orderBy("time").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 1, False), (1, 2, True), (3, 4, True)]


def test_a_glob_of_curves_keeps_its_files_apart(spark, tmp_path):
    write(tmp_path / "a.csv", "1,2\n3,4\n")
    write(tmp_path / "b.csv", "1,5\n3,6\n")
    rows = readers.read_curve(spark, f"{tmp_path}/*.csv").collect()
    assert sorted((r["file"][-5:], r["time"], r["x"]) for r in rows) == [("a.csv", 1, 2), ("a.csv", 3, 4), ("b.csv", 1, 5), ("b.csv", 3, 6)]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("t,x\n1,2\nbad,3\n", "line 3"),
        ("t,x\n1,2\n", "too_few_rows|two finite rows"),
        ("1,2\n1,3\n", "duplicate_time"),
        ("0,1\n-1,2\n", "no positive row"),
    ],
)
def test_curve_errors(spark, tmp_path, text, message):
    path = write(tmp_path / "curve.csv", text)
    with pytest.raises(ValueError, match=message):
        readers.read_curve(spark, str(path))


def test_curve_without_positive_rows_when_allowed(spark, tmp_path):
    path = write(tmp_path / "curve.csv", "0,1\n-1,2\n")
    assert readers.read_curve(spark, str(path), require_positive=False).count() == 2


def test_processed_reader(spark, tmp_path):
    path = write(tmp_path / "N5_front_kinematics_timeseries.csv", "time,x_reconstructed,other\n2,14,0\n1,10,0\n")
    rows = readers.read_processed(spark, str(path)).orderBy("time").collect()
    assert [(r["case"], r["x_processed"], r["processed_x0_shift"]) for r in rows] == [("N5", 0, 10), ("N5", 4, 10)]
    bad = write(tmp_path / "N7_front_kinematics_timeseries.csv", "time,x\n1,2\n")
    with pytest.raises(ValueError, match="x_reconstructed"):
        readers.read_processed(spark, str(bad))


def test_csv_sinks_keep_the_column_order(spark, tmp_path):
    df = spark.createDataFrame([("N5", 0.0, 1.0), ("N5", 1.0, 2.0)], "case string, time double, x_front double")
    out = series.front_kinematics(df)
    writers.write_csv(out, "kinematics_timeseries", str(tmp_path / "k"), by=["case"])
    back = spark.read.option("header", True).csv(str(tmp_path / "k"))
    assert tuple(back.columns[:-1]) == writers.TABLE_COLUMNS["kinematics_timeseries"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_csv(out, "kinematics_timeseries", str(tmp_path / "k"), by=["case"])
    writers.write_csv(series.kinematics_summary(out), "kinematics_summary", str(tmp_path / "s"))
    header = spark.read.option("header", True).csv(str(tmp_path / "s")).columns
    assert tuple(header) == writers.TABLE_COLUMNS["kinematics_summary"]


def test_slices_replace_only_written_partitions(spark, tmp_path):
    path = str(tmp_path / "slices")

    def rows(case, x):
        return spark.createDataFrame([("s", case, x)], "comparison_set string, case string, x double")

    writers.write_slice(rows("N5", 1.0).union(rows("N7", 2.0)), path)
    writers.write_slice(rows("N5", 3.0), path, overwrite=True)
    got = {(r["case"], r["x"]) for r in readers.read_points(spark, path).collect()}
    assert got == {("N5", 3.0), ("N7", 2.0)}


def test_gridded_sink_keeps_lineage(spark, tmp_path):
    path = str(tmp_path / "grids")
    df = spark.createDataFrame([("s", "N5", 0, 0, 1.5)], "comparison_set string, case string, ix int, iz int, C double")
    writers.write_gridded(df, path, "slices/N5", "linear")
    row = spark.read.parquet(path).first()
    assert (row["C"], row["source_slice"], row["interpolation_method"]) == (1.5, "slices/N5", "linear")


def test_file_listing(spark, tmp_path):
    write(tmp_path / "N5" / "G0.f00001", "x")
    write(tmp_path / "N7" / "G0.f00020", "x")
    write(tmp_path / "N7" / "notes.txt", "x")
    found = readers.list_files(spark, str(tmp_path), r"/([^/]+)/G0\.f(\d{5})$")
    assert {(r["case"], r["index"]) for r in found.select("case", F.col("index")).collect()} == {("N5", 1), ("N7", 20)}
