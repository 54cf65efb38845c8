"""Gaps, repeated times and short keys in series; smoothing weights; readers that refuse bad samples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import series
from fieldspark.sources import readers

NAN = float("nan")


def frame(spark, values, times=None, key="a"):
    times = range(len(values)) if times is None else times
    return spark.createDataFrame([(key, None if t is None else float(t), v) for t, v in zip(times, values, strict=True)], "k string, t double, v double")


@pytest.mark.parametrize("size", [2, 1000])
@pytest.mark.parametrize("bad", [None, NAN, float("inf")])
def test_integrals_fail_at_gaps(spark, size, bad):
    with pytest.raises(Exception, match="Non-finite value in column v"):
        series.cumulative_trapezoid(frame(spark, [1.0, bad, 1.0, 1.0]), ["k"], "t", "v", tile_size=size).collect()
    with pytest.raises(Exception, match="Repeated value in column t"):
        series.cumulative_trapezoid(frame(spark, [1.0, 2.0, 3.0, 4.0], [0, 1, 1, 2]), ["k"], "t", "v", tile_size=size).collect()


@pytest.mark.parametrize("size", [2, 3, 1000])
def test_integrals_restart_after_gaps(spark, size):
    values = [1.0, 3.0, None, 2.0, NAN, 5.0, 1.0, 1.0, 4.0, 6.0]
    times = [0, 1, 2, 3, 4, 5, 6, 8, 8, 9]
    out = series.cumulative_trapezoid(frame(spark, values, times), ["k"], "t", "v", tile_size=size, gaps="restart").orderBy("t", "v").collect()
    # Of the two rows at 8 the lower value comes first; the second one starts a segment.
    want = [(0, 1, 0), (1, 1, 2), (2, None, None), (3, 2, 0), (4, None, None), (5, 3, 0), (6, 3, 3), (8, 3, 5), (8, 4, 0), (9, 4, 5)]
    assert [(r["t"], r["segment"], r["cumulative"]) for r in out] == want
    with pytest.raises(ValueError, match="no initial value"):
        series.cumulative_trapezoid(frame(spark, values, times), ["k"], "t", "v", gaps="restart", initial="v")
    with pytest.raises(ValueError, match="Unknown treatment"):
        series.cumulative_trapezoid(frame(spark, values, times), ["k"], "t", "v", gaps="skip")


def test_rows_without_a_time_are_gaps(spark):
    for size in (2, 1000):
        out = series.cumulative_trapezoid(frame(spark, [9.0, 1.0, 1.0, 9.0], [None, 0, 2, NAN]), ["k"], "t", "v", tile_size=size, gaps="restart")
        assert sorted(r["cumulative"] for r in out.filter("segment is not null").collect()) == [0, 2] and out.count() == 4


@pytest.mark.parametrize("method", ["moving_average", "savgol"])
@pytest.mark.parametrize("size", [30, 1000])
def test_smoothing_spreads_a_missing_value_over_its_windows(spark, method, size):
    n, at, window = 40, 20, 7
    values = [float(k * k % 17) for k in range(n)]
    whole = {r["t"]: r["s"] for r in series.smooth(frame(spark, values), ["k"], "t", "v", "s", method, window, 2, size).collect()}
    for bad in (None, NAN):
        broken = [*values[:at], bad, *values[at + 1 :]]
        out = {r["t"]: r["s"] for r in series.smooth(frame(spark, broken), ["k"], "t", "v", "s", method, window, 2, size).collect()}
        for t in range(n):
            near = abs(t - at) <= window // 2
            assert (out[t] is None or np.isnan(out[t])) if near else out[t] == pytest.approx(whole[t])


@pytest.mark.parametrize(("window", "order"), [(5, 1), (7, 3), (11, 4)])
def test_smoothing_weights_are_those_of_the_polynomial_fit(spark, window, order):
    rng = np.random.default_rng(window)
    values = rng.normal(size=30)
    rows = [(key, float(t), float(v)) for key, n in (("long", 30), ("short", 6), ("two", 2), ("one", 1)) for t, v in enumerate(values[:n])]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    got = {(r["k"], r["t"]): r["s"] for r in series.smooth(df, ["k"], "t", "v", "s", "savgol", window, order).collect()}
    for key, n in (("long", 30), ("short", 6), ("two", 2), ("one", 1)):
        w = min(window, n if n % 2 else n - 1)
        for t in range(n):
            start = min(max(0, t - w // 2), n - w)
            degree = min(order, w - 1)
            fit = np.polynomial.Polynomial.fit(np.arange(w), values[start : start + w], degree) if w > 1 else lambda x, v=values[t]: v
            assert got[key, t] == pytest.approx(fit(t - start))


def test_chains_refuse_short_keys_and_repeated_times(spark):
    with pytest.raises(Exception, match="fewer than 2 rows"):
        series.front_kinematics(spark.createDataFrame([("a", 0.0, 1.0)], "case string, time double, x_front double")).collect()
    columns = "case string, time double, E_k double, E_p double, E_total double, epsilon double"
    with pytest.raises(Exception, match="fewer than 2 rows"):
        series.energy_diagnostics(spark.createDataFrame([("a", 0.0, 1.0, 1.0, 2.0, 0.0), ("b", 0.0, 1.0, 1.0, 2.0, 0.0), ("b", 1.0, 1.0, 1.0, 2.0, 0.0)], columns)).collect()
    with pytest.raises(Exception, match="Repeated value in column time"):
        series.energy_diagnostics(spark.createDataFrame([("b", 1.0, 1.0, 1.0, 2.0, 0.0), ("b", 1.0, 1.0, 1.0, 2.0, 0.0)], columns)).collect()


@pytest.mark.parametrize(
    ("text", "message"),
    [("0 1\n", "too_few_rows"), ("0 1\n1 nan\n", "non_finite"), ("0 1\n0 2\n", "duplicate_time"), ("# none\n", "No samples")],
)
def test_front_reader_checks_its_samples(spark, tmp_path, text, message):
    path = tmp_path / "case_N5" / "front.dat"
    path.parent.mkdir()
    path.write_text(text)
    with pytest.raises(ValueError, match=message):
        readers.read_front(spark, str(path))


def test_energy_reader_checks_every_column(spark, tmp_path):
    path = tmp_path / "case_N5" / "energy.dat"
    path.parent.mkdir()
    path.write_text("0 1 1 2 0\n1 1 inf 2 0\n")
    with pytest.raises(ValueError, match="E_p"):
        readers.read_energy_series(spark, str(path))


def test_curve_lines_are_numbered_across_splits(spark, tmp_path):
    lines = ["t,x", *[f"{k},{k + 1}" if k % 9 else "" for k in range(1, 3000)]]
    first = tmp_path / "a.csv"
    first.write_text("\n".join(lines) + "\n")
    broken = list(lines)
    broken[2345] = "2345,broken"
    second = tmp_path / "b.csv"
    second.write_text("\r\n".join(broken))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        numbered = readers.numbered_lines(spark, f"{tmp_path}/a.csv")
        assert spark.read.text(str(first)).rdd.getNumPartitions() > 3
        assert {r["_line_no"]: r["_line"] for r in numbered.collect()} == dict(enumerate(lines, 1))
        assert readers.read_curve(spark, str(first)).count() == sum(bool(x) for x in lines) - 1
        with pytest.raises(ValueError, match="line 2346: 2345,broken"):
            readers.read_curve(spark, str(second))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
