"""Series operators: hand-computed values, and tiles against the plain window."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import curve, series, stats


def make(spark, columns, **by_case):
    names = ["case", *columns]
    rows = [(case, *map(float, values)) for case, data in by_case.items() for values in zip(*data, strict=True)]
    return spark.createDataFrame(rows, ", ".join([f"{names[0]} string", *(f"{n} double" for n in names[1:])]))


def values(df, name, case="a"):
    return [r[name] for r in df.filter(F.col("case") == case).orderBy("time").collect()]


def random_series(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    data = {}
    for i, n in enumerate(lengths):
        time = np.cumsum(rng.uniform(0.1, 1.0, n))
        data[f"c{i}"] = [time, np.cumsum(rng.normal(0.5, 1.0, n))]
    return make(spark, ["time", "x_front"], **data), data


# --- golden values -----------------------------------------------------------------


def test_cumulative_trapezoid(spark):
    df = make(spark, ["time", "v"], a=[[0, 1, 3], [1, 3, 2]])
    assert values(series.cumulative_trapezoid(df, ["case"], "time", "v"), "cumulative") == [0, 2, 7]


def test_integral_from_initial_position(spark):
    df = make(spark, ["time", "v", "x"], a=[[0, 1, 3], [2, 4, 8], [10, 0, 0]])
    out = series.cumulative_trapezoid(df, ["case"], "time", "v", initial="x")
    assert values(out, "cumulative") == [10, 13, 25]


def energy(spark):
    return make(
        spark,
        ["time", "E_k", "E_p", "E_total", "epsilon"],
        a=[[0, 1, 3], [2, 2.5, 3], [3, 2.5, 2], [5.2, 4.2, 2.2], [1, 1, 1]],
    )


def test_energy_diagnostics(spark):
    out = series.energy_diagnostics(energy(spark), target=5.0)
    assert values(out, "E_total_minus_Ek_Ep") == pytest.approx([0.2, -0.8, -2.8])
    assert values(out, "cumulative_epsilon") == [0, 1, 3]
    assert values(out, "energy_closure") == pytest.approx([5.2] * 3)
    assert values(out, "closure_residual_from_target") == pytest.approx([0.2] * 3)
    assert values(out, "closure_drift_from_initial") == pytest.approx([0.0] * 3, abs=1e-12)
    assert values(out, "dEtotal_dt") == pytest.approx([-1.0] * 3)
    assert values(out, "differential_closure_residual") == pytest.approx([0.0] * 3, abs=1e-12)
    assert values(out, "energy_closure_minus") == pytest.approx([5.2, 3.2, -0.8])


def test_energy_summary(spark):
    row = series.energy_summary(series.energy_diagnostics(energy(spark), target=4.0), target=4.0).first()
    assert (row["n_points"], row["time_start"], row["time_end"], row["target"]) == (3, 0.0, 3.0, 4.0)
    assert (row["E_total_initial"], row["E_total_final"]) == (5.2, 2.2)
    assert row["max_abs_closure_residual_from_target"] == pytest.approx(1.2)
    assert row["rms_closure_residual_from_target"] == pytest.approx(1.2)
    assert row["max_abs_E_total_minus_Ek_Ep"] == pytest.approx(2.8)
    assert row["cumulative_epsilon_final"] == 3.0


def test_gradient_is_exact_for_parabolas(spark):
    t = np.array([0.0, 0.5, 2.0, 3.0, 7.0])
    df = make(spark, ["time", "x"], a=[t, t * t])
    assert values(series.gradient(df, ["case"], "time", "x", edge_order=2), "gradient") == pytest.approx(2 * t)
    first_order = values(series.gradient(df, ["case"], "time", "x"), "gradient")
    assert first_order == pytest.approx(np.gradient(t * t, t))


def test_gradient_of_two_rows_falls_back_to_one_step(spark):
    df = make(spark, ["time", "x"], a=[[0, 2], [1, 5]])
    assert values(series.gradient(df, ["case"], "time", "x", edge_order=2), "gradient") == [2, 2]


def test_moving_average_edges(spark):
    df = make(spark, ["time", "x"], a=[[0, 1, 2, 3], [1, 3, 5, 7]])
    assert values(series.smooth(df, ["case"], "time", "x", window=3), "smoothed") == pytest.approx([2, 3, 5, 6])


@pytest.mark.parametrize("window", [1, 2, 4, 5, 50])
def test_moving_average_matches_convolution(spark, window):
    rng = np.random.default_rng(1)
    data = {f"c{n}": [np.arange(n), rng.random(n)] for n in (1, 2, 5, 9)}
    out = series.smooth(make(spark, ["time", "x"], **data), ["case"], "time", "x", window=window).cache()
    for case, (_, x) in data.items():
        n = len(x)
        w = max(1, window + 1 - window % 2)
        if w > n:
            w = n if n % 2 else n - 1
        kernel = np.ones(max(1, w))
        want = np.convolve(x, kernel, "same") / np.convolve(np.ones(n), kernel, "same")
        assert values(out, "smoothed", case) == pytest.approx(want)


def test_savgol_keeps_cubics_and_uses_end_fits(spark):
    t = np.arange(15.0)
    cubic = 1 + t - 0.3 * t**2 + 0.02 * t**3
    short = cubic[:5]
    df = make(spark, ["time", "x"], a=[t, cubic], b=[t[:5], short], c=[t[:1], cubic[:1]])
    out = series.smooth(df, ["case"], "time", "x", method="savgol").cache()
    assert values(out, "smoothed") == pytest.approx(cubic)
    assert values(out, "smoothed", "b") == pytest.approx(short)
    assert values(out, "smoothed", "c") == pytest.approx(cubic[:1])
    noisy = cubic + np.random.default_rng(0).normal(size=15)
    got = values(series.smooth(make(spark, ["time", "x"], a=[t, noisy]), ["case"], "time", "x", method="savgol"), "smoothed")
    first, last = np.polynomial.Polynomial.fit(t[:11], noisy[:11], 3), np.polynomial.Polynomial.fit(t[4:], noisy[4:], 3)
    assert got[:5] == pytest.approx(first(t[:5]))
    assert got[10:] == pytest.approx(last(t[10:]))


def test_savgol_without_degree_is_the_moving_average(spark):
    df = make(spark, ["time", "x"], a=[range(6), [1, 4, 2, 8, 5, 7]])
    plain = series.smooth(df, ["case"], "time", "x", window=3)
    flat = series.smooth(df, ["case"], "time", "x", method="savgol", window=3, polyorder=0)
    assert values(flat, "smoothed") == pytest.approx(values(plain, "smoothed"))


def test_linear_front_has_constant_velocity_and_no_error(spark):
    df = make(spark, ["time", "x_front"], a=[[0, 1, 2], [5, 7, 9]])
    out = series.front_kinematics(df, window=1)
    assert values(out, "v_raw") == [2, 2, 2]
    assert values(out, "x_reconstruction_error") == [0, 0, 0]


def test_interpolation_at_curve_times(spark):
    fronts = make(spark, ["time", "x_front"], a=[[0, 2, 4], [0, 4, 8]])
    outline = spark.createDataFrame([(1.0, 1.0), (3.0, 7.0), (5.0, 10.0)], "time double, x double")
    out = curve.interpolate_at_curve(fronts, outline)
    assert values(out, "time") == [1, 3]
    assert values(out, "simulation_x_interp") == [2, 6]
    assert values(out, "x_error") == [1, -1]
    assert values(out, "relative_error") == pytest.approx([1, -1 / 7])


def test_interpolation_at_knots_and_without_overlap(spark):
    fronts = make(spark, ["time", "x_front"], a=[[0, 2, 4], [1, 5, 2]], b=[[10, 11], [0, 1]])
    outline = spark.createDataFrame([(0.0, 0.0), (2.0, -1.0), (4.0, 1.0)], "time double, x double")
    out = curve.interpolate_at_curve(fronts, outline).cache()
    assert values(out, "simulation_x_interp") == [1, 5, 2]
    assert values(out, "relative_error") == pytest.approx([None, -6, 1]) or values(out, "relative_error")[0] is None
    assert values(out, "log_error")[1] is None
    assert values(out, "time", "b") == []


def test_slope_comparison(spark):
    t = np.array([0.0, 3.0, 6.0, 12.0, 15.0])
    df = make(spark, ["time", "paper_x", "simulation_x_interp", "relative_error"], a=[t, 2 * t, 3 * t, t * 0 + 0.5])
    row = curve.slope_comparison(df, with_error_stats=True).first()
    assert row["n_slumping_points"] == 3
    assert row["paper_slumping_velocity"] == pytest.approx(2)
    assert row["simulation_slumping_velocity"] == pytest.approx(3)
    assert row["slumping_velocity_difference"] == pytest.approx(1)
    assert row["slumping_velocity_relative_difference"] == pytest.approx(0.5)
    assert row["slumping_mean_abs_relative_error"] == pytest.approx(0.5)


def test_slope_needs_two_points(spark):
    df = make(spark, ["time", "x"], a=[[5], [1]])
    row = stats.window_slopes(df, ["case"], "time", "x").first()
    assert (row["n_window_points"], row["slope_window"], row["slope_all"]) == (1, None, None)


def test_finite_stats_skip_or_spread_missing(spark):
    df = make(spark, ["time", "v"], a=[[0, 1, 2], [3, float("nan"), -4]])
    row = stats.finite_stats(df, ["case"], "v").first()
    assert row["mean_abs"] == 3.5
    assert row["rms"] == pytest.approx(5 / np.sqrt(2))
    assert row["finite_mean"] == -0.5
    assert (row["mean_abs_all"], row["max_abs_all"], row["rms_all"]) == (None, None, None)


def test_series_violations(spark):
    nan = float("nan")
    df = make(spark, ["time", "v"], a=[[0], [1]], b=[[0, 0, 1], [1, nan, 2]], ok=[[0, 1], [1, 2]])
    found = {(r["case"], r["rule"], r["column_name"]) for r in series.series_violations(df, ["case"], "time", ["v"]).collect()}
    assert found == {("a", "too_few_rows", None), ("b", "non_finite", "v"), ("b", "duplicate_time", "time")}
    with pytest.raises(ValueError, match="duplicate_time"):
        series.require_valid(df, ["case"], "time", ["v"])


# --- tiles ------------------------------------------------------------------------------
# One key holds most rows. Tiles of a few rows must give what one window gives.

TILE = 16


def both(build, columns, by):
    whole = {tuple(r[c] for c in by): [r[c] for c in columns] for r in build(10**6).collect()}
    cut = {tuple(r[c] for c in by): [r[c] for c in columns] for r in build(TILE).collect()}
    assert whole.keys() == cut.keys()
    for key, want in whole.items():
        assert cut[key] == pytest.approx(want, rel=1e-9, abs=1e-9), key


@pytest.mark.parametrize("method", ["moving_average", "savgol"])
def test_kinematics_in_tiles(spark, method):
    df, _ = random_series(spark, [70, 3, 16, 17])
    df = df.cache()
    columns = ["v_raw", "v_smooth", "x_reconstructed", "x_reconstruction_error"]
    both(lambda n: series.front_kinematics(df, method=method, window=5, tile_size=n), columns, ["case", "time"])


def test_energy_in_tiles(spark):
    df, _ = random_series(spark, [60, 2])
    rows = df.withColumns({"E_k": F.lit(1.0), "E_p": F.lit(2.0), "E_total": F.col("x_front"), "epsilon": F.abs("x_front")})
    rows = rows.cache()
    both(
        lambda n: series.energy_diagnostics(rows, tile_size=n),
        ["cumulative_epsilon", "dEtotal_dt", "closure_drift_from_initial"],
        ["case", "time"],
    )


def test_curve_interpolation_in_tiles(spark):
    """All curve points fall into a gap between two knots of one case."""
    df, data = random_series(spark, [50, 4])
    rng = np.random.default_rng(5)
    lo, hi = data["c0"][0][10], data["c0"][0][11]
    times = np.concatenate((np.linspace(lo, hi, 60), rng.uniform(0, 30, 40)))
    outline = spark.createDataFrame([(float(t), 1.0) for t in times], "time double, x double")
    df = df.cache()
    both(lambda n: curve.interpolate_at_curve(df, outline, tile_size=n), ["simulation_x_interp"], ["case", "time"])
    got = curve.interpolate_at_curve(df, outline, tile_size=TILE)
    for case, (t, x) in data.items():
        rows = {r["time"]: r["simulation_x_interp"] for r in got.filter(F.col("case") == case).collect()}
        inside = [v for v in times if t[0] <= v <= t[-1]]
        assert [rows[v] for v in inside] == pytest.approx(np.interp(inside, t, x))


def test_results_do_not_depend_on_shuffle_partitions(spark):
    df, _ = random_series(spark, [40, 5])
    before = sorted(map(tuple, series.front_kinematics(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    after = sorted(map(tuple, series.front_kinematics(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert before == after
