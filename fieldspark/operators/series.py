"""Integrate, differentiate, smooth and validate irregular time series per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from operator import add, truediv

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import finite, ieee_ratio, strict
from fieldspark.operators.ordered import TILE_SIZE, Tiles, nearest_marked, running_sum, tile_rows
from fieldspark.operators.stats import max_abs, mean_abs, rms, window_slope_columns
from fieldspark.plans.scale import attach

# Defaults that decide the results.
SMOOTHING_WINDOW = 11
SMOOTHING_POLYORDER = 3
ENERGY_TARGET = 12.0


# --- integrals ---------------------------------------------------------------


def _trapezoid(tiles: Tiles, time: str, value: str) -> Column:
    w = tiles.window
    return 0.5 * (F.col(value) + F.lag(value).over(w)) * (F.col(time) - F.lag(time).over(w))


def add_cumulative_trapezoid(tiles: Tiles, time: str, value: str, name: str) -> Tiles:
    """Needs a halo of one row and no missing values; the first row of each key gets 0."""
    stepped = tiles.with_columns({"_step": _trapezoid(tiles, time, value)})
    summed = running_sum(stepped, F.col("_step"), name, apart=True)
    return replace(summed, rows=summed.rows.drop("_step"))


def add_segment_trapezoid(tiles: Tiles, time: str, value: str, name: str, segment: str) -> Tiles:
    """Like ``add_cumulative_trapezoid``, but every gap ends a segment and the next one starts again at 0.

    A row without a finite time or value is a gap: it has neither an integral nor a segment. So is a row whose time
    repeats that of the row before, because the order of the two is not known; it starts a segment of its own.
    """
    w = tiles.window
    known = finite(time, value)
    joined = known & F.coalesce(F.lag(known).over(w), F.lit(False)) & F.coalesce(F.col(time) > F.lag(time).over(w), F.lit(False))
    tiles = tiles.with_columns({"_known": known, "_joined": joined})
    tiles = tiles.with_columns({"_step": F.when(F.col("_joined"), _trapezoid(tiles, time, value)), "_begin": F.col("_known") & ~F.col("_joined")})
    tiles = running_sum(tiles, F.col("_step"), "_total")
    tiles = running_sum(tiles, F.col("_begin").cast("double"), "_segment")
    tiles = nearest_marked(tiles, F.col("_begin"), F.col("_total"), "_from", "_to")
    known = F.col("_known")
    rows = tiles.rows.withColumns({name: F.when(known, F.col("_total") - F.col("_from")), segment: F.when(known, F.col("_segment")).cast("long")})
    return replace(tiles, rows=rows.drop("_known", "_joined", "_step", "_begin", "_total", "_segment", "_from", "_to"))


def cumulative_trapezoid(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    name: str = "cumulative",
    initial: str | None = None,
    tile_size: int = TILE_SIZE,
    gaps: str = "fail",
    segment: str = "segment",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Trapezoidal integral from the first row, from 0 or from the first value of ``initial``.

    An integral must not skip an interval. With ``gaps="fail"`` a missing or non-finite time or value or a repeated time
    fails the job. With ``gaps="restart"`` it starts again at 0 after each of these, and the column ``segment`` numbers the
    stretches; ``initial`` then is not possible. Rows of equal time are ordered by their value. With ``ties``, columns that
    order rows of equal time, repeated times are no gaps: there is no area between them.
    """
    if gaps == "restart":
        if initial is not None:
            raise ValueError("An integral that restarts has no initial value.")
        if ties:
            raise ValueError("An integral that restarts has gaps at repeated times.")
        tiles = add_segment_trapezoid(tile_rows(df, keys, [time, value], 1, tile_size), time, value, name, segment)
        return tiles.rows.select(*df.columns, name, segment)
    if gaps != "fail":
        raise ValueError(f"Unknown treatment of gaps {gaps!r}.")
    tiles = tile_rows(strict_rows(df, keys, [time, value]), keys, [time, *ties], 1, tile_size)
    tiles = add_cumulative_trapezoid(rising_times(tiles, time, value, repeats=bool(ties)), time, value, name)
    rows = tiles.rows
    if initial is not None:
        rows = with_first(rows, keys, time, {"_x0": initial}, tiles.single, ties)
        rows = rows.withColumn(name, F.col("_x0") + F.col(name))
    return rows.select(*df.columns, name)


def cumulative_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, tile_size: int = TILE_SIZE
) -> DataFrame:
    tiles = running_sum(tile_rows(df, keys, order, 0, tile_size), F.col(value), name)
    return tiles.result(*df.columns, name)


def place(time: str, ties: Sequence[str] = ()) -> Column:
    """What orders the rows of a key; NULL for rows without a time."""
    return F.when(F.col(time).isNotNull(), F.struct(time, *ties)) if ties else F.col(time)


def with_first(
    rows: DataFrame, keys: Sequence[str], time: str, firsts: dict[str, str], single: bool, ties: Sequence[str] = ()
) -> DataFrame:
    """Add the value each key has at its earliest time; rows without a time do not count."""
    at = place(time, ties)
    if single:
        w = Window.partitionBy(*keys)
        return rows.withColumns({n: F.min_by(c, at).over(w) for n, c in firsts.items()})
    facts = rows.groupBy(*keys).agg(*(F.min_by(c, at).alias(n) for n, c in firsts.items()))
    return attach(rows, facts, keys)


def relative_to_initial(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    name: str,
    first_name: str | None = None,
    tile_size: int = TILE_SIZE,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Shift ``value`` so that it starts at zero; ``first_name`` also keeps the shift."""
    facts = df.groupBy(*keys).agg(F.min_by(value, place(time, ties)).alias("_x0"))
    shifted = attach(df, facts, keys).withColumn(name, F.col(value) - F.col("_x0"))
    if first_name is None:
        return shifted.select(*df.columns, name)
    return shifted.withColumnRenamed("_x0", first_name).select(*df.columns, name, first_name)


# --- derivatives ---------------------------------------------------------------


def gradient_column(tiles: Tiles, time: str, value: str, edge_order: int, repeats: bool = False) -> Column:
    """Second-order non-uniform difference; needs a halo of ``edge_order`` rows.

    Ends use a one-sided difference over one step, or with ``edge_order=2`` and
    at least three rows the derivative of the parabola through three rows.
    A repeated time fails the job, or with ``repeats`` gives the infinity or NaN of a division by zero.
    """
    w = tiles.window
    ratio = ieee_ratio if repeats else truediv
    t, f = F.col(time), F.col(value)

    def shifted(offset: int) -> tuple[Column, Column]:
        pick = F.lag if offset < 0 else F.lead
        return pick(time, abs(offset)).over(w), pick(value, abs(offset)).over(w)

    (t_prev, f_prev), (t_next, f_next) = shifted(-1), shifted(1)
    back, ahead = t - t_prev, t_next - t
    slope_back, slope_ahead = ratio(f - f_prev, back), ratio(f_next - f, ahead)
    # Weighted mean of the two one-sided slopes: exact for parabolas.
    interior = ratio(slope_back * ahead + slope_ahead * back, back + ahead)
    first, last = slope_ahead, slope_back
    if edge_order == 2:
        (t2, f2), (t0, f0) = shifted(2), shifted(-2)
        next_slope = ratio(f2 - f_next, t2 - t_next)
        prev_slope = ratio(f_prev - f0, t_prev - t0)
        long_ahead, long_back = t2 - t, t - t0
        first = F.when(
            F.col("_n") >= 3, slope_ahead - ratio(ahead * (next_slope - slope_ahead), long_ahead)
        ).otherwise(first)
        last = F.when(F.col("_n") >= 3, slope_back + ratio(back * (slope_back - prev_slope), long_back)).otherwise(last)
    return F.when(F.col("_rn") == 1, first).when(F.col("_rn") == F.col("_n"), last).otherwise(interior)


def gradient(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    name: str = "gradient",
    edge_order: int = 1,
    tile_size: int = TILE_SIZE,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Derivative in time; ``ties`` order rows of equal time, which fail the job without them."""
    tiles = tile_rows(df, keys, [time, *ties], edge_order, tile_size)
    return tiles.with_columns({name: gradient_column(tiles, time, value, edge_order, bool(ties))}).result(*df.columns, name)


# --- smoothing -----------------------------------------------------------------


def _odd(window: int) -> int:
    window = max(1, int(window))
    return window if window % 2 else window + 1


def odd_window(n: Column, window: int) -> Column:
    """Largest odd window not above the requested one (made odd) nor above ``n``."""
    odd_n = F.when(n % 2 == 1, n).otherwise(n - 1)
    return F.greatest(F.lit(1), F.least(F.lit(_odd(window)), odd_n)).cast("int")


def effective_windows(df: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    return sized.withColumn("window", odd_window(F.col("n_points"), window))


def moving_average_column(tiles: Tiles, value: str, window: int) -> Column:
    """Centred mean, whatever the length of a key; missing if a value of its window is. Needs a halo of half the window."""
    half = (_odd(window) - 1) // 2
    if half == 0:
        return F.col(value)
    frame = tiles.window.rowsBetween(-half, half)
    plain = F.when(F.count(value).over(frame) == F.count(F.lit(1)).over(frame), F.avg(value).over(frame))
    if tiles.smallest_key >= _odd(window):
        return plain
    # Some key is shorter than the window, so its half-width is smaller.
    near = F.collect_list(F.struct("_rn", F.col(value).alias("_v"))).over(frame)
    own_half = (odd_window(F.col("_n"), window) - 1) / 2
    kept = F.filter(near, lambda e: F.abs(e["_rn"] - F.col("_rn")) <= own_half)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, e: acc + e["_v"])
    return F.when(F.col("_n") >= _odd(window), plain).otherwise(total / F.size(kept))


def _norm_ratio(k: int, width: Column, half: Column) -> Column:
    """Squared norms of the k-th and the (k-1)-th polynomial orthogonal over ``width`` positions from -1 to 1, as a ratio."""
    return k * k * (width * width - k * k) / (4.0 * (4 * k * k - 1)) / (half * half)


def fit_coefficients(at: Column, width: Column, half: Column, degree: int) -> list[Column]:
    """The weight of a sample in the least-squares fit read at ``at`` is a polynomial of its position: its coefficients.

    The orthogonal polynomials follow a three-term recurrence whose terms are formulas of the window length, so one
    expression serves all lengths. A window of w samples has w of these polynomials.
    """
    basis, value, norm = [[F.lit(1.0)]], [F.lit(1.0)], [width]
    for k in range(1, degree + 1):
        terms, read = [F.lit(0.0), *basis[-1]], at * value[-1]
        if k > 1:
            ratio = _norm_ratio(k - 1, width, half)
            terms = [t - ratio * basis[-2][m] if m < k - 1 else t for m, t in enumerate(terms)]
            read = read - ratio * value[-2]
        basis.append(terms)
        value.append(read)
        norm.append(norm[-1] * _norm_ratio(k, width, half))
    scale = [F.when(k < width, value[k] / norm[k]).otherwise(0.0) for k in range(degree + 1)]
    return [reduce(add, (scale[k] * basis[k][m] for k in range(m, degree + 1))) for m in range(degree + 1)]


def savgol_weights(widths: DataFrame, degree: int) -> DataFrame:
    """(width, at, weights): the weights of a window's samples in the fit read at each of its rows, for the given widths."""
    half = F.greatest((F.col("width") - 1) / 2, F.lit(1.0))
    rows = widths.select("width", half.alias("half"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("at"))
    fits = fit_coefficients((F.col("at") - F.col("half")) / F.col("half"), F.col("width").cast("double"), F.col("half"), degree)
    rows = rows.select("width", "half", "at", *(c.alias(f"c{m}") for m, c in enumerate(fits)))

    def weight(j: Column) -> Column:
        x = (j - F.col("half")) / F.col("half")
        return reduce(lambda acc, m: acc * x + F.col(f"c{m}"), range(degree - 1, -1, -1), F.col(f"c{degree}"))

    return rows.select("width", "at", F.transform(F.sequence(F.lit(0), F.col("width") - 1), weight).alias("_weights"))


def add_savgol(tiles: Tiles, value: str, name: str, window: int, polyorder: int) -> Tiles:
    """Least-squares polynomial smoothing; the end rows are read off the end fits; missing if a value of the window is.

    Needs a halo of ``window - 1`` rows. Where the effective window or degree is below one this is the moving average.
    The weights are a small table, made for the window lengths that occur and joined to the rows.
    """
    full, degree = _odd(window), max(0, int(polyorder))
    average = moving_average_column(tiles, value, window)
    if degree < 1:
        return tiles.with_columns({name: average})
    spark = tiles.rows.sparkSession
    width = odd_window(F.col("_n"), window)
    start = F.greatest(F.lit(1), F.least(F.col("_rn") - (width - 1) / 2, F.col("_n") - width + 1)).cast("long")
    near = F.collect_list(F.struct("_rn", F.col(value).alias("_v"))).over(tiles.window.rowsBetween(-(full - 1), full - 1))
    tiles = tiles.with_columns({"_average": average, "_near": near, "width": width, "at": (F.col("_rn") - start).cast("int")})
    # Outer halo rows lack their samples; their value is dropped later, so any slice will do.
    first = F.greatest(F.lit(1), F.col("_rn") - F.col("at") - F.col("_near")[0]["_rn"] + 1).cast("int")
    if tiles.smallest_key >= full:
        widths = spark.range(1).select(F.lit(full).alias("width"))
    else:
        widths = tiles.rows.select("width").distinct()
    rows = attach(tiles.rows, savgol_weights(widths, degree), ["width", "at"])
    samples = F.slice("_near", first, F.col("width"))["_v"]
    total = F.aggregate(F.zip_with(samples, "_weights", lambda v, w: v * w), F.lit(0.0), add)
    rows = rows.withColumn(name, F.when(F.col("width") > 1, total).otherwise(F.col("_average")))
    return replace(tiles, rows=rows.drop("_average", "_near", "width", "at", "_weights"))


def add_smooth(tiles: Tiles, value: str, name: str, method: str, window: int, polyorder: int) -> Tiles:
    if method == "moving_average" or _odd(window) == 1:
        return tiles.with_columns({name: moving_average_column(tiles, value, window)})
    if method != "savgol":
        raise ValueError(f"Unknown smoothing method {method!r}.")
    return add_savgol(tiles, value, name, window, polyorder)


def smoothing_halo(method: str, window: int) -> int:
    full = _odd(window)
    return (full - 1) // 2 if method == "moving_average" else full - 1


def smooth(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    name: str = "smoothed",
    method: str = "moving_average",
    window: int = SMOOTHING_WINDOW,
    polyorder: int = SMOOTHING_POLYORDER,
    tile_size: int = TILE_SIZE,
) -> DataFrame:
    tiles = tile_rows(df, keys, [time], smoothing_halo(method, window), tile_size)
    return add_smooth(tiles, value, name, method, window, polyorder).result(*df.columns, name)


# --- chains ----------------------------------------------------------------------


def front_kinematics(
    df: DataFrame,
    keys: Sequence[str] = ("case",),
    time: str = "time",
    position: str = "x_front",
    method: str = "moving_average",
    window: int = SMOOTHING_WINDOW,
    polyorder: int = SMOOTHING_POLYORDER,
    tile_size: int = TILE_SIZE,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Velocity, smoothed velocity, position rebuilt from it, and the rebuilding error.

    A missing or non-finite time or position, a repeated time or a key of one row fails the job. With ``ties``, columns
    that order rows of equal time, a repeated time gives the infinities and NaN of its slope; they are returned too.
    """
    # One halo serves the whole chain: two rows for the end slopes, the smoothing
    # frame around them, and one row back for the integral.
    halo = 3 + smoothing_halo(method, window)
    repeats = bool(ties)
    checked = strict_rows(df.select(*keys, time, *ties, position), keys, [time, position])
    tiles = rising_times(tile_rows(checked, keys, [time, *ties], halo, tile_size), time, position, 2, repeats)
    tiles = tiles.with_columns({"v_raw": gradient_column(tiles, time, position, 2, repeats)})
    tiles = add_smooth(tiles, "v_raw", "v_smooth", method, window, polyorder)
    tiles = add_cumulative_trapezoid(tiles, time, "v_smooth", "_travel")
    rows = with_first(tiles.rows, keys, time, {"_x0": position}, tiles.single, ties)
    rows = rows.withColumn("x_reconstructed", F.col("_x0") + F.col("_travel"))
    rows = rows.withColumn("x_reconstruction_error", F.col("x_reconstructed") - F.col(position))
    return rows.select(
        *keys, time, *ties, position, "v_raw", "v_smooth", "x_reconstructed", "x_reconstruction_error"
    )


def kinematics_summary(
    kinematics: DataFrame, keys: Sequence[str] = ("case",), time: str = "time", ties: Sequence[str] = ()
) -> DataFrame:
    error, at = F.col("x_reconstruction_error"), place(time, ties)
    _, raw_fit = window_slope_columns(time, "x_front")
    _, rebuilt_fit = window_slope_columns(time, "x_reconstructed")
    return kinematics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min(time).alias("time_start"),
        F.max(time).alias("time_end"),
        F.min_by("x_front", at).alias("x_start"),
        F.max_by("x_front", at).alias("x_end"),
        F.min("v_raw").alias("v_raw_min"),
        F.max("v_raw").alias("v_raw_max"),
        F.min("v_smooth").alias("v_smooth_min"),
        F.max("v_smooth").alias("v_smooth_max"),
        mean_abs(error).alias("mean_abs_reconstruction_error"),
        max_abs(error).alias("max_abs_reconstruction_error"),
        rms(error).alias("rms_reconstruction_error"),
        F.max_by(error, at).alias("final_reconstruction_error"),
        raw_fit.alias("slumping_velocity_raw_position_fit"),
        rebuilt_fit.alias("slumping_velocity_reconstructed_position_fit"),
    )


def energy_diagnostics(
    df: DataFrame,
    keys: Sequence[str] = ("case",),
    time: str = "time",
    target: float = ENERGY_TARGET,
    tile_size: int = TILE_SIZE,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Budget gap, dissipated energy, closure, its residuals and the rate-of-change balance.

    A missing or non-finite value, a repeated time or a key of one row fails the job, because an integral must not skip
    an interval. With ``ties``, columns that order rows of equal time, a repeated time adds no area and gives the infinities
    and NaN of its slope; they are returned too.
    """
    repeats = bool(ties)
    source = [*keys, time, *ties, "E_k", "E_p", "E_total", "epsilon"]
    checked = strict_rows(df.select(*source), keys, [time, "E_k", "E_p", "E_total", "epsilon"])
    tiles = rising_times(tile_rows(checked, keys, [time, *ties], 1, tile_size), time, "E_total", 2, repeats)
    tiles = tiles.with_columns({"dEtotal_dt": gradient_column(tiles, time, "E_total", 1, repeats)})
    tiles = add_cumulative_trapezoid(tiles, time, "epsilon", "cumulative_epsilon")
    # The integral starts at zero, so the first closure value is the first E_total.
    rows = with_first(tiles.rows, keys, time, {"_closure0": "E_total"}, tiles.single, ties)
    closure = F.col("E_total") + F.col("cumulative_epsilon")
    return rows.select(
        *source,
        (F.col("E_total") - (F.col("E_k") + F.col("E_p"))).alias("E_total_minus_Ek_Ep"),
        "cumulative_epsilon",
        closure.alias("energy_closure"),
        (closure - target).alias("closure_residual_from_target"),
        (closure - F.col("_closure0")).alias("closure_drift_from_initial"),
        "dEtotal_dt",
        (F.col("dEtotal_dt") + F.col("epsilon")).alias("differential_closure_residual"),
        (F.col("E_total") - F.col("cumulative_epsilon")).alias("energy_closure_minus"),
    )


def energy_summary(
    diagnostics: DataFrame,
    keys: Sequence[str] = ("case",),
    time: str = "time",
    target: float = ENERGY_TARGET,
    ties: Sequence[str] = (),
) -> DataFrame:
    at = place(time, ties)
    residual = F.col("closure_residual_from_target")
    drift = F.col("closure_drift_from_initial")
    balance = F.col("differential_closure_residual")
    return diagnostics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min(time).alias("time_start"),
        F.max(time).alias("time_end"),
        F.min_by("E_total", at).alias("E_total_initial"),
        F.max_by("E_total", at).alias("E_total_final"),
        F.min("epsilon").alias("epsilon_min"),
        F.max("epsilon").alias("epsilon_max"),
        F.max_by("cumulative_epsilon", at).alias("cumulative_epsilon_final"),
        F.min_by("energy_closure", at).alias("energy_closure_initial"),
        F.max_by("energy_closure", at).alias("energy_closure_final"),
        F.lit(float(target)).alias("target"),
        max_abs(residual).alias("max_abs_closure_residual_from_target"),
        mean_abs(residual).alias("mean_abs_closure_residual_from_target"),
        rms(residual).alias("rms_closure_residual_from_target"),
        max_abs(drift).alias("max_abs_closure_drift_from_initial"),
        F.max_by(drift, at).alias("final_closure_drift_from_initial"),
        max_abs(balance).alias("max_abs_differential_closure_residual"),
        rms(balance).alias("rms_differential_closure_residual"),
        max_abs(F.col("E_total_minus_Ek_Ep")).alias("max_abs_E_total_minus_Ek_Ep"),
    )


# --- validation --------------------------------------------------------------------


def series_violations(
    df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], min_rows: int = 2
) -> DataFrame:
    """One row per broken rule: too few rows, non-finite column, repeated time."""
    columns = [time, *values]
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *(F.count_if(~finite(c)).alias(f"_bad_{c}") for c in columns)
    )
    found = F.array(
        F.when(
            F.col("_rows") < min_rows,
            _violation("too_few_rows", F.lit(None), F.lit(None), F.col("_rows")),
        ),
        *(
            F.when(F.col(f"_bad_{c}") > 0, _violation("non_finite", F.lit(c), F.lit(None), F.col(f"_bad_{c}")))
            for c in columns
        ),
    )
    per_key = counts.withColumn("_v", F.explode(F.filter(found, lambda v: v.isNotNull())))
    repeats = df.groupBy(*keys, F.col(time).alias("_t")).count().filter(F.col("count") > 1)
    repeats = repeats.withColumn("_v", _violation("duplicate_time", F.lit(time), F.col("_t"), F.col("count")))
    both = per_key.select(*keys, "_v").unionByName(repeats.select(*keys, "_v"))
    return both.select(*keys, "_v.*")


def _violation(rule: str, column: Column, at_time: Column, rows: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        column.cast("string").alias("column_name"),
        at_time.cast("double").alias("at_time"),
        rows.cast("long").alias("row_count"),
    )


def require_valid(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Fail with the first few violations, otherwise return ``df`` unchanged."""
    broken = series_violations(df, keys, time, values).limit(10).collect()
    if broken:
        raise ValueError("Invalid series: " + "; ".join(str(row.asDict()) for row in broken))
    return df


def rising_times(tiles: Tiles, time: str, value: str, min_rows: int = 1, repeats: bool = False) -> Tiles:
    """Fail inside the job, in ``value``, when a time repeats or a key has fewer than ``min_rows`` rows. Needs a halo of one row.

    With ``repeats`` only the rows are counted.
    """
    checked = F.col(value)
    if not repeats:
        later = F.coalesce(F.col(time) > F.lag(time).over(tiles.window), F.lit(True))
        checked = strict(later, f"Repeated value in column {time}.", checked)
    if tiles.smallest_key < min_rows:
        checked = strict(F.col("_n") >= min_rows, f"A series has fewer than {min_rows} rows.", checked)
    return tiles.with_columns({value: checked})


def strict_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fail inside the job when a row holds a non-finite value, without an extra pass."""
    return df.withColumns({c: strict(finite(c), f"Non-finite value in column {c}.", F.col(c)) for c in columns})
