"""Queries on time series, energy budgets, kinematics and curve overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.catalog import fixtures as fx
from fieldspark.catalog.registry import register, register_like
from fieldspark.functions import finite
from fieldspark.operators import curve as cv
from fieldspark.operators import series as sr
from fieldspark.operators import stats

SERIES = fx.SERIES_SQL
FRONT = fx.FRONT_SQL


def _gradient_sql(source: str, value: str, order_two: bool) -> str:
    """Neighbours by lag and lead; ends one-sided or by the parabola through three rows."""
    w = 'OVER (PARTITION BY "case" ORDER BY time)'
    slope_back, slope_ahead = "(f - fp) / (t - tp)", "(fn - f) / (tn - t)"
    first, last = slope_ahead, slope_back
    if order_two:
        first = f"{slope_ahead} - (tn - t) * ((fn2 - fn) / (tn2 - tn) - {slope_ahead}) / (tn2 - t)"
        last = f"{slope_back} + (t - tp) * ({slope_back} - (fp - fp2) / (tp - tp2)) / (t - tp2)"
    return f"""SELECT *, CASE WHEN fp IS NULL THEN {first} WHEN fn IS NULL THEN {last}
        ELSE ({slope_back} * (tn - t) + {slope_ahead} * (t - tp)) / ((t - tp) + (tn - t)) END AS g
      FROM (SELECT *, time AS t, {value} AS f, lag(time) {w} AS tp, lag({value}) {w} AS fp,
        lead(time) {w} AS tn, lead({value}) {w} AS fn, lag(time, 2) {w} AS tp2, lag({value}, 2) {w} AS fp2,
        lead(time, 2) {w} AS tn2, lead({value}, 2) {w} AS fn2,
        row_number() {w} AS rn, count(*) OVER (PARTITION BY "case") AS n FROM {source})"""


def _cumulative_sql(source: str, value: str) -> str:
    w = 'OVER (PARTITION BY "case" ORDER BY time'
    return f"""SELECT *, sum(step) {w} ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, coalesce(0.5 *
      ({value} + lag({value}) {w})) * (time - lag(time) {w})), 0) AS step FROM {source})"""


@register(
    "cumtrapz",
    "case",
    "time cumulative",
    f"""WITH {SERIES}, c AS ({_cumulative_sql("series", "epsilon")}) SELECT "case", time, cum AS cumulative FROM c""",
)
def cumtrapz(spark, sf_dir):
    return sr.cumulative_trapezoid(fx.series(spark, sf_dir), ["case"], "time", "epsilon", ties=fx.TIES)


# Values with a gap after every 40th event, and times of which some repeat.
GAPPY_SQL = """gappy AS (SELECT "case", CASE WHEN event_id % 25 = 0 THEN floor(time) ELSE time END AS time,
  CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'nan'::DOUBLE ELSE E_k END AS value FROM series)"""
GAPS_SQL = f"""WITH {SERIES}, {GAPPY_SQL},
  k AS (SELECT *, value IS NOT NULL AND NOT isnan(value) AS known, row_number() OVER (PARTITION BY "case" ORDER BY time, value NULLS FIRST) AS rn FROM gappy),
  l AS (SELECT *, lag(known) OVER o AS pk, lag(time) OVER o AS pt, lag(value) OVER o AS pv FROM k WINDOW o AS (PARTITION BY "case" ORDER BY rn)),
  j AS (SELECT *, known AND coalesce(pk, false) AND coalesce(time > pt, false) AS joined FROM l),
  s AS (SELECT *, sum(CASE WHEN known AND NOT joined THEN 1 ELSE 0 END) OVER (PARTITION BY "case" ORDER BY rn ROWS UNBOUNDED PRECEDING) AS seg FROM j),
  c AS (SELECT *, sum(CASE WHEN joined THEN 0.5 * (value + pv) * (time - pt) ELSE 0 END) OVER
    (PARTITION BY "case", seg ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cum FROM s)
  SELECT "case", CASE WHEN known THEN CAST(seg AS BIGINT) END AS segment, known, time, CASE WHEN known THEN cum END AS cumulative FROM c"""


def _gappy(spark, sf_dir):
    rows = fx.series(spark, sf_dir)
    time = F.when(F.col("event_id") % 25 == 0, F.floor("time").cast("double")).otherwise(F.col("time"))
    value = F.when(F.col("event_id") % 40 == 0, F.lit(None)).when(F.col("event_id") % 41 == 0, float("nan")).otherwise(F.col("E_k"))
    return rows.select("case", time.alias("time"), value.cast("double").alias("value"))


def _series_gaps(spark, sf_dir, **options):
    out = sr.cumulative_trapezoid(_gappy(spark, sf_dir), ["case"], "time", "value", gaps="restart", **options)
    return out.withColumn("known", finite("value"))


@register("series_gaps", "case segment known", "time cumulative", GAPS_SQL)
def series_gaps(spark, sf_dir):
    """An integral over missing values and repeated times: it starts again after each of them."""
    return _series_gaps(spark, sf_dir)


@register_like("series_gaps_tiled", "series_gaps")
def series_gaps_tiled(spark, sf_dir):
    return _series_gaps(spark, sf_dir, tile_size=256)


@register(
    "gradient_e1",
    "case",
    "time gradient",
    f"""WITH {SERIES}, g AS ({_gradient_sql("series", "E_total", False)}) SELECT "case", time, g AS gradient FROM g""",
)
def gradient_e1(spark, sf_dir):
    return sr.gradient(fx.series(spark, sf_dir), ["case"], "time", "E_total", ties=fx.TIES)


@register(
    "gradient_e2",
    "case",
    "time gradient",
    f"""WITH {FRONT}, g AS ({_gradient_sql("front", "x_front", True)}) SELECT "case", time, g AS gradient FROM g""",
)
def gradient_e2(spark, sf_dir):
    return sr.gradient(fx.front(spark, sf_dir), ["case"], "time", "x_front", edge_order=2, ties=fx.TIES)


@register(
    "odd_window",
    "user_id n_points window",
    "",
    """SELECT user_id, n AS n_points, CAST(greatest(1, least(101, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END)) AS INTEGER)
      AS "window" FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""",
)
def odd_window(spark, sf_dir):
    return sr.effective_windows(fx.table(spark, sf_dir, "events"), ["user_id"], 100)


@register(
    "moving_average",
    "case",
    "time smoothed",
    f"""WITH {SERIES} SELECT "case", time, avg(E_k) OVER (PARTITION BY "case" ORDER BY time
      ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS smoothed FROM series""",
)
def moving_average(spark, sf_dir):
    return sr.smooth(fx.series(spark, sf_dir), ["case"], "time", "E_k")


@register(
    "moving_average_short",
    "user_id event_id",
    "smoothed",
    """WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
        count(*) OVER (PARTITION BY user_id) AS n FROM events),
      h AS (SELECT *, (greatest(1, least(301, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END)) - 1) // 2 AS half FROM s)
      SELECT a.user_id, a.event_id, avg(b.value) AS smoothed FROM h a JOIN h b ON a.user_id = b.user_id
        AND abs(a.rn - b.rn) <= a.half GROUP BY a.user_id, a.event_id""",
)
def moving_average_short(spark, sf_dir):
    """Series shorter than the window: each uses its own largest odd window."""
    events = fx.table(spark, sf_dir, "events")
    return sr.smooth(events, ["user_id"], "event_id", "value", window=301)


def _kernel_sql(length: int | str) -> str:
    """Weight of the sample at xj in the cubic fit read at xi: closed forms of the polynomials over w equally spaced samples.

    For windows too short for a cubic the norms of the surplus polynomials are zero and their terms drop out.
    """
    w = f"CAST({length} AS DOUBLE)"
    two, three = f"{w} * ({w} * {w} - 1)", f"{w} * ({w} * {w} - 1) * ({w} * {w} - 4)"

    def polynomials(x: str) -> list[str]:
        return ["1.0", x, f"({x} * {x} - ({w} * {w} - 1) / 12)", f"({x} * {x} * {x} - {x} * (3 * {w} * {w} - 7) / 20)"]

    norms = [w, f"{two} / 12", f"{three} / 180", f"{three} * ({w} * {w} - 9) / 2800"]
    products = zip(polynomials("xi"), polynomials("xj"), norms, strict=True)
    return " + ".join(f"coalesce({a} * {b} / nullif({n}, 0), 0)" for a, b, n in products)


SAVGOL_SQL = f"""WITH {SERIES}, s AS (SELECT "case", time, E_k, row_number() OVER (PARTITION BY "case" ORDER BY time) AS rn,
    count(*) OVER (PARTITION BY "case") AS n FROM series),
  p AS (SELECT *, greatest(1, least(rn - 5, n - 10)) AS st FROM s),
  q AS (SELECT p."case", p.time, p.rn - p.st - 5 AS xi, s.rn - p.st - 5 AS xj, s.E_k AS v FROM p CROSS JOIN range(11) AS o(j)
    JOIN s ON s."case" = p."case" AND s.rn = p.st + o.j)
  SELECT "case", time, sum(v * ({_kernel_sql(11)})) AS smoothed FROM q GROUP BY 1, 2"""


@register("savgol", "case", "time smoothed", SAVGOL_SQL)
def savgol(spark, sf_dir):
    return sr.smooth(fx.series(spark, sf_dir), ["case"], "time", "E_k", method="savgol")


@register(
    "savgol_short",
    "user_id event_id",
    "smoothed",
    f"""WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
        count(*) OVER (PARTITION BY user_id) AS n FROM events),
      h AS (SELECT *, greatest(1, least(101, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END)) AS w FROM s),
      p AS (SELECT *, greatest(1, least(rn - (w - 1) // 2, n - w + 1)) AS st FROM h),
      q AS (SELECT p.user_id, p.event_id, p.w, p.rn - p.st - (p.w - 1) // 2 AS xi, s.rn - p.st - (p.w - 1) // 2 AS xj, s.value AS v
        FROM p JOIN s ON s.user_id = p.user_id AND s.rn BETWEEN p.st AND p.st + p.w - 1)
      SELECT user_id, event_id, sum(v * ({_kernel_sql("w")})) AS smoothed FROM q GROUP BY 1, 2""",
)
def savgol_short(spark, sf_dir):
    """Series shorter than the window: each uses its own largest odd window."""
    events = fx.table(spark, sf_dir, "events")
    return sr.smooth(events, ["user_id"], "event_id", "value", method="savgol", window=101)


KINEMATICS_SQL = f"""{FRONT}, g AS ({_gradient_sql("front", "x_front", True)}),
  sm AS (SELECT "case", time, x_front, g AS v_raw, avg(g) OVER (PARTITION BY "case" ORDER BY time
    ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v_smooth FROM g),
  cm AS ({_cumulative_sql("sm", "v_smooth")}),
  kin AS (SELECT "case", time, x_front, v_raw, v_smooth, x0 + cum AS x_reconstructed,
    x0 + cum - x_front AS x_reconstruction_error FROM cm JOIN (SELECT "case", arg_min(x_front, time) AS x0
    FROM front GROUP BY 1) USING ("case"))"""
KINEMATICS_COLUMNS = "time x_front v_raw v_smooth x_reconstructed x_reconstruction_error"


@register("front_kinematics", "case", KINEMATICS_COLUMNS, f"WITH {KINEMATICS_SQL} SELECT * FROM kin")
def front_kinematics(spark, sf_dir):
    return sr.front_kinematics(fx.front(spark, sf_dir), ties=fx.TIES)


@register(
    "kinematics_summary",
    "case n_points",
    "time_start time_end x_start x_end v_raw_min v_raw_max v_smooth_min v_smooth_max mean_abs_reconstruction_error "
    "max_abs_reconstruction_error rms_reconstruction_error final_reconstruction_error "
    "slumping_velocity_raw_position_fit slumping_velocity_reconstructed_position_fit",
    f"""WITH {KINEMATICS_SQL} SELECT "case", count(*) AS n_points, min(time) AS time_start, max(time) AS time_end,
      arg_min(x_front, time) AS x_start, arg_max(x_front, time) AS x_end, min(v_raw) AS v_raw_min,
      max(v_raw) AS v_raw_max, min(v_smooth) AS v_smooth_min, max(v_smooth) AS v_smooth_max,
      avg(abs(x_reconstruction_error)) AS mean_abs_reconstruction_error,
      max(abs(x_reconstruction_error)) AS max_abs_reconstruction_error,
      sqrt(avg(x_reconstruction_error * x_reconstruction_error)) AS rms_reconstruction_error,
      arg_max(x_reconstruction_error, time) AS final_reconstruction_error,
      regr_slope(x_front, time) FILTER (WHERE time BETWEEN 3 AND 12) AS slumping_velocity_raw_position_fit,
      regr_slope(x_reconstructed, time) FILTER (WHERE time BETWEEN 3 AND 12)
        AS slumping_velocity_reconstructed_position_fit FROM kin GROUP BY 1""",
)
def kinematics_summary(spark, sf_dir):
    return sr.kinematics_summary(sr.front_kinematics(fx.front(spark, sf_dir), ties=fx.TIES), ties=fx.TIES)


ENERGY_SQL = f"""{SERIES}, g AS ({_gradient_sql("series", "E_total", False)}), c AS ({_cumulative_sql("g", "epsilon")}),
  e AS (SELECT "case", time, E_k, E_p, E_total, epsilon, E_total - (E_k + E_p) AS "E_total_minus_Ek_Ep",
    cum AS cumulative_epsilon, E_total + cum AS energy_closure, E_total + cum - 12.0 AS closure_residual_from_target,
    E_total + cum - first_value(E_total) OVER (PARTITION BY "case" ORDER BY time) AS closure_drift_from_initial,
    g AS "dEtotal_dt", g + epsilon AS differential_closure_residual, E_total - cum AS energy_closure_minus FROM c)"""
ENERGY_COLUMNS = (
    "time E_k E_p E_total epsilon E_total_minus_Ek_Ep cumulative_epsilon energy_closure "
    "closure_residual_from_target closure_drift_from_initial dEtotal_dt differential_closure_residual "
    "energy_closure_minus"
)


@register("energy_diagnostics", "case", ENERGY_COLUMNS, f"WITH {ENERGY_SQL} SELECT * FROM e")
def energy_diagnostics(spark, sf_dir):
    return sr.energy_diagnostics(fx.series(spark, sf_dir), ties=fx.TIES)


@register(
    "energy_summary",
    "case n_points",
    "time_start time_end E_total_initial E_total_final epsilon_min epsilon_max cumulative_epsilon_final "
    "energy_closure_initial energy_closure_final target max_abs_closure_residual_from_target "
    "mean_abs_closure_residual_from_target rms_closure_residual_from_target max_abs_closure_drift_from_initial "
    "final_closure_drift_from_initial max_abs_differential_closure_residual rms_differential_closure_residual "
    "max_abs_E_total_minus_Ek_Ep",
    f"""WITH {ENERGY_SQL} SELECT "case", count(*) AS n_points, min(time) AS time_start, max(time) AS time_end,
      arg_min(E_total, time) AS "E_total_initial", arg_max(E_total, time) AS "E_total_final",
      min(epsilon) AS epsilon_min, max(epsilon) AS epsilon_max,
      arg_max(cumulative_epsilon, time) AS cumulative_epsilon_final,
      arg_min(energy_closure, time) AS energy_closure_initial, arg_max(energy_closure, time) AS energy_closure_final,
      12.0::DOUBLE AS target, max(abs(closure_residual_from_target)) AS max_abs_closure_residual_from_target,
      avg(abs(closure_residual_from_target)) AS mean_abs_closure_residual_from_target,
      sqrt(avg(closure_residual_from_target ** 2)) AS rms_closure_residual_from_target,
      max(abs(closure_drift_from_initial)) AS max_abs_closure_drift_from_initial,
      arg_max(closure_drift_from_initial, time) AS final_closure_drift_from_initial,
      max(abs(differential_closure_residual)) AS max_abs_differential_closure_residual,
      sqrt(avg(differential_closure_residual ** 2)) AS rms_differential_closure_residual,
      max(abs("E_total_minus_Ek_Ep")) AS "max_abs_E_total_minus_Ek_Ep" FROM e GROUP BY 1""",
)
def energy_summary(spark, sf_dir):
    return sr.energy_summary(sr.energy_diagnostics(fx.series(spark, sf_dir), ties=fx.TIES), ties=fx.TIES)


RELATIVE_SQL = f"""{FRONT}, rel AS (SELECT "case", time, x_front,
  x_front - first_value(x_front) OVER (PARTITION BY "case" ORDER BY time) AS x_front_minus_x0,
  first_value(x_front) OVER (PARTITION BY "case" ORDER BY time) AS x0 FROM front)"""


def _relative(spark, sf_dir):
    return sr.relative_to_initial(fx.front(spark, sf_dir), ["case"], "time", "x_front", "x_front_minus_x0", "x0", ties=fx.TIES)


@register("relative_to_initial", "case", "time x_front x_front_minus_x0 x0", f"WITH {RELATIVE_SQL} SELECT * FROM rel")
def relative_to_initial(spark, sf_dir):
    return _relative(spark, sf_dir)


@register(
    "loglog_points",
    "case",
    "time x_front_minus_x0",
    f"""WITH {RELATIVE_SQL} SELECT * FROM rel WHERE time > 0 AND x_front_minus_x0 > 0 AND time BETWEEN 3 AND 12""",
)
def loglog_points(spark, sf_dir):
    return cv.overlay_points(_relative(spark, sf_dir), "time", "x_front_minus_x0", loglog=True, window=(3.0, 12.0))


@register(
    "series_violations",
    "user_id rule column_name row_count",
    "at_time",
    """WITH s AS (SELECT user_id, CAST(floor(value) AS DOUBLE) AS t, CASE WHEN event_id % 97 <> 0 THEN value END AS v
        FROM events)
      SELECT user_id, 'too_few_rows' AS rule, CAST(NULL AS VARCHAR) AS column_name, count(*) AS row_count,
        CAST(NULL AS DOUBLE) AS at_time FROM s GROUP BY 1 HAVING count(*) < 2
      UNION ALL SELECT user_id, 'non_finite', 'v', count(*), NULL FROM s WHERE v IS NULL GROUP BY 1
      UNION ALL SELECT user_id, 'duplicate_time', 't', count(*), t FROM s GROUP BY user_id, t HAVING count(*) > 1""",
)
def series_violations(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select(
        "user_id",
        F.floor("value").cast("double").alias("t"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("v"),
    )
    return sr.series_violations(rows, ["user_id"], "t", ["v"])


# --- statistics ------------------------------------------------------------------------


@register(
    "finite_stats",
    "case",
    "finite_mean mean_abs max_abs rms mean_abs_all max_abs_all rms_all",
    f"""WITH {SERIES}, s AS (SELECT "case", CASE WHEN "case" <> 'error' OR E_k > 1 THEN E_k - 20 END AS v FROM series)
      SELECT "case", avg(v) AS finite_mean, avg(abs(v)) AS mean_abs, max(abs(v)) AS max_abs, sqrt(avg(v * v)) AS rms,
      CASE WHEN count(v) = count(*) THEN avg(abs(v)) END AS mean_abs_all,
      CASE WHEN count(v) = count(*) THEN max(abs(v)) END AS max_abs_all,
      CASE WHEN count(v) = count(*) THEN sqrt(avg(v * v)) END AS rms_all FROM s GROUP BY 1""",
)
def finite_stats(spark, sf_dir):
    keep = (F.col("case") != "error") | (F.col("E_k") > 1)
    value = F.when(keep, F.col("E_k") - 20).otherwise(F.lit(float("inf")))
    return stats.finite_stats(fx.series(spark, sf_dir).withColumn("v", value), ["case"], "v")


@register(
    "window_slope",
    "case n_window_points",
    "slope_all slope_window",
    f"""WITH {FRONT} SELECT "case", regr_slope(x_front, time) AS slope_all,
      count(*) FILTER (WHERE time BETWEEN 3 AND 12) AS n_window_points,
      regr_slope(x_front, time) FILTER (WHERE time BETWEEN 3 AND 12) AS slope_window FROM front GROUP BY 1""",
)
def window_slope(spark, sf_dir):
    return stats.window_slopes(fx.front(spark, sf_dir), ["case"], "time", "x_front")


# --- overlays --------------------------------------------------------------------------


def _overlay_sql(prefix: str, source: str, value: str, curve_value: str, name: str, error: str) -> str:
    """Bracketing rows by two as-of joins per case."""
    return f"""{prefix}, knots AS (SELECT "case", time, {value} AS x FROM {source} WHERE "case" <> 'signup'),
  pts AS (SELECT k.other AS "case", s.time, s.{curve_value} AS paper_x FROM (SELECT * FROM {source}
    WHERE "case" = 'signup') s CROSS JOIN (SELECT DISTINCT "case" AS other FROM knots) k),
  lo AS (SELECT pts.*, l.time AS t0, l.x AS x0 FROM pts ASOF JOIN knots l ON pts."case" = l."case"
    AND pts.time >= l.time),
  br AS (SELECT lo.*, r.time AS t1, r.x AS x1 FROM lo ASOF JOIN knots r ON lo."case" = r."case"
    AND lo.time <= r.time),
  hit AS (SELECT "case", time, paper_x, CASE WHEN t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * ((time - t0) / (t1 - t0)) END
    AS v FROM br),
  cmp AS (SELECT "case", time, paper_x, v AS {name}, v - paper_x AS {error},
    (v - paper_x) / nullif(paper_x, 0) AS relative_error,
    CASE WHEN v > 0 AND paper_x > 0 THEN ln(v) - ln(paper_x) END AS log_error FROM hit)"""


RAW_OVERLAY_SQL = _overlay_sql(RELATIVE_SQL, "rel", "x_front_minus_x0", "x_front", "simulation_x_interp", "x_error")


def _others(df):
    return df.filter(F.col("case") != fx.CURVE_CASE)


def _raw_overlay(spark, sf_dir):
    relative = _relative(spark, sf_dir)
    return cv.interpolate_at_curve(_others(relative), fx.curve(relative), value="x_front_minus_x0")


@register(
    "interp_at_curve",
    "case",
    "time paper_x simulation_x_interp x_error relative_error log_error",
    f"WITH {RAW_OVERLAY_SQL} SELECT * FROM cmp",
)
def interp_at_curve(spark, sf_dir):
    return _raw_overlay(spark, sf_dir)


def _slope_sql(name: str) -> str:
    w = "time BETWEEN 3 AND 12"
    own, ref = f"regr_slope({name}, time) FILTER (WHERE {w})", f"regr_slope(paper_x, time) FILTER (WHERE {w})"
    label = name.split("_")[0]
    return f"""count(*) FILTER (WHERE {w}) AS n_slumping_points, {ref} AS paper_slumping_velocity,
      {own} AS {label}_slumping_velocity, {own} - {ref} AS slumping_velocity_difference,
      ({own} - {ref}) / nullif({ref}, 0) AS slumping_velocity_relative_difference"""


SLOPE_COLUMNS = "paper_slumping_velocity {0}_slumping_velocity slumping_velocity_difference " \
    "slumping_velocity_relative_difference"
WINDOW_ERRORS_SQL = """avg(abs(relative_error)) FILTER (WHERE time BETWEEN 3 AND 12) AS slumping_mean_abs_relative_error,
  max(abs(relative_error)) FILTER (WHERE time BETWEEN 3 AND 12) AS slumping_max_abs_relative_error"""


@register(
    "slope_comparison",
    "case n_slumping_points",
    SLOPE_COLUMNS.format("simulation") + " slumping_mean_abs_relative_error slumping_max_abs_relative_error",
    f"""WITH {RAW_OVERLAY_SQL} SELECT "case", {_slope_sql("simulation_x_interp")}, {WINDOW_ERRORS_SQL}
      FROM cmp GROUP BY 1""",
)
def slope_comparison(spark, sf_dir):
    return cv.slope_comparison(_raw_overlay(spark, sf_dir), with_error_stats=True)


@register(
    "overlay_summary_raw",
    "case n_comparison_points n_slumping_points",
    "time_min_compared time_max_compared mean_signed_error mean_abs_error rms_error mean_signed_relative_error "
    "mean_abs_relative_error max_abs_relative_error rms_log_error "
    + SLOPE_COLUMNS.format("simulation")
    + " slumping_mean_abs_relative_error slumping_max_abs_relative_error",
    f"""WITH {RAW_OVERLAY_SQL} SELECT "case", count(*) AS n_comparison_points, min(time) AS time_min_compared,
      max(time) AS time_max_compared, avg(x_error) AS mean_signed_error, avg(abs(x_error)) AS mean_abs_error,
      sqrt(avg(x_error * x_error)) AS rms_error, avg(relative_error) AS mean_signed_relative_error,
      avg(abs(relative_error)) AS mean_abs_relative_error, max(abs(relative_error)) AS max_abs_relative_error,
      sqrt(avg(log_error * log_error)) AS rms_log_error, {_slope_sql("simulation_x_interp")}, {WINDOW_ERRORS_SQL}
      FROM cmp GROUP BY 1""",
)
def overlay_summary_raw(spark, sf_dir):
    return cv.overlay_summary_raw(_raw_overlay(spark, sf_dir))


PROCESSED_SQL = _overlay_sql(
    f"""{KINEMATICS_SQL}, proc AS (SELECT "case", time, x_front, x_reconstructed - first_value(x_reconstructed)
    OVER (PARTITION BY "case" ORDER BY time) AS x_processed,
    first_value(x_reconstructed) OVER (PARTITION BY "case" ORDER BY time) AS shift FROM kin)""",
    "proc",
    "x_processed",
    "x_front",
    "processed_x_interp",
    "error",
)


@register(
    "overlay_summary_processed",
    "case n_comparison_points n_slumping_points",
    "time_min_compared time_max_compared processed_x0_shift mean_abs_error rms_error mean_abs_relative_error "
    "max_abs_relative_error rms_log_error " + SLOPE_COLUMNS.format("processed"),
    f"""WITH {PROCESSED_SQL} SELECT cmp."case", count(*) AS n_comparison_points, min(time) AS time_min_compared,
      max(time) AS time_max_compared, max(shift) AS processed_x0_shift,
      avg(abs(error)) AS mean_abs_error, sqrt(avg(error * error)) AS rms_error,
      CASE WHEN count(relative_error) = count(*) THEN avg(abs(relative_error)) END AS mean_abs_relative_error,
      CASE WHEN count(relative_error) = count(*) THEN max(abs(relative_error)) END AS max_abs_relative_error,
      sqrt(avg(log_error * log_error)) AS rms_log_error, {_slope_sql("processed_x_interp")}
      FROM cmp JOIN (SELECT DISTINCT "case", shift FROM proc) USING ("case") GROUP BY 1""",
)
def overlay_summary_processed(spark, sf_dir):
    fronts = fx.front(spark, sf_dir)
    rebuilt = sr.front_kinematics(fronts, ties=fx.TIES)
    processed = sr.relative_to_initial(
        rebuilt, ["case"], "time", "x_reconstructed", "x_processed", "processed_x0_shift", ties=fx.TIES
    )
    shifts = processed.select("case", "processed_x0_shift").distinct()
    comparison = cv.interpolate_at_curve(
        _others(processed),
        fx.curve(fronts),
        value="x_processed",
        interpolated="processed_x_interp",
        error="error",
    )
    return cv.overlay_summary_processed(comparison, shifts)


# --- the same queries over tiles, as long series need them ---------------------------------


TILE = 256


@register_like("cumtrapz_tiled", "cumtrapz")
def cumtrapz_tiled(spark, sf_dir):
    return sr.cumulative_trapezoid(fx.series(spark, sf_dir), ["case"], "time", "epsilon", tile_size=TILE, ties=fx.TIES)


@register_like("gradient_e2_tiled", "gradient_e2")
def gradient_e2_tiled(spark, sf_dir):
    return sr.gradient(fx.front(spark, sf_dir), ["case"], "time", "x_front", edge_order=2, tile_size=TILE, ties=fx.TIES)


@register_like("moving_average_tiled", "moving_average")
def moving_average_tiled(spark, sf_dir):
    return sr.smooth(fx.series(spark, sf_dir), ["case"], "time", "E_k", tile_size=TILE)


@register_like("savgol_tiled", "savgol")
def savgol_tiled(spark, sf_dir):
    return sr.smooth(fx.series(spark, sf_dir), ["case"], "time", "E_k", method="savgol", tile_size=TILE)


@register_like("front_kinematics_tiled", "front_kinematics")
def front_kinematics_tiled(spark, sf_dir):
    return sr.front_kinematics(fx.front(spark, sf_dir), tile_size=TILE, ties=fx.TIES)


@register_like("interp_at_curve_tiled", "interp_at_curve")
def interp_at_curve_tiled(spark, sf_dir):
    relative = _relative(spark, sf_dir)
    return cv.interpolate_at_curve(_others(relative), fx.curve(relative), value="x_front_minus_x0", tile_size=TILE)
