"""Queries on snapshots, slices, grids and field errors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldspark.catalog import fixtures as fx
from fieldspark.catalog.registry import register
from fieldspark.functions import half_even, lenient_double, order_label, relative_difference, speed
from fieldspark.operators import compare, grid, slicing, views
from fieldspark.plans import rollup, selection
from fieldspark.plans.comparison import select_snapshots, slice_points, snapshot_keys
from fieldspark.plans.scale import checkpoint_folder, durable
from fieldspark.sources import writers

KEYS = fx.KEYS
PTS = fx.POINTS_SQL
NODES = f"{fx.POINTS_SQL}, {fx.NODES_SQL}, {fx.selection_sql()}"
NODES_BY_LINE = f"{fx.POINTS_BY_LINE_SQL}, {fx.MERGED_SQL.format(source='pts')}, {fx.selection_sql('N11')}"


# --- snapshots ---------------------------------------------------------------------


@register(
    "flatten_elements",
    "case elem_id",
    "x y z C u v w p",
    """SELECT CAST(label AS VARCHAR) AS "case", vec_id AS elem_id,
      CAST(embedding[i] AS DOUBLE) AS x, CAST(embedding[8 + i] AS DOUBLE) AS y, CAST(embedding[16 + i] AS DOUBLE) AS z,
      CAST(embedding[56 + i] AS DOUBLE) AS C, CAST(embedding[24 + i] AS DOUBLE) AS u,
      CAST(embedding[32 + i] AS DOUBLE) AS v, CAST(embedding[40 + i] AS DOUBLE) AS w,
      CAST(embedding[48 + i] AS DOUBLE) AS p
      FROM embeddings CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i) AS n""",
)
def flatten_elements(spark, sf_dir):
    return slicing.flatten_elements(fx.elements(spark, sf_dir), ["case", "elem_id"])


@register(
    "field_fallback",
    "case elem_id source",
    "first_value",
    """SELECT CAST(label AS VARCHAR) AS "case", vec_id AS elem_id,
      CASE WHEN label % 3 = 0 THEN 'scal[0]' ELSE 'temp[0]' END AS source,
      CAST(embedding[57] AS DOUBLE) AS first_value FROM embeddings""",
)
def field_fallback(spark, sf_dir):
    return fx.elements(spark, sf_dir).select(
        "case",
        "elem_id",
        slicing.concentration_source().alias("source"),
        slicing.concentration()[0].alias("first_value"),
    )


@register(
    "snapshot_profile",
    "case element_count has_pos has_vel has_pres has_temp has_scal min_points max_points concentration_source",
    "",
    """SELECT CAST(label AS VARCHAR) AS "case", count(*) AS element_count, true AS has_pos, true AS has_vel,
      true AS has_pres, label % 3 <> 0 AS has_temp, label % 3 = 0 AS has_scal, 8 AS min_points, 8 AS max_points,
      CASE WHEN label % 3 = 0 THEN 'scal[0]' ELSE 'temp[0]' END AS concentration_source
      FROM embeddings GROUP BY label""",
)
def snapshot_profile(spark, sf_dir):
    return slicing.snapshot_profile(fx.elements(spark, sf_dir), ["case"])


# --- scalar expressions --------------------------------------------------------------


@register(
    "speed",
    "comparison_set case idx",
    "speed",
    f"""WITH {PTS} SELECT comparison_set, "case", idx, sqrt(u * u + v * v + w * w) AS speed FROM pts""",
)
def speed_query(spark, sf_dir):
    return fx.points(spark, sf_dir).withColumn("speed", speed())


@register(
    "p_minus_mean",
    "comparison_set case idx",
    "p p_fluctuation",
    f"""WITH {PTS} SELECT comparison_set, "case", idx, p, p - avg(p) OVER (PARTITION BY comparison_set, "case")
      AS p_fluctuation FROM pts""",
)
def p_minus_mean(spark, sf_dir):
    return slicing.minus_mean(fx.points(spark, sf_dir), KEYS, "p", "p_fluctuation")


@register(
    "round_key",
    "l_orderkey l_linenumber",
    "price_key part_key",
    """SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 10.0, 0) / 10.0 AS price_key,
      round_even(l_partkey / 8 * 100.0, 0) / 100.0 AS part_key FROM lineitem""",
)
def round_key(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        half_even("l_extendedprice", 1).alias("price_key"),
        half_even(F.col("l_partkey") / 8, 2).alias("part_key"),
    )


@register(
    "relative_difference",
    "l_orderkey l_linenumber",
    "relative_difference",
    """SELECT l_orderkey, l_linenumber, (l_discount - l_tax) / nullif(l_tax, 0) AS relative_difference FROM lineitem""",
)
def relative_difference_query(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", relative_difference("l_discount", "l_tax").alias("relative_difference")
    )


@register(
    "lenient_parse",
    "l_orderkey l_linenumber label",
    "number",
    """SELECT l_orderkey, l_linenumber,
      CASE WHEN l_linenumber IN (5, 7) THEN 'N' || l_linenumber END AS label,
      CASE WHEN l_linenumber NOT IN (3, 4) THEN l_quantity END AS number FROM lineitem""",
)
def lenient_parse(spark, sf_dir):
    number = F.col("l_linenumber")
    raw_order = F.concat(F.when(number % 2 == 0, " n").when(number == 7, "N").otherwise(" "), number.cast("string"))
    raw_value = (
        F.when(number == 3, "  ").when(number == 4, F.col("l_returnflag")).otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit(" ")))
    )
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", order_label(raw_order).alias("label"), lenient_double(raw_value).alias("number")
    )


# --- slices --------------------------------------------------------------------------


@register(
    "extent",
    "comparison_set case",
    "y_min y_max",
    f"""WITH {PTS} SELECT comparison_set, "case", min(y) AS y_min, max(y) AS y_max FROM pts GROUP BY 1, 2""",
)
def extent(spark, sf_dir):
    return slicing.extent(fx.points(spark, sf_dir), KEYS)


@register(
    "slice_plane",
    "comparison_set case idx",
    "x y z C u v w p",
    f"WITH {PTS}, {fx.SLICE_SQL} SELECT * FROM sl",
)
def slice_plane(spark, sf_dir):
    return slicing.slice_plane(fx.points(spark, sf_dir), KEYS)


SLAB_SQL = f"""WITH {PTS}, bd AS (SELECT comparison_set, "case", 0.5 * (min(y) + max(y)) AS y0,
  0.2 * (max(y) - min(y)) AS dy_tol FROM pts GROUP BY 1, 2),
  sl AS (SELECT pts.*, y0, dy_tol FROM pts JOIN bd USING (comparison_set, "case") WHERE abs(y - y0) <= dy_tol)"""


@register("slice_slab", "comparison_set case idx", "x y z C u v w p", f"{SLAB_SQL} SELECT * FROM sl")
def slice_slab(spark, sf_dir):
    return slicing.slice_slab(fx.points(spark, sf_dir), KEYS, ratio=0.2)


@register(
    "slice_meta",
    "comparison_set case mode rounded_unique_y_count_before_selection y_round_decimals point_count",
    "y0 selected_y dy_tol slab_ratio",
    f"""WITH {PTS}, {fx.SLICE_SQL} SELECT comparison_set, "case", 'nearest_plane' AS mode,
      max(n_levels) AS rounded_unique_y_count_before_selection, 10 AS y_round_decimals, count(*) AS point_count,
      max(y0) AS y0, max(selected_y) AS selected_y, CAST(NULL AS DOUBLE) AS dy_tol, 0.01 AS slab_ratio
      FROM sl GROUP BY 1, 2""",
)
def slice_meta(spark, sf_dir):
    return slicing.slice_meta(fx.points(spark, sf_dir), KEYS)


@register(
    "slice_meta_slab",
    "comparison_set case mode rounded_unique_y_count_before_selection y_round_decimals point_count",
    "y0 selected_y dy_tol slab_ratio",
    f"""{SLAB_SQL} SELECT comparison_set, "case", 'slab' AS mode,
      CAST(NULL AS BIGINT) AS rounded_unique_y_count_before_selection, 10 AS y_round_decimals, count(*) AS point_count,
      max(y0) AS y0, CAST(NULL AS DOUBLE) AS selected_y, max(dy_tol) AS dy_tol, 0.2 AS slab_ratio
      FROM sl GROUP BY 1, 2""",
)
def slice_meta_slab(spark, sf_dir):
    return slicing.slice_meta(fx.points(spark, sf_dir), KEYS, mode="slab", ratio=0.2)


RANGED = [f"{c}_{n}" for c in ("x", "y", "z", "C", "u", "v", "w", "p", "speed") for n in ("min", "max")]


@register(
    "slice_summary",
    "comparison_set case point_count rounded_unique_y_count",
    " ".join(RANGED),
    f"""WITH {PTS}, s AS (SELECT *, sqrt(u * u + v * v + w * w) AS speed FROM pts)
      SELECT comparison_set, "case", count(*) AS point_count,
      count(DISTINCT round_even(y * 1e10, 0) / 1e10) AS rounded_unique_y_count,
      {", ".join(f'{n.rsplit("_", 1)[1]}({n.rsplit("_", 1)[0]}) AS {n}' for n in RANGED)} FROM s GROUP BY 1, 2""",
)
def slice_summary(spark, sf_dir):
    return slicing.slice_summary(fx.points(spark, sf_dir), KEYS)


@register(
    "y_histogram",
    "comparison_set case bin point_count",
    "bin_low bin_high",
    f"""WITH {PTS}, bd AS (SELECT comparison_set, "case", min(C) AS lo, max(C) AS hi FROM pts GROUP BY 1, 2),
      b AS (SELECT comparison_set, "case", lo, hi,
        CAST(least(floor((C - lo) / (hi - lo) * 80) + 1, 80) AS INTEGER) AS bin
        FROM pts JOIN bd USING (comparison_set, "case"))
      SELECT comparison_set, "case", bin, count(*) AS point_count, lo + (hi - lo) / 80 * (bin - 1) AS bin_low,
      lo + (hi - lo) / 80 * bin AS bin_high FROM b GROUP BY comparison_set, "case", bin, lo, hi""",
)
def y_histogram(spark, sf_dir):
    return slicing.value_histogram(fx.points(spark, sf_dir), KEYS, "C")


@register(
    "plane_distance",
    "comparison_set case",
    "y_midspan distance_min distance_max",
    f"""{SLAB_SQL}, m AS (SELECT comparison_set, "case", CASE WHEN "case" = 'N' THEN 0.5 * (min(y) + max(y))
      ELSE max(y0) END AS mid FROM sl GROUP BY 1, 2)
      SELECT comparison_set, "case", max(mid) AS y_midspan, min(abs(y - mid)) AS distance_min,
      max(abs(y - mid)) AS distance_max FROM sl JOIN m USING (comparison_set, "case") GROUP BY 1, 2""",
)
def plane_distance(spark, sf_dir):
    # Case N has no recorded y0, so its plane is the middle of its own range.
    sliced = slicing.slice_slab(fx.points(spark, sf_dir), KEYS, ratio=0.2)
    bounds = slicing.slab_bounds(fx.points(spark, sf_dir), KEYS, ratio=0.2)
    return slicing.plane_distance(sliced, KEYS, bounds.filter(F.col("case") != "N"))


# --- grids ---------------------------------------------------------------------------

DOMAIN_SQL = f"""{PTS}, per_case AS (SELECT comparison_set, "case", min(x) AS x0, max(x) AS x1, min(z) AS z0,
  max(z) AS z1 FROM pts GROUP BY 1, 2), box AS (SELECT comparison_set, max(x0) AS xmin, min(x1) AS xmax,
  max(z0) AS zmin, min(z1) AS zmax FROM per_case GROUP BY 1)"""


@register("common_domain", "comparison_set", "xmin xmax zmin zmax", f"WITH {DOMAIN_SQL} SELECT * FROM box")
def common_domain(spark, sf_dir):
    return grid.common_domain(fx.points(spark, sf_dir), ["comparison_set"])


@register(
    "common_grid",
    "comparison_set iz ix",
    "x z",
    f"""WITH {DOMAIN_SQL}, n AS (SELECT comparison_set, xmin, xmax, zmin, zmax, CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iz
      FROM box CROSS JOIN range(50) AS a(i) CROSS JOIN range(20) AS b(j))
      SELECT comparison_set, iz, ix, xmin + ix * ((xmax - xmin) / 49.0) AS x, zmin + iz * ((zmax - zmin) / 19.0) AS z
      FROM n""",
)
def common_grid(spark, sf_dir):
    domain = grid.common_domain(fx.points(spark, sf_dir), ["comparison_set"])
    return grid.make_grid(domain, ["comparison_set"], 50, 20)


@register(
    "dedup_average",
    "comparison_set case multiplicity",
    "x z C",
    f"""WITH {PTS}, {fx.SLICE_SQL} SELECT comparison_set, "case", avg(x) AS x, avg(z) AS z, avg(C) AS C,
      count(*) AS multiplicity FROM sl
      GROUP BY comparison_set, "case", {fx.ROUND_SQL.format("x")}, {fx.ROUND_SQL.format("z")}""",
)
def dedup_average(spark, sf_dir):
    return grid.average_duplicates(slicing.slice_plane(fx.points(spark, sf_dir), KEYS), KEYS, ["C"])


DUPLICATE_COLUMNS = (
    "point_count exact_unique_pair_count exact_duplicate_point_count exact_duplicate_pair_group_count "
    "exact_max_pair_multiplicity rounded_unique_pair_count rounded_duplicate_point_count "
    "rounded_duplicate_pair_group_count rounded_max_pair_multiplicity"
)
MERGE_COLUMNS = (
    "original_point_count finite_point_count unique_point_count duplicate_point_count max_multiplicity"
)


@register(
    "dup_stats",
    f"comparison_set case {DUPLICATE_COLUMNS} {MERGE_COLUMNS}",
    "",
    f"""WITH {PTS}, e AS (SELECT comparison_set, "case", C AS a, z AS b, count(*) AS n FROM pts GROUP BY 1, 2, 3, 4),
      r AS (SELECT comparison_set, "case", round_even(C * 0.01, 0) / 0.01 AS a, z, count(*) AS n FROM (
        SELECT comparison_set, "case", C, round_even(z * 0.01, 0) / 0.01 AS z FROM pts) GROUP BY 1, 2, 3, 4),
      es AS (SELECT comparison_set, "case", CAST(sum(n) AS BIGINT) AS point_count, count(*) AS exact_unique_pair_count,
        CAST(sum(n) AS BIGINT) - count(*) AS exact_duplicate_point_count,
        count(*) FILTER (WHERE n > 1) AS exact_duplicate_pair_group_count, max(n) AS exact_max_pair_multiplicity
        FROM e GROUP BY 1, 2),
      rs AS (SELECT comparison_set, "case", count(*) AS rounded_unique_pair_count,
        CAST(sum(n) AS BIGINT) - count(*) AS rounded_duplicate_point_count,
        count(*) FILTER (WHERE n > 1) AS rounded_duplicate_pair_group_count, max(n) AS rounded_max_pair_multiplicity
        FROM r GROUP BY 1, 2)
      SELECT *, point_count AS original_point_count, point_count AS finite_point_count,
      rounded_unique_pair_count AS unique_point_count, rounded_duplicate_point_count AS duplicate_point_count,
      rounded_max_pair_multiplicity AS max_multiplicity FROM es JOIN rs USING (comparison_set, "case")""",
)
def dup_stats(spark, sf_dir):
    # Prices as x make exact and rounded positions differ; rounding is to hundreds.
    shifted = fx.points(spark, sf_dir).withColumn("x", F.col("C"))
    counts = grid.duplicate_counts(shifted, KEYS, -2)
    return counts.join(grid.merge_stats(shifted, KEYS, "p", -2), KEYS)


# --- masks and errors ------------------------------------------------------------------


def _nodes(spark, sf_dir):
    points = fx.points(spark, sf_dir)
    return fx.nodes(points), fx.selection(points)


@register(
    "common_mask",
    "comparison_set case ix iz in_mask",
    "",
    f"""WITH {NODES}, {fx.masked_sql("C", "C")} SELECT * FROM masked""",
)
def common_mask(spark, sf_dir):
    return compare.with_reference(*_nodes(spark, sf_dir), "C", ["C"])


@register(
    "mask_counts",
    "comparison_set valid_point_count total_grid_point_count",
    "",
    f"""WITH {NODES}, {fx.masked_sql("C", "C")} SELECT * FROM totals""",
)
def mask_counts(spark, sf_dir):
    return compare.mask_counts(*_nodes(spark, sf_dir), "C")


@register(
    "case_vs_reference",
    "comparison_set case ix iz in_mask",
    "C ref_C abs_diff",
    f"""WITH {NODES}, {fx.masked_sql("C", "C")} SELECT *, abs(C - ref_C) AS abs_diff FROM masked""",
)
def case_vs_reference(spark, sf_dir):
    return compare.case_vs_reference(*_nodes(spark, sf_dir), "C")


@register(
    "absdiff_field",
    "comparison_set case ix iz",
    "speed ref_speed abs_diff",
    f"""WITH {NODES}, {fx.masked_sql("speed", "speed")} SELECT *, abs(speed - ref_speed) AS abs_diff
      FROM masked WHERE in_mask AND "case" <> 'R'""",
)
def absdiff_field(spark, sf_dir):
    gridded, selection = _nodes(spark, sf_dir)
    beside = compare.case_vs_reference(gridded.withColumn("speed", speed()), selection, "speed")
    return beside.filter(F.col("in_mask") & (F.col("case") != F.col("reference_case")))


@register(
    "pressure_fluctuation",
    "comparison_set case ix iz in_mask",
    "p p_prime",
    f"""WITH {NODES}, {fx.masked_sql("p", "p")} SELECT *, p - avg(CASE WHEN in_mask THEN p END)
      OVER (PARTITION BY comparison_set, "case") AS p_prime FROM masked""",
)
def pressure_fluctuation(spark, sf_dir):
    return compare.with_fluctuation(*_nodes(spark, sf_dir))


def _l2(field: str, floor: float = 0.0) -> str:
    above, below = f"sum(({field} - ref_{field}) * ({field} - ref_{field}))", f"sum(ref_{field} * ref_{field})"
    return f"sqrt({above} / CASE WHEN {below} > {floor!r} THEN {below} END)"


def _linf(field: str, floor: float = 0.0) -> str:
    top = f"max(abs(ref_{field}))"
    return f"max(abs({field} - ref_{field})) / CASE WHEN {top} > {floor!r} THEN {top} END"


def _errors_sql(prefix: str, mask: str, fields: str, metrics: str, reference: str = "R", extra: str = "") -> str:
    return f"""WITH {prefix}, {fx.masked_sql(mask, fields, reference)}{extra},
      inside AS (SELECT * FROM {"fluct" if extra else "masked"} WHERE in_mask AND "case" <> '{reference}'),
      m AS (SELECT comparison_set, "case", {metrics} FROM inside GROUP BY 1, 2)
      SELECT m.*, "order", "index", reference_case, reference_index, valid_point_count, total_grid_point_count
      FROM m JOIN selection USING (comparison_set, "case") JOIN totals USING (comparison_set)"""


ERROR_KEYS = (
    "comparison_set case order reference_case index reference_index valid_point_count total_grid_point_count"
)
C_COLUMNS = "relative_L2_C mean_abs_error_C absolute_Linf_C relative_Linf_C"
C_METRICS = f"""{_l2("C")} AS relative_L2_C, avg(abs(C - ref_C)) AS mean_abs_error_C,
  max(abs(C - ref_C)) AS absolute_Linf_C, {_linf("C")} AS relative_Linf_C"""
SPEED_COLUMNS = "relative_L2_speed mean_abs_error_speed absolute_Linf_speed relative_Linf_speed"
SPEED_METRICS = f"""{_l2("speed")} AS relative_L2_speed, avg(abs(speed - ref_speed)) AS mean_abs_error_speed,
  max(abs(speed - ref_speed)) AS absolute_Linf_speed, {_linf("speed")} AS relative_Linf_speed"""
COMPONENT_COLUMNS = " ".join(f"relative_L2_{c} mean_abs_error_{c}" for c in "uvw")
COMPONENT_METRICS = ", ".join(
    f"{_l2(c, 1e-14)} AS relative_L2_{c}, avg(abs({c} - ref_{c})) AS mean_abs_error_{c}" for c in "uvw"
)
P_COLUMNS = "relative_L2_p_prime mean_abs_error_p_prime absolute_Linf_p_prime relative_Linf_p_prime"
P_METRICS = f"""{_l2("pp", 1e-14)} AS relative_L2_p_prime, avg(abs(pp - ref_pp)) AS mean_abs_error_p_prime,
  max(abs(pp - ref_pp)) AS absolute_Linf_p_prime, {_linf("pp", 1e-14)} AS relative_Linf_p_prime"""
FLUCTUATION = """, means AS (SELECT comparison_set, "case", avg(p) AS mp, avg(ref_p) AS mr FROM masked WHERE in_mask
  GROUP BY 1, 2), fluct AS (SELECT masked.*, p - mp AS pp, ref_p - mr AS ref_pp FROM masked
  JOIN means USING (comparison_set, "case"))"""


@register("field_errors_C", ERROR_KEYS, C_COLUMNS, _errors_sql(NODES, "C", "C", C_METRICS))
def field_errors_c(spark, sf_dir):
    return compare.concentration_errors(*_nodes(spark, sf_dir))


@register(
    "field_errors_velocity",
    ERROR_KEYS,
    f"{SPEED_COLUMNS} {COMPONENT_COLUMNS}",
    _errors_sql(NODES, "speed", "speed u v w", f"{SPEED_METRICS}, {COMPONENT_METRICS}"),
)
def field_errors_velocity(spark, sf_dir):
    return compare.velocity_errors(*_nodes(spark, sf_dir))


@register("field_errors_pressure", ERROR_KEYS, P_COLUMNS, _errors_sql(NODES, "p", "p", P_METRICS, extra=FLUCTUATION))
def field_errors_pressure(spark, sf_dir):
    return compare.pressure_errors(*_nodes(spark, sf_dir))


# --- the selected ones of several snapshots ------------------------------------------------


def _snapshot_selection(spark, sf_dir):
    """The snapshots of CHOSEN_SNAPSHOTS for both sets, by a set list with one map of indices."""
    points = fx.snapshots(spark, sf_dir)
    present = durable(points.select("comparison_set", "case").distinct())
    chosen = F.create_map(*[F.lit(v) for pair in fx.CHOSEN_SNAPSHOTS.items() for v in pair])
    sets = present.select("comparison_set").distinct().select(
        "comparison_set", F.lit(None).cast("double").alias("target_time"), F.lit(None).cast("string").alias("reference_case"), chosen.alias("case_indices")
    )
    return points, selection.resolve_sets(sets, fx.cases(present), fx.REFERENCE)


SELECTED_SQL = f"""{fx.SNAPSHOTS_SQL}, pts AS (SELECT * FROM pts_all
  WHERE idx = CASE "case" {" ".join(f"WHEN '{c}' THEN {i}" for c, i in fx.CHOSEN_SNAPSHOTS.items())} END),
  {fx.NODES_SQL}, {fx.selection_sql()}"""


@register(
    "select_snapshot_errors",
    f"{ERROR_KEYS} idx",
    f"selected_y {C_COLUMNS}",
    f"""WITH e AS ({_errors_sql(SELECTED_SQL, "C", "C", C_METRICS)}), s AS (WITH {SELECTED_SQL} SELECT comparison_set, "case", idx,
      max(selected_y) AS selected_y FROM sl GROUP BY 1, 2, 3) SELECT * FROM e JOIN s USING (comparison_set, "case")""",
)
def select_snapshot_errors(spark, sf_dir):
    """Errors of one snapshot per case, of two that are there, each cut at its own plane."""
    points, chosen = _snapshot_selection(spark, sf_dir)
    kept = select_snapshots(points, chosen)
    keys = snapshot_keys(points)
    plane = slicing.select_plane(kept, keys).select(*keys, "selected_y")
    nodes = grid.average_fields_per_node(slice_points(kept), keys, fx.FIELDS).withColumns(
        {"ix": F.col("x").cast("int"), "iz": F.rint(F.col("z") * 100).cast("int")}
    )
    errors = compare.concentration_errors(nodes, chosen).join(plane, KEYS)
    return errors.withColumns({c: F.col(c).cast("long") for c in ("index", "reference_index")})


STORED_SQL = f"""WITH {fx.SNAPSHOTS_SQL}, keyed AS (SELECT * REPLACE ("case" || '/' || idx AS "case") FROM pts_all),
  pts AS (SELECT * FROM keyed), {fx.SLICE_SQL},
  bd2 AS (SELECT comparison_set, "case", 0.5 * (min(y) + max(y)) AS y0, 0.2 * (max(y) - min(y)) AS dy_tol FROM pts GROUP BY 1, 2),
  slab AS (SELECT pts.*, y0, dy_tol FROM pts JOIN bd2 USING (comparison_set, "case") WHERE abs(y - y0) <= dy_tol),
  stored AS (SELECT comparison_set, "case", idx, C, y0, selected_y, CAST(NULL AS DOUBLE) AS dy_tol, 'nearest_plane' AS mode FROM sl WHERE idx = 1
    UNION ALL SELECT comparison_set, "case", idx, C, y0, NULL, dy_tol, 'slab' FROM slab WHERE idx = 2)
  SELECT comparison_set, split_part("case", '/', 1) AS "case", idx, mode, count(*) AS point_count, count(*) AS stored_points,
  sum(C) / count(*) AS mean_C, max(y0) AS y0, max(selected_y) AS selected_y, max(dy_tol) AS dy_tol FROM stored GROUP BY 1, 2, 3, 4"""


@register("store_round_trip", "comparison_set case idx mode point_count stored_points", "mean_C y0 selected_y dy_tol", STORED_SQL)
def store_round_trip(spark, sf_dir):
    """Both snapshots written, the second one replaced by a slab: the first one stays, and the metadata fit what is there."""
    path = f"{checkpoint_folder(spark)}/slices-{uuid.uuid4().hex}"
    points = fx.snapshots(spark, sf_dir)
    keys = snapshot_keys(points)
    writers.write_slice(slice_points(points), path, meta=slicing.slice_meta(points, keys))
    second = points.filter("idx = 2")
    writers.write_slice(slice_points(second, "slab", ratio=0.2), path, overwrite=True, meta=slicing.slice_meta(second, keys, "slab", ratio=0.2))
    there = writers.produced_snapshots(spark, path, {"comparison_set": "string", "case": "string", "idx": "int"})
    stored = spark.read.parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("stored_points"), F.avg("C").alias("mean_C"))
    meta = spark.read.parquet(writers.meta_path(path)).select(*keys, "mode", "point_count", "y0", "selected_y", "dy_tol")
    return there.join(stored, keys, "left").join(meta, keys, "left")


FRONT_POSITION_SQL = f"""WITH {fx.NUMBERED_POINTS_SQL}, {fx.NODES_SQL}, {fx.selection_sql()}, {fx.masked_sql("C", "C")},
  thr AS (SELECT comparison_set, 0.8 * max(ref_C) AS threshold FROM masked WHERE in_mask GROUP BY 1)
  SELECT comparison_set, "case", max("order") AS "order", max("index") AS "index", max(threshold) AS threshold,
  max(CASE WHEN in_mask AND C > threshold THEN x END) AS x_front FROM masked JOIN thr USING (comparison_set)
  JOIN selection USING (comparison_set, "case") GROUP BY 1, 2"""


@register("front_position", "comparison_set case order index", "threshold x_front", FRONT_POSITION_SQL)
def front_position(spark, sf_dir):
    points = fx.numbered_points(spark, sf_dir)
    return compare.front_positions(fx.nodes(points), fx.selection(points), ratio=0.8)


# --- views over grids ------------------------------------------------------------------


def _profile_sql(across: str, along: str, wanted: list[float]) -> str:
    values = ", ".join(f"({w!r}::DOUBLE)" for w in wanted)
    return f"""WITH {NODES}, ln AS (SELECT comparison_set, "case", i{across}, min({across}) AS line_at FROM nodes GROUP BY 1, 2, 3),
      rk AS (SELECT ln.*, wanted, row_number() OVER (PARTITION BY comparison_set, "case", wanted
        ORDER BY abs(line_at - wanted), i{across}) AS rn FROM ln CROSS JOIN (VALUES {values}) AS q(wanted)),
      prof AS (SELECT nodes.*, wanted FROM nodes JOIN (SELECT * FROM rk WHERE rn = 1) r
        USING (comparison_set, "case", i{across}))"""


@register(
    "x_profile",
    "comparison_set case ix",
    "wanted x C",
    f"""{_profile_sql("z", "x", [0.055, 0.5])} SELECT * FROM prof WHERE C IS NOT NULL""",
)
def x_profile(spark, sf_dir):
    profiles = views.profile(_nodes(spark, sf_dir)[0], KEYS, "z", "C", [0.055, 0.5])
    return views.profile_points(profiles, KEYS, "x", "C")


@register(
    "z_profile",
    "comparison_set case iz",
    "wanted z p",
    f"""{_profile_sql("x", "z", [0.0, 12.5])} SELECT * FROM prof WHERE p IS NOT NULL""",
)
def z_profile(spark, sf_dir):
    profiles = views.profile(_nodes(spark, sf_dir)[0], KEYS, "x", "p", [0.0, 12.5])
    return views.profile_points(profiles, KEYS, "z", "p")


@register(
    "profile_sparsity",
    "comparison_set case finite_count node_count all_missing is_sparse",
    "wanted missing_fraction",
    f"""{_profile_sql("z", "x", [0.05])}, v AS (SELECT *, CASE WHEN C > 40000 THEN C END AS cv FROM prof)
      SELECT comparison_set, "case", wanted, count(cv) AS finite_count, count(*) AS node_count,
      1.0::DOUBLE - count(cv)::DOUBLE / count(*) AS missing_fraction, count(cv) = 0 AS all_missing,
      count(cv) > 0 AND 1.0::DOUBLE - count(cv)::DOUBLE / count(*) > 0.25 AS is_sparse FROM v GROUP BY 1, 2, 3""",
)
def profile_sparsity(spark, sf_dir):
    # Low values count as missing here, so that the share is not trivial.
    gridded = _nodes(spark, sf_dir)[0].withColumn("C", F.when(F.col("C") > 40000, F.col("C")))
    return views.profile_sparsity(views.profile(gridded, KEYS, "z", "C", [0.05]), KEYS, "C")


@register(
    "range_flag",
    "comparison_set case extend",
    "value_min value_max max_abs",
    f"""WITH {NODES} SELECT comparison_set, "case", min(C) AS value_min, max(C) AS value_max,
      CASE WHEN max(abs(C)) = 0 THEN 1.0 ELSE max(abs(C)) END AS max_abs,
      CASE WHEN min(C) < 2000 AND max(C) > 99000 THEN 'both' WHEN min(C) < 2000 THEN 'min'
        WHEN max(C) > 99000 THEN 'max' ELSE 'neither' END AS extend FROM nodes GROUP BY 1, 2""",
)
def range_flag(spark, sf_dir):
    return views.range_flags(_nodes(spark, sf_dir)[0], KEYS, "C", F.lit(2000.0), F.lit(99000.0))


def _iso_sql() -> str:
    level = "50000.0::DOUBLE"
    corner = " ".join(
        f"""JOIN nodes k{r} ON k{r}.comparison_set = k0.comparison_set AND k{r}."case" = k0."case"
        AND k{r}.ix = k0.ix + {r % 2} AND k{r}.iz = k0.iz + {r // 2}"""
        for r in (1, 2, 3)
    )
    picked = ", ".join(f"k{r}.x AS x{r}, k{r}.z AS z{r}, k{r}.C AS v{r}" for r in range(4))
    bits = " + ".join(f"CASE WHEN v{r} > {level} THEN {1 << r} ELSE 0 END" for r in range(4))

    def point(a: int, b: int) -> tuple[str, str]:
        share = f"(({level} - v{a}) / nullif(v{b} - v{a}, 0))"
        return f"x{a} + {share} * (x{b} - x{a})", f"z{a} + {share} * (z{b} - z{a})"

    edges = {"bottom": point(0, 1), "top": point(2, 3), "left": point(0, 2), "right": point(1, 3)}
    table = [
        ("left", "bottom", "c IN (1, 14) OR (c = 6 AND mid > L) OR (c = 9 AND mid <= L)"),
        ("bottom", "right", "c IN (2, 13) OR (c = 9 AND mid > L) OR (c = 6 AND mid <= L)"),
        ("left", "top", "c IN (4, 11) OR (c = 9 AND mid > L) OR (c = 6 AND mid <= L)"),
        ("top", "right", "c IN (8, 7) OR (c = 6 AND mid > L) OR (c = 9 AND mid <= L)"),
        ("left", "right", "c IN (3, 12)"),
        ("bottom", "top", "c IN (5, 10)"),
    ]
    parts = [
        f"""SELECT comparison_set, "case", cx, cz, {edges[a][0]} AS x1, {edges[a][1]} AS z1,
        {edges[b][0]} AS x2, {edges[b][1]} AS z2 FROM cells WHERE {when.replace("L", level)}"""
        for a, b, when in table
    ]
    return f"""WITH {NODES}, quads AS (SELECT k0.comparison_set, k0."case", k0.ix AS cx, k0.iz AS cz, {picked}
      FROM nodes k0 {corner}),
      cells AS (SELECT *, {bits} AS c, (v0 + v1 + v2 + v3) / 4 AS mid FROM quads)
      {" UNION ALL ".join(parts)}"""


@register("iso_contour", "comparison_set case cx cz", "x1 z1 x2 z2", _iso_sql())
def iso_contour(spark, sf_dir):
    return views.iso_contour(_nodes(spark, sf_dir)[0], KEYS, "C", 50000.0)


@register(
    "contour_range",
    "comparison_set case outside_range",
    "value_min value_max",
    f"""WITH {NODES} SELECT comparison_set, "case", min(C) AS value_min, max(C) AS value_max,
      NOT (95000 BETWEEN min(C) AND max(C)) AS outside_range FROM nodes GROUP BY 1, 2""",
)
def contour_range(spark, sf_dir):
    return views.contour_range(_nodes(spark, sf_dir)[0], KEYS, "C", 95000.0)


@register(
    "downsample",
    "comparison_set case l_orderkey l_linenumber",
    "x z C",
    f"""SELECT l_linestatus AS comparison_set, l_returnflag AS "case", l_orderkey, l_linenumber, l_quantity AS x, l_discount AS z,
      l_extendedprice AS C FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_linestatus, l_returnflag ORDER BY
      substr(md5('{views.SAMPLE_SEED}:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey), 1, 13)) <= 2000""",
)
def downsample(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_linestatus").alias("comparison_set"),
        F.col("l_returnflag").alias("case"),
        "l_orderkey",
        "l_linenumber",
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("z"),
        F.col("l_extendedprice").alias("C"),
    )
    return views.downsample(rows, KEYS, "id", size=2000)


# --- roll-up ----------------------------------------------------------------------------


TIMES = {"A": 5.0, "N": 10.0, "R": 15.0}


def _sets(points):
    time = F.create_map(*[F.lit(v) for pair in TIMES.items() for v in pair])
    return points.select("comparison_set").distinct().withColumn("target_time", time[F.col("comparison_set")])


def _error_tables(spark, sf_dir):
    points = fx.points_by_line(spark, sf_dir)
    gridded, selection = fx.nodes(points, sliced=False), fx.selection(points, "N11")
    nodes = compare.node_table(gridded, selection)
    tables = {
        "concentration": compare.concentration_table(nodes),
        "velocity": compare.velocity_table(nodes),
        "pressure": compare.pressure_table(nodes),
    }
    return tables, _sets(selection)


def _summary(spark, sf_dir):
    return rollup.multitime_summary(*_error_tables(spark, sf_dir))


def _summary_sql() -> str:
    def one(field: str, mask: str, fields: str, metrics: str, names: str, extra: str = "") -> str:
        common = ["relative_L2", "mean_abs_error", "max_abs_error", "relative_Linf"]
        renamed = ", ".join(f"{s} AS {n}" for s, n in zip(names.split(), common, strict=True))
        inner = _errors_sql(NODES_BY_LINE, mask, fields, metrics, "N11", extra)
        return f"""SELECT comparison_set, '{field}' AS field, "case", "order", reference_case, "index",
          reference_index, {renamed}, valid_point_count, total_grid_point_count FROM ({inner})"""

    union = " UNION ALL ".join(
        [
            one("concentration", "C", "C", C_METRICS, C_COLUMNS),
            one("velocity", "speed", "speed u v w", SPEED_METRICS, SPEED_COLUMNS),
            one("pressure", "p", "p", P_METRICS, P_COLUMNS, FLUCTUATION),
        ]
    )
    time = "CASE comparison_set WHEN 'A' THEN 5.0::DOUBLE WHEN 'N' THEN 10.0 ELSE 15.0 END"
    return f"SELECT *, {time} AS target_time FROM ({union})"


SUMMARY_SQL = _summary_sql()
METRIC_NAMES = "relative_L2 mean_abs_error max_abs_error relative_Linf"


@register(
    "multitime_summary",
    "comparison_set field case order reference_case index reference_index valid_point_count total_grid_point_count",
    f"target_time {METRIC_NAMES}",
    SUMMARY_SQL,
)
def multitime_summary(spark, sf_dir):
    return rollup.sorted_summary(_summary(spark, sf_dir))


PIVOT_SQL = f"""WITH s AS ({SUMMARY_SQL}), w AS (SELECT target_time, comparison_set, field,
  max(CASE WHEN "case" = 'N5' THEN mean_abs_error END) AS N5,
  max(CASE WHEN "case" = 'N7' THEN mean_abs_error END) AS N7,
  max(CASE WHEN "case" = 'N9' THEN mean_abs_error END) AS N9 FROM s GROUP BY 1, 2, 3)
  SELECT *, CASE WHEN N5 <= N7 AND N5 <= N9 THEN 'N5' WHEN N7 <= N9 THEN 'N7' ELSE 'N9' END AS best_lower_order,
  CASE WHEN N5 > N7 AND N7 > N9 THEN 'N5 > N7 > N9' WHEN N5 >= N7 AND N7 >= N9 THEN 'mostly decreasing'
    ELSE 'not monotonic' END AS trend FROM w"""


@register("order_pivot", "comparison_set field best_lower_order trend", "target_time N5 N7 N9", PIVOT_SQL)
def order_pivot(spark, sf_dir):
    return rollup.order_pivot(_summary(spark, sf_dir), "mean_abs_error")


@register(
    "best_counts",
    "best_lower_order n",
    "",
    f"SELECT best_lower_order, count(*) AS n FROM ({PIVOT_SQL}) GROUP BY 1",
)
def best_counts(spark, sf_dir):
    return rollup.best_counts(rollup.order_pivot(_summary(spark, sf_dir), "mean_abs_error"))


@register(
    "error_vs_time",
    "field order metric",
    "target_time value",
    f"""WITH s AS ({SUMMARY_SQL}) SELECT field, "order", 'relative_L2' AS metric, target_time, relative_L2 AS value
      FROM s WHERE "order" IN (5, 9) UNION ALL
      SELECT field, "order", 'relative_Linf', target_time, relative_Linf FROM s WHERE "order" IN (5, 9)""",
)
def error_vs_time(spark, sf_dir):
    return views.error_vs_time(_summary(spark, sf_dir), ["relative_L2", "relative_Linf"], orders=[5, 9])


@register(
    "error_vs_order",
    "comparison_set order case",
    "value",
    f"""SELECT comparison_set, "order", "case", relative_L2_C AS value FROM (
      {_errors_sql(NODES_BY_LINE, "C", "C", C_METRICS, "N11")})""",
)
def error_vs_order(spark, sf_dir):
    points = fx.points_by_line(spark, sf_dir)
    errors = compare.concentration_errors(fx.nodes(points, sliced=False), fx.selection(points, "N11"))
    return views.error_vs_order(errors, "relative_L2_C").orderBy("comparison_set", "order")
