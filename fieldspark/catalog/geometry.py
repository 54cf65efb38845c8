"""Queries that interpolate scattered points to a grid."""

from __future__ import annotations

from fieldspark.catalog import fixtures as fx
from fieldspark.catalog.registry import register, register_like
from fieldspark.operators import compare, grid
from fieldspark.operators.regrid import regrid
from fieldspark.plans.comparison import compare_fields
from fieldspark.plans.selection import selection_from_points

NX, NZ = 20, 16
FIELDS = ["u", "v", "w", "speed"]
KEYS = ["comparison_set", "case"]


def _scatter(spark, sf_dir):
    """Each label is its own set here, with a grid over its own box."""
    points = fx.scatter(spark, sf_dir).withColumn("comparison_set", fx.F.col("case"))
    nodes = grid.make_grid(grid.own_domain(points, ["comparison_set"]), ["comparison_set"], NX, NZ)
    return points, nodes


OWN_BOX = """box AS (SELECT "case", min(x) AS xmin, max(x) AS xmax, min(z) AS zmin, max(z) AS zmax
  FROM scatter GROUP BY 1)"""
COMMON_BOX = """own AS (SELECT "case", min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM scatter GROUP BY 1),
  box AS (SELECT "case", max(x0) OVER () AS xmin, min(x1) OVER () AS xmax, max(z0) OVER () AS zmin,
    min(z1) OVER () AS zmax FROM own)"""


def _grid_sql(box: str) -> str:
    return f"""{fx.SCATTER_SQL}, {box},
  g AS (SELECT "case", CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iz,
    CASE WHEN i = {NX - 1} THEN xmax ELSE xmin + i * ((xmax - xmin) / {NX - 1}.0::DOUBLE) END AS gx,
    CASE WHEN j = {NZ - 1} THEN zmax ELSE zmin + j * ((zmax - zmin) / {NZ - 1}.0::DOUBLE) END AS gz
    FROM box CROSS JOIN range({NX}) AS a(i) CROSS JOIN range({NZ}) AS b(j))"""


NEAREST_SQL = f"""{_grid_sql(OWN_BOX)}, near AS (SELECT g."case", iz, ix, gx, gz, u, v, w, speed FROM g JOIN scatter s
  ON s."case" = g."case" QUALIFY row_number() OVER (PARTITION BY g."case", iz, ix
  ORDER BY (s.x - gx) * (s.x - gx) + (s.z - gz) * (s.z - gz), s.z, s.x) = 1)"""

def _linear_sql(box: str) -> str:
    """Every triangle whose circumcircle holds no other point, by brute force, then the one around each node."""
    return f"""{_grid_sql(box)}, p AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY x, z) AS id FROM scatter),
  t AS (SELECT a."case", a.id AS ia, b.id AS ib, c.id AS ic, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz,
    c.x AS cx, c.z AS cz, (b.x - a.x) * (c.z - a.z) - (b.z - a.z) * (c.x - a.x) AS area
    FROM p a JOIN p b ON b."case" = a."case" AND b.id > a.id JOIN p c ON c."case" = a."case" AND c.id > b.id),
  o AS (SELECT *, ax + ((cz - az) * ((bx - ax) ** 2 + (bz - az) ** 2) - (bz - az) * ((cx - ax) ** 2 + (cz - az) ** 2))
      / (2 * area) AS ox,
    az + ((bx - ax) * ((cx - ax) ** 2 + (cz - az) ** 2) - (cx - ax) * ((bx - ax) ** 2 + (bz - az) ** 2))
      / (2 * area) AS oz FROM t WHERE area <> 0),
  d AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p."case" = o."case" AND p.id NOT IN (ia, ib, ic)
    AND (p.x - ox) ** 2 + (p.z - oz) ** 2 < (ax - ox) ** 2 + (az - oz) ** 2)),
  hit AS (SELECT g."case", iz, ix, gx, gz, ia, ib, ic,
    ((bx - gx) * (cz - gz) - (bz - gz) * (cx - gx)) / area AS wa,
    ((cx - gx) * (az - gz) - (cz - gz) * (ax - gx)) / area AS wb,
    ((ax - gx) * (bz - gz) - (az - gz) * (bx - gx)) / area AS wc FROM g JOIN d ON d."case" = g."case"),
  kept AS (SELECT * FROM hit WHERE wa >= -1e-12 AND wb >= -1e-12 AND wc >= -1e-12
    QUALIFY row_number() OVER (PARTITION BY "case", iz, ix ORDER BY ia, ib, ic) = 1),
  lin AS (SELECT g."case", g.iz, g.ix, g.gx, g.gz, {", ".join(
      f"wa * a.{f} + wb * b.{f} + wc * c.{f} AS {f}" for f in FIELDS)}
    FROM g LEFT JOIN kept k ON k."case" = g."case" AND k.iz = g.iz AND k.ix = g.ix
    LEFT JOIN p a ON a."case" = k."case" AND a.id = k.ia LEFT JOIN p b ON b."case" = k."case" AND b.id = k.ib
    LEFT JOIN p c ON c."case" = k."case" AND c.id = k.ic)"""


LINEAR_SQL = _linear_sql(OWN_BOX)


@register(
    "regrid_linear",
    "case iz ix",
    "x z u v w speed",
    f"""WITH {LINEAR_SQL} SELECT "case", iz, ix, gx AS x, gz AS z, u, v, w, speed FROM lin""",
)
def regrid_linear(spark, sf_dir):
    return regrid(*_scatter(spark, sf_dir), FIELDS)


@register(
    "regrid_nearest",
    "case iz ix",
    "x z u v w",
    f"""WITH {NEAREST_SQL} SELECT "case", iz, ix, gx AS x, gz AS z, u, v, w FROM near""",
)
def regrid_nearest(spark, sf_dir):
    return regrid(*_scatter(spark, sf_dir), ["u", "v", "w"], method="nearest")


@register_like("regrid_linear_tiled", "regrid_linear")
def regrid_linear_tiled(spark, sf_dir):
    """Cells far smaller than the point sets, so that the cell tree and the circle search do the work."""
    return regrid(*_scatter(spark, sf_dir), FIELDS, tile_points=16)


@register_like("regrid_nearest_tiled", "regrid_nearest")
def regrid_nearest_tiled(spark, sf_dir):
    return regrid(*_scatter(spark, sf_dir), ["u", "v", "w"], method="nearest", leaf_size=16)


RAW_SQL = f"""WITH {fx.POINTS_SQL}, {fx.SLICE_SQL}, d AS (SELECT comparison_set, "case", x, z, min(C) AS C FROM sl GROUP BY 1, 2, 3, 4),
  per_case AS (SELECT comparison_set, "case", min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM sl GROUP BY 1, 2),
  box AS (SELECT comparison_set, max(x0) AS xmin, min(x1) AS xmax, max(z0) AS zmin, min(z1) AS zmax
    FROM per_case GROUP BY 1),
  g AS (SELECT comparison_set, "case", CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iz,
    CASE WHEN i = 12 THEN xmax ELSE xmin + i * ((xmax - xmin) / 12.0::DOUBLE) END AS gx,
    CASE WHEN j = 6 THEN zmax ELSE zmin + j * ((zmax - zmin) / 6.0::DOUBLE) END AS gz
    FROM box JOIN per_case USING (comparison_set) CROSS JOIN range(13) AS a(i) CROSS JOIN range(7) AS b(j))
  SELECT g.comparison_set, g."case", iz, ix, gx AS x, gz AS z, C FROM g JOIN d
  ON d.comparison_set = g.comparison_set AND d."case" = g."case"
  QUALIFY row_number() OVER (PARTITION BY g.comparison_set, g."case", iz, ix
    ORDER BY (d.x - gx) * (d.x - gx) + (d.z - gz) * (d.z - gz), d.z, d.x) = 1"""


@register("regrid_raw", "comparison_set case iz ix", "x z C", RAW_SQL)
def regrid_raw(spark, sf_dir):
    """Nearest value without merging first: many points share a position, the least value counts."""
    points = fx.slice_plane(fx.points(spark, sf_dir), KEYS)
    nodes = grid.make_grid(grid.common_domain(points, ["comparison_set"]), ["comparison_set"], 13, 7)
    return regrid(points, nodes, ["C"], method="nearest", deduplicate=False)


# --- as many points as there are order lines: the cell tree and the search over tiles do the work ------------------------

SPREAD_SQL = """spread AS (SELECT l_returnflag AS "case", l_extendedprice / 1000.0 AS x,
  ((l_orderkey * 7919 + l_linenumber * 104729) % 1000003) / 10000.0 AS z, l_quantity AS q FROM lineitem),
  g AS (SELECT "case", CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iz, CAST(10 + 4.0 * i AS DOUBLE) AS gx, CAST(10 + 5.0 * j AS DOUBLE) AS gz
    FROM (SELECT DISTINCT "case" FROM spread) CROSS JOIN range(16) AS a(i) CROSS JOIN range(16) AS b(j))"""


def _spread(spark, sf_dir):
    """Line items spread over the plane, with a field that is a plane, and a grid well inside them."""
    lines = fx.table(spark, sf_dir, "lineitem")
    mixed = (fx.F.col("l_orderkey") * 7919 + fx.F.col("l_linenumber") * 104729) % 1000003
    x, z = fx.F.col("l_extendedprice") / 1000.0, mixed / 10000.0
    points = lines.select(
        fx.F.col("l_returnflag").alias("comparison_set"), fx.F.col("l_returnflag").alias("case"), x.alias("x"), z.alias("z"), fx.F.col("l_quantity").alias("q")
    )
    # Every case is a set of its own, and each set has the same grid.
    nodes = points.select("comparison_set").distinct().withColumn("id", fx.F.explode(fx.F.sequence(fx.F.lit(0), fx.F.lit(255))))
    nodes = nodes.select("comparison_set", (fx.F.col("id") % 16).cast("int").alias("iz"), fx.F.floor(fx.F.col("id") / 16).cast("int").alias("ix"))
    nodes = nodes.withColumns({"x": 10 + 4.0 * fx.F.col("ix"), "z": 10 + 5.0 * fx.F.col("iz")})
    return points.withColumn("C", 2 * fx.F.col("x") - 3 * fx.F.col("z") + 1), nodes


@register(
    "regrid_linear_lines",
    "case iz ix",
    "x z C",
    f"""WITH {SPREAD_SQL} SELECT "case", iz, ix, gx AS x, gz AS z, 2 * gx - 3 * gz + 1 AS C FROM g""",
)
def regrid_linear_lines(spark, sf_dir):
    """Linear interpolation gives a plane back, wherever the triangles lie."""
    return regrid(*_spread(spark, sf_dir), ["C"])


@register(
    "regrid_nearest_lines",
    "case iz ix",
    "x z q",
    f"""WITH {SPREAD_SQL}, d AS (SELECT "case", {fx.ROUND_SQL.format("x")} AS xr, {fx.ROUND_SQL.format("z")} AS zr, avg(x) AS x, avg(z) AS z, avg(q) AS q
      FROM spread GROUP BY 1, 2, 3)
      SELECT g."case", iz, ix, gx AS x, gz AS z, q FROM g JOIN d ON d."case" = g."case" QUALIFY row_number() OVER (
      PARTITION BY g."case", iz, ix ORDER BY (d.x - gx) * (d.x - gx) + (d.z - gz) * (d.z - gz), d.z, d.x) = 1""",
)
def regrid_nearest_lines(spark, sf_dir):
    return regrid(*_spread(spark, sf_dir), ["q"], method="nearest")


DIAGNOSTIC_COLUMNS = "abs_diff_min abs_diff_max abs_diff_mean relative_L2"


def _diagnostic_sql(source: str, table: str) -> str:
    return f"""WITH {source}, s AS (SELECT "case", sqrt(u * u + v * v + w * w) AS a, speed AS b FROM {table})
      SELECT "case", count(a) AS valid_point_count, count(*) AS total_grid_point_count, min(abs(a - b)) AS abs_diff_min,
      max(abs(a - b)) AS abs_diff_max, avg(abs(a - b)) AS abs_diff_mean,
      sqrt(sum((a - b) * (a - b))) / nullif(sqrt(sum(b * b)), 0) AS "relative_L2" FROM s GROUP BY 1"""


@register(
    "speed_order_diag",
    "case valid_point_count total_grid_point_count",
    DIAGNOSTIC_COLUMNS,
    _diagnostic_sql(LINEAR_SQL, "lin"),
)
def speed_order_diag(spark, sf_dir):
    points, nodes = _scatter(spark, sf_dir)
    gridded = regrid(points, nodes, FIELDS)
    return compare.speed_order_diagnostic(gridded, KEYS)


@register(
    "speed_order_diag_nearest",
    "case valid_point_count total_grid_point_count",
    DIAGNOSTIC_COLUMNS,
    _diagnostic_sql(NEAREST_SQL, "near"),
)
def speed_order_diag_nearest(spark, sf_dir):
    points, nodes = _scatter(spark, sf_dir)
    gridded = regrid(points, nodes, FIELDS, method="nearest")
    return compare.speed_order_diagnostic(gridded, KEYS)


COMPARED_SQL = f"""WITH {_linear_sql(COMMON_BOX)},
  n AS (SELECT "case", ix, iz, gx AS x, u AS C, sqrt(u * u + v * v + w * w) AS speed, u, v, w, speed AS p FROM lin),
  ok AS (SELECT ix, iz, count(C) = (SELECT count(DISTINCT "case") FROM n) AS in_mask FROM n GROUP BY 1, 2),
  means AS (SELECT "case", avg(p) AS mp FROM n JOIN ok USING (ix, iz) WHERE in_mask GROUP BY 1),
  m AS (SELECT a."case", a.x, a.C, r.C AS rc, a.speed, r.speed AS rs, a.p - pa.mp AS pp, r.p - pr.mp AS rp
    FROM n a JOIN n r ON r."case" = '9' AND r.ix = a.ix AND r.iz = a.iz JOIN ok ON ok.ix = a.ix AND ok.iz = a.iz
    JOIN means pa ON pa."case" = a."case" JOIN means pr ON pr."case" = '9' WHERE in_mask)
  SELECT 'all' AS comparison_set, "case", count(*) AS valid_point_count, CAST({NX * NZ} AS BIGINT) AS total_grid_point_count,
  sqrt(sum((C - rc) ** 2) / sum(rc ** 2)) AS "relative_L2_C", avg(abs(C - rc)) AS "mean_abs_error_C",
  sqrt(sum((speed - rs) ** 2) / sum(rs ** 2)) AS "relative_L2_speed", max(abs(speed - rs)) AS "absolute_Linf_speed",
  sqrt(sum((pp - rp) ** 2) / sum(rp ** 2)) AS "relative_L2_p_prime", avg(abs(pp - rp)) AS mean_abs_error_p_prime,
  max(CASE WHEN C > (SELECT 0.2 * max(C) FROM m WHERE "case" = '9') THEN x END) AS x_front
  FROM m WHERE "case" <> '9' GROUP BY "case" """


@register(
    "regrid_field_errors",
    "comparison_set case valid_point_count total_grid_point_count",
    "relative_L2_C mean_abs_error_C relative_L2_speed absolute_Linf_speed relative_L2_p_prime "
    "mean_abs_error_p_prime x_front",
    COMPARED_SQL,
)
def regrid_field_errors(spark, sf_dir):
    """The whole way from scattered points to error tables: common grid, interpolation, mask, errors."""
    points = fx.scatter(spark, sf_dir).withColumns(
        {"C": fx.F.col("u"), "p": fx.F.col("speed"), "idx": fx.F.col("case").cast("int")}
    )
    cases = points.select("case", fx.F.col("idx").alias("order")).distinct()
    chosen = selection_from_points(points, cases, "9")
    result = compare_fields(points, chosen, nx=NX, nz=NZ, front_ratio=0.2)
    counts = ["valid_point_count", "total_grid_point_count"]
    keys = ["comparison_set", "case"]
    joined = (
        result.concentration.select(*keys, *counts, "relative_L2_C", "mean_abs_error_C")
        .join(result.velocity.select(*keys, "relative_L2_speed", "absolute_Linf_speed"), keys)
        .join(result.pressure.select(*keys, "relative_L2_p_prime", "mean_abs_error_p_prime"), keys)
    )
    return joined.join(result.fronts.select(*keys, "x_front"), keys)
