"""Views over the test tables that play the part of points, series, curves and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators.grid import average_fields_per_node
from fieldspark.operators.series import cumulative_sum
from fieldspark.operators.slicing import slice_plane
from fieldspark.plans.scale import durable, spooled
from fieldspark.plans.selection import selection_from_points

KEYS = ["comparison_set", "case"]
REFERENCE = "R"
FIELDS = ["C", "u", "v", "w", "p"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- points ----------------------------------------------------------------------


def _point_columns() -> list:
    price = F.col("l_extendedprice")
    return [
        F.col("l_quantity").alias("x"),
        F.col("l_tax").alias("y"),
        F.col("l_discount").alias("z"),
        price.alias("C"),
        (price * F.col("l_discount")).alias("u"),
        (price * F.col("l_tax")).alias("v"),
        F.col("l_quantity").alias("w"),
        (price * (1 + F.col("l_tax"))).alias("p"),
    ]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as points: two comparison sets, three cases, R the reference, one snapshot of each case."""
    lines = table(spark, sf_dir, "lineitem")
    idx = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 4).otherwise(6)
    return lines.select(
        F.col("l_linestatus").alias("comparison_set"), F.col("l_returnflag").alias("case"), *_point_columns(), idx.alias("idx")
    )


POINT_COLUMNS_SQL = """l_quantity AS x, l_tax AS y, l_discount AS z, l_extendedprice AS C,
  l_extendedprice * l_discount AS u, l_extendedprice * l_tax AS v, l_quantity AS w,
  l_extendedprice * (1 + l_tax) AS p"""
POINTS_SQL = f"""pts AS (SELECT l_linestatus AS comparison_set, l_returnflag AS "case", {POINT_COLUMNS_SQL},
  CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 4 ELSE 6 END AS idx FROM lineitem)"""


def numbered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, sets and cases; the index is the line number, so that of a case is read off all its lines."""
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_linestatus").alias("comparison_set"), F.col("l_returnflag").alias("case")]
    return lines.select(*keys, *_point_columns(), F.col("l_linenumber").alias("idx"))


NUMBERED_POINTS_SQL = f"""pts AS (SELECT l_linestatus AS comparison_set, l_returnflag AS "case", {POINT_COLUMNS_SQL},
  l_linenumber AS idx FROM lineitem)"""


def points_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines under four cases N5, N7, N9, N11 by line number, sets by return flag; one snapshot of each case."""
    lines = table(spark, sf_dir, "lineitem")
    rest = F.col("l_linenumber") % 4
    case = F.when(rest == 0, "N11").when(rest == 1, "N5").when(rest == 2, "N7").otherwise("N9")
    return lines.select(F.col("l_returnflag").alias("comparison_set"), case.alias("case"), *_point_columns(), (20 + rest).alias("idx"))


POINTS_BY_LINE_SQL = f"""pts AS (SELECT l_returnflag AS comparison_set,
  CASE l_linenumber % 4 WHEN 0 THEN 'N11' WHEN 1 THEN 'N5' WHEN 2 THEN 'N7' ELSE 'N9' END AS "case",
  {POINT_COLUMNS_SQL}, 20 + l_linenumber % 4 AS idx FROM lineitem)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of each case of ``points``: lines of odd numbers are the first; the planes of the second lie higher."""
    lines = table(spark, sf_dir, "lineitem")
    idx = F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2)
    columns = {"comparison_set": F.col("l_linestatus"), "case": F.col("l_returnflag")}
    rows = lines.select(*[c.alias(n) for n, c in columns.items()], *_point_columns(), idx.alias("idx"))
    return rows.withColumn("y", F.col("y") + F.when(F.col("idx") == 2, 0.125).otherwise(0.0))


SNAPSHOTS_SQL = f"""pts_all AS (SELECT * REPLACE (y + CASE WHEN idx = 2 THEN 0.125 ELSE 0 END AS y) FROM (
  SELECT l_linestatus AS comparison_set, l_returnflag AS "case", {POINT_COLUMNS_SQL},
  CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS idx FROM lineitem))"""
# Snapshots that the second set of sets chooses: the second one of A and R, the first one of N.
CHOSEN_SNAPSHOTS = {"A": 2, "N": 1, "R": 2}


def cases(all_points: DataFrame) -> DataFrame:
    """Case dimension, read off the points: A, N, R or labels such as N5."""
    order = (
        F.when(F.col("case") == "A", 5)
        .when(F.col("case") == "N", 7)
        .when(F.col("case") == "R", 11)
        .otherwise(F.regexp_replace("case", "^N", "").try_cast("int"))
    )
    return all_points.select("case").distinct().withColumn("order", order)


ORDER_SQL = """CASE "case" WHEN 'A' THEN 5 WHEN 'N' THEN 7 WHEN 'R' THEN 11
  ELSE TRY_CAST(regexp_replace("case", '^N', '') AS INTEGER) END"""


def nodes(all_points: DataFrame, sliced: bool = True) -> DataFrame:
    """Points (of the slice at mid y) merged per node; x and z take few values, so these are grid nodes."""
    kept = slice_plane(all_points, KEYS) if sliced else all_points
    merged = average_fields_per_node(kept, KEYS, FIELDS)
    return merged.withColumns({"ix": F.col("x").cast("int"), "iz": F.rint(F.col("z") * 100).cast("int")})


ROUND_SQL = "round_even({0} * 1e10, 0) / 1e10"
SLICE_SQL = f"""lv AS (SELECT comparison_set, "case", {ROUND_SQL.format("y")} AS level, min(y) AS lo, max(y) AS hi
    FROM pts GROUP BY 1, 2, 3),
  bd AS (SELECT comparison_set, "case", 0.5 * (min(lo) + max(hi)) AS y0, count(*) AS n_levels
    FROM lv GROUP BY 1, 2),
  ranked AS (SELECT comparison_set, "case", level, y0, n_levels, row_number() OVER (
    PARTITION BY comparison_set, "case" ORDER BY abs(level - y0), level) AS rn
    FROM lv JOIN bd USING (comparison_set, "case")),
  sel AS (SELECT comparison_set, "case", y0, level AS selected_y, n_levels FROM ranked WHERE rn = 1),
  sl AS (SELECT pts.*, y0, selected_y, n_levels FROM pts JOIN sel USING (comparison_set, "case")
    WHERE {ROUND_SQL.format("y")} = selected_y)"""
MERGED_SQL = f"""nodes AS (SELECT comparison_set, "case", {ROUND_SQL.format("x")} AS x, {ROUND_SQL.format("z")} AS z,
    CAST({ROUND_SQL.format("x")} AS INTEGER) AS ix, CAST(round_even({ROUND_SQL.format("z")} * 100, 0) AS INTEGER) AS iz,
    avg(C) AS C, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(p) AS p
    FROM {{source}} GROUP BY 1, 2, 3, 4, 5, 6)"""
NODES_SQL = f"{SLICE_SQL}, {MERGED_SQL.format(source='sl')}"


def selection(all_points: DataFrame, reference: str = REFERENCE) -> DataFrame:
    # What is there, read off the points in one pass; the cases follow from it.
    present = durable(all_points.groupBy("comparison_set", "case").agg(F.max("idx").alias("idx")))
    return durable(selection_from_points(present, cases(present), reference))


def selection_sql(reference: str = REFERENCE) -> str:
    return f"""pres AS (SELECT comparison_set, "case", CAST(max(idx) AS BIGINT) AS "index" FROM pts GROUP BY 1, 2),
  selection AS (SELECT comparison_set, "case", {ORDER_SQL} AS "order", "index", '{reference}' AS reference_case,
    max(CASE WHEN "case" = '{reference}' THEN "index" END) OVER (PARTITION BY comparison_set) AS reference_index,
    count(*) OVER (PARTITION BY comparison_set) AS n_cases FROM pres)"""


def masked_sql(value: str, fields: str, reference: str = REFERENCE) -> str:
    """Nodes with their reference values and the mask on the expression ``value``."""
    refs = ", ".join(f"r.{f} AS ref_{f}" for f in fields.split())
    return f"""src AS (SELECT *, sqrt(u * u + v * v + w * w) AS speed FROM nodes),
  ok AS (SELECT comparison_set, ix, iz, count({value}) = (SELECT max(n_cases) FROM selection s
    WHERE s.comparison_set = src.comparison_set) AS in_mask FROM src GROUP BY 1, 2, 3),
  masked AS (SELECT n.*, {refs}, ok.in_mask FROM src n JOIN ok USING (comparison_set, ix, iz)
    LEFT JOIN (SELECT * FROM src WHERE "case" = '{reference}') r USING (comparison_set, ix, iz)),
  totals AS (SELECT comparison_set, count(*) AS total_grid_point_count, count(*) FILTER (WHERE in_mask)
    AS valid_point_count FROM ok GROUP BY 1)"""


# --- series ----------------------------------------------------------------------


# Events of one type at the same time are ordered by their number.
TIES = ["event_id"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as irregular series per event type, time in days."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    return events.select(
        F.col("event_type").alias("case"),
        ((micros - start) / F.lit(86400e6)).alias("time"),
        F.col("value").alias("E_k"),
        F.col("user_id").cast("double").alias("E_p"),
        (F.col("value") + F.col("user_id")).alias("E_total"),
        (F.col("event_id") % 10).cast("double").alias("epsilon"),
        "event_id",
    )


SERIES_SQL = """series AS (SELECT event_type AS "case",
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 86400e6 AS time, value AS E_k,
  CAST(user_id AS DOUBLE) AS E_p, value + user_id AS E_total, CAST(event_id % 10 AS DOUBLE) AS epsilon, event_id
  FROM events)"""


def front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing position per case: the running sum of the event values, made once however often it is read."""
    rows = series(spark, sf_dir).select("case", "time", *TIES, "E_k")
    return spooled(cumulative_sum(rows, ["case"], ["time", *TIES], "E_k", "x_front").select("case", "time", *TIES, "x_front"))


FRONT_SQL = f"""{SERIES_SQL},
  front AS (SELECT "case", time, sum(E_k) OVER (PARTITION BY "case" ORDER BY time
    ROWS UNBOUNDED PRECEDING) AS x_front FROM series)"""

CURVE_CASE = "signup"


def curve(all_fronts: DataFrame) -> DataFrame:
    """The external curve: the front of one case."""
    return all_fronts.filter(F.col("case") == CURVE_CASE).select("time", F.col("x_front").alias("x"))


# --- scattered points --------------------------------------------------------------


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scattered points in general position, one case per label."""
    e = F.col("embedding")
    value = {name: e[i].cast("double") for i, name in enumerate(["x", "z", "u", "v", "w"])}
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("comparison_set"), F.col("label").cast("string").alias("case"), *(c.alias(n) for n, c in value.items())
    )
    return rows.withColumn("speed", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w")))


SCATTER_SQL = """scatter AS (SELECT *, sqrt(u * u + v * v + w * w) AS speed FROM (
  SELECT CAST(label AS VARCHAR) AS "case", CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS z,
  CAST(embedding[3] AS DOUBLE) AS u, CAST(embedding[4] AS DOUBLE) AS v, CAST(embedding[5] AS DOUBLE) AS w
  FROM embeddings))"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as snapshot elements of eight points; some hold the field in ``scal`` only."""
    e = F.col("embedding").cast("array<double>")

    def part(i: int):
        return F.slice(e, 8 * i + 1, 8)

    in_scal = F.col("label") % 3 == 0
    none = F.lit(None).cast("array<array<double>>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("case"),
        F.col("vec_id").alias("elem_id"),
        F.array(part(0), part(1), part(2)).alias("pos"),
        F.array(part(3), part(4), part(5)).alias("vel"),
        F.array(part(6)).alias("pres"),
        F.when(~in_scal, F.array(part(7))).otherwise(none).alias("temp"),
        F.when(in_scal, F.array(part(7))).otherwise(none).alias("scal"),
    )
