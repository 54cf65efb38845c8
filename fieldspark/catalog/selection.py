"""Queries on comparison sets, work lists, inventories and time alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.catalog import fixtures as fx
from fieldspark.catalog.registry import register
from fieldspark.plans import selection as sel

CASE_ORDER = """CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 7 ELSE 11 END"""


def _cases(spark, sf_dir):
    return fx.cases(fx.points(spark, sf_dir))


def _sets(spark, sf_dir):
    """One comparison set per supplier: the last line number of each case; even ones name a reference."""
    lines = fx.table(spark, sf_dir, "lineitem")
    last = lines.groupBy("l_suppkey", "l_returnflag").agg(F.max("l_linenumber").alias("i"))
    entries = F.map_from_entries(F.collect_list(F.struct("l_returnflag", "i")))
    sets = last.groupBy("l_suppkey").agg(entries.alias("case_indices"))
    return sets.select(
        F.col("l_suppkey").cast("string").alias("comparison_set"),
        (F.col("l_suppkey") / 10.0).alias("target_time"),
        F.when(F.col("l_suppkey") % 2 == 0, "N").alias("reference_case"),
        "case_indices",
        F.col("l_suppkey").alias("position"),
    )


SETS_SQL = f"""last AS (SELECT l_suppkey, l_returnflag AS "case", {CASE_ORDER} AS "order", max(l_linenumber) AS "index"
  FROM lineitem GROUP BY 1, 2, 3)"""


@register(
    "resolve_selection",
    "comparison_set case order index reference_case reference_index n_cases",
    "target_time",
    f"""WITH {SETS_SQL}, r AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'N' ELSE 'R' END AS reference_case FROM last)
      SELECT CAST(r.l_suppkey AS VARCHAR) AS comparison_set, r."case", r."order", r."index", r.reference_case,
      q."index" AS reference_index, count(*) OVER (PARTITION BY r.l_suppkey) AS n_cases,
      r.l_suppkey / 10.0::DOUBLE AS target_time
      FROM r JOIN last q ON q.l_suppkey = r.l_suppkey AND q."case" = r.reference_case""",
)
def resolve_selection(spark, sf_dir):
    return sel.resolve_sets(_sets(spark, sf_dir), _cases(spark, sf_dir), "R")


@register(
    "set_metadata",
    "comparison_set reference_case case_indices",
    "target_time",
    f"""WITH {SETS_SQL} SELECT CAST(l_suppkey AS VARCHAR) AS comparison_set,
      CASE WHEN l_suppkey % 2 = 0 THEN 'N' ELSE 'R' END AS reference_case,
      string_agg("case" || '=' || "index", ',' ORDER BY "case") AS case_indices,
      l_suppkey / 10.0::DOUBLE AS target_time FROM last GROUP BY l_suppkey""",
)
def set_metadata(spark, sf_dir):
    return sel.set_metadata(_sets(spark, sf_dir), "R")


@register(
    "work_plan",
    "case index first_position",
    "",
    f"""WITH {SETS_SQL} SELECT "case", "index", min(l_suppkey) AS first_position FROM last GROUP BY 1, 2""",
)
def work_plan(spark, sf_dir):
    return sel.slice_tasks(_sets(spark, sf_dir))


@register(
    "comparison_tasks",
    "comparison_set field_position field",
    "",
    """SELECT comparison_set, field_position, field FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS comparison_set
      FROM lineitem) CROSS JOIN (VALUES (0, 'concentration'), (1, 'velocity'), (2, 'pressure')) AS f(field_position, field)""",
)
def comparison_tasks(spark, sf_dir):
    return sel.comparison_tasks(_sets(spark, sf_dir))


@register(
    "order_to_case",
    "comparison_set order case status",
    "",
    f"""WITH m AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS comparison_set, l_returnflag AS "case" FROM lineitem),
      req AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS comparison_set, 3 + 2 * l_linenumber AS "order" FROM lineitem),
      c AS (SELECT DISTINCT l_returnflag AS "case", {CASE_ORDER} AS "order" FROM lineitem)
      SELECT req.comparison_set, req."order", c."case", CASE WHEN c."case" IS NULL THEN 'unknown_order'
        WHEN m."case" IS NULL THEN 'not_in_set' ELSE 'ok' END AS status
      FROM req LEFT JOIN c USING ("order") LEFT JOIN m ON m.comparison_set = req.comparison_set AND m."case" = c."case" """,
)
def order_to_case(spark, sf_dir):
    """Every order of lines is a set; its line numbers stand for requested orders."""
    lines = fx.table(spark, sf_dir, "lineitem")
    name = F.col("l_orderkey").cast("string").alias("comparison_set")
    members = lines.select(name, F.col("l_returnflag").alias("case")).distinct()
    requested = lines.select(name, (3 + 2 * F.col("l_linenumber")).alias("order")).distinct()
    return sel.cases_for_orders(requested, _cases(spark, sf_dir), members)


@register(
    "inventory",
    "case order index status",
    "",
    """WITH c AS (SELECT DISTINCT l_suppkey AS "case", CAST(l_suppkey % 7 AS INTEGER) AS "order" FROM lineitem),
      f AS (SELECT DISTINCT l_suppkey AS "case", CAST(l_quantity AS INTEGER) AS "index" FROM lineitem)
      SELECT c."case", c."order", e."index", CASE WHEN f."case" IS NULL THEN 'MISSING' ELSE 'OK' END AS status
      FROM c CROSS JOIN (SELECT CAST(i AS INTEGER) AS "index" FROM range(40, 60) AS r(i)) e
      LEFT JOIN f ON f."case" = c."case" AND f."index" = e."index" """,
)
def inventory(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    cases = lines.select(F.col("l_suppkey").alias("case"), (F.col("l_suppkey") % 7).cast("int").alias("order")).distinct()
    listing = lines.select(F.col("l_suppkey").alias("case"), F.col("l_quantity").cast("int").alias("index"))
    return sel.inventory(cases, range(40, 60), listing)


@register(
    "missing_inputs",
    "case index",
    "",
    """SELECT DISTINCT l_returnflag AS "case", l_partkey AS "index" FROM lineitem WHERE l_linestatus = 'O' EXCEPT
      SELECT l_returnflag, l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.03""",
)
def missing_inputs(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    pair = [F.col("l_returnflag").alias("case"), F.col("l_partkey").alias("index")]
    required = lines.filter(F.col("l_linestatus") == "O").select(*pair).distinct()
    present = lines.filter((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.03)).select(*pair)
    return sel.missing_inputs(required, present, ["case", "index"])


@register(
    "incremental_skip",
    "comparison_set case index",
    "",
    """SELECT DISTINCT l_linestatus AS comparison_set, l_returnflag AS "case", l_suppkey AS "index" FROM lineitem EXCEPT
      SELECT l_linestatus, l_returnflag, l_suppkey FROM lineitem WHERE l_quantity >= 50""",
)
def incremental_skip(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    key = [
        F.col("l_linestatus").alias("comparison_set"),
        F.col("l_returnflag").alias("case"),
        F.col("l_suppkey").alias("index"),
    ]
    produced = lines.filter(F.col("l_quantity") >= 50).select(*key)
    return sel.pending(lines.select(*key).distinct(), produced, ["comparison_set", "case", "index"])


@register(
    "locate_by_meta",
    "comparison_set case index expected_path path",
    "",
    """WITH f AS (SELECT 'grid/' || event_id AS path, event_type AS "case", user_id AS "index",
        CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 's2' END AS file_set FROM events),
      q AS (SELECT 's' || (1 + user_id % 2) AS comparison_set, event_type AS "case", user_id AS "index",
        'grid/' || (min(event_id) * 3) AS expected_path FROM events GROUP BY 1, 2, 3),
      m AS (SELECT q.*, min(f.path) FILTER (WHERE file_set IS NULL OR file_set IN ('', q.comparison_set)) AS found
        FROM q LEFT JOIN f ON f."case" = q."case" AND f."index" = q."index" GROUP BY 1, 2, 3, 4)
      SELECT comparison_set, "case", "index", expected_path, CASE WHEN expected_path IN (SELECT path FROM f)
        THEN expected_path ELSE found END AS path FROM m""",
)
def locate_by_meta(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    rest = F.col("event_id") % 3
    files = events.select(
        F.concat(F.lit("grid/"), F.col("event_id").cast("string")).alias("path"),
        F.col("event_type").alias("case"),
        F.col("user_id").alias("index"),
        F.when(rest == 1, "").when(rest == 2, "s2").alias("comparison_set"),
    )
    wanted = events.groupBy(
        F.concat(F.lit("s"), (1 + F.col("user_id") % 2).cast("string")).alias("comparison_set"),
        F.col("event_type").alias("case"),
        F.col("user_id").alias("index"),
    ).agg(F.concat(F.lit("grid/"), (F.min("event_id") * 3).cast("string")).alias("expected_path"))
    return sel.locate(wanted, files)


@register(
    "time_alignment",
    "comparison_set case status",
    "time reference_time time_difference",
    """WITH t AS (SELECT CAST(l_orderkey AS VARCHAR) AS comparison_set, l_returnflag AS "case", max(l_discount) AS time
        FROM lineitem GROUP BY 1, 2),
      r AS (SELECT comparison_set, time AS reference_time FROM t WHERE "case" = 'R')
      SELECT comparison_set, "case", time, reference_time, abs(time - reference_time) AS time_difference,
      CASE WHEN reference_time IS NULL THEN 'missing' WHEN abs(time - reference_time) > 0.035 THEN 'exceeds'
        ELSE 'ok' END AS status FROM t LEFT JOIN r USING (comparison_set)""",
)
def time_alignment(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    times = lines.groupBy(
        F.col("l_orderkey").cast("string").alias("comparison_set"), F.col("l_returnflag").alias("case")
    ).agg(F.max("l_discount").alias("time"))
    return sel.time_alignment(times, "R", 0.035)
