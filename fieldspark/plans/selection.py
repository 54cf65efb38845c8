"""Which snapshots take part: comparison sets, cases, work lists, missing inputs.

Dimension tables
    sets   comparison_set, target_time, reference_case (may be NULL), case_indices MAP
    cases  case, order

A *selection* has one row per (comparison_set, case): ``target_time, order, index,
reference_case, reference_index, n_cases``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import finite, strict
from fieldspark.plans.scale import attach

# Defaults that decide the results.
TIME_TOLERANCE = 0.05
FIELDS = ("concentration", "velocity", "pressure")


def resolve_sets(sets: DataFrame, cases: DataFrame, reference_case: str) -> DataFrame:
    """Selection of every comparison set.

    A set must list all configured cases; its reference is its own, else the
    configured one, and must be a configured case.
    """
    known = cases.agg(F.collect_set("case").alias("_known")).scalar()
    checked = sets.withColumns(
        {"_known": known, "reference_case": F.coalesce("reference_case", F.lit(reference_case))}
    )
    lacking = F.size(F.array_except("_known", F.map_keys("case_indices")))
    checked = checked.withColumn(
        "reference_case",
        F.when(lacking > 0, F.raise_error(F.lit("A comparison set does not list all configured cases.")))
        .when(
            ~F.array_contains("_known", F.col("reference_case")),
            F.raise_error(F.lit("The reference case is not a configured case.")),
        )
        .otherwise(F.col("reference_case")),
    )
    exploded = checked.select(
        "comparison_set",
        "target_time",
        "reference_case",
        F.element_at("case_indices", F.col("reference_case")).alias("reference_index"),
        F.explode("case_indices").alias("case", "index"),
    )
    return _with_orders(exploded, cases)


def resolve_selection(
    sets: DataFrame,
    cases: DataFrame,
    reference_case: str,
    comparison_set: str | None = None,
    case_indices: Mapping[str, int] | None = None,
    index: int | None = None,
    file_indices: Sequence[int] = (),
) -> DataFrame:
    """Selection by precedence: named set, explicit map, single index, last configured index."""
    if comparison_set is not None:
        named = sets.filter(F.col("comparison_set") == comparison_set)
        if named.isEmpty():
            raise ValueError(f"Unknown comparison set {comparison_set!r}.")
        return resolve_sets(named, cases, reference_case)
    if case_indices is not None:
        entries = [part for case, i in case_indices.items() for part in (F.lit(case), F.lit(int(i)))]
        chosen = F.create_map(*entries)
    else:
        chosen_index = index if index is not None else file_indices[-1]
        chosen = F.map_from_entries(F.collect_list(F.struct(F.col("case"), F.lit(int(chosen_index)))))
    made = cases.agg(chosen.alias("case_indices")) if case_indices is None else cases.limit(1).select(
        chosen.alias("case_indices")
    )
    made = made.select(
        F.lit("").alias("comparison_set"),
        F.lit(None).cast("double").alias("target_time"),
        F.lit(None).cast("string").alias("reference_case"),
        "case_indices",
    )
    return resolve_sets(made, cases, reference_case)


def selection_from_points(points: DataFrame, cases: DataFrame, reference_case: str, index: str = "idx") -> DataFrame:
    """Selection of point data in which each (set, case) holds one snapshot, its largest index."""
    present = points.groupBy("comparison_set", "case").agg(F.max(index).cast("long").alias("index"))
    in_set = Window.partitionBy("comparison_set")
    present = present.withColumns(
        {
            "target_time": F.lit(None).cast("double"),
            "reference_case": F.lit(reference_case),
            "reference_index": F.max(F.when(F.col("case") == reference_case, F.col("index"))).over(in_set),
        }
    )
    return _with_orders(present, cases)


def _with_orders(rows: DataFrame, cases: DataFrame) -> DataFrame:
    # A case that ``cases`` does not list stays, without an order.
    counted = rows.join(cases.select("case", "order"), "case", "left").withColumn(
        "n_cases", F.count(F.lit(1)).over(Window.partitionBy("comparison_set"))
    )
    return counted.select(
        "comparison_set",
        "target_time",
        "case",
        "order",
        "index",
        "reference_case",
        "reference_index",
        "n_cases",
    )


def set_metadata(sets: DataFrame, reference_case: str) -> DataFrame:
    """One record per set: target time, effective reference and its indices in case order."""
    pairs = F.array_sort(F.map_entries("case_indices"))
    text = F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return sets.select(
        "comparison_set",
        "target_time",
        F.coalesce("reference_case", F.lit(reference_case)).alias("reference_case"),
        text.alias("case_indices"),
    )


# --- work lists ------------------------------------------------------------------------


def slice_tasks(sets: DataFrame, position: str = "position") -> DataFrame:
    """Distinct (case, index) over all sets, in the order they are first needed."""
    exploded = sets.select(position, F.explode("case_indices").alias("case", "index"))
    return exploded.groupBy("case", "index").agg(F.min(position).alias("first_position"))


def comparison_tasks(sets: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    return sets.select(
        "comparison_set", F.posexplode(F.array(*map(F.lit, fields))).alias("field_position", "field")
    )


def cases_for_orders(requested: DataFrame, cases: DataFrame, selection: DataFrame) -> DataFrame:
    """Look up requested (comparison_set, order) pairs; ``status`` says why one is skipped."""
    named = requested.join(cases.groupBy("order").agg(F.min("case").alias("case")), "order", "left")
    members = selection.select("comparison_set", "case", F.lit(True).alias("_member"))
    joined = named.join(members, ["comparison_set", "case"], "left")
    return joined.select(
        "comparison_set",
        "order",
        "case",
        F.when(F.col("case").isNull(), "unknown_order")
        .when(F.col("_member").isNull(), "not_in_set")
        .otherwise("ok")
        .alias("status"),
    )


def inventory(cases: DataFrame, indices: Sequence[int] | Column, listing: DataFrame) -> DataFrame:
    """Every expected (case, index) with OK or MISSING; ``listing`` holds the pairs that exist."""
    wanted = indices if isinstance(indices, Column) else F.array(*(F.lit(int(i)) for i in indices))
    expected = cases.select("case", "order", F.explode(wanted).alias("index"))
    found = listing.select("case", "index").distinct().withColumn("_found", F.lit(True))
    return expected.join(found, ["case", "index"], "left").select(
        "case", "order", "index", F.when(F.col("_found"), "OK").otherwise("MISSING").alias("status")
    )


def inventory_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(F.col("status") == "OK").alias("existing"),
        F.count_if(F.col("status") == "MISSING").alias("missing"),
    )


def missing_inputs(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.join(present, list(keys), "left_anti")


def require_inputs(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    absent = missing_inputs(required, present, keys).limit(10).collect()
    if absent:
        raise FileNotFoundError(f"Missing inputs, first {len(absent)}: {[row.asDict() for row in absent]}")
    return required


def pending(required: DataFrame, produced: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Work whose output does not exist yet; everything when overwriting."""
    return required if overwrite else missing_inputs(required, produced, keys)


def locate(wanted: DataFrame, files: DataFrame, expected_path: str = "expected_path") -> DataFrame:
    """The expected path where it exists, else the first path whose metadata fits.

    ``files`` holds path, case, index and comparison_set; a file without a set fits any set.
    """
    exact = files.select(F.col("path").alias(expected_path), F.lit(True).alias("_exact")).distinct()
    # First path per distinct metadata; a wanted row meets at most one with its set and one without a set.
    described = files.groupBy("case", "index", F.nullif("comparison_set", F.lit("")).alias("comparison_set")).agg(
        F.min("path").alias("_path")
    )
    of_set = described.filter(F.col("comparison_set").isNotNull()).withColumnRenamed("_path", "_of_set")
    of_any = described.filter(F.col("comparison_set").isNull()).select("case", "index", F.col("_path").alias("_of_any"))
    found = (
        wanted.distinct()
        .join(exact, expected_path, "left")
        .join(of_set, ["case", "index", "comparison_set"], "left")
        .join(of_any, ["case", "index"], "left")
    )
    best = F.when(F.col("_exact"), F.col(expected_path)).otherwise(F.least("_of_set", "_of_any"))
    return found.select(*wanted.columns, best.alias("path"))


# --- time alignment ----------------------------------------------------------------------


def time_alignment(times: DataFrame, reference_case: str | Column, tolerance: float = TIME_TOLERANCE) -> DataFrame:
    """Distance of every case's time from the reference case's, classed by tolerance."""
    ref = F.lit(reference_case) if isinstance(reference_case, str) else reference_case
    refs = times.filter(F.col("case") == ref).groupBy("comparison_set").agg(F.max("time").alias("reference_time"))
    joined = attach(times, refs, ["comparison_set"], "left")
    known = finite("time", "reference_time")
    gap = F.when(known, F.abs(F.col("time") - F.col("reference_time")))
    return joined.withColumns(
        {
            "time_difference": gap,
            "status": F.when(~known, "missing").when(gap > tolerance, "exceeds").otherwise("ok"),
        }
    )


def require_alignment(aligned: DataFrame) -> DataFrame:
    """Fail inside the job when any case is out of tolerance."""
    ok = F.col("status") == "ok"
    return aligned.withColumn("status", strict(ok, "Snapshot times are not aligned.", F.col("status")))
