"""Collect error tables of many comparison sets, pivot them by order, rank and classify."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import lenient_double, order_label, strict

# Field order, metric columns per field, order labels and table columns.
FIELD_ORDER = ("concentration", "velocity", "pressure")
METRIC_COLUMNS = {
    "concentration": ("relative_L2_C", "mean_abs_error_C", "absolute_Linf_C", "relative_Linf_C"),
    "velocity": ("relative_L2_speed", "mean_abs_error_speed", "absolute_Linf_speed", "relative_Linf_speed"),
    "pressure": (
        "relative_L2_p_prime",
        "mean_abs_error_p_prime",
        "absolute_Linf_p_prime",
        "relative_Linf_p_prime",
    ),
}
METRICS = ("relative_L2", "mean_abs_error", "max_abs_error", "relative_Linf")
ORDER_LABELS = ("N5", "N7", "N9")
REPEATED_CELL = "Several rows for one time, set, field and order; name the column that orders them."


def multitime_summary(tables: Mapping[str, DataFrame], sets: DataFrame) -> DataFrame:
    """Union of the per-field error tables under common metric names, with each set's time."""

    def renamed(field: str) -> DataFrame:
        metrics = zip(METRIC_COLUMNS[field], METRICS, strict=True)
        return tables[field].select(
            "comparison_set",
            F.lit(field).alias("field"),
            "case",
            "order",
            "reference_case",
            "index",
            "reference_index",
            *(F.col(source).alias(name) for source, name in metrics),
            "valid_point_count",
            "total_grid_point_count",
        )

    union = reduce(DataFrame.unionByName, (renamed(f) for f in FIELD_ORDER if f in tables))
    times = sets.select("comparison_set", "target_time")
    return union.join(times, "comparison_set", "left").select(
        "comparison_set", "target_time", *[c for c in union.columns if c != "comparison_set"]
    )


def _numeric_time() -> Column:
    return F.coalesce(F.col("target_time").try_cast("double"), F.lit(float("inf")))


def _field_rank() -> Column:
    position = F.array_position(F.array(*map(F.lit, FIELD_ORDER)), F.col("field"))
    return F.when(position > 0, position).otherwise(len(FIELD_ORDER) + 1)


def sorted_summary(summary: DataFrame) -> DataFrame:
    order = F.coalesce(F.col("order").try_cast("int"), F.lit(0))
    return summary.orderBy(_numeric_time(), _field_rank(), order, "case")


def order_pivot(
    summary: DataFrame, metric: str, sequence: str | None = None, labels: Sequence[str] = ORDER_LABELS
) -> DataFrame:
    """One row per (time, set, field): the metric by order, the best order and the trend.

    Of several rows for one cell the last by ``sequence`` counts; without a sequence they fail the job. On equal
    values the earlier order is the best one.
    """
    cells = summary.filter(F.col("field").isin(*FIELD_ORDER)).select(
        "target_time",
        "comparison_set",
        "field",
        order_label(F.col("order").cast("string"), labels).alias("_label"),
        lenient_double(F.col(metric).cast("string")).alias("_value"),
        (F.col(sequence) if sequence else F.lit(0)).alias("_seq"),
    )
    wide = (
        cells.filter(F.col("_label").isNotNull())
        .groupBy("target_time", "comparison_set", "field")
        .pivot("_label", list(labels))
        .agg(F.max_by("_value", "_seq") if sequence else strict(F.count(F.lit(1)) < 2, REPEATED_CELL, F.first("_value")))
    )
    ranked = F.array(*(F.struct(F.col(c).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("label")) for i, c in enumerate(labels)))
    best = F.array_min(F.filter(ranked, lambda e: e["v"].isNotNull()))["label"]
    pairs = list(zip(labels, labels[1:], strict=False))
    complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in labels))
    falling = reduce(lambda a, b: a & b, (F.col(a) > F.col(b) for a, b in pairs))
    not_rising = reduce(lambda a, b: a & b, (F.col(a) >= F.col(b) for a, b in pairs))
    trend = (
        F.when(~complete, "NA")
        .when(falling, " > ".join(labels))
        .when(not_rising, "mostly decreasing")
        .otherwise("not monotonic")
    )
    return wide.withColumns({"best_lower_order": F.coalesce(best, F.lit("NA")), "trend": trend})


def sorted_pivot(pivot: DataFrame) -> DataFrame:
    return pivot.orderBy(_numeric_time(), _field_rank(), "comparison_set", "field")


def best_counts(pivot: DataFrame) -> DataFrame:
    return pivot.groupBy("best_lower_order").agg(F.count(F.lit(1)).alias("n"))
