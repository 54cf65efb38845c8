"""Measure every case against the reference case on the nodes valid in all of them.

Input is a gridded table: one row per (set, case, node) with field columns, and
a selection table with one row per (set, case), see ``plans.selection``. One
exchange on (set, node) yields both the common mask and the reference value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import finite_or_null, guarded_ratio, is_finite, speed, strict
from fieldspark.plans.scale import attach, durable, spooled

# Fixed value: share of the largest reference concentration that marks the front.
FRONT_THRESHOLD_RATIO = 0.01

SELECTION = ["order", "index", "reference_case", "reference_index", "n_cases"]


def with_reference(
    gridded: DataFrame,
    selection: DataFrame,
    mask_field: str,
    fields: Sequence[str],
    sets: Sequence[str] = ("comparison_set",),
    case: str = "case",
    node: Sequence[str] = ("ix", "iz"),
) -> DataFrame:
    """Add the selection columns, ``in_mask``, ``ref_<field>`` and ``_first_of_node``.

    A node is in the mask when ``mask_field`` is finite there in every case of the set.
    """
    cleaned = gridded.withColumns({f: finite_or_null(f) for f in fields})
    rows = attach(cleaned, selection, [*sets, case]).drop("target_time")
    at_node = Window.partitionBy(*sets, *node)
    is_ref = F.col(case) == F.col("reference_case")
    added = {
        "in_mask": F.count(F.col(mask_field)).over(at_node) == F.col("n_cases"),
        "_first_of_node": F.min(case).over(at_node) == F.col(case),
    }
    added |= {f"ref_{f}": F.max(F.when(is_ref, F.col(f))).over(at_node) for f in fields}
    return rows.withColumns(added)


def case_vs_reference(
    gridded: DataFrame, selection: DataFrame, field: str, **names
) -> DataFrame:
    """Every case beside the reference at each node, with the absolute difference."""
    rows = with_reference(gridded, selection, field, [field], **names)
    return rows.withColumn("abs_diff", F.abs(F.col(field) - F.col(f"ref_{field}")))


def mask_counts(
    gridded: DataFrame,
    selection: DataFrame,
    field: str,
    sets: Sequence[str] = ("comparison_set",),
    **names,
) -> DataFrame:
    rows = with_reference(gridded, selection, field, [field], sets=sets, **names)
    once = F.col("_first_of_node")
    return rows.groupBy(*sets).agg(
        F.count_if(once & F.col("in_mask")).alias("valid_point_count"),
        F.count_if(once).alias("total_grid_point_count"),
    )


# --- one table of nodes, one aggregate ------------------------------------------------

# Which field's finite nodes make the mask of a field's errors.
MASKS = {"C": "C", "speed": "speed", "u": "speed", "v": "speed", "w": "speed", "p": "p"}


def _pair(field: str, mask: str) -> tuple[Column, Column]:
    inside = F.col(mask)
    return F.when(inside, F.col(field)), F.when(inside, F.col(f"ref_{field}"))


def _moments(field: str, mask: str) -> list[Column]:
    """What every error of a field follows from, over the masked rows of a case."""
    v, r = _pair(field, mask)
    off = v - r
    both = F.when(off.isNotNull(), r)
    return [
        F.sum(off * off).alias(f"_dd_{field}"),
        F.sum(both * both).alias(f"_rr_{field}"),
        F.avg(F.abs(off)).alias(f"_mad_{field}"),
        F.max(F.abs(off)).alias(f"_maxd_{field}"),
        F.max(F.abs(both)).alias(f"_maxr_{field}"),
    ]


def relative_l2(field: str, safe: bool) -> Column:
    above, below = F.col(f"_dd_{field}"), F.col(f"_rr_{field}")
    if safe:
        return F.sqrt(guarded_ratio(above, below))
    return F.sqrt(strict(below != 0.0, "The reference norm is zero or no node is valid.", F.try_divide(above, below)))


def mean_abs_error(field: str) -> Column:
    return F.col(f"_mad_{field}")


def absolute_linf(field: str) -> Column:
    return F.col(f"_maxd_{field}")


def relative_linf(field: str, safe: bool) -> Column:
    above, below = F.col(f"_maxd_{field}"), F.col(f"_maxr_{field}")
    if safe:
        return guarded_ratio(above, below)
    return strict(below != 0.0, "The reference maximum is zero or no node is valid.", F.try_divide(above, below))


@dataclass(frozen=True)
class NodeTable:
    """Every case's values beside the reference's at each node, and what follows from one pass over them.

    ``rows`` and ``facts``, one row per case, are written tables. ``fields`` are the fields they hold.
    """

    rows: DataFrame
    facts: DataFrame
    fields: tuple[str, ...]
    sets: tuple[str, ...]
    case: str

    @property
    def keys(self) -> list[str]:
        return [*self.sets, self.case]

    def table(self, mask: str, metrics: Sequence[Column], facts: DataFrame | None = None) -> DataFrame:
        """The errors of all cases but the reference, with the counts of one mask."""
        # One row per case is left, so this window is tiny. Each node was counted in one case only.
        nodes = F.sum("_first_nodes").over(Window.partitionBy(*self.sets))
        counted = (self.facts if facts is None else facts).withColumn("total_grid_point_count", nodes)
        kept = [*self.keys, *SELECTION[:-1], *metrics, F.col(f"_valid_{mask}").alias("valid_point_count"), "total_grid_point_count"]
        return counted.select(*kept).filter(F.col(self.case) != F.col("reference_case"))


def node_table(
    gridded: DataFrame,
    selection: DataFrame,
    fields: Sequence[str] = ("C", "u", "v", "w", "speed", "p"),
    sets: Sequence[str] = ("comparison_set",),
    case: str = "case",
    node: Sequence[str] = ("ix", "iz"),
) -> NodeTable:
    """One exchange on (set, node) for all ``fields``, written once, and one aggregate over it, written too."""
    fields = tuple(fields)
    masks = list(dict.fromkeys(MASKS[f] for f in fields))
    source = gridded.withColumn("speed", speed()) if "speed" in fields else gridded
    cleaned = source.withColumns({f: finite_or_null(f) for f in fields})
    rows = attach(cleaned, selection, [*sets, case]).drop("target_time")
    at_node = Window.partitionBy(*sets, *node)
    is_ref = F.col(case) == F.col("reference_case")
    added = {f"_mask_{m}": F.count(F.col(m)).over(at_node) == F.col("n_cases") for m in masks}
    added |= {"_first_of_node": F.min(case).over(at_node) == F.col(case)}
    added |= {f"ref_{f}": F.max(F.when(is_ref, F.col(f))).over(at_node) for f in fields}
    keep = [*sets, case, *node, *[c for c in ("x",) if c in gridded.columns], *SELECTION, *fields, *added]
    rows = spooled(rows.withColumns(added).select(*keep))
    facts = [F.first(c).alias(c) for c in SELECTION[:-1]]
    facts += [F.count_if(f"_mask_{m}").alias(f"_valid_{m}") for m in masks]
    facts += [m for f in fields if f != "p" for m in _moments(f, f"_mask_{MASKS[f]}")]
    if "p" in fields:
        facts += [F.avg(c).alias(n) for c, n in zip(_pair("p", "_mask_p"), ("_mean", "_ref_mean"), strict=True)]
    if "C" in fields:
        facts.append(F.max(F.when(F.col("_mask_C"), F.col("ref_C"))).alias("_peak"))
    facts.append(F.count_if("_first_of_node").alias("_first_nodes"))
    return NodeTable(rows, durable(rows.groupBy(*sets, case).agg(*facts)), fields, tuple(sets), case)


# --- error tables -----------------------------------------------------------------------


def concentration_table(nodes: NodeTable) -> DataFrame:
    metrics = [
        relative_l2("C", safe=False).alias("relative_L2_C"),
        mean_abs_error("C").alias("mean_abs_error_C"),
        absolute_linf("C").alias("absolute_Linf_C"),
        relative_linf("C", safe=False).alias("relative_Linf_C"),
    ]
    return nodes.table("C", metrics)


def velocity_table(nodes: NodeTable) -> DataFrame:
    """The mask is where speed is finite in every case; component ratios are the safe ones."""
    metrics = [
        relative_l2("speed", safe=False).alias("relative_L2_speed"),
        mean_abs_error("speed").alias("mean_abs_error_speed"),
        absolute_linf("speed").alias("absolute_Linf_speed"),
        relative_linf("speed", safe=False).alias("relative_Linf_speed"),
    ]
    for c in ("u", "v", "w"):
        metrics += [relative_l2(c, safe=True).alias(f"relative_L2_{c}"), mean_abs_error(c).alias(f"mean_abs_error_{c}")]
    return nodes.table("speed", metrics)


def _fluctuating(nodes: NodeTable) -> DataFrame:
    """The rows with ``p_prime``: pressure minus its case's mean over the mask, and its reference."""
    means = nodes.facts.select(*nodes.keys, "_mean", "_ref_mean")
    rows = attach(nodes.rows, means, nodes.keys)
    return rows.withColumns({"p_prime": F.col("p") - F.col("_mean"), "ref_p_prime": F.col("ref_p") - F.col("_ref_mean")}).drop("_mean", "_ref_mean")


def pressure_table(nodes: NodeTable) -> DataFrame:
    """Errors of the fluctuation. The means are facts of the first pass, so a second one over the written nodes is enough."""
    moments = _fluctuating(nodes).groupBy(*nodes.keys).agg(*_moments("p_prime", "_mask_p"))
    facts = nodes.facts.join(moments, nodes.keys)
    some = "No finite common grid node for the pressure comparison."
    metrics = [
        relative_l2("p_prime", safe=True).alias("relative_L2_p_prime"),
        mean_abs_error("p_prime").alias("mean_abs_error_p_prime"),
        strict(F.col("_valid_p") > 0, some, absolute_linf("p_prime")).alias("absolute_Linf_p_prime"),
        relative_linf("p_prime", safe=True).alias("relative_Linf_p_prime"),
    ]
    return nodes.table("p", metrics, facts)


def front_table(nodes: NodeTable, ratio: float = FRONT_THRESHOLD_RATIO) -> DataFrame:
    """Largest x with C above a share of the largest masked reference C; all cases."""
    sets = list(nodes.sets)
    thresholds = nodes.facts.groupBy(*sets).agg((F.lit(float(ratio)) * F.max("_peak")).alias("threshold"))
    reached = F.col("_mask_C") & (F.col("C") > F.col("threshold"))
    return (
        attach(nodes.rows, thresholds, sets)
        .groupBy(*nodes.keys)
        .agg(
            F.first("order").alias("order"),
            F.first("index").alias("index"),
            F.first("threshold").alias("threshold"),
            F.max(F.when(reached, F.col("x"))).alias("x_front"),
        )
    )


def concentration_errors(gridded: DataFrame, selection: DataFrame, **names) -> DataFrame:
    return concentration_table(node_table(gridded, selection, ["C"], **names))


def velocity_errors(gridded: DataFrame, selection: DataFrame, **names) -> DataFrame:
    return velocity_table(node_table(gridded, selection, ["speed", "u", "v", "w"], **names))


def pressure_errors(gridded: DataFrame, selection: DataFrame, **names) -> DataFrame:
    return pressure_table(node_table(gridded, selection, ["p"], **names))


def front_positions(gridded: DataFrame, selection: DataFrame, ratio: float = FRONT_THRESHOLD_RATIO, **names) -> DataFrame:
    return front_table(node_table(gridded, selection, ["C"], **names), ratio)


def with_fluctuation(gridded: DataFrame, selection: DataFrame, **names) -> DataFrame:
    """Every node with ``in_mask``, pressure and ``p_prime``, beside the reference's."""
    rows = _fluctuating(node_table(gridded, selection, ["p"], **names))
    return rows.withColumnsRenamed({"_mask_p": "in_mask"})


def speed_order_diagnostic(gridded: DataFrame, keys: Sequence[str], direct: str = "speed") -> DataFrame:
    """Speed of interpolated components against interpolated speed, both columns of one table, over nodes with both."""
    both = is_finite("_a") & is_finite("_b")
    rows = gridded.select(*keys, speed().alias("_a"), F.col(direct).alias("_b"))
    rows = rows.withColumn("_d", F.when(both, F.abs(F.col("_a") - F.col("_b"))))
    size = F.sqrt(F.sum(F.when(both, F.col("_b") * F.col("_b"))))
    return rows.groupBy(*keys).agg(
        F.count("_d").alias("valid_point_count"),
        F.count(F.lit(1)).alias("total_grid_point_count"),
        F.min("_d").alias("abs_diff_min"),
        F.max("_d").alias("abs_diff_max"),
        F.avg("_d").alias("abs_diff_mean"),
        F.when(size > 0.0, F.sqrt(F.sum(F.col("_d") * F.col("_d"))) / size).alias("relative_L2"),
    )
