"""An adaptive cell tree over points, kept as Spark tables, and nearest-point search by joins.

Cells of level L cut the box of a key into 2^L by 2^L parts. Only occupied cells
are rows. A cell with at most ``leaf_size`` points is a leaf, so a dense cluster
is cut finer than its surroundings and no leaf grows with the data. The search
walks the levels from the root, keeps the cells that may still hold the nearest
point and joins points only inside the leaves that remain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, inf, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.plans.scale import attach, durable

MAX_DEPTH = 48
# Levels the search goes down per join.
STRIDE = 3
# Relative slack that keeps a cell whose edge rounding could hide the nearest point.
SLACK = 1e-9


@dataclass(frozen=True)
class Tree:
    """``points`` carry their leaf (``_lv, _lx, _lz``)."""

    points: DataFrame
    cells: DataFrame  # keys, level, cx, cz, n: occupied cells of every level
    near_cells: DataFrame  # the same down to two levels below the leaves
    leaves: DataFrame  # keys, level, cx, cz, n
    steps: DataFrame  # keys, _from, _fx, _fz and the cells the search reaches from there
    box: DataFrame  # keys, _x0, _xs, _z0, _zs
    keys: tuple[str, ...]
    x: str
    z: str
    depth: int
    leaf_size: int


def _cell_index(value: str, low: str, span: str, depth: int) -> Column:
    count = 1 << depth
    index = F.floor((F.col(value) - F.col(low)) / F.col(span) * F.lit(float(count)))
    return F.least(F.greatest(index, F.lit(0)), F.lit(count - 1)).cast("long")


def build_tree(points: DataFrame, keys: Sequence[str], x: str, z: str, leaf_size: int) -> Tree:
    """Points must be distinct in (x, z) within a key."""
    keys = tuple(keys)
    span_x, span_z = F.max(x) - F.min(x), F.max(z) - F.min(z)
    box = durable(
        points.groupBy(*keys).agg(
            F.min(x).alias("_x0"),
            F.when(span_x > 0, span_x).otherwise(1.0).alias("_xs"),
            F.min(z).alias("_z0"),
            F.when(span_z > 0, span_z).otherwise(1.0).alias("_zs"),
            F.count(F.lit(1)).alias("_count"),
        )
    )
    largest = box.agg(F.max("_count")).first()[0] or 0
    zero = F.lit(0).cast("long")
    if largest <= leaf_size:
        root = box.select(*keys, F.lit(0).alias("level"), zero.alias("cx"), zero.alias("cz"), F.col("_count").alias("n"))
        flat = points.withColumns({"_lv": F.lit(0), "_lx": zero, "_lz": zero})
        return Tree(flat, root, root, root, root, box, keys, x, z, 0, leaf_size)

    boxed, depth = attach(points, box, keys), min(MAX_DEPTH, _levels_for(largest / leaf_size))
    while True:
        placed = boxed.withColumns(
            {"_fx": _cell_index(x, "_x0", "_xs", depth), "_fz": _cell_index(z, "_z0", "_zs", depth)}
        )
        extents = [F.first("_xs") / (F.max(x) - F.min(x)), F.first("_zs") / (F.max(z) - F.min(z))]
        # How much finer than the box the points of the cell lie; NULL when they share a coordinate.
        finer = F.least(*(F.when(F.max(c) > F.min(c), e) for c, e in zip((x, z), extents, strict=True)))
        fine = durable(placed.groupBy(*keys, "_fx", "_fz").agg(F.count(F.lit(1)).alias("n"), finer.alias("_finer")))
        full = fine.filter(F.col("n") > leaf_size).agg(F.max("n"), F.max("_finer")).first()
        if full[0] is None or depth >= MAX_DEPTH:
            break
        deeper = max(0, ceil(log2(full[1] or 1.0)) - depth) + _levels_for(full[0] / leaf_size)
        depth = min(MAX_DEPTH, depth + deeper)

    levels = fine.select(*keys, "_fx", "_fz", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    levels = levels.withColumns({"cx": _ancestor("_fx", depth), "cz": _ancestor("_fz", depth)})
    cells = durable(levels.groupBy(*keys, "level", "cx", "cz").agg(F.sum("n").alias("n")))
    # Cells below a leaf are not part of the tree; two levels of them serve as a first bound.
    split = cells.filter((F.col("n") > leaf_size) & (F.col("level") < depth))
    near_cells = durable(_below(cells, split, keys, 3).unionByName(cells.filter("level < 3")))
    tree_cells = durable(_below(near_cells, split, keys, 1))
    is_leaf = (F.col("n") <= leaf_size) | (F.col("level") == depth)
    # The root of a key small enough to be a leaf has no parent.
    roots = cells.filter((F.col("level") == 0) & is_leaf)
    leaves = durable(tree_cells.filter(is_leaf).unionByName(roots))

    leaf_levels = [r["level"] for r in leaves.select("level").distinct().collect()]
    at_leaf_levels = placed.drop("_x0", "_xs", "_z0", "_zs").withColumn("_lv", F.explode(F.array(*map(F.lit, leaf_levels))))
    at_leaf_levels = at_leaf_levels.withColumns({"_lx": _ancestor("_fx", depth, "_lv"), "_lz": _ancestor("_fz", depth, "_lv")})
    own = leaves.select(*keys, F.col("level").alias("_lv"), F.col("cx").alias("_lx"), F.col("cz").alias("_lz"))
    assigned = attach(at_leaf_levels, own, [*keys, "_lv", "_lx", "_lz"]).drop("_fx", "_fz")
    steps = _search_steps(tree_cells, leaves, keys, depth, is_leaf)
    return Tree(assigned, cells, near_cells, leaves, steps, box, keys, x, z, depth, leaf_size)


def _below(cells: DataFrame, split: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """Cells that lie ``levels`` below a cell that is split."""
    over = split.select(
        *keys, (F.col("level") + levels).alias("level"), F.col("cx").alias("_px"), F.col("cz").alias("_pz")
    )
    under = cells.withColumns({"_px": F.shiftright("cx", levels), "_pz": F.shiftright("cz", levels)})
    return under.join(over, [*keys, "level", "_px", "_pz"], "left_semi").drop("_px", "_pz")


def _levels_for(ratio: float) -> int:
    """Levels that split evenly spread points that far, and one to spare."""
    return max(1, ceil(log2(max(ratio, 1.0)) / 2) + 1)


def _ancestor(index: str, depth: int, level: str = "level") -> Column:
    """Cell index at another level; the division by a power of two is exact."""
    return F.floor(F.col(index) / F.pow(F.lit(2.0), (F.lit(depth) - F.col(level)).cast("double"))).cast("long")


def _search_steps(tree_cells: DataFrame, leaves: DataFrame, keys: Sequence[str], depth: int, is_leaf: Column) -> DataFrame:
    """Cells reached from a cell in one step: those ``STRIDE`` levels below, and leaves on the way.

    A leaf leads to itself, so that it stays a candidate.
    """
    start = (F.floor((F.col("level") - 1) / STRIDE) * STRIDE).cast("int")
    last = (F.col("level") % STRIDE == 0) | (F.col("level") == depth)
    reached = tree_cells.filter(last | is_leaf).withColumn("_from", start)
    shrink = F.pow(F.lit(2.0), (F.col("level") - F.col("_from")).cast("double"))
    down = reached.select(
        *keys,
        "_from",
        F.floor(F.col("cx") / shrink).cast("long").alias("_fx"),
        F.floor(F.col("cz") / shrink).cast("long").alias("_fz"),
        "level",
        "cx",
        "cz",
    )
    stay = leaves.select(*keys, F.col("level").alias("_from"), F.col("cx").alias("_fx"), F.col("cz").alias("_fz"), "level", "cx", "cz")
    return durable(down.unionByName(stay))


def candidate_leaves(
    tree: Tree, queries: DataFrame, query_id: Sequence[str], qx: str, qz: str, within: str | None = None, direction: bool = False
) -> DataFrame:
    """Leaves that may hold the point nearest to each query: ``_lv, _lx, _lz``, ``_near`` and ``_bound``.

    ``within`` names a column with a squared distance beyond which points do not matter. With ``direction`` a query is a
    unit vector, and the least is that of the negative height of a point along it, so the farthest point is found.
    """
    spans = _cell_heights if direction else _cell_distances
    ids = [*tree.keys, *query_id]
    zero = F.lit(0).cast("long")
    rows = attach(queries, tree.box.drop("_count"), tree.keys)
    if within:
        rows = rows.withColumn("_bound", F.col(within))
    elif tree.depth > 0:
        rows = _with_first_bound(tree, rows, qx, qz)
    else:
        rows = rows.withColumn("_bound", F.lit(inf))
    rows = rows.withColumns({"level": F.lit(0), "cx": zero, "cz": zero})
    rows = rows.withColumns(spans(qx, qz))
    for _ in range(ceil(tree.depth / STRIDE)):
        rows = rows.withColumnsRenamed({"level": "_from", "cx": "_fx", "cz": "_fz"}).drop("_near", "_far")
        rows = attach(rows, tree.steps, [*tree.keys, "_from", "_fx", "_fz"]).drop("_from", "_fx", "_fz")
        # The bound of the step before drops most cells before the shuffle.
        rows = rows.withColumns(spans(qx, qz)).filter(F.col("_near") <= F.col("_bound"))
        nearest_far = F.min("_far").over(Window.partitionBy(*ids))
        if direction:
            size = F.col("_xs") + F.col("_zs") + F.abs("_x0") + F.abs("_z0")
            reach = nearest_far + SLACK * size
        else:
            size = F.col("_xs") * F.col("_xs") + F.col("_zs") * F.col("_zs")
            reach = nearest_far * (1 + SLACK) + SLACK * SLACK * size
        rows = rows.withColumn("_bound", F.least(F.col("_bound"), reach))
        rows = rows.filter(F.col("_near") <= F.col("_bound"))
    return rows.withColumnsRenamed({"level": "_lv", "cx": "_lx", "cz": "_lz"}).drop(
        "_x0", "_xs", "_z0", "_zs", "_far"
    )


def _with_first_bound(tree: Tree, rows: DataFrame, qx: str, qz: str) -> DataFrame:
    """Upper bound on the squared distance: the smallest occupied cell around the query holds a point."""
    placed = rows.withColumns(
        {
            "_ix": _cell_index(qx, "_x0", "_xs", tree.depth),
            "_iz": _cell_index(qz, "_z0", "_zs", tree.depth),
            "level": F.explode(F.sequence(F.lit(0), F.lit(tree.depth))),
        }
    )
    around = placed.withColumns({"cx": _ancestor("_ix", tree.depth), "cz": _ancestor("_iz", tree.depth)})
    occupied = attach(around, tree.near_cells, [*tree.keys, "level", "cx", "cz"]).withColumns(_cell_distances(qx, qz))
    return occupied.groupBy(*rows.columns).agg((F.min("_far") * (1 + SLACK)).alias("_bound"))


def _cell_distances(qx: str, qz: str) -> dict[str, Column]:
    """Squared distance from the query to the nearest and the farthest place of a cell."""
    cells = F.pow(F.lit(2.0), F.col("level").cast("double"))
    near, far = F.lit(0.0), F.lit(0.0)
    for q, low, span, index in ((qx, "_x0", "_xs", "cx"), (qz, "_z0", "_zs", "cz")):
        size = F.col(span) / cells
        lo = F.col(low) + F.col(index) * size
        hi = lo + size
        gap = F.greatest(lo - F.col(q), F.col(q) - hi, F.lit(0.0))
        reach = F.greatest(F.abs(F.col(q) - lo), F.abs(F.col(q) - hi))
        near, far = near + gap * gap, far + reach * reach
    return {"_near": near, "_far": far}


def _cell_heights(dx: str, dz: str) -> dict[str, Column]:
    """Least and greatest negative height of a cell's places along a direction."""
    cells = F.pow(F.lit(2.0), F.col("level").cast("double"))
    near, far = F.lit(0.0), F.lit(0.0)
    for d, low, span, index in ((dx, "_x0", "_xs", "cx"), (dz, "_z0", "_zs", "cz")):
        lo = F.col(low) + F.col(index) * (F.col(span) / cells)
        ends = F.col(d) * lo, F.col(d) * (lo + F.col(span) / cells)
        near, far = near - F.greatest(*ends), far - F.least(*ends)
    return {"_near": near, "_far": far}


def farthest_points(
    tree: Tree, queries: DataFrame, query_id: Sequence[str], dx: str, dz: str, payload: Sequence[str], beyond: str
) -> DataFrame:
    """Per query, a direction of length one, the point farthest along it and the payload columns.

    Queries without a point whose height is at least ``beyond`` are absent from the result.
    """
    ids = [*tree.keys, *query_id]
    asked = queries.select(*ids, F.col(dx).alias("_qx"), F.col(dz).alias("_qz"), (-F.col(beyond)).alias("_within"))
    leaves = candidate_leaves(tree, asked, query_id, "_qx", "_qz", "_within", direction=True)
    place = [F.col(tree.x).alias("_pt_x"), F.col(tree.z).alias("_pt_z")]
    points = tree.points.select(*tree.keys, "_lv", "_lx", "_lz", *place, *payload)
    met = leaves.join(points, [*tree.keys, "_lv", "_lx", "_lz"])
    met = met.withColumn("_low", -(F.col("_qx") * F.col("_pt_x") + F.col("_qz") * F.col("_pt_z")))
    met = met.filter(F.col("_low") <= F.col("_within"))
    best = F.min(F.struct("_low", "_pt_z", "_pt_x", *payload)).alias("_best")
    return met.groupBy(*ids).agg(best).select(*ids, *(F.col(f"_best.{c}").alias(c) for c in payload))


def nearest_points(
    tree: Tree,
    queries: DataFrame,
    query_id: Sequence[str],
    qx: str,
    qz: str,
    payload: Sequence[str],
    within: str | None = None,
) -> DataFrame:
    """Per query the nearest point: ``_d2`` and the payload columns; ties go to lower z, then x.

    Queries without a point inside ``within`` are absent from the result.
    """
    ids = [*tree.keys, *query_id]
    asked = queries.select(*ids, F.col(qx).alias("_qx"), F.col(qz).alias("_qz"), *([F.col(within).alias("_within")] if within else []))
    leaves = candidate_leaves(tree, asked, query_id, "_qx", "_qz", "_within" if within else None)
    points = tree.points.select(
        *tree.keys, "_lv", "_lx", "_lz", F.col(tree.x).alias("_pt_x"), F.col(tree.z).alias("_pt_z"), *payload
    )
    met = leaves.join(points, [*tree.keys, "_lv", "_lx", "_lz"])
    dx, dz = F.col("_pt_x") - F.col("_qx"), F.col("_pt_z") - F.col("_qz")
    # The search left a bound, so only close pairs reach the aggregation.
    met = met.withColumn("_d2", dx * dx + dz * dz).filter(F.col("_d2") <= F.col("_bound"))
    best = F.min(F.struct("_d2", "_pt_z", "_pt_x", *payload)).alias("_best")
    return met.groupBy(*ids).agg(best).select(*ids, "_best._d2", *(F.col(f"_best.{c}").alias(c) for c in payload))
