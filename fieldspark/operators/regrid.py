"""Scattered points to grid nodes: nearest value and linear (Delaunay) interpolation.

Linear interpolation needs, for every node, the Delaunay triangle around it and
not the whole triangulation. Nodes are grouped by the leaf of a cell tree they
fall in; one grouped Python call per leaf finds each node's triangle among the
points of the leaf, of its neighbours and of the hull. A triangle whose circle
stays inside that neighbourhood is final. The others are checked against all
points by a distributed nearest-point search at the circle's centre, and improved
with the point found, until every circle is empty. Groups therefore stay bounded
while the result is that of the whole set.

Points on a common circle (rectangular layouts) admit several triangulations. A
slight shear of the coordinates settles them the same way in every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import finite
from fieldspark.operators import triangles as tri
from fieldspark.operators.grid import DEDUP_DECIMALS, average_duplicates
from fieldspark.operators.quadtree import Tree, build_tree, candidate_leaves, farthest_points, nearest_points
from fieldspark.plans.scale import attach, durable, ship, spooled

NEAREST_LEAF = 256
TILE_POINTS = 512
TILE_NODES = 4096
SHEAR = 1e-7
NODE = ["iz", "ix"]


# --- shared -------------------------------------------------------------------------


def node_queries(grid: DataFrame, points: DataFrame, sets: Sequence[str], case: str) -> DataFrame:
    """Grid nodes of a set for each of its cases."""
    return attach(grid, points.select(*sets, case).distinct(), sets)


def distinct_points(
    points: DataFrame, keys: Sequence[str], fields: Sequence[str], deduplicate: bool, decimals: int
) -> DataFrame:
    """Merge near-equal positions, or only keep one row (the least) per exact position."""
    if deduplicate:
        return average_duplicates(points, keys, fields, decimals).select(*keys, "x", "z", *fields)
    usable = points.filter(finite("x", "z", *fields))
    least = usable.groupBy(*keys, "x", "z").agg(F.min(F.struct(*fields)).alias("_f"))
    return least.select(*keys, "x", "z", *(F.col(f"_f.{f}").alias(f) for f in fields))


def shared_support(points: DataFrame, fields: Sequence[str]) -> bool:
    """True when every usable point has all fields, so one triangulation serves them all."""
    if len(fields) == 1:
        return True
    placed = finite("x", "z")
    some = reduce(lambda a, b: a | b, (finite(f) for f in fields))
    lacking = points.filter(placed & some & ~finite(*fields))
    return lacking.isEmpty()


def regrid(
    points: DataFrame,
    grid: DataFrame,
    fields: Sequence[str],
    method: str = "linear",
    sets: Sequence[str] = ("comparison_set",),
    case: str = "case",
    deduplicate: bool = True,
    decimals: int = DEDUP_DECIMALS,
    tile_points: int = TILE_POINTS,
    leaf_size: int = NEAREST_LEAF,
) -> DataFrame:
    """Fields of every case at every node of its set's grid: (sets, case, iz, ix, x, z, fields).

    Fields that miss different points are interpolated each over its own points.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"Unknown interpolation method {method!r}.")
    ship(points.sparkSession)
    keys = [*sets, case]
    nodes = node_queries(grid, points, sets, case)
    groups = [list(fields)] if shared_support(points, fields) else [[f] for f in fields]
    results = []
    for group in groups:
        # Written once: the tree, its levels and every round of the search read the merged points, not the source.
        merged = spooled(distinct_points(points, keys, group, deduplicate, decimals))
        if method == "nearest":
            results.append(_nearest(merged, nodes, keys, group, leaf_size))
        else:
            results.append(_linear(merged, nodes, keys, group, tile_points))
    # Every result holds all nodes, and the reader of the table sees NULL where there is no value.
    joined = reduce(lambda a, b: a.join(b.drop("x", "z"), [*keys, *NODE]), results)
    return joined.select(*keys, *NODE, "x", "z", *fields)


# --- nearest ------------------------------------------------------------------------


def _nearest(points: DataFrame, nodes: DataFrame, keys: list[str], fields: list[str], leaf_size: int) -> DataFrame:
    tree = build_tree(points, keys, "x", "z", leaf_size)
    found = nearest_points(tree, nodes, [*NODE, "x", "z"], "x", "z", fields)
    return found.select(*keys, *NODE, "x", "z", *fields)


# --- linear: two points that every tile knows --------------------------------------------


def outermost(points: DataFrame, keys: list[str]) -> DataFrame:
    """The first and the last point of each key by (X, Z): any place lies on one side of the edge between them."""
    place = F.struct("_X", "_Z")
    ends = points.groupBy(*keys).agg(F.min(F.struct(place.alias("at"), "_values")).alias("first"), F.max(F.struct(place.alias("at"), "_values")).alias("last"))
    each = ends.select(*keys, F.explode(F.array("first", "last")).alias("e"))
    return each.select(*keys, F.col("e.at._X").alias("_X"), F.col("e.at._Z").alias("_Z"), F.col("e._values").alias("_values"))


# --- linear: one tile -------------------------------------------------------------------

TILE = ["_lv", "_lx", "_lz", "_chunk"]
CORNERS = ["a", "b", "c"]


def _state_schema(keys: list[str], nodes: DataFrame) -> T.StructType:
    key_fields = [nodes.schema[k] for k in [*keys, *NODE]]
    numbers = ["x", "z", "_X", "_Z", "_qx", "_qz"] + [f"{c}{axis}" for c in CORNERS for axis in ("x", "z")]
    return T.StructType(
        [
            *key_fields,
            *(T.StructField(n, T.DoubleType()) for n in numbers),
            *(T.StructField(f"{c}v", T.ArrayType(T.DoubleType())) for c in CORNERS),
            T.StructField("_inside", T.BooleanType()),
            T.StructField("_turned", T.BooleanType()),
            T.StructField("_final", T.BooleanType()),
        ]
    )


def _tile_solver(columns: list[str]):
    def solve(nodes: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame(columns=columns)
        places, xz = nodes[["_X", "_Z"]].to_numpy(), points[["_X", "_Z"]].to_numpy()
        origin = places.mean(axis=0)
        places, xz = places - origin, xz - origin
        corner = tri.first_triangles(places, xz)
        inside = corner[:, 2] >= 0
        shifted = places.copy()
        shifted[inside] = tri.nudge(places[inside], xz[corner[inside]])
        corner[inside] = tri.triangulate_around(shifted[inside], xz, corner[inside])

        out = nodes[[c for c in columns if c in nodes.columns]].copy()
        out["_qx"], out["_qz"] = shifted[:, 0] + origin[0], shifted[:, 1] + origin[1]
        # One more entry, which -1 names: the corner at infinity.
        xz = np.vstack([xz, np.full((1, 2), np.nan)])
        values = [*points["_values"], None]
        for k, name in enumerate(CORNERS):
            out[f"{name}x"], out[f"{name}z"] = (xz[corner[:, k], axis] + origin[axis] for axis in (0, 1))
            out[f"{name}v"] = [values[c] for c in corner[:, k]]
        # An edge may be turned once more, when all points have a say.
        out["_inside"], out["_turned"] = inside, False
        # The circle of an outer triangle is a half-plane, and that of a key with one point is nothing.
        everywhere = np.isinf(nodes[["_safe_x0", "_safe_x1", "_safe_z0", "_safe_z1"]].to_numpy()).all(axis=1)
        out["_final"] = np.where(inside, _circle_within(nodes, xz[corner], origin), everywhere | (corner[:, 0] < 0))
        return out[columns]

    return solve


def _circle_within(nodes: pd.DataFrame, corners: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Whether each circle stays in the region whose points were all at hand."""
    offset = tri.circle_offset(corners[:, 0], corners[:, 1], corners[:, 2])
    centre = corners[:, 0] + offset + origin
    radius = np.sqrt((offset * offset).sum(-1)) * (1 + 1e-9)
    safe = nodes[["_safe_x0", "_safe_x1", "_safe_z0", "_safe_z1"]].to_numpy()
    with np.errstate(invalid="ignore"):
        return (
            (centre[:, 0] - radius > safe[:, 0])
            & (centre[:, 0] + radius < safe[:, 1])
            & (centre[:, 1] - radius > safe[:, 2])
            & (centre[:, 1] + radius < safe[:, 3])
        )


# --- linear: tiles and their surroundings ------------------------------------------------


def _tile_surroundings(tree: Tree) -> tuple[DataFrame, DataFrame]:
    """Leaves each tile borrows points from, and the region in which a tile knows all points.

    A tile borrows from leaves around it that are at most two levels coarser or one
    finer, so it stays bounded. If that covers every point of the 3 by 3 block of
    cells around it, the block is its known region, otherwise only its own cell.
    """
    keys = list(tree.keys)
    leaves = tree.leaves
    own = leaves.select(*keys, *(F.col(c).alias(n) for c, n in (("level", "_lv"), ("cx", "_lx"), ("cz", "_lz"))))
    at = [F.struct((F.col("_lx") + i).alias("x"), (F.col("_lz") + j).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = own.withColumn("_at", F.explode(F.array(*at)))

    def cell(level: Column, x: Column, z: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), x.cast("long").alias("cx"), z.cast("long").alias("cz"))

    x, z, level = F.col("_at.x"), F.col("_at.z"), F.col("_lv")
    near = [cell(level - up, F.floor(x / (1 << up)), F.floor(z / (1 << up))) for up in (0, 1, 2)]
    near += [cell(level + 1, 2 * x + i, 2 * z + j) for i in (0, 1) for j in (0, 1)]
    wanted = around.select(*keys, "_lv", "_lx", "_lz", F.explode(F.array(*near)).alias("_c"))
    wanted = wanted.select(*keys, "_lv", "_lx", "_lz", "_c.*").distinct()
    borrowed = wanted.join(leaves, [*keys, "level", "cx", "cz"])

    block = around.select(*keys, "_lv", "_lx", "_lz", F.col("_lv").alias("level"), x.alias("cx"), z.alias("cz"))
    in_block = block.join(tree.cells, [*keys, "level", "cx", "cz"])
    needed = in_block.groupBy(*keys, "_lv", "_lx", "_lz").agg(F.sum("n").alias("_needed"))
    # A borrowed coarser leaf covers a block cell alone; finer ones add up to it.
    finer = borrowed.filter(F.col("level") > F.col("_lv")).withColumns(
        {"_bx": F.shiftright("cx", 1), "_bz": F.shiftright("cz", 1)}
    )
    same = borrowed.filter(F.col("level") == F.col("_lv")).withColumns({"_bx": F.col("cx"), "_bz": F.col("cz")})
    counted = same.unionByName(finer).select(*keys, "_lv", "_lx", "_lz", "_bx", "_bz", "n")
    known = counted.groupBy(*keys, "_lv", "_lx", "_lz").agg(F.sum("n").alias("_known"))
    coarse = borrowed.filter(F.col("level") < F.col("_lv")).select(*keys, "_lv", "_lx", "_lz", "level", "cx", "cz")
    covered = (
        in_block.select(*keys, "_lv", "_lx", "_lz", F.col("cx").alias("_bx"), F.col("cz").alias("_bz"), "n")
        .join(coarse, [*keys, "_lv", "_lx", "_lz"])
        .filter(
            (F.floor(F.col("_bx") / F.pow(F.lit(2.0), (F.col("_lv") - F.col("level")).cast("double"))) == F.col("cx"))
            & (F.floor(F.col("_bz") / F.pow(F.lit(2.0), (F.col("_lv") - F.col("level")).cast("double"))) == F.col("cz"))
        )
        .groupBy(*keys, "_lv", "_lx", "_lz")
        .agg(F.sum("n").alias("_covered"))
    )
    tile = [*keys, "_lv", "_lx", "_lz"]
    whole = F.coalesce("_known", F.lit(0)) + F.coalesce("_covered", F.lit(0)) >= F.col("_needed")
    reach = needed.join(known, tile, "left").join(covered, tile, "left").select(*tile, F.when(whole, 1).otherwise(0).alias("_ring"))
    bounds = attach(reach, tree.box.drop("_count"), keys)
    cells = F.pow(F.lit(2.0), F.col("_lv").cast("double"))
    inf = float("inf")

    def side(low: str, span: str, index: str, offset: Column, outermost: Column, beyond: float) -> Column:
        return F.when(outermost, F.lit(beyond)).otherwise(F.col(low) + offset * (F.col(span) / cells))

    columns = {}
    for axis, low, span, index in (("x", "_x0", "_xs", "_lx"), ("z", "_z0", "_zs", "_lz")):
        first, last = F.col(index) - F.col("_ring"), F.col(index) + F.col("_ring") + 1
        columns[f"_safe_{axis}0"] = side(low, span, index, first, first <= 0, -inf)
        columns[f"_safe_{axis}1"] = side(low, span, index, last, last >= cells, inf)
    safe = bounds.select(*tile, *(c.alias(n) for n, c in columns.items()))
    lent = borrowed.select(*tile, F.col("level").alias("_from_lv"), F.col("cx").alias("_from_lx"), F.col("cz").alias("_from_lz"))
    return lent, safe


def _sheared(df: DataFrame) -> DataFrame:
    return df.withColumns({"_X": F.col("x") + SHEAR * F.col("z"), "_Z": (1.0 + SHEAR) * F.col("z")})


def _linear(
    points: DataFrame, nodes: DataFrame, keys: list[str], fields: list[str], tile_points: int
) -> DataFrame:
    cloud = _sheared(points).select(*keys, "_X", "_Z", F.array(*fields).alias("_values"))
    nodes = _sheared(nodes).select(*keys, *NODE, "x", "z", "_X", "_Z")
    tree = build_tree(cloud, keys, "_X", "_Z", tile_points)
    if tree.depth > 0:
        # Tiles and every round of the search join the points by their leaf.
        tree = replace(tree, points=spooled(tree.points))
    ends = durable(outermost(cloud, keys))

    own_tile = ["_lv", "_lx", "_lz"]
    if tree.depth == 0:
        placed = nodes.withColumns({c: F.lit(0).cast("int" if c == "_lv" else "long") for c in own_tile})
        inf = float("inf")
        placed = placed.withColumns(
            {"_safe_x0": F.lit(-inf), "_safe_x1": F.lit(inf), "_safe_z0": F.lit(-inf), "_safe_z1": F.lit(inf)}
        )
        lent = tree.points.select(*keys, *own_tile, "_X", "_Z", "_values")
    else:
        leaves = candidate_leaves(tree, nodes, NODE, "_X", "_Z")
        nearest = leaves.groupBy(*keys, *NODE, "x", "z", "_X", "_Z").agg(
            F.min(F.struct("_near", *own_tile)).alias("_leaf")
        )
        placed = nearest.select(*keys, *NODE, "x", "z", "_X", "_Z", *(F.col(f"_leaf.{c}").alias(c) for c in own_tile))
        borrowed, safe = _tile_surroundings(tree)
        placed = durable(attach(placed, safe, [*keys, *own_tile]))
        lending = tree.points.select(
            *keys, *(F.col(c).alias(f"_from{c}") for c in own_tile), "_X", "_Z", "_values"
        )
        lent = borrowed.join(lending, [*keys, "_from_lv", "_from_lx", "_from_lz"]).select(
            *keys, *own_tile, "_X", "_Z", "_values"
        )
    # A tile with very many nodes is solved in several chunks, each with the same points.
    chunks = placed.groupBy(*keys, *own_tile).agg(F.ceil(F.count(F.lit(1)) / TILE_NODES).cast("int").alias("_chunks"))
    chunks = durable(chunks)
    node_hash = F.xxhash64(*NODE)
    placed = attach(placed, chunks, [*keys, *own_tile]).withColumn(
        "_chunk", F.pmod(node_hash, F.col("_chunks").cast("long")).cast("int")
    )
    spread = chunks.select(*keys, *own_tile, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    columns = [*keys, *TILE, "_X", "_Z", "_values"]
    supply = attach(lent, spread, [*keys, *own_tile]).select(*columns).unionByName(attach(spread, ends, keys).select(*columns))
    # Both sides of the grouping stem from the same tables, so one side gets fresh columns.
    supply = supply.select(*(F.col(c).alias(c) for c in columns))

    schema = _state_schema(keys, nodes)
    solved = (
        placed.groupBy(*keys, *TILE)
        .cogroup(supply.groupBy(*keys, *TILE))
        .applyInPandas(_tile_solver(schema.fieldNames()), schema)
    )
    if tree.depth > 0:
        solved = _finish(durable(solved), tree, keys)
    return _evaluate(solved, keys, fields)


# --- linear: check against all points ------------------------------------------------------


def _finish(state: DataFrame, tree: Tree, keys: list[str]) -> DataFrame:
    """Improve the open triangles until none is left: with the point nearest to the centre of the circle, or farthest beyond the edge.

    Rows that are settled are written once; every round reads only the rows that are still open.
    """
    finished = [state.filter("_final")]
    pending = durable(state.filter("NOT _final"))
    columns = state.columns

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            corners = _corner_array(batch)
            offset = tri.circle_offset(corners[:, 0], corners[:, 1], corners[:, 2])
            centre = corners[:, 0] + offset
            along = corners[:, 1] - corners[:, 0]
            along /= np.hypot(*along.T)[:, None]
            outer = ~batch["_inside"].to_numpy(dtype=bool)
            batch["_cx"], batch["_cz"] = np.where(outer, -along[:, 1], centre[:, 0]), np.where(outer, along[:, 0], centre[:, 1])
            height = -along[:, 1] * corners[:, 0, 0] + along[:, 0] * corners[:, 0, 1]
            batch["_r2"] = np.where(outer, height, (offset * offset).sum(-1) * (1 + 1e-9))
            yield batch

    def improve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _improved(batch.reset_index(drop=True))[columns]

    asked_schema = T.StructType([*state.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("_cx", "_cz", "_r2"))])
    payload = ["_X", "_Z", "_values"]
    sized = durable(tree.box.select(*keys, F.greatest("_xs", "_zs").alias("_size")))
    for _ in range(tri.MAX_EXCHANGES):
        kinds = {r["_inside"] for r in pending.select("_inside").distinct().collect()}
        if not kinds:
            return reduce(DataFrame.unionByName, finished)
        asked = attach(pending.mapInPandas(asking, asked_schema), sized, keys)
        found = []
        if True in kinds:
            found.append(nearest_points(tree, asked.filter("_inside"), NODE, "_cx", "_cz", payload, within="_r2").drop("_d2"))
        if False in kinds:
            outer = asked.filter("NOT _inside").withColumn("_beyond", F.col("_r2") + tri.INSIDE_TOLERANCE * F.col("_size"))
            found.append(farthest_points(tree, outer, NODE, "_cx", "_cz", payload, beyond="_beyond"))
        entering = reduce(DataFrame.unionByName, found).select(
            *keys, *NODE, F.col("_X").alias("_in_x"), F.col("_Z").alias("_in_z"), F.col("_values").alias("_in_v")
        )
        joined = attach(pending, sized, keys).join(entering, [*keys, *NODE], "left")
        stepped = durable(joined.mapInPandas(improve, state.schema))
        finished.append(stepped.filter("_final"))
        pending = stepped.filter("NOT _final")
    raise RuntimeError("The search for an empty circle did not settle.")


def _corner_array(batch: pd.DataFrame) -> np.ndarray:
    return np.stack([batch[[f"{c}x", f"{c}z"]].to_numpy() for c in CORNERS], axis=1)


def _improved(batch: pd.DataFrame) -> pd.DataFrame:
    corners, entering = _corner_array(batch), batch[["_in_x", "_in_z"]].to_numpy(dtype=float)
    known, inside = ~np.isnan(entering[:, 0]), batch["_inside"].to_numpy(dtype=bool)
    offset = tri.circle_offset(corners[:, 0], corners[:, 1], corners[:, 2])
    moving = known & inside
    moving[moving] = tri.depth_inside(entering[moving], corners[moving, 0], offset[moving]) > 0
    rows = np.flatnonzero(moving)
    _swap_in(batch, rows, tri.exchange(batch[["_qx", "_qz"]].to_numpy()[rows], corners[rows], entering[rows]))

    # Outer triangles: the point found closes them, or gives an edge further out; an edge that a place lies on turns once.
    slack = tri.INSIDE_TOLERANCE * batch["_size"].to_numpy(dtype=float)
    place, a, b = batch[["_X", "_Z"]].to_numpy(), corners[:, 0], corners[:, 1]
    closing = np.flatnonzero(known & ~inside)
    step = tri.outer_step(place[closing], a[closing], b[closing], entering[closing], slack[closing])
    _swap_in(batch, closing, np.array([2, 1, 0])[step])
    shut = closing[step == 0]
    moved = tri.nudge(place[shut], _corner_array(batch.loc[shut])) if len(shut) else np.zeros((0, 2))
    batch.loc[shut, "_qx"], batch.loc[shut, "_qz"], batch.loc[shut, "_inside"] = moved[:, 0], moved[:, 1], True
    turning = np.flatnonzero(~known & ~inside & ~batch["_turned"].to_numpy(dtype=bool) & (tri.edge_height(place, a, b) <= slack))
    for of in ("x", "z", "v"):
        first = batch.loc[turning, f"a{of}"].copy()
        batch.loc[turning, f"a{of}"] = batch.loc[turning, f"b{of}"]
        batch.loc[turning, f"b{of}"] = first
    batch.loc[turning, "_turned"] = True
    batch["_final"] = True
    batch.loc[np.concatenate([rows, closing, turning]), "_final"] = False
    return batch


def _swap_in(batch: pd.DataFrame, rows: np.ndarray, corner: np.ndarray) -> None:
    """Put the entering point of each row into the place of a corner (0, 1 or 2)."""
    for k, name in enumerate(CORNERS):
        hit = rows[corner == k]
        batch.loc[hit, f"{name}x"] = batch.loc[hit, "_in_x"]
        batch.loc[hit, f"{name}z"] = batch.loc[hit, "_in_z"]
        batch.loc[hit, f"{name}v"] = batch.loc[hit, "_in_v"]


# --- linear: values ----------------------------------------------------------------------


def _evaluate(state: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Weights of the node in its triangle applied to the corner values; NULL outside the hull."""
    px, pz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    qx, qz = F.col("cx") - F.col("ax"), F.col("cz") - F.col("az")
    rx, rz = F.col("_X") - F.col("ax"), F.col("_Z") - F.col("az")
    area = px * qz - pz * qx
    weighted = state.withColumns(
        {"_wb": F.try_divide(rx * qz - rz * qx, area), "_wc": F.try_divide(px * rz - pz * rx, area)}
    ).withColumn("_wa", 1.0 - F.col("_wb") - F.col("_wc"))

    def value(i: int) -> Column:
        total = F.col("_wa") * F.col("av")[i] + F.col("_wb") * F.col("bv")[i] + F.col("_wc") * F.col("cv")[i]
        return F.when(F.col("_inside"), total)

    return weighted.select(*keys, *NODE, "x", "z", *(value(i).alias(f) for i, f in enumerate(fields)))
