"""Interpolation against brute force, in one tile and cut into many."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import grid
from fieldspark.operators.quadtree import build_tree
from fieldspark.operators.regrid import regrid

SETS = ["comparison_set"]


def frame(spark, x, z, **fields):
    names = ["comparison_set", "case", "x", "z", *fields]
    rows = [("s", "N5", float(a), float(b), *map(float, f)) for a, b, *f in zip(x, z, *fields.values(), strict=True)]
    types = ["comparison_set string", "case string", *(f"{n} double" for n in names[2:])]
    return spark.createDataFrame(rows, ", ".join(types))


def grid_of(spark, xs, zs):
    rows = [("s", j, i, float(a), float(b)) for j, b in enumerate(zs) for i, a in enumerate(xs)]
    return spark.createDataFrame(rows, "comparison_set string, iz int, ix int, x double, z double")


def collected(df, *fields):
    return {(r["iz"], r["ix"]): tuple(r[f] for f in fields) for r in df.collect()}


def brute_linear(points, values, places):
    """Value in the triangle with the empty circle around each place; NaN outside all of them."""
    a, b, c = (points[list(ids)] for ids in zip(*itertools.combinations(range(len(points)), 3), strict=True))
    index = np.array(list(itertools.combinations(range(len(points)), 3)))
    p, q = b - a, c - a
    d = 2 * (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0])
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    o = a + np.stack((q[:, 1] * pp - p[:, 1] * qq, p[:, 0] * qq - q[:, 0] * pp), 1) / d[:, None]
    r2 = ((a - o) ** 2).sum(1)
    inside = ((points[None] - o[:, None]) ** 2).sum(2) < r2[:, None] * (1 - 1e-10)
    own = np.zeros_like(inside)
    own[np.arange(len(index))[:, None], index] = True
    keep = ~(inside & ~own).any(1)
    a, p, q, d, index = a[keep], p[keep], q[keep], d[keep], index[keep]
    out = np.full(len(places), np.nan)
    for i, place in enumerate(places):
        r = place - a
        wb = 2 * (r[:, 0] * q[:, 1] - r[:, 1] * q[:, 0]) / d
        wc = 2 * (p[:, 0] * r[:, 1] - p[:, 1] * r[:, 0]) / d
        least = np.minimum(np.minimum(wb, wc), 1 - wb - wc)
        best = least.argmax()
        if least[best] >= -1e-12:
            v = values[index[best]]
            out[i] = v[0] * (1 - wb[best] - wc[best]) + v[1] * wb[best] + v[2] * wc[best]
    return out


def clustered(n=60, seed=7):
    """A third of the points in one tiny spot."""
    rng = np.random.default_rng(seed)
    points = rng.random((n, 2))
    points[: n // 3] = 0.31 + 1e-3 * rng.random((n // 3, 2))
    return points, rng.random(n)


@pytest.mark.parametrize("tile_points", [1000, 6])
def test_linear_matches_brute_force(spark, tile_points):
    points, values = clustered()
    xs, zs = np.linspace(0.02, 0.98, 9), np.linspace(0.02, 0.98, 8)
    xs[3], zs[2] = 0.3104, 0.3107  # one line of nodes runs through the cluster
    result = regrid(
        frame(spark, points[:, 0], points[:, 1], v=values),
        grid_of(spark, xs, zs),
        ["v"],
        tile_points=tile_points,
    )
    got = collected(result, "v")
    places = np.array([(a, b) for b in zs for a in xs])
    want = brute_linear(points, values, places)
    assert len(got) == len(places)
    for (j, b), (i, a) in itertools.product(enumerate(zs), enumerate(xs)):
        expected = want[j * len(xs) + i]
        if np.isnan(expected):
            assert got[j, i][0] is None
        else:
            assert got[j, i][0] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("leaf_size", [1000, 2])
def test_nearest_matches_brute_force(spark, leaf_size):
    points, values = clustered()
    xs, zs = np.linspace(-0.3, 1.3, 11), np.linspace(0.0, 1.0, 7)
    result = regrid(
        frame(spark, points[:, 0], points[:, 1], v=values),
        grid_of(spark, xs, zs),
        ["v"],
        method="nearest",
        leaf_size=leaf_size,
    )
    got = collected(result, "v")
    for (j, b), (i, a) in itertools.product(enumerate(zs), enumerate(xs)):
        nearest = ((points - (a, b)) ** 2).sum(1).argmin()
        assert got[j, i][0] == pytest.approx(values[nearest])


def test_dense_cluster_is_cut_finer(spark):
    points, values = clustered(300)
    df = frame(spark, points[:, 0], points[:, 1], v=values)
    tree = build_tree(df, ["comparison_set", "case"], "x", "z", 8)
    sizes = tree.points.groupBy("_lv", "_lx", "_lz").count().collect()
    assert max(r["count"] for r in sizes) <= 8
    assert sum(r["count"] for r in sizes) == 300
    assert tree.leaves.agg(F.sum("n")).first()[0] == 300


def test_linear_reproduces_a_plane(spark):
    points = frame(spark, [0, 1, 0, 1], [0, 0, 1, 1], v=[1, 3, 4, 6])
    nodes = grid_of(spark, np.linspace(0, 1, 5), np.linspace(0, 1, 4))
    for (iz, ix), (v,) in collected(regrid(points, nodes, ["v"]), "v").items():
        assert v == pytest.approx(2 * ix / 4 + 3 * iz / 3 + 1, abs=1e-14)


def test_rectangular_layout_does_not_depend_on_tiles(spark):
    """All cells are cocircular here; the diagonal must not depend on the cut."""
    rng = np.random.default_rng(3)
    x, z = np.meshgrid(np.arange(9.0), np.arange(7.0))
    points = frame(spark, x.ravel(), z.ravel(), v=rng.random(63))
    nodes = grid_of(spark, np.linspace(0, 8, 12), np.linspace(0, 6, 11))
    whole = collected(regrid(points, nodes, ["v"], tile_points=1000), "v")
    cut = collected(regrid(points, nodes, ["v"], tile_points=5), "v")
    assert whole.keys() == cut.keys()
    for key, (v,) in whole.items():
        assert v is not None
        assert cut[key][0] == pytest.approx(v, abs=1e-9)


def test_duplicates_are_averaged_first(spark):
    points = frame(spark, [0, 0, 1, 0, 1], [0, 0, 0, 1, 1], v=[1, 3, 3, 4, 6])
    got = collected(regrid(points, grid_of(spark, [0, 1], [0, 1]), ["v"]), "v")
    assert [got[k][0] for k in ((0, 0), (0, 1), (1, 0), (1, 1))] == pytest.approx([2, 3, 4, 6])


def test_fields_with_different_gaps_use_their_own_points(spark):
    nan = float("nan")
    points = frame(spark, [0, 1, 0, 1, 0.5], [0, 0, 1, 1, 0.5], a=[0, 0, 0, 0, 1], b=[0, 0, 0, 0, nan])
    got = collected(regrid(points, grid_of(spark, [0.5], [0.5]), ["a", "b"]), "a", "b")
    assert got[0, 0] == pytest.approx((1.0, 0.0))


def test_points_on_a_line_give_no_value(spark):
    points = frame(spark, [0, 1, 2], [0, 1, 2], v=[1, 2, 3])
    assert collected(regrid(points, grid_of(spark, [0, 1], [0, 1]), ["v"]), "v")[0, 0] == (None,)


def test_raw_nearest_keeps_the_least_value(spark):
    points = frame(spark, [0, 0, 1], [0, 0, 1], v=[5, 4, 9])
    got = collected(regrid(points, grid_of(spark, [0, 1], [0]), ["v"], method="nearest", deduplicate=False), "v")
    assert got[0, 0] == (4.0,)


def test_grid_covers_the_common_domain(spark):
    rows = [("N5", -2, -3), ("N5", 4, 5), ("N7", 0, -1), ("N7", 6, 3), ("N9", -1, -2), ("N9", 2, 4)]
    points = spark.createDataFrame([("s", c, float(x), float(z)) for c, x, z in rows], "comparison_set string, case string, x double, z double")
    nodes = grid.make_grid(grid.common_domain(points, SETS), SETS, 3, 5).collect()
    assert {(r["ix"], r["x"]) for r in nodes} == {(0, 0.0), (1, 1.0), (2, 2.0)}
    assert {(r["iz"], r["z"]) for r in nodes} == {(i, float(i - 1)) for i in range(5)}


def test_disjoint_domains_fail(spark):
    points = spark.createDataFrame(
        [("s", c, x, z) for c, x in (("N5", 0.0), ("N5", 1.0), ("N7", 2.0), ("N7", 3.0)) for z in (0.0, 1.0)],
        "comparison_set string, case string, x double, z double",
    )
    with pytest.raises(Exception, match="overlapping x-z domain"):
        grid.common_domain(points, SETS).collect()


def _in_hull(place, cloud):
    """Whether the directions to the points leave no half-plane free; on the border counts as inside."""
    off = cloud - place
    if (np.hypot(*off.T) < 1e-12).any():
        return True
    angles = np.sort(np.arctan2(off[:, 1], off[:, 0]))
    return np.diff(np.append(angles, angles[0] + 2 * np.pi)).max() <= np.pi + 1e-9


@pytest.mark.parametrize("shape", ["ring", "two spots", "steps", "line"])
def test_nodes_outside_the_hull_are_those_without_a_value_in_every_tiling(spark, shape):
    """Most nodes lie outside the points of their tile, many outside all, and some on the border."""
    rng = np.random.default_rng(11)
    if shape == "ring":
        angle = rng.uniform(0, 2 * np.pi, 400)
        cloud = np.stack([np.cos(angle), np.sin(angle)], -1) * rng.uniform(0.9, 1.0, 400)[:, None]
    elif shape == "two spots":
        cloud = np.vstack([rng.normal(-1, 0.01, (200, 2)), rng.normal(1, 0.01, (200, 2)), [[-1.0, 1.0]]])
    elif shape == "steps":
        cloud = np.array([(x, z) for x in range(-5, 6) for z in range(-5, 6) if x + z <= 2], dtype=float) / 5
    else:
        cloud = np.stack([np.linspace(-1, 1, 200)] * 2, -1)
    values = 2 * cloud[:, 0] - 3 * cloud[:, 1] + 1
    points = spark.createDataFrame(
        [("s", "a", float(x), float(z), float(v)) for (x, z), v in zip(cloud, values, strict=True)], "comparison_set string, case string, x double, z double, C double"
    )
    nodes = spark.createDataFrame([("s", j, i, i / 4 - 1.25, j / 4 - 1.25) for i in range(11) for j in range(11)], "comparison_set string, iz int, ix int, x double, z double")
    for size in (16, 100_000):
        got = regrid(points, nodes, ["C"], tile_points=size).collect()
        assert len(got) == 121
        for r in got:
            inside = shape != "line" and _in_hull(np.array([r["x"], r["z"]]), cloud)
            assert (r["C"] is not None) == inside, (size, r)
            assert not inside or r["C"] == pytest.approx(2 * r["x"] - 3 * r["z"] + 1, abs=1e-9)
