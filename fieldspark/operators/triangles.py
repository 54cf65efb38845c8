"""Numpy helpers that run inside tasks: the triangle around a place among some points.

The Delaunay triangle around a place is found by exchange. It starts from an outer triangle: an edge between two points,
with the place on its left, whose third corner lies at infinity and stands for "outside the hull". Its circle is the
half-plane left of the edge. The deepest point there makes a triangle with the edge that holds the place, or one of two
new edges beyond which the place lies. Without a point there the place is outside. From the first finite triangle on,
the deepest point inside the circumcircle is swapped in until the circle is empty.
"""

from __future__ import annotations

import numpy as np

# A point counts as inside a circle only beyond this share of its distance scale.
CIRCLE_TOLERANCE = 1e-11
INSIDE_TOLERANCE = 1e-12
MAX_EXCHANGES = 2000
CHUNK = 512


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def circle_offset(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Circumcentre minus the first corner."""
    p, q = b - a, c - a
    twice = 2.0 * _cross(p, q)
    pp, qq = (p * p).sum(-1), (q * q).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack((q[..., 1] * pp - p[..., 1] * qq, p[..., 0] * qq - q[..., 0] * pp), -1) / twice[..., None]


def depth_inside(point: np.ndarray, a: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Positive where the point is inside the circle by more than rounding."""
    away = point - a
    square = (away * away).sum(-1)
    power = square - 2.0 * (away * offset).sum(-1)
    scale = square + np.sqrt(square * (offset * offset).sum(-1))
    return np.where(power < -CIRCLE_TOLERANCE * scale, -power, 0.0)


def weights(place: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Barycentric weights; -inf where the triangle is flat."""
    p, q, r = b - a, c - a, place - a
    area = _cross(p, q)
    flat = np.abs(area) <= 1e-14 * np.sqrt((p * p).sum(-1) * (q * q).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        wb, wc = _cross(r, q) / area, _cross(p, r) / area
    out = np.stack((1.0 - wb - wc, wb, wc), -1)
    return np.where(flat[..., None], -np.inf, out)


def exchange(place: np.ndarray, corners: np.ndarray, entering: np.ndarray) -> np.ndarray:
    """Corner (0, 1 or 2) of each triangle that the entering point replaces."""
    options = []
    for k in range(3):
        swapped = corners.copy()
        swapped[:, k] = entering
        options.append(weights(place, swapped[:, 0], swapped[:, 1], swapped[:, 2]).min(-1))
    return np.stack(options, -1).argmax(-1)


def outer_step(place: np.ndarray, a: np.ndarray, b: np.ndarray, deepest: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """What becomes of an edge a-b with the place, and the deepest point, on its left.

    0: the three points hold the place; 1: the place is beyond the edge from a to the point; 2: beyond that from the point to b.
    """
    beyond_a = _cross(deepest - a, place - a) / np.maximum(np.hypot(*(deepest - a).T), 1e-300)
    beyond_b = _cross(b - deepest, place - deepest) / np.maximum(np.hypot(*(b - deepest).T), 1e-300)
    beyond = np.maximum(beyond_a, beyond_b)
    return np.where(beyond <= slack, 0, np.where(beyond_a >= beyond_b, 1, 2))


def edge_height(place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the place lies on the left of the edge a-b."""
    return _cross(b - a, place - a) / np.maximum(np.hypot(*(b - a).T), 1e-300)


def first_triangles(places: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Point numbers (a, b, c) of a triangle that holds each place; c is -1 where the place is left of a-b and no point is.

    An edge that a place lies on, with no point on its left, is turned around once.
    """
    found = np.full((len(places), 3), -1, dtype=np.int64)
    turned = np.zeros(len(places), dtype=bool)
    order = np.lexsort((points[:, 1], points[:, 0]))
    size = np.ptp(points, axis=0).max() if len(points) else 0.0
    if size == 0.0:
        return found
    slack = INSIDE_TOLERANCE * size
    found[:, 0], found[:, 1] = order[0], order[-1]
    under = edge_height(places, points[found[:, 0]], points[found[:, 1]]) < 0
    found[under, 0], found[under, 1] = order[-1], order[0]
    for start in range(0, len(places), CHUNK):
        active = np.arange(start, min(start + CHUNK, len(places)))
        while len(active):
            a, b, place = points[found[active, 0]], points[found[active, 1]], places[active]
            along = (b - a) / np.hypot(*(b - a).T)[:, None]
            normal = np.stack((-along[:, 1], along[:, 0]), -1)
            score = normal @ points.T
            deepest = score.argmax(axis=1)
            deep = score[np.arange(len(active)), deepest] - (normal * a).sum(-1) > slack
            step = outer_step(place, a, b, points[deepest], np.full(len(active), slack))
            flip = ~deep & ~turned[active] & (edge_height(place, a, b) <= slack)
            inside, left, right = (deep & (step == k) for k in range(3))
            found[active[inside], 2] = deepest[inside]
            found[active[left], 1] = deepest[left]
            found[active[right], 0] = deepest[right]
            found[active[flip], :2] = found[active[flip], 1::-1]
            turned[active[flip]] = True
            active = active[left | right | flip]
    return found


def nudge(places: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Move each place a hair towards the middle of its first triangle, off edges and corners."""
    return places + 1e-9 * (corners.mean(axis=1) - places)


def triangulate_around(places: np.ndarray, points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Exchange until no circle holds a point; rows of ``triangles`` index ``points``."""
    result = triangles.copy()
    for start in range(0, len(places), CHUNK):
        active = np.arange(start, min(start + CHUNK, len(places)))
        for _ in range(MAX_EXCHANGES):
            if not len(active):
                break
            corners = points[result[active]]
            a = corners[:, 0]
            offset = circle_offset(a, corners[:, 1], corners[:, 2])
            centre = a + offset
            # Least squared distance to the centre, up to a constant per row.
            score = (points * points).sum(-1)[None] - 2.0 * centre @ points.T
            deepest = score.argmin(axis=1)
            moving = depth_inside(points[deepest], a, offset) > 0
            active, deepest, corners = active[moving], deepest[moving], corners[moving]
            if len(active):
                out = exchange(places[active], corners, points[deepest])
                result[active, out] = deepest
        if len(active):
            raise RuntimeError("The search for an empty circle did not settle.")
    return result
