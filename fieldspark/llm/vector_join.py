"""Embedding near-duplicates by an epsilon grid order join.

1. Every usable vector is scaled to length 1, so cosine >= c means distance <= eps = sqrt(2 - 2c). Equal vectors are one
   representative with a multiplicity, so exact copies never meet as pairs.
2. Spark adds up the second moments of all representatives; their leading eigenvectors are the principal axes.
3. The representatives are put into epsilon grid order: cells of side eps along the axes, compared axis by axis. They are
   numbered through range partitions of the order, which is cut into tiles of ``TILE`` vectors.
4. Sequence intervals are joined recursively. An interval is described by its bounds along the axes and by the bounds of
   the lengths left over; two intervals whose bounds are further apart than eps hold no link, and nothing below
   them is looked at. From all tiles down to pairs of tiles these are equi-joins of the small tables of bounds; inside a
   pair of tiles, one bounded group, it goes on down to runs of ``LEAF`` vectors, whose cosines are computed in double precision.
5. A group returns link counts and one root per vector of the parts it has joined, never the pairs. Components of the roots
   are found by large-star and small-star steps.

The bounds are exact, so the axes and the order influence the time alone, not the result.

Defined cases: vectors that are NULL, empty or zero or hold NULL or non-finite components link with nothing and stay alone,
as do rows with a NULL id, whose class is NULL and which are kept; vectors of unequal length are compared as if the
shorter one went on with zeros; repeated rows are copies and link with each other; a repeated id with another vector is a
vector of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.near_duplicates import components
from fieldspark.llm.text import attach, ship, spooled
from fieldspark.operators.ordered import number_rows

COSINE = 0.95
TILE = 16_384
LEAF = 128
# Vectors of a range partition in which they are numbered, where there are more than the session's partitions.
RUN_ROWS = 200_000
AXES = 8
# Only so many leading components of a vector shape the axes; any axes are valid.
SHAPING = 512
# Tiles and runs are grouped by this power of two from level to level.
_STEP = 2
# Cosines this close to the threshold are computed once more, from the unscaled vectors.
_NEAR = 1e-12


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; short ones go on with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of the largest component so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and the digest of the vector; NULL where it cannot link."""
    for batch in batches:
        column = batch.column("vector")
        names = []
        for value in column:
            row = None if value.as_py() is None else value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            usable = row is not None and len(row) and np.isfinite(row).all() and row.any()
            names.append(blake2b(np.trim_zeros(row, "b").tobytes(), digest_size=16).digest() if usable else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.binary()), column], names=["id", "digest", "vector"])


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = _unit(_matrix(batch.column("vector").slice(at, 1000), width=max(width, _longest(batch))))[:, :width]
                rows = np.hstack([rows, np.ones((len(rows), 1))])
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    return run


def _longest(batch: pa.RecordBatch) -> int:
    return int(np.diff(batch.column("vector").offsets.to_numpy()).max(initial=0))


def principal_axes(reps: DataFrame, width: int, n_axes: int = AXES) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the leading principal axes (width, n_axes) of unit vectors."""
    shaping = min(width, SHAPING)
    sums = reps.select("vector").mapInArrow(_moments(shaping), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.zeros((shaping + 1) ** 2)
    for row in sums.collect():
        total[row["place"]] = row["value"]
    total = total.reshape(shaping + 1, -1)
    count = max(1.0, total[-1, -1])
    mean = total[-1, :-1] / count
    axes = np.linalg.eigh(total[:-1, :-1] / count - np.outer(mean, mean))[1][:, ::-1][:, :n_axes]
    return np.pad(mean, (0, width - shaping)), np.pad(axes, ((0, width - shaping), (0, 0)))


def places_of(units: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates along the axes, and the length of what is left over. Distances between rows are not less than between these."""
    off = units - mean
    along = off @ axes
    rest = off - along @ axes.T
    return np.hstack([along, np.sqrt((rest * rest).sum(axis=1, keepdims=True))])


def _placed(width: int, mean: np.ndarray, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                place = places_of(_unit(_matrix(part.column("vector"), width)), mean, axes)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in place.T.copy()]], names=[*part.schema.names, *[f"p{k}" for k in range(place.shape[1])]])

    return run


def _apart(low_a: list[Column], high_a: list[Column], low_b: list[Column], high_b: list[Column]) -> Column:
    """Squared distance of two boxes."""
    gaps = [F.greatest(la - hb, lb - ha, F.lit(0.0)) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b, strict=True)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def interval_pairs(bounds: DataFrame, limit: float) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose bounds are not further apart than the squared distance ``limit``.

    ``bounds`` has a tile's number and its lowest and highest places l0.., h0... Tiles are joined into ever longer
    intervals of the order; then pairs of intervals are taken apart again, as far as their bounds are near.
    """
    n = sum(c.startswith("l") for c in bounds.columns)
    levels = [bounds.withColumnRenamed("tile", "part")]
    largest = bounds.agg(F.coalesce(F.max("tile"), F.lit(0))).first()[0]
    while largest > 0:
        wider = levels[-1].groupBy(F.shiftright("part", _STEP).alias("part"))
        levels.append(wider.agg(*[F.min(f"l{k}").alias(f"l{k}") for k in range(n)], *[F.max(f"h{k}").alias(f"h{k}") for k in range(n)]))
        largest >>= _STEP
    pairs = levels[-1].select(F.col("part").alias("a"), F.col("part").alias("b"))
    for level in reversed(levels[:-1]):
        sides = []
        for s in "ab":
            kept = [F.shiftright("part", _STEP).alias(s), F.col("part").alias(f"{s}_"), *[F.col(f"{e}{k}").alias(f"{s}{e}{k}") for e in "lh" for k in range(n)]]
            sides.append(level.select(*kept))
        boxes = [[F.col(f"{s}{e}{k}") for k in range(n)] for s in "ab" for e in "lh"]
        near = pairs.join(sides[0], "a").join(sides[1], "b").filter((F.col("a_") <= F.col("b_")) & (_apart(*boxes) <= limit))
        pairs = near.select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    return pairs


class _Side:
    """One tile inside a group: rows in order, and the bounds of its runs, level by level."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, mean: np.ndarray, axes: np.ndarray):
        self.raw, self.weight = vectors, weight.astype(np.float64)
        self.units = _unit(vectors)
        place = places_of(self.units, mean, axes)
        self.starts = np.arange(0, len(place), LEAF)
        self.levels = [(np.minimum.reduceat(place, self.starts), np.maximum.reduceat(place, self.starts))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            cut = np.arange(0, len(low), 1 << _STEP)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        self.links = np.zeros(len(vectors))

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[min(k, len(self.levels) - 1)]


def leaf_pairs(a: _Side, b: _Side, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs of runs that are not provably apart, found by taking pairs of intervals apart."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        (la, ha), (lb, hb) = a.level(k), b.level(k)
        if k < top:
            fan = np.arange(1 << _STEP)
            grow = [k < len(s.levels) - 1 for s in (a, b)]
            left, right = ((x[:, None] << _STEP) + fan if g else x[:, None] for x, g in zip((left, right), grow, strict=True))
            left, right = (np.broadcast_to(x, (len(left), left.shape[1], right.shape[1])).ravel() for x in (left[:, :, None], right[:, None, :]))
            there = (left < len(la)) & (right < len(lb))
            left, right = left[there], right[there]
        if same:
            left, right = left[left <= right], right[left <= right]
        gap = np.maximum(np.maximum(la[left] - hb[right], lb[right] - ha[left]), 0.0)
        near = (gap * gap).sum(axis=1) <= limit
        left, right = left[near], right[near]
    yield from zip(left.tolist(), right.tolist(), strict=True)


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    root = parent[of]
    while not np.array_equal(further := parent[root], root):
        root = further
    return root


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of each u and v; the least number becomes the root."""
    while len(u):
        u, v = _roots(parent, u), _roots(parent, v)
        apart = u != v
        u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        np.minimum.at(parent, u, v)


def join_sides(a: _Side, b: _Side, cosine: float) -> np.ndarray:
    """Add the links of two tiles (or of one with itself) to their counts; the roots of the rows of a, then b."""
    same = a is b
    first = 0 if same else len(a.units)
    parent = np.arange(len(a.units) + (0 if same else len(b.units)))
    limit = squared_reach(cosine)
    for i, j in leaf_pairs(a, b, limit):
        rows, columns = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        value = a.units[rows] @ b.units[columns].T
        linked = value >= cosine
        for r, c in np.argwhere(np.abs(value - cosine) <= _NEAR):
            x, y = a.raw[i * LEAF + r], b.raw[j * LEAF + c]
            linked[r, c] = float(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine
        if same and i == j:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        a.links[rows] += linked @ b.weight[columns]
        if not (same and i == j):
            b.links[columns] += a.weight[rows] @ linked
        u, v = np.nonzero(linked)
        _unite(parent, u + i * LEAF, v + j * LEAF + first)
    return _roots(parent, np.arange(len(parent)))


def squared_reach(cosine: float) -> float:
    """The squared distance of unit vectors at the threshold, with room for rounding."""
    return (2 - 2 * cosine) * (1 + 1e-9) + 1e-12


def _joined(cosine: float, width: int, mean: np.ndarray, axes: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("second", "ascending"), ("seq", "ascending")])
        seq = group.column("seq").to_numpy()
        cut = int(len(seq) - group.column("second").to_numpy().sum())
        vectors = _matrix(group.column("vector").combine_chunks() if group.num_rows else pa.array([], pa.list_(pa.float64())), width)
        weight = group.column("copies").to_numpy()
        a = _Side(vectors[:cut], weight[:cut], mean, axes)
        b = a if cut == len(seq) else _Side(vectors[cut:], weight[cut:], mean, axes)
        root = join_sides(a, b, cosine)
        links = np.rint(a.links if b is a else np.concatenate([a.links, b.links])).astype(np.int64)
        some = links > 0
        return pa.table({"seq": seq[some], "links": links[some], "root": seq[root][some]})

    return run


def _links(ordered: DataFrame, pairs: DataFrame, cosine: float, width: int, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(seq, links, root) of the linked rows of every pair of tiles."""
    first = F.struct(F.col("a").alias("tile"), F.lit(0).alias("second"))
    second = F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("tile"), F.lit(1).alias("second")))
    members = pairs.select("a", "b", F.explode(F.array_compact(F.array(first, second))).alias("m")).select("a", "b", "m.tile", "m.second")
    rows = ordered.select("tile", "seq", "copies", "vector").join(members, "tile")
    return rows.select("a", "b", "second", "seq", "copies", "vector").groupBy("a", "b").applyInArrow(_joined(cosine, width, mean, axes), "seq long, links long, root long")


def near_vector_classes(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE, tile: int = TILE
) -> DataFrame:
    """One row per row of ``vectors``: the id, n_links, component_id and kept (it is the id of its class)."""
    ship(vectors.sparkSession)
    source = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    named = spooled(source.mapInArrow(_digests, T.StructType([source.schema["id"], T.StructField("digest", T.BinaryType()), source.schema["vector"]])))
    usable = named.filter("digest is not null and id is not null")
    reps = spooled(usable.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    count, width = reps.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    mean, axes = principal_axes(reps, width)
    n = axes.shape[1]
    side = float(np.sqrt(squared_reach(cosine)))
    placed = reps.mapInArrow(_placed(width, mean, axes), T.StructType([*reps.schema.fields, *[T.StructField(f"p{k}", T.DoubleType()) for k in range(n + 1)]]))
    # The digest tells rows of one cell apart, so no cell is too large for a tile. Tiles are cut by the number of a row in
    # the whole order, so their size does not depend on the partitions.
    cells = {f"c{k}": F.floor(F.col(f"p{k}") / side) for k in range(n)}
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // RUN_ROWS)
    ordered = number_rows(placed.withColumns({"whole": F.lit(0), **cells}), ["whole"], [*cells, "digest"], parts)
    ordered = ordered.withColumn("seq", F.col("_rn") - 1).withColumn("tile", F.floor(F.col("seq") / tile)).drop("whole", "_rn", "_n", *cells)
    spans = [f(f"p{k}").alias(f"{e}{k}") for e, f in (("l", F.min), ("h", F.max)) for k in range(n + 1)]
    pairs = spooled(interval_pairs(spooled(ordered.groupBy("tile").agg(*spans)), squared_reach(cosine)))
    found = spooled(_links(ordered, pairs, cosine, width, mean, axes))

    links = found.groupBy("seq").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("seq").alias("a"), F.col("root").alias("b")).filter("a != b"))
    facts = ordered.select("seq", "digest", "least", "copies").join(links, "seq", "left")
    facts = facts.join(labels.withColumnRenamed("id", "seq"), "seq", "left").withColumn("class", F.coalesce("component", "seq"))
    classes = facts.groupBy("class").agg(F.min("least").alias("component_id"))
    facts = facts.join(classes, "class").select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    known = F.col("id").isNotNull()
    return attach(named.select("id", "digest"), facts, ["digest"], "left").select(
        F.col("id").alias(id_column),
        F.when(known, F.coalesce("links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links"),
        F.when(known, F.coalesce("component_id", "id")).alias("component_id"),
        (~known | (F.col("id") == F.coalesce("component_id", "id"))).alias("kept"),
    )


def classes_sql(cosine: float = COSINE) -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r AND list_cosine_similarity(a.x, b.x) >= {cosine}),
degree AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a),
reach(r, root) AS (SELECT r, vec_id FROM usable UNION SELECT l.b, reach.root FROM reach JOIN link l ON l.a = reach.r),
least AS (SELECT r, min(root) AS component_id FROM reach GROUP BY r)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), true) AS kept
FROM v LEFT JOIN degree USING (r) LEFT JOIN least USING (r)"""
