"""Ordered rows per key, cut into tiles of bounded size.

A window partitioned by the key alone would put a whole series into one task.
``tile_rows`` numbers the rows of every key in order and, when some key has more
rows than a tile may hold, cuts each key into tiles of exactly ``tile_size``
rows. Rows near a tile edge are copied into the neighbour (the halo), so bounded
frames give the same answer as on the whole series. Running totals and carried
values add a per-tile summary from the earlier tiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldspark.plans.scale import attach, spooled

TILE_SIZE = 1_000_000
# monotonically_increasing_id keeps the partition number above this many bits.
ROW_BITS = 33
# Rows that a range partition holds at least while rows are numbered: the size of the tiles does not decide the number of tasks.
RANGE_ROWS = 100_000
# A double up to 2^31 added to this number keeps its multiple of 2^-20 only.
SPLIT_SHIFT = 1.5 * 2.0**32


@dataclass(frozen=True)
class Tiles:
    """Rows with ``_tile``, ``_rn`` (1-based per key), ``_n`` (rows of the key) and ``_core``."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    single: bool
    smallest_key: int

    @property
    def window(self) -> WindowSpec:
        if self.single:
            return Window.partitionBy(*self.keys).orderBy(*self.order)
        # The numbers keep rows that are equal in ``order`` in one order, in a tile and in the halos beside it.
        return Window.partitionBy(*self.keys, "_tile").orderBy("_rn")

    @property
    def reversed_window(self) -> WindowSpec:
        if self.single:
            return Window.partitionBy(*self.keys).orderBy(*map(F.desc, self.order))
        return Window.partitionBy(*self.keys, "_tile").orderBy(F.desc("_rn"))

    def with_columns(self, columns: dict[str, Column]) -> Tiles:
        return replace(self, rows=self.rows.withColumns(columns))

    def core(self) -> Tiles:
        """Drop the halo copies; every row is then present exactly once."""
        return self if self.single else replace(self, rows=self.rows.filter("_core"))

    def result(self, *columns: str) -> DataFrame:
        return self.core().rows.select(*columns)


def tile_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    halo: int = 0,
    tile_size: int = TILE_SIZE,
) -> Tiles:
    """Number the rows of each key by ``order`` (unique within a key) and tile them."""
    keys, order = tuple(keys), tuple(order)
    sizes = df.groupBy(*keys).count().agg(F.max("count"), F.min("count"), F.sum("count")).first()
    largest, smallest, total = (size or 0 for size in sizes)
    if largest <= tile_size:
        by_key = Window.partitionBy(*keys)
        rows = df.withColumns(
            {
                "_rn": F.row_number().over(by_key.orderBy(*order)).cast("long"),
                "_n": F.count(F.lit(1)).over(by_key),
                "_tile": F.lit(0).cast("long"),
                "_core": F.lit(True),
            }
        )
        return Tiles(rows, keys, order, True, smallest)
    if halo > tile_size:
        raise ValueError("A tile must hold at least as many rows as the halo.")
    numbered = number_rows(df, keys, order, max(2, -(-total // max(tile_size, RANGE_ROWS))))
    pos, tile = (F.col("_rn") - 1) % tile_size, F.floor((F.col("_rn") - 1) / tile_size)
    last_tile = F.floor((F.col("_n") - 1) / tile_size)
    copies = F.array(
        F.struct(tile.alias("_tile"), F.lit(True).alias("_core")),
        F.when((pos < halo) & (tile > 0), F.struct((tile - 1).alias("_tile"), F.lit(False).alias("_core"))),
        F.when(
            (pos >= tile_size - halo) & (tile < last_tile),
            F.struct((tile + 1).alias("_tile"), F.lit(False).alias("_core")),
        ),
    )
    rows = numbered.withColumn("_copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    rows = rows.select("*", "_copy._tile", "_copy._core").drop("_copy")
    return Tiles(rows, keys, order, False, smallest)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    """``_rn``, the place of each row in its key from 1, and ``_n``, the rows of the key.

    Rows go to range partitions, local positions and the offsets of the partitions make the numbers. No key may be NULL.
    """
    # The written table fixes which partition each row fell into.
    ranged = spooled(
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part, local = F.shiftright("_id", ROW_BITS), F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    ranged = ranged.withColumns({"_part": part, "_local": local}).drop("_id")
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(by_key).alias("_n"),
    )
    return (
        attach(ranged, runs, [*keys, "_part"])
        .withColumn("_rn", F.col("_local") + F.col("_shift"))
        .drop("_part", "_local", "_shift")
    )


def split(value: Column) -> tuple[Column, Column]:
    """``value`` as a multiple of 2^-20, whose sums have no rounding error below 2^33, and the small rest.

    Values of 2^31 and more, infinities and NaN stay whole.
    """
    small = F.abs(value) < F.lit(2.0**31)
    exact = F.when(small, (value + F.lit(SPLIT_SHIFT)) - F.lit(SPLIT_SHIFT)).otherwise(value)
    return exact, F.when(small, value - exact).otherwise(0.0)


def running_sum(tiles: Tiles, value: Column, name: str, apart: bool = False) -> Tiles:
    """Cumulative sum of ``value`` in order, NULL counted as zero.

    With ``apart`` the exact parts and the rests are summed apart, so that rounding errors do not pile up along a long series.
    """
    value = F.coalesce(value, F.lit(0.0))
    exact, rest = split(value) if apart else (value, F.lit(0.0))
    core = tiles.core().with_columns({"_inc": exact, "_rest": rest})
    upto = core.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = core.with_columns({"_inc": F.sum("_inc").over(upto), "_rest": F.sum("_rest").over(upto)})
    if tiles.single:
        return replace(local, rows=local.rows.withColumn(name, F.col("_inc") + F.col("_rest")).drop("_inc", "_rest"))
    totals = core.rows.groupBy(*core.keys, "_tile").agg(F.sum("_inc").alias("_total"), F.sum("_rest").alias("_total_rest"))
    earlier = Window.partitionBy(*core.keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *core.keys,
        "_tile",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_offset"),
        F.coalesce(F.sum("_total_rest").over(earlier), F.lit(0.0)).alias("_offset_rest"),
    )
    rows = attach(local.rows, offsets, [*core.keys, "_tile"])
    total = (F.col("_inc") + F.col("_offset")) + (F.col("_rest") + F.col("_offset_rest"))
    return replace(local, rows=rows.withColumn(name, total).drop("_inc", "_rest", "_offset", "_offset_rest"))


def nearest_marked(tiles: Tiles, marked: Column, value: Column, before: str, after: str) -> Tiles:
    """Add the latest marked ``value`` at or before each row and the first one at or after it."""
    core = tiles.core().with_columns({"_mark": F.when(marked, value)})
    # Looking ahead is looking back in descending order: a frame that starts at the
    # current row and ends at the partition's end would be read anew for every row.
    upto = (Window.unboundedPreceding, Window.currentRow)
    local = core.with_columns(
        {
            before: F.last("_mark", ignorenulls=True).over(core.window.rowsBetween(*upto)),
            after: F.last("_mark", ignorenulls=True).over(core.reversed_window.rowsBetween(*upto)),
        }
    )
    if tiles.single:
        return replace(local, rows=local.rows.drop("_mark"))
    # min_by and max_by skip the unmarked rows because their ordering value is NULL.
    at_mark = F.when(F.col("_mark").isNotNull(), F.col("_rn"))
    ends = core.rows.groupBy(*core.keys, "_tile").agg(
        F.max_by("_mark", at_mark).alias("_last"), F.min_by("_mark", at_mark).alias("_first")
    )
    by_key, earlier = Window.partitionBy(*core.keys), (Window.unboundedPreceding, -1)
    carried = ends.select(
        *core.keys,
        "_tile",
        F.last("_last", ignorenulls=True)
        .over(by_key.orderBy("_tile").rowsBetween(*earlier))
        .alias("_carry_in"),
        F.last("_first", ignorenulls=True)
        .over(by_key.orderBy(F.desc("_tile")).rowsBetween(*earlier))
        .alias("_carry_back"),
    )
    rows = attach(local.rows, carried, [*core.keys, "_tile"]).withColumns(
        {before: F.coalesce(before, "_carry_in"), after: F.coalesce(after, "_carry_back")}
    )
    return replace(local, rows=rows.drop("_mark", "_carry_in", "_carry_back"))
