"""Work that the size of a tile or the order of a division must not decide."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldspark.catalog import series  # noqa: F401  (registration)
from fieldspark.catalog.registry import QUERIES
from fieldspark.operators import ordered, regrid, slicing

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("halo", [0, 2])
def test_small_tiles_do_not_make_many_tasks(spark, monkeypatch, halo):
    seen, number = [], ordered.number_rows

    def counted(df, keys, order, parts):
        seen.append(parts)
        return number(df, keys, order, parts)

    monkeypatch.setattr(ordered, "number_rows", counted)
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS t")
    tiles = ordered.tile_rows(df, ["k"], ["t"], halo, 4)
    assert seen == [2]
    rows = tiles.core().rows.orderBy("k", "t").collect()
    assert [(r["k"], r["t"], r["_rn"], r["_n"], r["_tile"]) for r in rows] == [(k, 2 * i + k, i + 1, 500, i // 4) for k in (0, 1) for i in range(500)]


@pytest.mark.parametrize("query", ["series_gaps_tiled", "savgol_tiled", "moving_average_tiled"])
def test_tiled_queries_number_their_rows_in_few_partitions(spark, monkeypatch, query):
    seen, number = [], ordered.number_rows

    def counted(df, keys, order, parts):
        seen.append(parts)
        return number(df, keys, order, parts)

    monkeypatch.setattr(ordered, "number_rows", counted)
    QUERIES[query](spark, SF_DIR)
    assert seen == [2]


@pytest.mark.parametrize("query", ["series_gaps_tiled", "savgol_tiled", "moving_average_tiled"])
def test_range_partitions_that_cut_tiles_give_the_same_rows(spark, monkeypatch, query):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 300)
    tiled, plain = (QUERIES[name](spark, SF_DIR) for name in (query, query.removesuffix("_tiled")))
    assert tiled.exceptAll(plain).isEmpty() and plain.exceptAll(tiled).isEmpty()


def test_a_value_on_the_edge_of_a_bin_falls_as_in_the_sql(spark):
    values = [0.0, 0.21, 0.42, 0.84, 1.05]
    found = slicing.value_histogram(spark.createDataFrame([("a", v) for v in values], "k string, v double"), ["k"], "v", 10)
    listed = ", ".join(f"({v}::DOUBLE)" for v in values)
    want = duckdb.sql(f"SELECT CAST(least(floor(v / 1.05::DOUBLE * 10) + 1, 10) AS INTEGER) AS bin, count(*) FROM (VALUES {listed}) AS q(v) GROUP BY 1 ORDER BY 1")
    assert [(r["bin"], r["point_count"]) for r in found.orderBy("bin").collect()] == want.fetchall()


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_regridding_reads_its_points_once(spark, method):
    rows, seen = 400, spark.sparkContext.accumulator(0)

    def read(value):
        seen.add(1)
        return value

    points = spark.range(rows).selectExpr("'s' AS comparison_set", "'a' AS `case`", "id % 20 + id / 1000 AS x", "floor(id / 20) + id / 900 AS z")
    points = points.withColumns({c: F.col(c).cast("double") for c in "xz"}).withColumn("C", F.udf(read, "double")(F.col("x")).cast("double"))
    nodes = spark.createDataFrame([("s", i, j, 2.0 + i, 2.0 + j) for i in range(8) for j in range(8)], "comparison_set string, iz int, ix int, x double, z double")
    out = regrid.regrid(points, nodes, ["C"], method=method, tile_points=32, leaf_size=32)
    assert out.count() == 64
    # One reading calls the function for the filter and for the mean.
    assert seen.value <= 2 * rows
