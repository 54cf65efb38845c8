"""Long series: rounding errors of running sums do not pile up, so integrals are those of exact sums."""

from __future__ import annotations

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldspark.operators import ordered, series


@pytest.mark.parametrize("size", [50_000, 1_000_000])
def test_the_budget_of_a_long_series_is_that_of_exact_sums(spark, size):
    rows = spark.range(200_000).select(
        F.lit("a").alias("case"), F.col("id").cast("double").alias("time"), *(F.lit(v).alias(n) for n, v in (("E_k", 1.0), ("E_p", 2.0), ("E_total", 3.0), ("epsilon", 0.1)))
    )
    out = series.energy_diagnostics(rows, tile_size=size).select("time", "cumulative_epsilon").toPandas()
    exact = (out["time"].map(int) * Fraction(0.1)).map(float)
    assert ((out["cumulative_epsilon"] - exact).abs() <= exact.map(math.ulp)).all()


VALUES = [0.1, -0.3, 2.0**31, -(2.0**31), 1e-9, None, 5e9, -5e9, 1e300, math.inf, 1.0, -math.inf, 1.0]


@pytest.mark.parametrize("size", [3, 1000])
def test_sums_of_large_and_infinite_values(spark, size):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(VALUES)], "k string, i long, v double")
    tiles = ordered.running_sum(ordered.tile_rows(df, ["k"], ["i"], 0, size), F.col("v"), "s", apart=True)
    sums = [r["s"] for r in tiles.rows.orderBy("i").collect()]
    assert sums[:9] == pytest.approx([0.1, -0.2, 2.0**31, -0.2, -0.2, -0.2, 5e9, -0.2, 1e300], rel=1e-6)
    assert sums[9:11] == [math.inf, math.inf]
    assert all(math.isnan(s) for s in sums[11:])
