"""Curve points and the ranges of many series: the stretches cover each range once, and no place holds many ranges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fieldspark.operators import curve as cv


def test_stretches_cover_each_range_once(spark):
    bounds = [float(k) for k in range(1, 256)]
    rng = random.Random(1)
    ends = [tuple(sorted((rng.uniform(-3, 260), rng.uniform(-3, 260)))) for _ in range(300)] + [(0.0, 255.5), (7.0, 7.0), (-9.0, -8.0), (300.0, 301.0)]
    ranges = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(ends)], "k int, _lo double, _hi double")
    found: dict = {}
    for r in cv.range_stretches(ranges, bounds, 8).collect():
        found.setdefault(r["k"], []).extend(range(r["_node"] << r["_level"], (r["_node"] + 1) << r["_level"]))
    for k, (lo, hi) in enumerate(ends):
        inside = [b for b in range(256) if (b == 255 or lo < b + 1) and (b == 0 or hi >= b)]
        assert sorted(found[k]) == inside


def test_points_meet_the_ranges_around_them(spark):
    rng = random.Random(2)
    ends = [tuple(sorted((rng.uniform(0, 100), rng.uniform(0, 100)))) for _ in range(200)]
    series = spark.createDataFrame([(k, t) for k, e in enumerate(ends) for t in e], "k int, t double")
    times = [round(rng.uniform(-5, 105), 1) for _ in range(400)] + [ends[0][0], ends[0][1]]
    curve = spark.createDataFrame([(t,) for t in times], "t double")
    got = sorted((r["k"], r["t"]) for r in cv.curve_for_each_key(curve, series, ["k"], "t").collect())
    assert got == sorted((k, t) for k, (lo, hi) in enumerate(ends) for t in times if lo <= t <= hi)
    assert cv.curve_for_each_key(curve, series.filter("false"), ["k"], "t").count() == 0
    assert cv.curve_for_each_key(curve.filter("false"), series, ["k"], "t").count() == 0


def test_no_place_holds_many_of_ten_thousand_series(spark):
    # A third of the series has the same range, the others begin and end anywhere.
    ranges = spark.range(10_000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(1) * 50).alias("_lo"),
        F.when(F.col("id") % 3 == 0, 100.0).otherwise(50 + F.rand(2) * 50).alias("_hi"),
    )
    curve = spark.range(2_000).select((F.col("id") / 20).alias("t"))
    dealt, repeated = cv.met_ranges(curve, ranges, "t")
    places = dealt.groupBy("_level", "_node", "_salt").count()
    total, most = places.agg(F.sum("count"), F.max("count")).first()
    assert total <= 10_000 * 2 * (cv.LEVELS + 1) and most <= 0.01 * total
    assert repeated.groupBy("_level", "_node", "_salt").count().agg(F.max("count")).first()[0] <= 2_000
