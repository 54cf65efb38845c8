"""Series with repeated times: rows of equal time follow their tie columns, and the queries give the rows of their SQL."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as registered
from fieldspark.operators import series
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES = "cumtrapz cumtrapz_tiled energy_diagnostics energy_summary front_kinematics front_kinematics_tiled gradient_e1 gradient_e2 kinematics_summary overlay_summary_processed gradient_e2_tiled".split()


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The small tables, with every event three times under numbers and users of their own."""
    folder = tmp_path_factory.mktemp("copies")
    for name in oracle.TABLES:
        os.symlink(f"{SF_DIR}/{name}.parquet", folder / f"{name}.parquet") if name != "events" else None
    duckdb.connect().execute(
        f"""COPY (SELECT * REPLACE (event_id + 100000 * k AS event_id, user_id + 7 * k AS user_id)
        FROM '{SF_DIR}/events.parquet', range(3) AS r(k)) TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    return str(folder)


def settled(sql: str) -> str:
    """The SQL with the ties that its ORDER BY leaves open settled by the number of the event."""
    sql = sql.replace("ORDER BY time", "ORDER BY time, event_id")
    sql = re.sub(r'(arg_(?:min|max))\(("?\w+"?), time\)', r"\1(\2, (time, event_id))", sql)
    for name in ("front", "sm", "kin", "e"):
        sql = sql.replace(f' {name} AS (SELECT "case", time, ', f' {name} AS (SELECT "case", time, event_id, ')
    return sql


@pytest.mark.parametrize("name", QUERIES)
def test_queries_follow_their_sql_at_repeated_times(spark, copies, name, monkeypatch):
    known = registered.oracle_sql()
    monkeypatch.setattr(registered, "oracle_sql", lambda: {k: settled(v) for k, v in known.items()})
    problem, rows = oracle.difference(spark, oracle.database(copies), name, copies)
    assert problem is None
    assert rows > 0


ROWS = [("a", 0.0, 1, 1.0), ("a", 1.0, 2, 4.0), ("a", 1.0, 3, 2.0), ("a", 1.0, 4, 2.0), ("a", 3.0, 5, 0.0), ("a", 4.0, 6, 6.0), ("a", 5.0, 7, 6.0)]


@pytest.mark.parametrize("size", [2, 3, 1000])
def test_repeated_times_add_no_area(spark, size):
    df = spark.createDataFrame(ROWS, "k string, t double, n long, v double")
    out = series.cumulative_trapezoid(df, ["k"], "t", "v", tile_size=size, ties=["n"]).orderBy("n").collect()
    assert [r["cumulative"] for r in out] == [0.0, 2.5, 2.5, 2.5, 4.5, 7.5, 13.5]
    with pytest.raises(ValueError, match="gaps at repeated times"):
        series.cumulative_trapezoid(df, ["k"], "t", "v", gaps="restart", ties=["n"])
