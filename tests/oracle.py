"""Run registered queries beside their oracle SQL and compare the rows.

python -m tests.oracle [sf] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA else str(v))
        elif str(frame[c].dtype).startswith(("int", "Int", "uint")):
            frame[c] = frame[c].astype("float64")
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(spark, con, name: str, sf_dir: str) -> tuple[str | None, int]:
    """A description of the first difference, or None, and the row count."""
    got = registered.queries()[name](spark, sf_dir).toPandas()
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}", len(got)
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    uneven = {c: k for c, k in kinds.items() if k[0] != k[1] and not {*k} <= {"f", "i"}}
    if uneven:
        return f"types {uneven}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}", len(got)
    a, b = _sorted(got), _sorted(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} rows differ in {c}: {a[c][i]!r} vs {b[c][i]!r}", len(got)
    return None, len(got)


def main() -> None:
    from tests.session import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(registered.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), database(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            problem, rows = difference(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001  report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", 0
        mark = "ok  " if problem is None else "FAIL"
        if name not in registered.oracle_sql():
            mark = "rows"
        print(f"{mark} {name:28s} {rows:7d} rows {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem is not None:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
