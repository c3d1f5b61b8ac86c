"""Comparing a job's rows with those of its SQL in DuckDB."""

import datetime
from pathlib import Path

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.10g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, data, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(_plain(r[i]) for i in at) for r in data), key=repr)


def same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert rows(df.columns, df.collect(), order) == rows(names, found.fetchall(), order)
