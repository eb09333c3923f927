"""Run a check on Spark and its SQL twin on DuckDB, and compare the rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    """A value in a form both engines share; kinds stay apart (1 is not '1' or 1.0)."""
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, float):
        return ("null",) if math.isnan(v) else ("float", float(f"{v:.9g}"))
    if isinstance(v, datetime):
        return ("time", v.replace(tzinfo=None).isoformat())
    if isinstance(v, date):
        return ("date", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(plain(x) for x in v))
    return ("text", str(v))


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def difference(df, con, sql) -> str | None:
    """None when both agree, else a short account of the difference."""
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} against {dc}"
    if len(sr) != len(dr):
        only_s, only_d = set(sr) - set(dr), set(dr) - set(sr)
        return f"{len(sr)} rows against {len(dr)}; e.g. only Spark {list(only_s)[:2]}, only SQL {list(only_d)[:2]}"
    for s, d in zip(sr, dr):
        if s != d:
            bad = [(c, x, y) for c, x, y in zip(sc, s, d) if x != y]
            return f"first difference {bad}"
    return None
