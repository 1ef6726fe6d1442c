"""Compare a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
