"""Spark results against DuckDB over the same files."""

from __future__ import annotations

import glob
import math
import os


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        c.execute(f"create view {name} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, int):
        return v
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def differences(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    want, wanted = rows([d[0] for d in cur.description], cur.fetchall())
    if columns != wanted:
        return f"columns {columns} {wanted}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} rows, {len(want)} wanted; only here {a}; only there {b}"
    return None
