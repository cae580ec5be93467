"""Run a registered query and its check statement side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql, con=None):
    """(same, number of rows, first differences)"""
    df = query(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left == right:
        return True, len(left[1]), None
    a, b = set(left[1]), set(right[1])
    return False, len(left[1]), {
        "columns": (left[0], right[0]), "rows": (len(left[1]), len(right[1])),
        "spark only": sorted(a - b)[:3], "check only": sorted(b - a)[:3]}
