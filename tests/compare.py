"""Compares a query's rows with its SQL's, as multisets of rows with columns by name."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def both(spark, query, sql: str, sf_dir: str) -> tuple[list, list, list[str], list[str]]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    con = connect(sf_dir)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    return got, rows_of(names, rel.fetchall()), sorted(df.columns), sorted(names)
