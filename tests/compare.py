"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb


def normal(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def same_rows(spark, sf_dir: str, query, sql: str) -> None:
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = query(spark, sf_dir)
    expected = db.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    mine = sorted(tuple(normal(row[n]) for n in names) for row in found.collect())
    place = [expected.columns.index(n) for n in names]
    theirs = sorted(tuple(normal(row[i]) for i in place) for row in expected.fetchall())
    assert mine == theirs
