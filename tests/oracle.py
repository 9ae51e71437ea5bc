"""A query's rows held against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return db


def in_order(rows: pd.DataFrame) -> list[tuple]:
    text = rows[sorted(rows.columns)].astype(object).where(rows.notna(), None)
    return sorted((tuple(map(repr, map(plain, r))) for r in text.itertuples(index=False)))


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def assert_same(query, sql: str, spark, sf_dir: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert in_order(ours) == in_order(theirs)
