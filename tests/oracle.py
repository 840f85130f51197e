"""Comparing a Spark result with the same query in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{Path(sf_dir) / table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "<null>"
    if isinstance(value, float) and math.isnan(value):
        return "<nan>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """(spark rows, duckdb rows) with columns sorted by name, rows sorted."""
    result = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(result.columns), (sorted(spark_df.columns), sorted(result.columns))
    return rows_of(spark_df.columns, spark_df.collect()), rows_of(result.columns, result.fetchall())
