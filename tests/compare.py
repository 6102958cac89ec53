"""Compare a Spark frame with the result of a check query in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def mismatch(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns, types and rows (in any order)."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {n: str(t) for n, t in zip(names, con.sql(sql).types)}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns: {sorted(spark_df.columns)} / {sorted(names)}"
    wrong = {
        n: (t, types[n])
        for n, t in spark_df.dtypes
        if TYPES.get(types[n], types[n].lower()) != t and not types[n].endswith("[]")
    }
    if wrong:
        return f"types: {wrong}"
    expected = _bag(names, result.fetchall())
    actual = _bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if expected == actual:
        return None
    return (
        f"rows {sum(actual.values())} / {sum(expected.values())}; "
        f"only spark {list((actual - expected).items())[:3]}; "
        f"only duckdb {list((expected - actual).items())[:3]}"
    )
