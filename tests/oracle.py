"""Runs a query in Spark and its SQL in DuckDB and compares the two results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from driftkit.queries.base import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date, decimal.Decimal)):
        return str(value)
    if isinstance(value, dict):
        return str({k: _plain(v) for k, v in value.items()})
    if hasattr(value, "asDict"):
        return str({k: _plain(v) for k, v in value.asDict().items()})
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return repr(value)


# Type names of the two engines that mean the same.
_SAME_TYPE = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
}


def compare(name: str, spark, con, sf_dir: str, fn, sql: str) -> list[str]:
    """What differs, as lines of text; empty when the results agree."""
    got = fn(spark, sf_dir)
    rel = con.sql(sql)
    problems = []
    got_types = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    want_types = {c: _SAME_TYPE.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    if got_types != want_types:
        problems.append(f"{name}: schema {got_types} <> {want_types}")
    cols = sorted(got_types)
    if cols != sorted(want_types):
        return problems
    got_rows = sorted(tuple(_plain(r[c]) for c in cols) for r in got.collect())
    index = [rel.columns.index(c) for c in cols]
    want_rows = sorted(tuple(_plain(r[i]) for i in index) for r in rel.fetchall())
    if len(got_rows) != len(want_rows):
        problems.append(f"{name}: {len(got_rows)} rows <> {len(want_rows)}")
    if got_rows != want_rows:
        only_got = [r for r in got_rows if r not in set(want_rows)][:3]
        only_want = [r for r in want_rows if r not in set(got_rows)][:3]
        problems.append(f"{name}: values differ {cols}\n  spark {only_got}\n  duck  {only_want}")
    return problems
