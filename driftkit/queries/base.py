"""Registration of queries and the inputs they derive from the given tables.

An input is one SELECT written so that Spark and DuckDB both accept it. The
given tables appear as ``{orders}``, identifiers that need it are double-quoted.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_SCHEMAS: dict[str, StructType] = {}

#: Rows of a given table that one task takes where they are dealt out by key.
ROWS_PER_TASK = 128_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name`` with the DuckDB text it must agree with."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names or TABLES}


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks for work on all rows of a given table, so that each takes as many whatever the table's size.

    The rows are counted from the files' footers.
    """
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // ROWS_PER_TASK))


def derive(spark: SparkSession, sf_dir: str, text: str, dealt: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """The input ``text`` as a DataFrame; ``dealt`` names tables to put in so many partitions by a column first."""
    named = {n: table(spark, sf_dir, n) for n in TABLES if re.search(rf"\{{{n}\}}", text)}
    named.update({n: named[n].repartition(*how) for n, how in (dealt or {}).items() if n in named})
    return spark.sql(text.replace('"', "`"), **named)


def duck(text: str) -> str:
    """The input ``text`` as a DuckDB subquery."""
    return "(" + text.format(**{n: n for n in TABLES}) + ")"
