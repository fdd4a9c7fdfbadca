"""The catalog of a table set: one row per column."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from driftkit import model as M


def catalog(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    database: str,
    keys: Mapping[str, Sequence[str]] | None = None,
    defaults: Mapping[str, Mapping[str, str]] | None = None,
    captured_at: datetime.datetime | None = None,
) -> DataFrame:
    """Catalog rows of ``tables``, from their schemas alone; no data is read.

    ``keys`` and ``defaults`` declare what a schema cannot carry: the key
    columns of a table, and default values as SQL text.
    """
    keys, defaults = keys or {}, defaults or {}
    rows = []
    for table in sorted(tables):
        key = list(keys.get(table, ()))
        unknown = set(key) - set(tables[table].columns)
        if unknown:
            raise ValueError(f"{table} has no column {', '.join(sorted(unknown))}")
        for i, field in enumerate(tables[table].schema.fields):
            rows.append((
                database, table, i + 1, field.name, field.dataType.simpleString(), not field.nullable,
                defaults.get(table, {}).get(field.name),
                key.index(field.name) + 1 if field.name in key else 0,
                captured_at, None,
            ))
    return spark.createDataFrame(rows, M.CATALOG)
