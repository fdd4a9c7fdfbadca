"""Whole databases against each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.operators.checks import check_row_ranges, compare_counts, not_null_check, pk_unique_check
from driftkit.operators.data_diff import diff_tables_data, row_counts
from driftkit.operators.keys import keys_for
from driftkit.operators.schema_diff import schema_diff
from driftkit.operators.validation import validate
from driftkit.sources.catalog import catalog

Tables = Mapping[str, DataFrame]
Keys = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class DatabaseDiff:
    schema: DataFrame
    data: DataFrame


def diff_database(
    spark: SparkSession, old: Tables, new: Tables, keys: Keys | None = None, declared: DataFrame | None = None
) -> DatabaseDiff:
    """Schema changes, and data changes of every table.

    ``declared`` is a catalog of the database: the keys that it declares serve the
    tables without one in ``keys``. A table with neither is compared by its number of rows.
    """
    changes = schema_diff(catalog(spark, old, "db"), catalog(spark, new, "db")).drop("database")
    return DatabaseDiff(changes, diff_tables_data(old, new, keys_for(old, new, keys or {}, declared)))


def validate_data(
    changes: DataFrame, expected: DataFrame, counts: DataFrame, ranges: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """``validate``, with every row count outside its range as one more, unexpected, change."""
    seen = changes.select(*by, "kind", "table", "subject", "detail")
    return validate(seen.unionByName(check_row_ranges(counts, ranges, by)), expected, by)


def integrity_errors(tables: Tables, keys: Keys, not_null: Keys | None = None) -> DataFrame:
    """``error``: one line per duplicate key set and per column with unwanted NULLs.

    A key column must be filled; ``not_null`` names further columns per table.
    """
    not_null = not_null or {}
    parts = []
    for t in sorted(set(keys) | set(not_null)):
        filled = list(dict.fromkeys([*keys.get(t, ()), *not_null.get(t, ())]))
        parts.append(
            not_null_check(tables[t], filled)
            .filter("nulls > 0")
            .select(F.concat(F.lit(f"{t}."), "column", F.lit(": "), "nulls", F.lit(" NULL(s)")).alias("error"))
        )
        if keys.get(t):
            parts.append(
                pk_unique_check(tables[t], keys[t])
                .filter(~F.col("is_unique"))
                .select(F.concat(
                    F.lit(f"{t}: "), "duplicate_keys", F.lit(" duplicate key(s), "), "extra_rows", F.lit(" extra row(s)")
                ).alias("error"))
            )
    if not parts:
        raise ValueError("integrity checks need key or not-null columns")
    return reduce(DataFrame.unionByName, parts)


def check(
    spark: SparkSession,
    backup: Tables,
    reference: Tables | None = None,
    with_data: bool = False,
    keys: Keys | None = None,
    not_null: Keys | None = None,
) -> DataFrame:
    """One report row on a backup; a part that was not asked for stays NULL and does not fail.

    ``tables`` and the error list hold one entry per table or column.
    """
    keys = {t: k for t, k in (keys or {}).items() if t in backup}
    if keys or not_null:
        errors = integrity_errors(backup, keys, not_null).agg(F.array_sort(F.collect_list("error"))).scalar()
    else:
        errors = F.array().cast("array<string>")
    schema_changes = data_ok = F.lit(None)
    tables = F.lit(None)
    if reference is not None:
        old, new = catalog(spark, reference, "db"), catalog(spark, backup, "db")
        schema_changes = schema_diff(old, new).agg(F.count(F.lit(1))).scalar()
    if with_data:
        counts = row_counts(backup)
        if reference is not None:
            stats = compare_counts(counts, row_counts(reference))
            data_ok = stats.agg(F.bool_and("rows_match")).scalar()
        else:
            stats = counts.select(
                "table", F.col("rows").alias("backup_rows"), F.lit(None).cast("bigint").alias("reference_rows"),
                F.lit(None).cast("boolean").alias("rows_match"),
            )
        tables = stats.agg(F.array_sort(F.collect_list(F.struct(*stats.columns)))).scalar()
    row = spark.range(1).select(
        errors.alias("integrity_errors"),
        schema_changes.cast("bigint").alias("schema_changes"),
        data_ok.cast("boolean").alias("data_ok"),
        tables.cast(
            "array<struct<table:string,backup_rows:bigint,reference_rows:bigint,rows_match:boolean>>"
        ).alias("tables"),
    )
    integrity_ok, schema_ok = F.size("integrity_errors") == 0, F.col("schema_changes") == 0
    passed = integrity_ok & F.coalesce(schema_ok, F.lit(True)) & F.coalesce(F.col("data_ok"), F.lit(True))
    return row.select(
        integrity_ok.alias("integrity_ok"), "integrity_errors", schema_ok.alias("schema_ok"), "schema_changes",
        "data_ok", "tables", passed.alias("passed"),
    )
