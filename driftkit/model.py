"""Names and schemas every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# The kinds of change a report can hold.
TABLE_ADDED = "table added"
TABLE_REMOVED = "table removed"
COLUMN_ADDED = "column added"
COLUMN_REMOVED = "column removed"
COLUMN_CHANGED = "column type changed"
INDEX_ADDED = "index added"
INDEX_REMOVED = "index removed"
ROWS_OUT_OF_RANGE = "row count out of range"

# The status of a compared row.
ADDED, REMOVED, CHANGED = "added", "removed", "changed"

# The state of a fleet member after a check.
NO_BASELINE, ERROR, DRIFT, OK = "no-baseline", "error", "drift", "ok"

# The state of a fleet member after a rollout.
APPLIED, DRY_RUN, FAILED, SKIPPED, CANARY = "applied", "dry-run", "failed", "skipped", "canary"

# Outcome of testing a change against a spec.
CONFIRMED, UNEXPECTED, MISSING = "confirmed", "unexpected", "missing"

CATALOG = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("not_null", T.BooleanType()),
    T.StructField("default_value", T.StringType()),
    T.StructField("pk", T.IntegerType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("error", T.StringType()),
])

INDEXES = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("index", T.StringType()),
    T.StructField("is_unique", T.BooleanType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("error", T.StringType()),
])

REGISTRY = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("dsn", T.StringType()),
    T.StructField("baseline", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

CHANGE_ITEM = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("detail", T.StringType()),
])

DRIFT_REPORT = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("baseline_at", T.TimestampType()),
    T.StructField("checked_at", T.TimestampType()),
    T.StructField("has_drift", T.BooleanType()),
    T.StructField("changes", T.ArrayType(CHANGE_ITEM)),
    T.StructField("error", T.StringType()),
])

_COLUMN_SPEC = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))
_INDEX_SPEC = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("unique", T.BooleanType())]))

TABLE_SPEC = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("added_columns", _COLUMN_SPEC),
    T.StructField("removed_columns", _COLUMN_SPEC),
    T.StructField("changed_columns", _COLUMN_SPEC),
    T.StructField("added_indexes", _INDEX_SPEC),
    T.StructField("removed_indexes", _INDEX_SPEC),
])

SPEC = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("schema", T.StructType([
        T.StructField("added_tables", T.ArrayType(T.StringType())),
        T.StructField("removed_tables", T.ArrayType(T.StringType())),
        T.StructField("modified_tables", T.ArrayType(TABLE_SPEC)),
    ])),
    T.StructField("data", T.MapType(T.StringType(), T.StructType([
        T.StructField("min_rows", T.LongType()), T.StructField("max_rows", T.LongType())]))),
])
