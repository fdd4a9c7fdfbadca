"""Report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_text(table: Column, subject: Column, kind: Column, detail: Column) -> Column:
    """One change as a line: ``t.s: kind detail``, or ``t: kind`` without a subject."""
    # The two line formats.
    return F.when(
        subject.isNotNull(),
        F.format_string("%s.%s: %s %s", table, subject, kind, F.coalesce(detail, F.lit(""))),
    ).otherwise(F.format_string("%s: %s", table, kind))


def risk_text(description: Column, rows: Column) -> Column:
    """One risk as a line, with its row count when that is known."""
    # The line format.
    return F.when(
        rows.isNotNull(), F.format_string("%s (%d rows affected)", description, rows)
    ).otherwise(description)


def provider(dsn: Column) -> Column:
    """Where a member lives, judged by the prefix of its address."""
    # Address prefixes and provider names.
    return (
        F.when(dsn.startswith("turso://"), "turso")
        .when(dsn.startswith("d1://"), "d1")
        .otherwise("local")
    )


def redact(dsn: Column) -> Column:
    """An address without the token in front of its ``@``."""
    return F.regexp_replace(dsn, "://[^@/]*@", "://")
