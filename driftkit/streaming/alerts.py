"""Alert payloads for drifted checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit import model as M

_CHECK = ["source", "baseline_at", "checked_at"]


def _line() -> Column:
    """One line of text per changed table."""
    name = F.concat(F.lit("• `"), "table", F.lit("` "))
    columns = F.when(F.col("__columns") > 0, F.format_string("%d column change(s)", "__columns"))
    indexes = F.when(F.col("__indexes") > 0, F.format_string("%d index change(s)", "__indexes"))
    return (
        F.when(F.col("__added"), F.concat(name, F.lit("*added*")))
        .when(F.col("__removed"), F.concat(name, F.lit("*removed*")))
        .otherwise(F.concat(name, F.lit("modified — "), F.concat_ws(", ", columns, indexes)))
    )


def drift_lines(drift: DataFrame) -> DataFrame:
    """Per drifted check: ``tables`` changed, and the ``lines`` that say how, in table order."""
    kind = F.col("c.kind")
    per_table = (
        drift.filter(F.col("has_drift"))
        .select(*_CHECK, F.explode("changes").alias("c"))
        .groupBy(*_CHECK, F.col("c.table").alias("table"))
        .agg(
            F.bool_or(kind == M.TABLE_ADDED).alias("__added"),
            F.bool_or(kind == M.TABLE_REMOVED).alias("__removed"),
            F.count_if(kind.isin(M.COLUMN_ADDED, M.COLUMN_REMOVED, M.COLUMN_CHANGED)).alias("__columns"),
            F.count_if(kind.isin(M.INDEX_ADDED, M.INDEX_REMOVED)).alias("__indexes"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("table", _line().alias("line"))))
    return per_table.groupBy(*_CHECK).agg(
        F.count(F.lit(1)).alias("tables"), F.array_join(ordered["line"], "\n").alias("lines")
    )


def alert_payload(drift: DataFrame, style: str = "generic") -> DataFrame:
    """``source, checked_at, payload`` of each drifted check, as JSON for a webhook.

    ``generic`` carries the report row itself, ``slack`` the blocks of a message.
    """
    if style not in ("generic", "slack"):
        raise ValueError("style must be 'generic' or 'slack'")
    lines = drift_lines(drift)
    if style == "slack":
        return lines.select("source", "checked_at", F.to_json(_slack(lines)).alias("payload"))
    keyed = drift.filter(F.col("has_drift")).select(*_CHECK, "has_drift", "changes")
    counted = keyed.withColumn("__tables", F.size(F.array_distinct(F.col("changes")["table"])))
    # The wording of the message.
    text = F.format_string("Schema drift detected in %s (%d changes)", "source", "__tables")
    result = F.struct(*_CHECK, "has_drift", "changes").alias("result")
    return counted.select("source", "checked_at", F.to_json(F.struct(text.alias("text"), result)).alias("payload"))


def _utc(df: DataFrame, name: str) -> Column:
    """A time as the message shows it; a time without a zone is taken to be UTC."""
    zoned = isinstance(df.schema[name].dataType, T.TimestampType)
    at = F.to_utc_timestamp(name, F.current_timezone()) if zoned else F.col(name)
    return F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'")


def _slack(df: DataFrame) -> Column:
    # The wording and block layout of the message.
    title = F.lit("⚠️ Schema Drift Detected")
    text = F.format_string("⚠️ Schema drift detected in `%s`", "source")

    def field(label: str, value: Column) -> Column:
        return F.struct(
            F.lit("mrkdwn").alias("type"), F.concat(F.lit(f"*{label}*\n"), value).alias("text")
        )

    fields = F.array(
        field("Source", F.concat(F.lit("`"), F.col("source"), F.lit("`"))),
        field("Changes", F.format_string("%d table(s)", "tables")),
        field("Baseline", _utc(df, "baseline_at")),
        field("Detected", _utc(df, "checked_at")),
    )
    no_text = F.lit(None).cast("struct<type:string,text:string>")
    no_fields = F.lit(None).cast("array<struct<type:string,text:string>>")

    def block(kind: str, body: Column, parts: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), body.alias("text"), parts.alias("fields"))

    def body(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    blocks = F.array(
        block("header", body("plain_text", title), no_fields),
        block("section", no_text, fields),
        block("section", body("mrkdwn", F.col("lines")), no_fields),
    )
    return F.struct(text.alias("text"), blocks.alias("blocks"))
