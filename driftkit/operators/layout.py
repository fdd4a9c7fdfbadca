"""Catalog rows compiled into layouts that a rebuild can take: types, defaults, keys, nullability."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit.operators.schema_diff import DATABASE, readable

# Declared types of other engines and what holds their values; an INTEGER there has 64 bits.
DECLARED = {"text": "string", "clob": "string", "": "string", "integer": "bigint", "real": "double", "blob": "binary",
            "numeric": "decimal(38,10)", "datetime": "timestamp"}


@dataclass(frozen=True)
class Layout:
    schema: T.StructType
    defaults: Mapping[str, Column] = field(default_factory=dict)
    key: tuple[str, ...] = ()


def read_type(text: str | None) -> T.DataType | None:
    """The type that a declaration names; None if it names none."""
    name = (text or "").strip().lower()
    try:
        return T.DataType.fromDDL(DECLARED.get(name, text.strip() if text else "string"))
    except (ParseException, AnalysisException):
        return None


def read_default(spark: SparkSession, text: str, dtype: T.DataType) -> Column | None:
    """A default, which is SQL text, as an expression of a type; None if it cannot be one.

    It must not look at rows: a default is the same for a row as for none.
    """
    try:
        value = F.expr(text).cast(dtype)
        given, kept = spark.range(1).select(F.expr(text).isNotNull(), F.expr(text).try_cast(dtype).isNotNull()).first()
    except (ParseException, AnalysisException):
        return None
    return value if given == kept else None


def layout_problems(catalog: DataFrame) -> DataFrame:
    """``database, table, column, problem``: what keeps catalogs from becoming layouts, for a whole fleet.

    ``problem`` is an unreadable type, or a column that a table has twice. The
    different type texts are read once each; there are few, however many columns.
    """
    rows = readable(catalog)
    texts = [r[0] for r in rows.select("type").distinct().collect()]
    bad = [t for t in texts if read_type(t) is None]
    unread = rows.filter(F.col("type").isin(bad) if bad else F.lit(False)).select(
        *DATABASE, "table", "column", F.concat(F.lit("unreadable type "), "type").alias("problem")
    )
    twice = rows.groupBy(*DATABASE, "table", F.lower("column").alias("__name")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("column").alias("column")
    )
    return unread.distinct().unionByName(
        twice.filter("__n > 1").select(*DATABASE, "table", "column", F.lit("repeated column").alias("problem"))
    )


def compile_layouts(catalog: DataFrame) -> dict[str, Layout]:
    """The layout of each table of one database's catalog.

    Columns go by their ordinal, key columns by their place in the key; a key column
    holds no NULL. A table with a problem (an unreadable type or default, or a
    repeated column) is an error that names it. What comes to the driver is as long
    as the schema is wide.
    """
    spark = catalog.sparkSession
    columns = ("database", "table", "ordinal", "column", "type", "not_null", "default_value", "pk")
    rows = [r.asDict() for r in readable(catalog).select(*columns).distinct().collect()]
    if len({r["database"] for r in rows}) > 1:
        raise ValueError("layouts are those of one database")
    tables: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["table"], r["ordinal"], r["column"])):
        tables.setdefault(r["table"], []).append(r)
    layouts, problems = {}, []
    for name, listed in tables.items():
        fields, defaults, seen = [], {}, set()
        for r in listed:
            dtype = read_type(r["type"])
            if dtype is None or r["column"].lower() in seen:
                problems.append(f"{name}.{r['column']}: " + ("repeated column" if dtype else f"unreadable type {r['type']}"))
                continue
            seen.add(r["column"].lower())
            fields.append(T.StructField(r["column"], dtype, not (r["not_null"] or (r["pk"] or 0) > 0)))
            if r["default_value"]:
                value = read_default(spark, r["default_value"], dtype)
                if value is None:
                    problems.append(f"{name}.{r['column']}: unreadable default {r['default_value']}")
                else:
                    defaults[r["column"]] = value
        key = sorted((r for r in listed if (r["pk"] or 0) > 0), key=lambda r: r["pk"])
        layouts[name] = Layout(T.StructType(fields), defaults, tuple(r["column"] for r in key))
    if problems:
        raise ValueError("; ".join(problems))
    return layouts
