"""Observed changes against expected ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.operators.schema_diff import DATABASE

_KEY = ("kind", "table", "subject")


def validate(changes: DataFrame, expected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``verdict, kind, table, subject, detail, copies``: confirmed, unexpected or missing.

    Changes match on kind, table and subject, one to one when they repeat. Equal
    changes are counted before they meet, so what remains per key is one row for
    each different ``detail``, that is for each pair of types.
    """
    key = [*by, *_KEY]
    if by:  # both sides may lie by table already; a union of them would then work both out in one task
        changes, expected = changes.repartition(*key), expected.repartition(*key)
    one, none = F.lit(1), F.lit(0)
    both = changes.select(*key, "detail", one.alias("found"), none.alias("wanted")).unionByName(
        expected.select(*key, F.lit(None).cast("string").alias("detail"), none.alias("found"), one.alias("wanted"))
    )
    counted = both.groupBy(*key, "detail").agg(F.sum("found").alias("found"), F.sum("wanted").alias("wanted"))

    group = Window.partitionBy(*key)
    ordered = group.orderBy(F.col("detail").asc_nulls_first())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        *key, "detail", "found",
        F.sum("wanted").over(group).alias("__wanted"),
        F.sum("found").over(group).alias("__found"),
        F.coalesce(F.sum("found").over(before), F.lit(0).cast("bigint")).alias("__before"),
        (F.row_number().over(ordered) == 1).alias("__first"),
    )
    zero = F.lit(0).cast("bigint")
    confirmed = F.least(F.greatest(F.col("__wanted") - F.col("__before"), zero), F.col("found"))
    missing = F.when(F.col("__first"), F.greatest(F.col("__wanted") - F.col("__found"), zero)).otherwise(zero)

    def outcome(verdict: str, detail: Column, copies: Column) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), detail.alias("detail"), copies.alias("copies"))

    outcomes = F.array(
        outcome(M.CONFIRMED, F.col("detail"), confirmed),
        outcome(M.UNEXPECTED, F.col("detail"), F.col("found") - confirmed),
        outcome(M.MISSING, F.lit(None).cast("string"), missing),
    )
    return (
        placed.select(*key, F.explode(outcomes).alias("o"))
        .filter("o.copies > 0")
        .select(*by, "o.verdict", *_KEY, "o.detail", "o.copies")
    )


def validation_passed(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Changes per verdict, and ``passed`` when none is unexpected or missing."""

    def copies(verdict: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("verdict") == verdict, F.col("copies"))), F.lit(0).cast("bigint"))

    counts = [copies(v).alias(v) for v in (M.CONFIRMED, M.UNEXPECTED, M.MISSING)]
    passed = (copies(M.UNEXPECTED) == 0) & (copies(M.MISSING) == 0)
    return result.groupBy(*by).agg(*counts, passed.alias("passed"))


def _listed(kind: str, *fields: tuple[str, Column]) -> Column:
    item = F.struct(*[c.alias(n) for n, c in fields])
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))


def _own_groups(changes: DataFrame, by: Sequence[str] | None) -> Sequence[str]:
    """One spec per database, unless told otherwise or the changes name none."""
    return [c for c in DATABASE if c in changes.columns] if by is None else by


def table_specs(changes: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Per changed table its expected changes, or ``kind`` when the table came or went.

    A list is at most as long as the table is wide.
    """
    name, unique = ("name", F.col("subject")), F.coalesce(F.col("new.is_unique"), F.lit(False))
    no_type, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    whole = F.col("kind").isin(M.TABLE_ADDED, M.TABLE_REMOVED)
    return changes.groupBy(*_own_groups(changes, by), "table").agg(
        F.max(F.when(whole, F.col("kind"))).alias("kind"),
        _listed(M.COLUMN_ADDED, name, ("type", F.col("new.type"))).alias("added_columns"),
        _listed(M.COLUMN_REMOVED, name, ("type", no_type)).alias("removed_columns"),
        _listed(M.COLUMN_CHANGED, name, ("type", F.col("new.type"))).alias("changed_columns"),
        _listed(M.INDEX_ADDED, name, ("unique", unique)).alias("added_indexes"),
        _listed(M.INDEX_REMOVED, name, ("unique", no_flag)).alias("removed_indexes"),
    )


def spec_from_diff(
    changes: DataFrame, description: str | None = None, by: Sequence[str] | None = None
) -> DataFrame:
    """The spec that expects exactly ``changes``: one document per database, or per ``by`` group."""
    by = _own_groups(changes, by)

    def names(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("table"))))

    fields = {f.name: f.dataType for f in M.SPEC.fields}
    table = F.struct(*[F.col(f) for f in M.TABLE_SPEC.fieldNames()])
    docs = table_specs(changes, by).groupBy(*by).agg(
        F.struct(
            names(M.TABLE_ADDED).alias("added_tables"),
            names(M.TABLE_REMOVED).alias("removed_tables"),
            F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), table))).alias("modified_tables"),
        ).alias("schema")
    )
    return docs.select(
        (F.col("database") if "database" in by else F.lit(None).cast("string")).alias("database"),
        F.lit(1).alias("version"),
        F.lit(description).cast("string").alias("description"),
        F.col("schema").cast(fields["schema"]).alias("schema"),
        F.lit(None).cast(fields["data"]).alias("data"),
    )


def spec_changes(spec: DataFrame) -> DataFrame:
    """Expected changes of spec documents: ``database, kind, table, subject``."""
    nothing = F.array().cast("array<struct<kind:string,table:string,subject:string>>")

    def change(kind: str, table: Column, subject: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), table.alias("table"), subject.cast("string").alias("subject"))

    def tables(field: str, kind: str) -> Column:
        return F.coalesce(F.transform(f"schema.{field}", lambda t: change(kind, t, F.lit(None))), nothing)

    # The lists of a modified table and the kind of change in each.
    lists = {
        "added_columns": M.COLUMN_ADDED, "removed_columns": M.COLUMN_REMOVED, "changed_columns": M.COLUMN_CHANGED,
        "added_indexes": M.INDEX_ADDED, "removed_indexes": M.INDEX_REMOVED,
    }

    def inside(m: Column) -> Column:
        def entries(field: str, kind: str) -> Column:
            return F.coalesce(F.transform(m[field]["name"], lambda n: change(kind, m["table"], n)), nothing)

        return F.concat(*[entries(field, kind) for field, kind in lists.items()])

    modified = F.coalesce(F.flatten(F.transform("schema.modified_tables", inside)), nothing)
    every = F.concat(tables("added_tables", M.TABLE_ADDED), tables("removed_tables", M.TABLE_REMOVED), modified)
    return spec.select("database", F.explode(every).alias("c")).select("database", "c.*")


def spec_ranges(spec: DataFrame) -> DataFrame:
    """Row ranges of spec documents: ``database, table, min_rows, max_rows``."""
    return spec.select("database", F.explode("data").alias("table", "r")).select(
        "database", "table", "r.min_rows", "r.max_rows"
    )
