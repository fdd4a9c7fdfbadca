"""Differences between the catalogs of databases, for a whole fleet at once.

Both catalogs, and their index lists if given, are put together and shuffled
once, by table. One sort there serves both the grouping by column or index,
which also folds rows captured twice, and the look at all of a table. Repeats
of one table's columns and indexes meet in one task, which can spill them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.sources.tables import INTERNAL_PREFIXES

DATABASE = ("database",)

# What is compared of a column or index.
_PROPERTIES = {"type": "string", "not_null": "boolean", "default_value": "string", "pk": "int", "is_unique": "boolean"}
_ITEM = "struct<" + ",".join(f"{name}:{of}" for name, of in _PROPERTIES.items()) + ">"


def user_tables(catalog: DataFrame) -> DataFrame:
    """Catalog rows without the tables a database keeps for itself."""
    internal = F.lit(False)
    for prefix in INTERNAL_PREFIXES:
        internal = internal | F.col("table").startswith(prefix)
    return catalog.filter(~internal)


def readable(catalog: DataFrame) -> DataFrame:
    """Rows that describe a column or index: no read errors, no empty members."""
    rows = catalog.filter(F.col("table").isNotNull())
    return rows.filter(F.col("error").isNull()) if "error" in catalog.columns else rows


def _columns(catalog: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    known = ["type", "not_null", *[c for c in ("default_value", "pk") if c in catalog.columns]]
    return _side(readable(user_tables(catalog)), by, "column", known, side)


def _indexes(indexes: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    return _side(readable(user_tables(indexes)), by, "index", ["is_unique"], side)


def _side(rows: DataFrame, by: Sequence[str], part: str, known: Sequence[str], side: str) -> DataFrame:
    """One flat row per column or index: what the sort of the diff holds is no wider than it must be."""
    return rows.select(
        *by, "table", F.lit(part == "column").alias("is_column"), F.col(part).alias("name"),
        F.lit(side == "old").alias("is_old"),
        *[(F.col(c) if c in known else F.lit(None)).cast(of).alias(c) for c, of in _PROPERTIES.items()],
    )


def diff_tables(old: DataFrame, new: DataFrame, by: Sequence[str] = DATABASE) -> DataFrame:
    """Tables only one catalog has: ``kind, table, columns``."""
    both = _columns(old, by, "old").unionByName(_columns(new, by, "new"))
    return (
        both.groupBy(*by, "table")
        .agg(F.count_if("is_old").alias("__old"), F.count_if(~F.col("is_old")).alias("__new"))
        .filter("__old = 0 or __new = 0")
        .select(
            *by,
            F.when(F.col("__old") == 0, M.TABLE_ADDED).otherwise(M.TABLE_REMOVED).alias("kind"),
            "table",
            (F.col("__old") + F.col("__new")).alias("columns"),
        )
    )


def _is_changed(compare_default: bool, compare_pk: bool) -> Column:
    fields = ["type", "not_null"] + ["default_value"] * compare_default + ["pk"] * compare_pk
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}"))
    return F.col("is_column") & F.col("old").isNotNull() & F.col("new").isNotNull() & differs


def schema_diff(
    old: DataFrame,
    new: DataFrame,
    old_indexes: DataFrame | None = None,
    new_indexes: DataFrame | None = None,
    by: Sequence[str] = DATABASE,
    compare_default: bool = False,
    compare_pk: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """The change table: ``kind, table, subject, detail, old, new`` per database.

    A table only one side has is one change; its columns and indexes are not
    listed. A column has changed when its type or NOT NULL differs. ``partitions``
    says into how many the rows are dealt; without it the session does, and where
    that number is fixed, a task sorts more the more rows there are.
    """
    both = _columns(old, by, "old").unionByName(_columns(new, by, "new"))
    if old_indexes is not None:
        both = both.unionByName(_indexes(old_indexes, by, "old"))
    if new_indexes is not None:
        both = both.unionByName(_indexes(new_indexes, by, "new"))

    # Dealt out first: maxima over text are found by a sort, and a sort before the shuffle would hold a
    # whole input split of wide rows next to what the split's own plan holds, to fold hardly a row.
    table = [*by, "table"]
    properties = F.struct(*_PROPERTIES).cast(_ITEM)
    dealt = both.repartition(*table) if partitions is None else both.repartition(partitions, *table)
    items = dealt.groupBy(*table, "is_column", "name").agg(
        F.max(F.when(F.col("is_old"), properties)).alias("old"), F.max(F.when(~F.col("is_old"), properties)).alias("new")
    )
    is_column = F.col("is_column")
    kind = (
        F.when(is_column & F.col("old").isNull(), M.COLUMN_ADDED)
        .when(is_column & F.col("new").isNull(), M.COLUMN_REMOVED)
        .when(_is_changed(compare_default, compare_pk), M.COLUMN_CHANGED)
        .when(~is_column & F.col("old").isNull(), M.INDEX_ADDED)
        .when(~is_column & F.col("new").isNull(), M.INDEX_REMOVED)
    )
    arrow = F.concat(F.col("old.type"), F.lit("→"), F.col("new.type"))
    # In the order of the grouping, so its sort serves the window too.
    whole = Window.partitionBy(*table).orderBy("is_column", "name")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = items.select(
        *table, "name", "old", "new", kind.alias("kind"),
        F.bool_or(is_column & F.col("old").isNotNull()).over(every).alias("__in_old"),
        F.bool_or(is_column & F.col("new").isNotNull()).over(every).alias("__in_new"),
        (F.row_number().over(whole) == 1).alias("__first"),
    )
    in_both = F.col("__in_old") & F.col("__in_new")

    def inside(value: Column) -> Column:
        return F.when(in_both, value)

    return rows.filter(F.when(in_both, F.col("kind").isNotNull()).otherwise(
        F.col("__first") & (F.col("__in_old") | F.col("__in_new"))
    )).select(
        *by,
        F.when(in_both, F.col("kind")).when(F.col("__in_new"), M.TABLE_ADDED).otherwise(M.TABLE_REMOVED).alias("kind"),
        "table", inside(F.col("name")).alias("subject"),
        inside(F.when(F.col("kind") == M.COLUMN_CHANGED, arrow)).alias("detail"),
        inside(F.col("old")).alias("old"), inside(F.col("new")).alias("new"),
    )


def diff_columns(old: DataFrame, new: DataFrame, by: Sequence[str] = DATABASE, **options) -> DataFrame:
    """Columns added, removed or changed in tables both catalogs have; ``options`` are those of ``schema_diff``."""
    return schema_diff(old, new, by=by, **options).filter(F.col("subject").isNotNull())


def diff_indexes(
    old_indexes: DataFrame,
    new_indexes: DataFrame,
    old: DataFrame,
    new: DataFrame,
    by: Sequence[str] = DATABASE,
    partitions: int | None = None,
) -> DataFrame:
    """Indexes added or removed, by name, on tables both catalogs have."""
    changes = schema_diff(old, new, old_indexes, new_indexes, by, partitions=partitions)
    return changes.filter(F.col("kind").isin(M.INDEX_ADDED, M.INDEX_REMOVED))


def _is_table_level() -> Column:
    return F.col("kind").isin(M.TABLE_ADDED, M.TABLE_REMOVED)


def change_summary(
    changes: DataFrame, data_changes: DataFrame | None = None, by: Sequence[str] = DATABASE
) -> DataFrame:
    """Per database: tables added, removed, modified and, with a data diff, changed in content."""
    flags = changes.select(
        *by, "table", (F.col("kind") == M.TABLE_ADDED).alias("a"), (F.col("kind") == M.TABLE_REMOVED).alias("r"),
        (~_is_table_level()).alias("m"), F.lit(False).alias("d"),
    )
    if data_changes is not None:
        no = F.lit(False)
        flags = flags.unionByName(data_changes.select(
            *by, "table", no.alias("a"), no.alias("r"), no.alias("m"),
            (F.col("added") + F.col("removed") + F.col("changed") > 0).alias("d"),
        ))
    per_table = flags.groupBy(*by, "table").agg(*[F.bool_or(f).alias(f) for f in "armd"])
    counts = [F.count_if("a").alias("tables_added"), F.count_if("r").alias("tables_removed"),
              F.count_if("m").alias("tables_modified")]
    if data_changes is not None:
        counts.append(F.count_if("d").alias("tables_with_data_changes"))
    return per_table.groupBy(*by).agg(*counts)


def change_detail(changes: DataFrame, by: Sequence[str] = DATABASE) -> DataFrame:
    """Per modified table: how many of its columns and indexes changed."""
    return changes.filter(~_is_table_level()).groupBy(*by, "table").agg(
        F.count_if(F.col("kind").isin(M.COLUMN_ADDED, M.COLUMN_REMOVED, M.COLUMN_CHANGED)).alias("column_changes"),
        F.count_if(F.col("kind").isin(M.INDEX_ADDED, M.INDEX_REMOVED)).alias("index_changes"),
    )


def verify_schema(
    got: DataFrame,
    want: DataFrame,
    got_indexes: DataFrame | None = None,
    want_indexes: DataFrame | None = None,
    by: Sequence[str] = DATABASE,
    partitions: int | None = None,
) -> DataFrame:
    """Per database: whether ``got`` has the schema of ``want``, indexes included, and how many tables differ."""
    changes = schema_diff(got, want, got_indexes, want_indexes, by, partitions=partitions)
    differing = changes.select(*by, F.col("table").alias("__differs")).distinct()
    known = [side.select(*by, F.lit(None).cast("string").alias("__differs")) for side in (want, got)]
    return (
        known[0].unionByName(known[1]).unionByName(differing)
        .groupBy(*by)
        .agg(F.count("__differs").alias("tables_differing"))
        .withColumn("matches", F.col("tables_differing") == 0)
    )
