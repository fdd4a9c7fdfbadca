"""Row counts, keys, NULLs and foreign keys."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit import model as M
from driftkit.functions.values import comparable, read_as, text_form
from driftkit.operators.data_diff import row_counts
from driftkit.operators.keyed import without_match
from driftkit.session import discard, work_dir


@dataclass(frozen=True)
class ForeignKey:
    """``child.columns`` must be found in ``parent.parent_columns``."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.columns or len(self.columns) != len(self.parent_columns):
            raise ValueError("a foreign key needs as many parent columns as child columns")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _complete(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in columns])


def compare_counts(backup: DataFrame, reference: DataFrame) -> DataFrame:
    """``table, backup_rows, reference_rows, rows_match`` for each reference table.

    A table the backup lacks counts as 0 rows and never matches.
    """
    found = backup.select("table", F.col("rows").alias("__found"))
    return reference.join(found, "table", "left").select(
        "table",
        F.coalesce(F.col("__found"), F.lit(0).cast("bigint")).alias("backup_rows"),
        F.col("rows").alias("reference_rows"),
        F.coalesce(F.col("__found") == F.col("rows"), F.lit(False)).alias("rows_match"),
    )


def compare_row_counts(backup: Mapping[str, DataFrame], reference: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of two table sets next to each other."""
    return compare_counts(row_counts(backup), row_counts(reference))


def check_row_ranges(counts: DataFrame, ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tables whose row count lies outside ``min_rows..max_rows``, as changes.

    A NULL bound is open; a table that is not there has no rows.
    """
    rows = F.coalesce(F.col("rows"), F.lit(0).cast("bigint"))
    outside = F.coalesce(rows < F.col("min_rows"), F.lit(False)) | F.coalesce(rows > F.col("max_rows"), F.lit(False))

    def bound(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return (
        ranges.join(counts, [*by, "table"], "left")
        .filter(outside)
        .select(
            *by, F.lit(M.ROWS_OUT_OF_RANGE).alias("kind"), "table", F.lit(None).cast("string").alias("subject"),
            F.concat(rows.cast("string"), F.lit(" not in "), bound("min_rows"), F.lit(".."), bound("max_rows"))
            .alias("detail"),
        )
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their number of ``copies``.

    Rows with a NULL in the key belong to ``not_null_check``.
    """
    counted = df.filter(_complete(keys)).select(*[comparable(_c(k), df.schema[k].dataType).alias(k) for k in keys])
    return counted.groupBy(*[_c(k) for k in keys]).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def pk_unique_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``duplicate_keys``, the ``extra_rows`` they bring, and ``is_unique``."""
    return duplicate_keys(df, keys).agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0).cast("bigint")).alias("extra_rows"),
        (F.count(F.lit(1)) == 0).alias("is_unique"),
    )


def not_null_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, nulls, rows`` of each column, from one pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(_c(c).isNull()).alias(f"__{i}") for i, c in enumerate(columns)]
    )
    per_column = [F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("nulls")) for i, c in enumerate(columns)]
    return counts.select(F.explode(F.array(*per_column)).alias("c"), "__rows").select(
        "c.*", F.col("__rows").alias("rows")
    )


def orphan_keys(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Complete child keys without a parent, with the ``rows`` that hold them.

    A child key is read in its parent's types; what cannot be is an orphan.
    Both sides are reduced to their distinct keys before the shuffle, so a key
    that fills much of the child travels once per task, not once per row.
    """
    held = (
        child.select(*[_c(c) for c in fk.columns])
        .filter(_complete(fk.columns))
        .groupBy(*[_c(c) for c in fk.columns])
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    types = [parent.schema[p].dataType for p in fk.parent_columns]
    if all(child.schema[c].dataType == t for c, t in zip(fk.columns, types, strict=True)):
        known = parent.select(*[_c(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)])
        return without_match(held, known.filter(_complete(fk.columns)).distinct(), fk.columns)
    read = [f"__read{i}" for i in range(len(fk.columns))]
    held = held.select("*", *[read_as(held, c, t).alias(r) for c, t, r in zip(fk.columns, types, read, strict=True)])
    known = parent.select(*[_c(p).alias(r) for p, r in zip(fk.parent_columns, read, strict=True)])
    return without_match(held, known.filter(_complete(read)).distinct(), read).drop(*read)


def _relation(fk: ForeignKey) -> list[Column]:
    return [
        F.lit(fk.child).alias("child"), F.lit(", ".join(fk.columns)).alias("columns"), F.lit(fk.parent).alias("parent")
    ]


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class _KeyForm:
    """How the keys of all relations share the same few columns: whole numbers as longs, all else as text.

    A key has ``whole`` longs and ``text`` texts at most; what a relation does not
    use is 0 or empty, the relation tells them apart. A value that its parent's
    type cannot hold is text that no parent key has.
    """

    tables: Mapping[str, DataFrame]
    fks: Sequence[ForeignKey]

    def _types(self, fk: ForeignKey) -> list[T.DataType]:
        return [self.tables[fk.parent].schema[c].dataType for c in fk.parent_columns]

    def is_whole(self, fk: ForeignKey) -> list[bool]:
        child = self.tables[fk.child].schema
        return [
            isinstance(t, _WHOLE) and isinstance(child[c].dataType, _WHOLE)
            for c, t in zip(fk.columns, self._types(fk), strict=True)
        ]

    @property
    def columns(self) -> list[str]:
        whole = max(sum(self.is_whole(fk)) for fk in self.fks)
        text = max(len(fk.columns) - sum(self.is_whole(fk)) for fk in self.fks)
        return [*[f"__w{k}" for k in range(whole)], *[f"__t{k}" for k in range(text)]]

    def key(self, fk: ForeignKey, df: DataFrame, columns: Sequence[str]) -> list[Column]:
        """The key columns of a relation from the columns of its child or its parent."""
        out = {c: F.lit(0).cast("bigint") if c.startswith("__w") else F.lit("") for c in self.columns}
        whole = text = 0
        for c, t, w in zip(columns, self._types(fk), self.is_whole(fk), strict=True):
            if w:
                out[f"__w{whole}"] = _c(c).cast("bigint")
                whole += 1
            else:
                strange = F.concat(F.lit("\u0000"), text_form(_c(c), df.schema[c].dataType))
                out[f"__t{text}"] = F.coalesce(text_form(read_as(df, c, t), t), strange)
                text += 1
        return [v.alias(c) for c, v in out.items()]

    def keys(self, parents: bool) -> DataFrame:
        """``relation`` and key of every complete key of the children, or of the parents: one scan per table."""
        sides: dict[str, list[tuple[int, ForeignKey]]] = {}
        for i, fk in enumerate(self.fks):
            sides.setdefault(fk.parent if parents else fk.child, []).append((i, fk))
        listed = []
        for name, uses in sides.items():
            df = self.tables[name]
            structs = []
            for i, fk in uses:
                columns = fk.parent_columns if parents else fk.columns
                structs.append(F.when(_complete(columns), F.struct(F.lit(i).alias("relation"), *self.key(fk, df, columns))))
            # One relation needs no array; several become one row each.
            one = df.select(structs[0].alias("k")) if len(structs) == 1 else df.select(F.explode(F.array(*structs)).alias("k"))
            listed.append(one.filter("k is not null").select("k.*"))
        return reduce(DataFrame.unionByName, listed)

    def orphans(self) -> DataFrame:
        """``relation``, key and ``rows`` of every child key without a parent."""
        by = ["relation", *self.columns]
        held = self.keys(parents=False).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
        return without_match(held, self.keys(parents=True).distinct(), by)


def fk_check(tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey]) -> DataFrame:
    """Per relation: how many keys and rows have no parent.

    Child keys are read in their parent's types; what cannot be is an orphan.
    Each table is scanned once, whatever the number of its relations, and keys
    are counted by task before the shuffle.
    """
    form = _KeyForm(tables, fks)
    found = form.orphans().select("relation", F.lit(1).cast("bigint").alias("k"), F.col("rows").alias("r"))
    return _named(_with_all(found, fks).groupBy("relation").agg(
        F.sum("k").alias("orphan_keys"), F.sum("r").alias("orphan_rows")
    ), fks)


def _with_all(found: DataFrame, fks: Sequence[ForeignKey]) -> DataFrame:
    """``found`` and a row of zeros for each relation, so that one without orphans is reported too."""
    zero = F.lit(0).cast("bigint")
    every = found.sparkSession.range(len(fks)).select(F.col("id").cast("int").alias("relation"), zero.alias("k"), zero.alias("r"))
    return found.unionByName(every)


def _named(rows: DataFrame, fks: Sequence[ForeignKey]) -> DataFrame:
    named = F.element_at(F.array(*[F.struct(*_relation(fk)) for fk in fks]), F.col("relation") + 1)
    return rows.select(named.alias("__n"), *[c for c in rows.columns if c != "relation"]).select(
        "__n.*", *[c for c in rows.columns if c != "relation"]
    )


def fk_sample(
    tables: Mapping[str, DataFrame],
    fks: Sequence[ForeignKey],
    row_keys: Mapping[str, Sequence[str]],
    n: int = 5,
) -> DataFrame:
    """The first ``n`` violating rows per relation, next to the exact number.

    The rows come in key order, then in the order of the row key. Each orphan key
    has a row, so the first ``n`` rows hold no other keys than the first ``n`` keys:
    ``n`` keys per relation at most, which are broadcast to one scan of each child. Keys of other
    types than whole numbers and texts go in the order of their printed form. All
    relations together take one scan of each parent and two of each child.
    """
    form = _KeyForm(tables, fks)
    columns, spark = form.columns, next(iter(tables.values())).sparkSession
    counted = Window.partitionBy("relation")
    path = f"{work_dir(spark).rstrip('/')}/orphans-{uuid.uuid4().hex}"
    form.orphans().write.parquet(path)
    orphans = spark.read.parquet(path)
    # Spark keeps the first n of each relation in every task, so no task sees all orphans of one.
    turn = F.row_number().over(counted.orderBy(*columns))
    first = orphans.withColumn("__turn", turn).filter(F.col("__turn") <= n).select("relation", *columns)
    totals = orphans.groupBy("relation").agg(F.sum("rows").alias("violations"))
    # At most n keys and one total per relation, so these are small whatever the tables hold.
    wanted, totals = (spark.createDataFrame(df.collect(), df.schema) for df in (first, totals))
    discard(spark, path)
    parts = []
    for name in dict.fromkeys(fk.child for fk in fks):
        child, own = tables[name], [(i, fk) for i, fk in enumerate(fks) if fk.child == name]
        needed = [_c(c) for c in dict.fromkeys([*row_keys[name], *[c for _, fk in own for c in fk.columns]])]
        keys = [F.when(_complete(fk.columns), F.struct(F.lit(i).alias("relation"), *form.key(fk, child, fk.columns)))
                for i, fk in own]
        rows = child.select(F.struct(*needed).alias("__row"), F.explode(F.array(*keys)).alias("__k"))
        rows = rows.filter("__k is not null").select("__row", "__k.*")
        held = rows.join(F.broadcast(wanted), ["relation", *columns], "left_semi")

        def text(names: Sequence[str], schema: T.StructType = child.schema) -> Column:
            return F.concat_ws(", ", *[text_form(F.col("__row").getField(c), schema[c].dataType) for c in names])

        shown = reduce(lambda rest, use: F.when(F.col("relation") == use[0], text(use[1].columns)).otherwise(rest), own, F.lit(None))
        turn = F.row_number().over(counted.orderBy(*columns, *[F.col("__row").getField(k) for k in row_keys[name]]))
        kept = held.withColumn("__turn", turn).filter(F.col("__turn") <= n)
        parts.append(kept.select("relation", "__turn", shown.alias("key"), text(row_keys[name]).alias("row_key")))
    sample = reduce(DataFrame.unionByName, parts)
    return _named(sample.join(totals, "relation").orderBy("relation", "__turn").drop("__turn"), fks)
