"""Differences between the rows of two versions of a table.

Both versions are put together with a sign, -1 for an old row and +1 for a new
one, and grouped by all compared columns. Equal rows cancel, and what is left
over is the difference, exact also for repeated rows, repeated keys and NULL
keys. Copies of one row are counted before the shuffle and rows that share a key
are spread by their values, so no key or copy fills a task. Only the differences
go on to the second grouping, by key, that tells a changed row from an added or
removed one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit import model as M
from driftkit.functions.values import comparable, read_as, text_form
from driftkit.operators.keyed import membership

_NET = "__net"
_LOST = "__lost_"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def shared_columns(old: DataFrame, new: DataFrame) -> list[str]:
    """Columns both versions have, in the order of the new one."""
    have = set(old.columns)
    return [c for c in new.columns if c in have]


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.MapType, T.ArrayType, T.StructType, T.VariantType))


def _aligned(
    old: DataFrame, new: DataFrame, columns: Sequence[str], compare: str
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the same comparable columns.

    A retyped column is read in its new type. Old values that type cannot hold
    are kept as text in an extra column, so they never equal a new NULL.
    """
    left: list[Column] = []
    right: list[Column] = []
    extra_left: list[Column] = []
    extra_right: list[Column] = []
    for name in columns:
        was, now = old.schema[name].dataType, new.schema[name].dataType
        if compare == "text":
            left.append(text_form(_c(name), was).alias(name))
            right.append(text_form(_c(name), now).alias(name))
            continue
        if was == now or (_is_nested(was) and was.simpleString() == now.simpleString()):
            left.append(comparable(_c(name), was).alias(name))
            right.append(comparable(_c(name), now).alias(name))
            continue
        read = read_as(old, name, now)
        left.append(comparable(read, now).alias(name))
        right.append(comparable(_c(name), now).alias(name))
        lost = f"{_LOST}{name}"
        extra_left.append(F.when(read.isNull(), text_form(_c(name), was)).alias(lost))
        extra_right.append(F.lit(None).cast("string").alias(lost))
    return old.select(*left, *extra_left), new.select(*right, *extra_right)


def _signed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides grouped by all columns, with the net number of copies where it is not 0."""
    both = left.withColumn(_NET, F.lit(-1)).unionByName(right.withColumn(_NET, F.lit(1)))
    return both.groupBy(*[_c(n) for n in left.columns]).agg(F.sum(_NET).alias(_NET)).filter(F.col(_NET) != 0)


def differences(
    old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None, compare: str = "typed"
) -> DataFrame:
    """The compared columns plus ``__net``: copies gained (> 0) or lost (< 0).

    ``compare="text"`` compares printed values, so ``1`` equals ``'1'``.
    """
    if compare not in ("typed", "text"):
        raise ValueError("compare must be 'typed' or 'text'")
    columns = list(columns or shared_columns(old, new))
    if not columns:
        raise ValueError("the two versions share no column")
    return _signed(*_aligned(old, new, columns, compare))


def _with_lost(diff: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys, and for retyped ones the text of values that the new type cannot hold."""
    return [*keys, *[f"{_LOST}{k}" for k in keys if f"{_LOST}{k}" in diff.columns]]


def _key_shown(diff: DataFrame, name: str) -> Column:
    """A key as it is listed: as text where it was retyped, so that unreadable ones are seen."""
    if f"{_LOST}{name}" not in diff.columns:
        return _c(name).alias(name)
    return F.coalesce(_c(f"{_LOST}{name}"), text_form(_c(name), diff.schema[name].dataType)).alias(name)


def _gained(net: Column) -> Column:
    return F.greatest(net, F.lit(0))


def _lost(net: Column) -> Column:
    return F.greatest(-net, F.lit(0))


def _is_changed() -> Column:
    return (F.col("__old_n") == 1) & (F.col("__new_n") == 1)


def _per_key(diff: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    net = F.col(_NET)
    return diff.groupBy(*[_c(k) for k in keys]).agg(
        F.sum(_lost(net)).alias("__old_n"), F.sum(_gained(net)).alias("__new_n"), *more
    )


def _pairs(diff: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per differing key with one old and one new row next to each other."""
    row = F.struct(*[_c(v).alias(v) for v in values]) if values else F.struct(F.lit(True).alias("present"))
    return _per_key(
        diff,
        keys,
        F.first(F.when(F.col(_NET) < 0, row), ignorenulls=True).alias("old"),
        F.first(F.when(F.col(_NET) > 0, row), ignorenulls=True).alias("new"),
    )


def _check_keys(keys: Sequence[str], columns: Sequence[str]) -> list[str]:
    missing = [k for k in keys if k not in columns]
    if not keys or missing:
        raise ValueError(f"key columns must be in both versions: {missing or 'none given'}")
    return list(keys)


def _unreadable(rows: DataFrame, keys: Sequence[str], types: T.StructType) -> Column:
    """Whether some key has a value that the other side's type cannot hold."""
    lost = [_c(k).isNotNull() & read_as(rows, k, types[k].dataType).isNull() for k in keys]
    return reduce(lambda a, b: a | b, lost)


def added_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the new version whose key the old one does not have.

    A retyped key is read in its new type; old keys that cannot be are no new row's key.
    """
    known = old.filter(~_unreadable(old, keys, new.schema))
    known = known.select(*[read_as(old, k, new.schema[k].dataType).alias(k) for k in keys])
    return membership(new, known, keys, present=False)


def removed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the old version whose key the new one does not have.

    A retyped key is read in its new type; an old key that cannot be is removed.
    """
    if all(old.schema[k].dataType == new.schema[k].dataType for k in keys):
        return membership(old, new, keys, present=False)
    read = [f"__read{i}" for i in range(len(keys))]
    lost = _unreadable(old, keys, new.schema)
    rows = old.filter(~lost).select(
        "*", *[read_as(old, k, new.schema[k].dataType).alias(r) for k, r in zip(keys, read, strict=True)]
    )
    known = new.select(*[_c(k).alias(r) for k, r in zip(keys, read, strict=True)])
    return membership(rows, known, read, present=False).drop(*read).unionByName(old.filter(lost))


def diff_rows(
    old: DataFrame, new: DataFrame, keys: Sequence[str], limit: int | None = None, compare: str = "typed"
) -> DataFrame:
    """Rows that differ: ``status, key, old, new, copies``.

    A key with one differing row on each side is ``changed``. When a key is
    repeated and more than one of its rows differ, each of them is listed as
    ``removed`` or ``added`` with its number of copies. ``limit`` applies to the
    finished result in key order. A retyped key is shown as text.
    """
    columns = shared_columns(old, new)
    keys = _check_keys(keys, columns)
    diff = differences(old, new, columns, compare)
    grouped = _with_lost(diff, keys)
    values = [c for c in columns if c not in keys]
    key = F.struct(*[_key_shown(diff, k) for k in keys]).alias("key")

    pairs = _pairs(diff, grouped, values)
    repeated = (F.col("__old_n") > 1) | (F.col("__new_n") > 1)
    single = pairs.filter(~repeated).select(
        F.when(_is_changed(), M.CHANGED).when(F.col("__new_n") == 1, M.ADDED).otherwise(M.REMOVED).alias("status"),
        key, "old", "new", F.lit(1).cast("bigint").alias("copies"),
    )
    row = F.struct(*[_c(v).alias(v) for v in values]) if values else F.struct(F.lit(True).alias("present"))
    gained = F.col(_NET) > 0
    several = membership(diff, _per_key(diff, grouped).filter(repeated), grouped, present=True).select(
        F.when(gained, M.ADDED).otherwise(M.REMOVED).alias("status"),
        key,
        F.when(~gained, row).alias("old"),
        F.when(gained, row).alias("new"),
        F.abs(F.col(_NET)).cast("bigint").alias("copies"),
    )
    rows = single.unionByName(several)
    if limit is not None:
        rows = rows.orderBy("key", "status", "old", "new").limit(limit)
    return rows


def diff_cells(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: str = "typed") -> DataFrame:
    """Cells of changed rows that differ: keys, ``column``, ``old``, ``new`` as text.

    Rows of a repeated key of which several differ have no counterparts, so
    ``diff_rows`` lists them and they have no cells here.
    """
    columns = shared_columns(old, new)
    keys = _check_keys(keys, columns)
    values = [c for c in columns if c not in keys]
    diff = differences(old, new, columns, compare)
    grouped = _with_lost(diff, keys)
    kept = [c for c in diff.columns if c not in grouped and c != _NET]
    types = {f.name: f.dataType for f in diff.schema.fields}

    def cell(name: str) -> Column:
        before, after = F.col("old")[name], F.col("new")[name]
        differs = ~before.eqNullSafe(after)
        shown = text_form(before, types[name])
        if f"{_LOST}{name}" in kept:
            unread = F.col("old")[f"{_LOST}{name}"]
            differs, shown = differs | unread.isNotNull(), F.coalesce(unread, shown)
        return F.when(
            differs,
            F.struct(F.lit(name).alias("column"), shown.alias("old"), text_form(after, types[name]).alias("new")),
        )

    changed = _pairs(diff, grouped, kept).filter(_is_changed())
    return changed.select(
        *[_c(k) for k in keys], F.explode(F.array_compact(F.array(*[cell(v) for v in values]))).alias("__cell")
    ).select(*[_c(k) for k in keys], "__cell.*")


def diff_counts(
    old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None, compare: str = "typed"
) -> DataFrame:
    """One row ``added, removed, changed``.

    Without a key only the row counts are compared and their net difference is
    reported.
    """
    if not keys:
        return _net_counts(old, new)
    columns = shared_columns(old, new)
    keys = _check_keys(keys, columns)
    diff = differences(old, new, columns, compare)
    changed = _is_changed()
    zero = F.lit(0).cast("bigint")
    return _per_key(diff, _with_lost(diff, keys)).agg(
        F.coalesce(F.sum(F.when(changed, 0).otherwise(F.col("__new_n"))), zero).alias("added"),
        F.coalesce(F.sum(F.when(changed, 0).otherwise(F.col("__old_n"))), zero).alias("removed"),
        F.count_if(changed).alias("changed"),
    )


def _net_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    signed = old.agg((-F.count(F.lit(1))).alias(_NET)).unionByName(new.agg(F.count(F.lit(1)).alias(_NET)))
    net = F.sum(_NET)
    return signed.agg(
        _gained(net).alias("added"), _lost(net).alias("removed"), F.lit(0).cast("bigint").alias("changed")
    )


def diff_multiset(old: DataFrame, new: DataFrame, compare: str = "typed") -> DataFrame:
    """Rows by multiplicity, without a key: shared columns, ``status``, ``copies``."""
    diff = differences(old, new, None, compare)
    return diff.select(
        *[_c(c) for c in diff.columns if c != _NET and not c.startswith(_LOST)],
        F.when(F.col(_NET) > 0, M.ADDED).otherwise(M.REMOVED).alias("status"),
        F.abs(F.col(_NET)).cast("bigint").alias("copies"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, rows`` of every table, counted in one job."""
    if not tables:
        raise ValueError("no tables given")
    counts = [
        tables[t].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows")
        for t in sorted(tables)
    ]
    return reduce(DataFrame.unionByName, counts)


def diff_tables_data(
    old: Mapping[str, DataFrame],
    new: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``table, added, removed, changed`` for every table with data changes.

    A table only one side has counts all its rows as added or removed; a shared
    table without any difference is left out.
    """
    keys = keys or {}
    none = F.lit(0).cast("bigint")
    n = F.count(F.lit(1))
    parts: list[DataFrame] = []
    for t in sorted(set(old) | set(new)):
        if t not in old:
            part = new[t].agg(n.alias("added"), none.alias("removed"), none.alias("changed"))
        elif t not in new:
            part = old[t].agg(none.alias("added"), n.alias("removed"), none.alias("changed"))
        else:
            part = diff_counts(old[t], new[t], keys.get(t)).filter("added + removed + changed > 0")
        parts.append(part.select(F.lit(t).alias("table"), "added", "removed", "changed"))
    if not parts:
        raise ValueError("no tables given")
    return reduce(DataFrame.unionByName, parts)


def literal(value: object, dtype: T.DataType) -> Column:
    """``value`` as a literal of a column's type; a zoneless time stays as it is."""
    if isinstance(dtype, T.TimestampNTZType) and value is not None:
        return F.lit(str(value)).cast(dtype)
    return F.lit(value).cast(dtype)


def _sortable(dtype: T.DataType) -> bool:
    return not _is_nested(dtype)


def page_order(df: DataFrame, order_by: Sequence[str]) -> list[str]:
    """``order_by`` and then every other plain column: only equal rows tie in this order."""
    rest = [f.name for f in df.schema.fields if f.name not in order_by and _sortable(f.dataType)]
    return [*order_by, *rest]


def page(
    df: DataFrame,
    order_by: Sequence[str],
    limit: int,
    offset: int = 0,
    after: Sequence[object] | None = None,
    seen: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """One page of rows in ``page_order`` order, and the total as a one-row frame.

    To read the next page, give the last row's values of the ``page_order``
    columns as ``after``, and how many rows equal to it in these columns were
    read so far as ``seen``: the filter reaches the scan, and pages read one
    after the other hold every row once. An ``offset`` sorts the rows it skips;
    ``order_index`` leads straight to a page, however deep.
    """
    if not order_by:
        raise ValueError("a page needs an order")
    names = page_order(df, order_by)
    order = [_c(c) for c in names]
    rows = df
    if after is not None:
        if len(after) != len(order):
            raise ValueError("after needs one value per column of page_order")
        beyond = F.lit(False)
        equal = F.lit(True)
        for name, col, value in zip(names, order, after, strict=True):
            # NULLs come first in the order.
            last = literal(value, df.schema[name].dataType)
            beyond = beyond | (equal & (col.isNotNull() if value is None else col > last))
            equal = equal & (col.isNull() if value is None else col.eqNullSafe(last))
        rows = df.filter(equal).offset(seen).unionByName(df.filter(beyond))
    return rows.orderBy(*order).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))
