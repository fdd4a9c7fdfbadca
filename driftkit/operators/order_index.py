"""An order-statistics index: where each row stands in an order, without one task that sees them all.

Rows are dealt out by ranges of the order and sorted inside each range, so a row
is known by its range and its place there. Rows per range and their running sum,
a row per range, turn a position into a range and a place and back. No task holds
more than a range, and a page reads only the ranges that it touches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftkit.operators.data_diff import literal, page_order
from driftkit.operators.keyed import lookup
from driftkit.session import discard, work_dir

RANGE, PLACE, POSITION = "__range", "__place", "position"
_SALT = "__salt"


@dataclass(frozen=True)
class OrderIndex:
    """``rows`` are the table's with ``__range`` and ``__place``; ``ranges`` has ``range, rows, start, first``.

    ``start`` counts the rows of all ranges before, ``first`` is the range's
    first key. Both are files under ``path``.
    """

    rows: DataFrame
    ranges: DataFrame
    order: tuple[str, ...]
    path: str

    def total(self) -> int:
        return self.ranges.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def release(self) -> None:
        """Deletes the files; frames read from the index are of no use from here on."""
        discard(self.rows.sparkSession, self.path)


def order_index(
    df: DataFrame, order_by: Sequence[str], path: str | None = None, ranges: int | None = None
) -> OrderIndex:
    """Writes the index of ``df`` in ``page_order`` order, NULLs first.

    Only rows equal in every sortable column tie, and these are spread over ranges
    too, so that copies of one row do not fill a task. ``ranges`` is a number of
    ranges; without it Spark cuts them by size.
    """
    if not order_by:
        raise ValueError("an index needs an order")
    names = page_order(df, order_by)
    spark = df.sparkSession
    path = path or f"{work_dir(spark).rstrip('/')}/order-{uuid.uuid4().hex}"
    order = [*[F.col(f"`{n}`") for n in names], F.col(_SALT)]
    salted = df.withColumn(_SALT, F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(ranges, *order) if ranges else salted.repartitionByRange(*order)
    (
        dealt.sortWithinPartitions(*order)
        .drop(_SALT)
        .withColumn(RANGE, F.spark_partition_id())
        # The lower 33 bits are the row's number within its partition.
        .withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .write.parquet(f"{path}/rows")
    )
    rows = spark.read.parquet(f"{path}/rows")
    # One row per range, so the running sum is short however long the table is.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    (
        rows.groupBy(F.col(RANGE).alias("range"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min_by(F.struct(*[f"`{n}`" for n in names]), PLACE).alias("first"))
        .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("bigint")))
        .write.parquet(f"{path}/ranges")
    )
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> OrderIndex:
    """The index written at ``path``."""
    ranges = spark.read.parquet(f"{path}/ranges")
    order = tuple(ranges.schema["first"].dataType.fieldNames())
    return OrderIndex(spark.read.parquet(f"{path}/rows"), ranges.select("range", "rows", "start", "first"), order, path)


def positioned(index: OrderIndex) -> DataFrame:
    """Every row with its ``position``, from 0."""
    starts = index.ranges.select(F.col("range").alias(RANGE), "start")
    return index.rows.join(starts, RANGE).withColumn(POSITION, F.col("start") + F.col(PLACE)).drop("start", RANGE, PLACE)


def page_at(index: OrderIndex, offset: int, limit: int) -> DataFrame:
    """The rows at ``offset`` to ``offset + limit - 1`` with their ``position``.

    The driver looks up the ranges that the page touches; the scan then skips the
    other ranges and, in the first and the last, the rows outside. Nothing is
    sorted. An offset beyond the end gives an empty page.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    end = offset + limit
    touched = (F.col("start") < F.lit(end)) & (F.col("start") + F.col("rows") > F.lit(offset))
    edge = index.ranges.filter(touched).agg(
        F.min(F.struct("range", "start")).alias("low"), F.max(F.struct("range", "start")).alias("high")
    ).first()
    if edge["low"] is None:
        return positioned(index).filter(F.lit(False))
    at, place = F.col(RANGE), F.col(PLACE)
    low, high = edge["low"], edge["high"]
    inside = at.between(low["range"], high["range"])
    inside &= (at > low["range"]) | (place >= F.lit(offset - low["start"]))
    inside &= (at < high["range"]) | (place < F.lit(end - high["start"]))
    cut = OrderIndex(index.rows.filter(inside), index.ranges.filter(F.col("range").between(low["range"], high["range"])),
                     index.order, index.path)
    return positioned(cut)


def pages(index: OrderIndex, size: int) -> DataFrame:
    """Every row with its ``position`` and the number of its ``page``, from 0; a page has ``size`` rows."""
    if size < 1:
        raise ValueError("a page needs a row")
    return positioned(index).withColumn("page", F.floor(F.col(POSITION) / size).cast("bigint"))


def offset_of(index: OrderIndex, key: Sequence[object]) -> int:
    """How many rows stand before the first one that is not less than ``key``, values of the leading columns.

    The rows of the ranges that begin before the key are known, all but those of
    the last of them, the only range that is read.
    """
    if not 0 < len(key) <= len(index.order):
        raise ValueError("a key needs values of the leading columns of the order")
    named = index.order[: len(key)]
    wanted = F.struct(*[
        literal(v, index.rows.schema[n].dataType).alias(n) for n, v in zip(named, key, strict=True)
    ])
    first = F.struct(*[F.col("first").getField(n).alias(n) for n in named])
    last = index.ranges.filter(first < wanted).agg(F.max(F.struct("start", "range")).alias("last")).first()["last"]
    if last is None:
        return 0
    held = index.rows.filter(F.col(RANGE) == last["range"])
    return last["start"] + held.filter(F.struct(*[F.col(f"`{n}`") for n in named]) < wanted).count()


def ranked(index: OrderIndex, by: Sequence[str]) -> DataFrame:
    """Every row with its ``rank`` in its group, from 0, and the ``size`` of the group.

    ``by`` are the leading columns of the order. A group is counted by range, so
    one that fills many ranges is ranked by as many tasks.
    """
    if tuple(by) != index.order[: len(by)]:
        raise ValueError("groups must lead the order")
    columns = [F.col(f"`{c}`") for c in by]
    parts = index.rows.groupBy(*columns, RANGE).agg(F.min(PLACE).alias("__first"), F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*columns)
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(
        *columns, RANGE, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(group).alias("size"),
    )
    return (
        lookup(index.rows, placed, [*by, RANGE])
        .withColumn("rank", F.col("__shift") + F.col(PLACE))
        .drop("__shift", RANGE, PLACE)
    )
