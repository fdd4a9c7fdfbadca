"""Live catalogs against their baselines, and the history of such checks."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit import model as M
from driftkit.operators.as_of import as_of
from driftkit.operators.keyed import lookup, membership
from driftkit.operators.order_index import order_index, ranked
from driftkit.operators.schema_diff import DATABASE, readable, schema_diff, user_tables

CAPTURE = ("database", "captured_at")

#: Spark's own limit for keeping the first rows of a group in each task.
_KEPT_BY_TASK = 1000


def latest_snapshot(snapshots: DataFrame, by: Sequence[str] = DATABASE) -> DataFrame:
    """The catalog rows of each database's newest snapshot."""
    return membership(snapshots, newest_times(snapshots, by), [*by, "captured_at"], present=True)


def newest_times(snapshots: DataFrame, by: Sequence[str] = DATABASE) -> DataFrame:
    """When each database was captured last."""
    return snapshots.groupBy(*by).agg(F.max("captured_at").alias("captured_at"))


def if_one_capture(value: Column, *times: str) -> Column:
    """``value`` of a group; an error if the rows of the group hold several of one kind of time."""
    several = F.lit(False)
    for at in times:
        several = several | F.coalesce(F.min(at) != F.max(at), F.lit(False))
    return F.when(several, F.raise_error(F.lit("several captures of one database: give one, or use drift_in_force"))).otherwise(value)


def indexes_at(indexes: DataFrame, times: DataFrame, by: Sequence[str] = DATABASE) -> DataFrame:
    """The index rows captured at those times; a snapshot without indexes has none."""
    return membership(indexes, times, [*by, "captured_at"], present=True)


def drift(
    baseline: DataFrame,
    live: DataFrame,
    baseline_indexes: DataFrame | None = None,
    live_indexes: DataFrame | None = None,
    checked_at: datetime.datetime | None = None,
    by: Sequence[str] = DATABASE,
    partitions: int | None = None,
) -> DataFrame:
    """One report row per database that has a baseline.

    ``source, baseline_at, checked_at, has_drift, changes, error``; ``changes``
    lists one database's schema changes. A member that could not be read carries
    its ``error`` and no verdict; one that the live catalogs do not hold was
    checked when the newest of them was captured. More than one capture of a
    database on either side is an error: ``latest_snapshot`` gives the newest, and
    ``drift_in_force`` judges them all. ``partitions`` is that of ``schema_diff``.
    """
    changes = schema_diff(baseline, live, baseline_indexes, live_indexes, by, partitions=partitions)
    item = F.struct(*[F.col(f) for f in M.CHANGE_ITEM.fieldNames()])
    no_item = F.lit(None).cast(M.CHANGE_ITEM)
    no_text = F.lit(None).cast("string")
    at_type = baseline.schema["captured_at"].dataType
    no_time = F.lit(None).cast(at_type)

    def part(df: DataFrame, is_baseline: bool, at, change, error) -> DataFrame:
        return df.select(
            *by, F.lit(is_baseline).alias("__base"),
            (at if is_baseline else no_time).alias("__baseline_at"),
            (no_time if is_baseline else at).alias("__checked_at"),
            change.cast(M.CHANGE_ITEM).alias("__change"), error.cast("string").alias("__error"),
        )

    parts = (
        part(baseline, True, F.col("captured_at"), no_item, no_text)
        .unionByName(part(live, False, F.col("captured_at").cast(at_type), no_item,
                          F.col("error") if "error" in live.columns else no_text))
        .unionByName(part(changes, False, no_time, item, no_text))
    )
    if checked_at is not None:
        checked = F.lit(checked_at).cast(at_type)
    elif "captured_at" in by:
        checked = F.max("__checked_at")
    else:
        now = F.coalesce(F.max(F.col("captured_at").cast(at_type)), F.current_timestamp().cast(at_type))
        checked = F.coalesce(F.max("__checked_at"), live.agg(now.alias("at")).scalar())
    per_member = parts.groupBy(*by).agg(
        F.bool_or("__base").alias("__known"),
        F.max("__baseline_at").alias("baseline_at"),
        checked.alias("checked_at"),
        if_one_capture(F.array_sort(F.collect_list("__change")), "__baseline_at", "__checked_at").alias("__changes"),
        F.max("__error").alias("error"),
    )
    readable = F.col("error").isNull()
    return per_member.filter("__known").select(
        F.col("database").alias("source"),
        *[c for c in by if c != "database"],
        "baseline_at", "checked_at",
        F.when(readable, F.size("__changes") > 0).alias("has_drift"),
        F.when(readable, F.col("__changes")).otherwise(F.array().cast("array<" + M.CHANGE_ITEM.simpleString() + ">"))
        .alias("changes"),
        "error",
    )


def fingerprints(catalog: DataFrame, indexes: DataFrame | None = None, by: Sequence[str] = CAPTURE) -> DataFrame:
    """A digest per capture of all that a comparison looks at; captures with equal digests have equal schemas."""
    no = F.lit(None).cast("string")
    lines = readable(user_tables(catalog)).select(
        *by, F.to_json(F.struct("table", "column", "type", "not_null")).alias("__line")
    )
    if indexes is not None:
        lines = lines.unionByName(readable(user_tables(indexes)).select(
            *by, F.to_json(F.struct("table", "index", "is_unique")).alias("__line")
        ))
    # A capture that has no column is one too.
    every = lines.unionByName(catalog.select(*by, no.alias("__line")))
    text = F.concat_ws("\n", F.array_sort(F.collect_set("__line")))
    return every.groupBy(*by).agg(F.sha2(text, 256).alias("fingerprint"))


def _reports(
    pairs: DataFrame,
    baseline: DataFrame,
    snapshots: DataFrame,
    baseline_indexes: DataFrame | None,
    indexes: DataFrame | None,
) -> DataFrame:
    """A report for each pair (``database``, ``captured_at``, ``baseline_at``) of a capture and a baseline.

    Both sides come down to a digest per capture first. Only captures whose digest
    differs from their baseline's meet its rows, so a baseline that most captures
    still match is not multiplied by them.
    """
    errors = snapshots.groupBy(*CAPTURE).agg(F.max("error").alias("error")) if "error" in snapshots.columns else None
    live_print = fingerprints(snapshots, indexes)
    base_print = fingerprints(baseline, baseline_indexes).withColumnsRenamed(
        {"captured_at": "baseline_at", "fingerprint": "__base"}
    )
    judged = lookup(lookup(pairs, live_print, CAPTURE), base_print, ["database", "baseline_at"])
    judged = judged.withColumn("error", F.lit(None).cast("string")) if errors is None else lookup(judged, errors, CAPTURE)
    differs = judged.filter(F.col("error").isNull() & (F.col("fingerprint") != F.col("__base")))
    differs = differs.select(*CAPTURE, "baseline_at")

    def then(rows: DataFrame) -> DataFrame:
        based = differs.withColumnsRenamed({"database": "__database", "captured_at": "__captured_at"})
        match = F.col("database").eqNullSafe(F.col("__database")) & (F.col("captured_at") == F.col("baseline_at"))
        return rows.join(based, match).drop("__database", "captured_at", "baseline_at").withColumnRenamed(
            "__captured_at", "captured_at"
        )

    def now(rows: DataFrame) -> DataFrame:
        return membership(rows, differs, CAPTURE, present=True)

    changes = schema_diff(
        then(baseline), now(snapshots), None if baseline_indexes is None else then(baseline_indexes),
        None if indexes is None else now(indexes), CAPTURE,
    )
    item = F.struct(*[F.col(f) for f in M.CHANGE_ITEM.fieldNames()]).cast(M.CHANGE_ITEM)
    listed = changes.groupBy(*CAPTURE).agg(F.array_sort(F.collect_list(item)).alias("__changes"))
    nothing = F.array().cast(T.ArrayType(M.CHANGE_ITEM))
    return lookup(judged, listed, CAPTURE).select(
        F.col("database").alias("source"), "baseline_at", F.col("captured_at").alias("checked_at"),
        F.when(F.col("error").isNull(), F.col("__changes").isNotNull()).alias("has_drift"),
        F.coalesce("__changes", nothing).alias("changes"), "error",
    )


def drift_of_snapshots(
    baseline: DataFrame,
    snapshots: DataFrame,
    baseline_indexes: DataFrame | None = None,
    indexes: DataFrame | None = None,
) -> DataFrame:
    """Each snapshot, told apart by database and capture time, against the database's newest baseline.

    ``baseline_indexes`` are those of the newest baselines, whatever their time;
    ``indexes`` may hold the indexes of other snapshots too.
    """
    newest = newest_times(baseline)
    taken = snapshots.select(*CAPTURE).distinct()
    pairs = lookup(taken, newest.withColumnRenamed("captured_at", "baseline_at"), ["database"])
    return _reports(
        pairs.filter(F.col("baseline_at").isNotNull()), latest_snapshot(baseline), snapshots,
        None if baseline_indexes is None else lookup(baseline_indexes.drop("captured_at"), newest, ["database"]),
        None if indexes is None else _of(indexes, taken),
    )


def _of(indexes: DataFrame, captures: DataFrame) -> DataFrame:
    return membership(indexes, captures, CAPTURE, present=True)


def drift_in_force(
    baselines: DataFrame,
    snapshots: DataFrame,
    baseline_indexes: DataFrame | None = None,
    indexes: DataFrame | None = None,
) -> DataFrame:
    """Each snapshot against the baseline in force when it was taken: the database's last one up to that time.

    Both may hold any number of captures of a database. One that was taken before
    the first baseline has no report. ``indexes`` may hold those of other captures.
    """
    taken = snapshots.select(*CAPTURE).distinct()
    pairs = as_of(taken, baselines, ["database"], "captured_at", "baseline_at").filter(F.col("baseline_at").isNotNull())
    return _reports(
        pairs, baselines, snapshots,
        None if baseline_indexes is None else _of(baseline_indexes, baselines.select(*CAPTURE)),
        None if indexes is None else _of(indexes, taken),
    )


def history_summary(history: DataFrame) -> DataFrame:
    """Per source: checks, drifts, last check and last drift."""
    return history.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("has_drift").alias("drift_count"),
        F.max("checked_at").alias("last_checked"),
        F.max(F.when(F.col("has_drift"), F.col("checked_at"))).alias("last_drift"),
    )


def history_last(history: DataFrame, n: int, then_by: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` checks of each source, oldest first; ``then_by`` settles equal times.

    Up to 1,000 every task keeps the newest of each source before the shuffle.
    Beyond that an order index ranks them, so a source may fill many tasks.
    """
    if n > _KEPT_BY_TASK:
        rows = ranked(order_index(history, ["source", "checked_at", *then_by]), ["source"])
        newest = rows.filter(F.col("rank") >= F.col("size") - n).drop("rank", "size")
        return newest.orderBy("source", "checked_at", *then_by)
    newest_first = Window.partitionBy("source").orderBy(F.desc("checked_at"), *[F.desc(c) for c in then_by])
    return (
        history.withColumn("__n", F.row_number().over(newest_first))
        .filter(F.col("__n") <= n)
        .drop("__n")
        .orderBy("source", "checked_at", *then_by)
    )
