"""Many databases at once: the registry, its checks and rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.functions.text import provider, redact
from driftkit.operators.drift import if_one_capture
from driftkit.operators.keyed import lookup
from driftkit.operators.schema_diff import schema_diff


def fleet_filter(registry: DataFrame, tag: str = "") -> DataFrame:
    """Members with ``tag``; all of them when it is empty."""
    return registry.filter(F.array_contains("tags", tag)) if tag else registry


def with_provider(registry: DataFrame) -> DataFrame:
    """Members with the kind of place they live in."""
    return registry.withColumn("provider", provider(F.col("dsn")))


def registry_problems(registry: DataFrame) -> DataFrame:
    """What is wrong with a registry: ``problem, name, members``; no rows when it is sound."""

    def problem(df: DataFrame, text: str, members) -> DataFrame:
        return df.select(F.lit(text).alias("problem"), "name", members.cast("bigint").alias("members"))

    def blank(c: str):
        return F.coalesce(F.col(c), F.lit("")) == ""

    empty = registry.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").withColumn("name", F.lit(None).cast("string"))
    repeated = (
        registry.filter(~blank("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    return (
        problem(empty, "no databases", F.col("n"))
        .unionByName(problem(registry.filter(blank("name")), "no name", F.lit(1)))
        .unionByName(problem(registry.filter(blank("dsn") & ~blank("name")), "no dsn", F.lit(1)))
        .unionByName(problem(repeated, "duplicate name", F.col("n")))
        .unionByName(problem(_unplaced(registry), "no position", F.lit(1)))
    )


def _unplaced(registry: DataFrame) -> DataFrame:
    """Members that no rollout could put in order."""
    return registry.filter(F.col("pos").isNull() if "pos" in registry.columns else F.lit(False))


def fleet_status(registry: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Members, and when the baseline of each was captured."""
    captured = snapshots.groupBy(F.col("database").alias("name")).agg(F.max("captured_at").alias("baseline_at"))
    return registry.join(captured, "name", "left").select(
        "name", F.col("baseline_at").isNotNull().alias("has_baseline"), "baseline_at", "tags"
    )


def fleet_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after an upsert by name: ``pos, name, dsn, baseline, tags, added, updated``, by name.

    The address is replaced, tags only by tags that are not empty; the baseline
    and the position of a known member stay, a new one has its first position.
    A name that comes in repeatedly is applied in ``pos`` order; rows without a
    position come after those with one, and equal positions go by address,
    baseline and tags.
    """
    has_tags = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    turn = F.struct(F.col("pos").isNull().alias("last"), "pos", "dsn", "baseline", "tags")
    coming = incoming.groupBy("name").agg(
        F.min("pos").alias("__pos"),
        F.max(turn)["dsn"].alias("__dsn"),
        F.min(turn)["baseline"].alias("__baseline"),
        F.max(F.when(has_tags, turn))["tags"].alias("__tags"),
        F.count(F.lit(1)).alias("__n"),
    )
    known = existing.select("pos", "name", "dsn", "baseline", "tags", F.lit(True).alias("__known"))
    is_known = F.coalesce(F.col("__known"), F.lit(False))
    comes = F.coalesce(F.col("__n"), F.lit(0).cast("bigint"))
    merged = known.join(coming, "name", "full").select(
        F.coalesce("pos", "__pos").alias("pos"),
        "name",
        F.when(comes > 0, F.col("__dsn")).otherwise(F.col("dsn")).alias("dsn"),
        F.when(is_known, F.col("baseline")).otherwise(F.col("__baseline")).alias("baseline"),
        F.coalesce("__tags", "tags").alias("tags"),
        F.when(is_known, 0).otherwise(1).cast("bigint").alias("added"),
        (comes - F.when(is_known, 0).otherwise(1)).alias("updated"),
    )
    return merged.orderBy("name")


def merge_counts(merged: DataFrame) -> DataFrame:
    """How many members a merge added and updated."""
    return merged.agg(F.sum("added").alias("added"), F.sum("updated").alias("updated"))


def fleet_check(
    registry: DataFrame,
    baselines: DataFrame,
    live: DataFrame,
    baseline_indexes: DataFrame | None = None,
    live_indexes: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """State of every member: ``no-baseline``, ``error``, ``drift`` or ``ok``, tested in that order.

    Also the member's error, and how many tables were added, removed or
    modified. More than one capture of a member on either side is an error:
    ``latest_snapshot`` gives the newest. ``partitions`` is that of ``schema_diff``.
    """
    changes = schema_diff(baselines, live, baseline_indexes, live_indexes, partitions=partitions)
    whole = F.col("kind").isin(M.TABLE_ADDED, M.TABLE_REMOVED)
    no_text, no, no_time = F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string")

    def time(rows: DataFrame) -> Column:
        return F.col("captured_at").cast("string") if "captured_at" in rows.columns else no_time

    changed = changes.groupBy("database", "table").agg(F.max(F.when(whole, F.col("kind"))).alias("__kind")).select(
        "database", no.alias("known"), no_text.alias("error"), F.coalesce("__kind", F.lit("modified")).alias("change"),
        no_time.alias("base_at"), no_time.alias("live_at"),
    )
    seen = baselines.select(
        "database", F.lit(True).alias("known"), no_text.alias("error"), no_text.alias("change"),
        time(baselines).alias("base_at"), no_time.alias("live_at"),
    )
    found = live.select(
        "database", no.alias("known"), (F.col("error") if "error" in live.columns else no_text).alias("error"),
        no_text.alias("change"), no_time.alias("base_at"), time(live).alias("live_at"),
    )
    summary = seen.unionByName(found).unionByName(changed).groupBy("database").agg(
        if_one_capture(F.bool_or("known"), "base_at", "live_at").alias("known"),
        F.max("error").alias("error"),
        F.count_if(F.col("change") == M.TABLE_ADDED).alias("a"),
        F.count_if(F.col("change") == M.TABLE_REMOVED).alias("r"),
        F.count_if(F.col("change") == "modified").alias("m"),
    )
    state = (
        F.when(~F.coalesce(F.col("known"), F.lit(False)), M.NO_BASELINE)
        .when(F.col("error").isNotNull(), M.ERROR)
        .when(F.col("a") + F.col("r") + F.col("m") > 0, M.DRIFT)
        .otherwise(M.OK)
    )

    def tables(c: str):
        return F.when(F.col("state").isin(M.DRIFT, M.OK), F.col(c))

    return (
        registry.select(F.col("name").alias("database"), "dsn")
        .join(summary, "database", "left")
        .withColumn("state", state)
        .select(
            "database", redact(F.col("dsn")).alias("dsn"), "state",
            F.when(F.col("state") == M.ERROR, F.col("error")).alias("error"),
            tables("a").alias("tables_added"), tables("r").alias("tables_removed"),
            tables("m").alias("tables_modified"),
        )
        .orderBy("database")
    )


def fleet_counts(states: DataFrame) -> DataFrame:
    """Members per state, and whether any drifted or failed."""
    n = {s: F.count_if(F.col("state") == s) for s in (M.OK, M.DRIFT, M.NO_BASELINE, M.ERROR)}
    return states.agg(
        *[c.alias(s.replace("-", "_")) for s, c in n.items()],
        (n[M.DRIFT] + n[M.ERROR] > 0).alias("has_problems"),
    )


def snapshot_report(captured: DataFrame) -> DataFrame:
    """Per database of a catalog scan: tables captured, and the error if it failed."""
    return captured.groupBy("database").agg(F.countDistinct("table").alias("tables"), F.max("error").alias("error"))


#: Positions ranked together: what lies before is counted by ranges of this size.
_RANGE = 4096


def _nth_success(outcomes: DataFrame, nth: int, fleet: str) -> DataFrame:
    """(``fleet``, ``__hold``): the place of each fleet's ``nth`` success, where it has so many.

    Successes are counted by range of positions first, and only the members of
    the range in which the count is reached are ranked.
    """
    good = outcomes.filter("__ok").withColumn("__range", F.floor(F.col("pos") / _RANGE))
    ranges = good.groupBy(fleet, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(fleet).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    deciding = ranges.filter((F.col("__before") < nth) & (F.col("__before") + F.col("__n") >= nth))
    inside = lookup(good, deciding.select(fleet, "__range", "__before"), [fleet, "__range"]).filter("__before is not null")
    place = F.row_number().over(Window.partitionBy(fleet).orderBy("__place"))
    return inside.withColumn("__at", F.col("__before") + place).filter(F.col("__at") == nth).select(
        fleet, F.col("__place").alias("__hold")
    )


def rollout_states(
    outcomes: DataFrame, canary: int = 0, dry_run: bool = False, fleet: str = "fleet"
) -> DataFrame:
    """``outcomes`` with the ``state`` of each member of an ordered rollout.

    ``outcomes`` has ``fleet``, ``pos`` (a whole number), ``ok`` (whether the
    member would succeed) and, to settle equal positions, ``name``. Members go
    in that order; the first failure stops the rest, and ``canary`` successes
    hold the rest back. A dry run tries every member. A member without a
    position fails the job: nobody could say when its turn is.

    Where a fleet stops follows from two places, its first failure and its
    ``canary``-th success; no fleet is ever sorted as a whole.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    if dry_run:
        return outcomes.withColumn("state", F.when(ok, M.DRY_RUN).otherwise(M.FAILED))
    missing = F.raise_error(F.lit("a member has no position")).cast("bigint")
    settle = [F.col("name")] if "name" in outcomes.columns else []
    place = F.struct(F.coalesce(F.col("pos").cast("bigint"), missing).alias("pos"), *settle)
    placed = outcomes.withColumn("__ok", ok).withColumn("__place", place)
    nowhere = F.lit(None).cast(placed.schema["__place"].dataType)
    marks = placed.filter("not __ok").groupBy(fleet).agg(F.min("__place").alias("__fail")).withColumn("__hold", nowhere)
    if canary > 0:
        holds = _nth_success(placed, canary, fleet).withColumn("__fail", nowhere)
        marks = marks.unionByName(holds)
    stops = marks.groupBy(fleet).agg(F.min("__fail").alias("__fail"), F.min("__hold").alias("__hold"))
    fails_first = F.col("__fail").isNotNull() & (F.col("__hold").isNull() | (F.col("__fail") < F.col("__hold")))
    state = (
        F.when(fails_first & (F.col("__place") == F.col("__fail")), M.FAILED)
        .when(fails_first & (F.col("__place") > F.col("__fail")), M.SKIPPED)
        .when(~fails_first & (F.col("__place") > F.col("__hold")), M.CANARY)
        .otherwise(M.APPLIED)
    )
    return (
        lookup(placed, stops, [fleet])
        .withColumn("state", state)
        .drop("__fail", "__hold", "__place", "__ok")
    )


def rollout_counts(rollout: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Members applied (dry runs included), failed, and skipped (held back by a canary included)."""
    return rollout.groupBy(*by).agg(
        F.count_if(F.col("state").isin(M.APPLIED, M.DRY_RUN)).alias("applied"),
        F.count_if(F.col("state") == M.FAILED).alias("failed"),
        F.count_if(F.col("state").isin(M.SKIPPED, M.CANARY)).alias("skipped"),
    )
