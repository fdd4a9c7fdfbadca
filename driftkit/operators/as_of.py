"""Which fact was in force when: the last one at or before each event of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftkit.operators.keyed import lookup
from driftkit.operators.order_index import PLACE, RANGE, order_index


def as_of(events: DataFrame, facts: DataFrame, by: Sequence[str], at: str, found: str) -> DataFrame:
    """``events`` with the time ``found`` of the last fact of their key, NULL where there is none yet.

    Times of facts and events, each once per key, form one timeline that is cut
    into ranges; the newest fact is carried along in a range and, one row per key
    and range, from range to range. So a key that holds a third of the timeline is
    carried by many tasks. A fact at the time of an event is in force; NULL is a
    key like others, an event without a time has no fact.
    """
    keys = [F.col(f"`{k}`") for k in by]
    time = F.col(f"`{at}`")
    none = F.lit(None).cast(facts.schema[at].dataType)
    timeline = (
        facts.filter(time.isNotNull()).select(*keys, time.alias("__at"), time.alias("__fact")).distinct()
        .unionByName(events.filter(time.isNotNull()).select(*keys, time.alias("__at"), none.alias("__fact")).distinct())
    )
    rows = order_index(timeline, [*by, "__at"]).rows
    # The fact in force is the newest so far, so it is a running maximum.
    carried = rows.groupBy(*keys, RANGE).agg(F.max("__fact").alias("__newest"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*keys, RANGE, F.max("__newest").over(before).alias("__before"))
    here = Window.partitionBy(*keys, RANGE).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("__here", F.max("__fact").over(here)).filter(F.col("__fact").isNull()).drop(PLACE, "__fact")
    placed = lookup(within, carried, [*by, RANGE])
    # An event and a fact of its time may stand on two sides of a border.
    facts_at = facts.select(*keys, time.alias("__at")).distinct().withColumn("__same", F.col("__at"))
    in_force = lookup(placed, facts_at, [*by, "__at"]).select(
        *keys, F.col("__at").alias(at), F.coalesce("__same", F.greatest("__here", "__before")).alias(found)
    )
    return lookup(events, in_force, [*by, at])
