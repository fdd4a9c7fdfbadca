"""Captures kept as what changed between them: a capture of an unchanged fleet adds no catalog rows.

A store holds ``captures``, the captures of each database numbered in time, and
``events``, the catalog lines that appeared or vanished with one. A line appears in
capture k if k has it and k - 1 does not; counted with a plus in its own capture and
a minus in the next, lines that stay cancel out, whichever database holds how many.
Both are only ever appended to.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit import model as M
from driftkit.operators.keyed import lookup
from driftkit.operators.order_index import order_index, ranked
from driftkit.session import discard, work_dir

CAPTURES = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("capture", T.LongType()),
    T.StructField("batch", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("copies", T.LongType()),
    T.StructField("capture", T.LongType()),
    T.StructField("appeared", T.BooleanType()),
    T.StructField("batch", T.StringType()),
])

#: What a line says; the rest of a catalog row is its database and its capture.
LINE = T.StructType([f for f in M.CATALOG.fields if f.name not in ("database", "captured_at", "error")])


@dataclass(frozen=True)
class Store:
    captures: DataFrame
    events: DataFrame


def _line() -> Column:
    return F.to_json(F.struct(*LINE.fieldNames()))


def open_store(spark: SparkSession, path: str) -> Store:
    """What is stored at ``path``, which may be nothing yet.

    Events are written before the captures of their batch, so those of an append
    that broke off have no capture and do not count, even if it is made again.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/captures")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return Store(spark.createDataFrame([], CAPTURES), spark.createDataFrame([], EVENTS))
    captures = spark.read.schema(CAPTURES).parquet(f"{path}/captures")
    events = spark.read.schema(EVENTS).parquet(f"{path}/events")
    return Store(captures, events.join(captures, ["database", "capture", "batch"], "left_semi").select(*EVENTS.fieldNames()))


def append_captures(catalog: DataFrame, path: str) -> None:
    """Adds the captures in ``catalog``, any number per database, to the store at ``path``.

    Each must be newer than all stored ones of its database; another one is an
    error. Databases that could not be read are left out. One without any table
    is a capture without lines.
    """
    spark = catalog.sparkSession
    store = open_store(spark, path)
    batch = uuid.uuid4().hex
    scratch = f"{work_dir(spark).rstrip('/')}/captures-{batch}"
    key = ["database", "captured_at"]
    sound = catalog.filter(F.col("error").isNull()) if "error" in catalog.columns else catalog
    rows = sound.select(*[(F.col(f.name) if f.name in catalog.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in M.CATALOG.fields if f.name != "error"])
    last = store.captures.groupBy("database").agg(F.max("capture").alias("__last"), F.max("captured_at").alias("__at"))

    # Captures are numbered by an order index, so a database captured very often is numbered by many tasks.
    index = order_index(rows.select(*key).distinct(), key, f"{scratch}/order")
    numbered = lookup(ranked(index, ["database"]), last, ["database"])
    older = F.raise_error(F.lit("a capture is not newer than the stored ones of its database"))
    at = F.when(F.col("captured_at") <= F.col("__at"), older.cast("timestamp")).otherwise(F.col("captured_at"))
    numbered.select(
        "database", at.alias("captured_at"),
        (F.col("rank") + F.coalesce(F.col("__last"), F.lit(0)) + 1).alias("capture"),
        (F.col("rank") + 1 == F.col("size")).alias("newest"),
    ).write.parquet(f"{scratch}/captures")
    new = spark.read.parquet(f"{scratch}/captures")

    held = rows.filter(F.col("table").isNotNull()).groupBy(*key, _line().alias("line")).agg(F.count(F.lit(1)).alias("copies"))
    placed = lookup(held, new, key)
    came = placed.select("database", "line", "copies", "capture", F.lit(1).alias("n"))
    gone = placed.filter(~F.col("newest")).select("database", "line", "copies", (F.col("capture") + 1).alias("capture"), F.lit(-1).alias("n"))
    # What was there in the last stored capture goes with the first new one, unless that has it too.
    first = new.groupBy("database").agg(F.min("capture").alias("__first"))
    before = lookup(_open(store.events), first, ["database"]).filter(F.col("__first").isNotNull()).select(
        "database", "line", "copies", F.col("__first").alias("capture"), F.lit(-1).alias("n")
    )
    changed = (
        came.unionByName(gone).unionByName(before)
        .groupBy("database", "line", "copies", "capture").agg(F.sum("n").alias("n")).filter("n <> 0")
    )
    events = changed.select("database", "line", "copies", "capture", (F.col("n") > 0).alias("appeared"), F.lit(batch).alias("batch"))
    events.write.mode("append").parquet(f"{path}/events")
    new.withColumn("batch", F.lit(batch)).select(*CAPTURES.fieldNames()).write.mode("append").parquet(f"{path}/captures")
    discard(spark, scratch)


def _open(events: DataFrame) -> DataFrame:
    """The lines of each database's newest capture: those that appeared once more than they vanished."""
    n = F.sum(F.when(F.col("appeared"), 1).otherwise(-1))
    return events.groupBy("database", "line", "copies").agg(n.alias("__n")).filter("__n > 0").drop("__n")


def intervals(store: Store) -> DataFrame:
    """Every line with the captures it was in: ``since`` the one it appeared in, ``until`` the one it was gone in.

    ``until`` is NULL while it is there. Also the times of both, as ``valid_from``
    and ``valid_to``. A line has as many intervals as it appeared times.
    """
    turns = Window.partitionBy("database", "line", "copies").orderBy("capture")
    spans = store.events.withColumn("until", F.lead("capture").over(turns)).filter("appeared").withColumnRenamed("capture", "since")

    def timed(df: DataFrame, number: str, name: str) -> DataFrame:
        times = store.captures.drop("batch").withColumnsRenamed({"capture": number, "captured_at": name})
        return lookup(df, times, ["database", number])

    spans = timed(timed(spans, "since", "valid_from"), "until", "valid_to")
    return spans.select("database", "line", "copies", "since", "until", "valid_from", "valid_to")


def _rows(lines: DataFrame) -> DataFrame:
    """Catalog rows of lines, as often as they were captured."""
    parsed = lines.withColumn("c", F.from_json("line", LINE)).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    fields = {f.name: F.col(f"c.{f.name}") for f in LINE.fields}
    return parsed.select(*[
        (fields[f.name] if f.name in fields else F.col(f.name) if f.name in lines.columns else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in M.CATALOG.fields
    ])


def captures_as_of(store: Store, at: object | None = None) -> DataFrame:
    """Catalog rows of each database's last capture up to the time ``at``, or of the newest."""
    taken = store.captures if at is None else store.captures.filter(F.col("captured_at") <= F.lit(at))
    chosen = taken.groupBy("database").agg(F.max_by("captured_at", "capture").alias("captured_at"), F.max("capture").alias("__capture"))
    inside = (F.col("since") <= F.col("__capture")) & (F.col("until").isNull() | (F.col("until") > F.col("__capture")))
    return _rows(lookup(intervals(store), chosen, ["database"]).filter(inside))


def every_capture(store: Store) -> DataFrame:
    """Catalog rows of all captures, as they were captured: each line in each capture of its intervals."""
    newest = store.captures.groupBy("database").agg(F.max("capture").alias("__newest"))
    spans = lookup(intervals(store), newest, ["database"])
    last = F.coalesce(F.col("until") - 1, F.col("__newest"))
    lines = spans.withColumn("capture", F.explode(F.sequence("since", last)))
    return _rows(lookup(lines, store.captures.drop("batch"), ["database", "capture"]))
