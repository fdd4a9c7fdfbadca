"""When the drift of a database changes: captures closed by a watermark, then state per database.

Two streams. The first folds catalog rows into one row per capture and lets it go
once the watermark has passed it; the second keeps, per database, the baseline in
force and the last verdict, and reports a capture whose verdict is another one.
Baselines arrive like captures, so nothing is joined to a baseline table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftkit import model as M
from driftkit.operators.schema_diff import user_tables

ARRIVING = T.StructType([*M.CATALOG.fields, T.StructField("is_baseline", T.BooleanType())])

CLOSED = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("is_baseline", T.BooleanType()),
    T.StructField("lines", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

TRANSITIONS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("baseline_at", T.TimestampType()),
    T.StructField("checked_at", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("before", T.StringType()),
    T.StructField("appeared", T.LongType()),
    T.StructField("vanished", T.LongType()),
    T.StructField("error", T.StringType()),
])

_STATE = "baseline_at timestamp, baseline array<string>, verdict string"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Captured catalog rows under ``path`` as they arrive; ``is_baseline`` tells baselines from checks."""
    return spark.readStream.schema(ARRIVING).parquet(path)


def column_line() -> Column:
    """All that a comparison looks at in a catalog row; NULL for a row that names no table."""
    line = F.to_json(F.struct("table", "column", "type", "not_null"))
    return F.when(F.col("table").isNotNull() & F.col("error").isNull(), line)


def closed_captures(rows: DataFrame, delay: str, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes one row per capture to ``path`` once the newest capture is ``delay`` ahead of it.

    Rows of a capture may come in any order, in several files and more than once:
    its lines are a set. What arrives after its capture was let go is late; it is
    left out and counted by Spark as dropped by the watermark. A database that
    could not be read has an error and no lines.
    """
    named = user_tables(rows.withColumn("table", F.coalesce("table", F.lit("")))).withColumn("table", F.nullif("table", F.lit("")))
    captures = (
        named.withWatermark("captured_at", delay)
        .groupBy("database", "captured_at", "is_baseline")
        .agg(F.sort_array(F.collect_set(column_line())).alias("lines"), F.max("error").alias("error"))
    )
    return _start(captures, path, checkpoint, interval)


def _start(frame: DataFrame, path: str, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _judge(key: tuple, batches: Iterator, state) -> Iterator:
    """Goes through the captures of one database in time order and yields the rows to report."""
    import hashlib

    import pandas as pd

    baseline_at, baseline, verdict = state.get if state.exists else (None, None, "ok")
    captures = [r for batch in batches for r in batch.itertuples(index=False)]
    # At one time the baseline comes first.
    captures.sort(key=lambda r: (r.captured_at, not r.is_baseline))
    out = []
    for r in captures:
        failed = isinstance(r.error, str)
        if r.is_baseline:
            if not failed:
                baseline_at, baseline = r.captured_at.to_pydatetime(), [str(x) for x in r.lines]
            continue
        if baseline is None:
            continue
        appeared = vanished = None
        if failed:
            now = f"error {r.error}"
        else:
            plus, minus = sorted(set(r.lines) - set(baseline)), sorted(set(baseline) - set(r.lines))
            appeared, vanished = len(plus), len(minus)
            text = "\n".join(["+" + x for x in plus] + ["-" + x for x in minus])
            now = "drift " + hashlib.sha256(text.encode()).hexdigest() if text else "ok"
        if now != verdict:
            out.append((
                key[0], baseline_at, r.captured_at, now.split(" ")[0], verdict.split(" ")[0], appeared, vanished,
                r.error if failed else None,
            ))
        verdict = now
    if baseline is not None:
        state.update((baseline_at, baseline, verdict))
    if not out:
        return
    frame = pd.DataFrame(out, columns=TRANSITIONS.fieldNames())
    yield frame.astype({"appeared": "Int64", "vanished": "Int64", "baseline_at": "datetime64[ns]", "checked_at": "datetime64[ns]"})


def transitions(captures: DataFrame) -> DataFrame:
    """The captures (streaming, as closed) whose verdict differs from the one before: ``ok``, ``drift`` or ``error``.

    Drift that stays the same is reported once, drift of another kind again. A
    capture is judged against the database's last readable baseline; before the
    first one there is no verdict. The state of a database is its baseline and its
    last verdict, however many captures it had.
    """
    return captures.groupBy("database").applyInPandasWithState(_judge, TRANSITIONS, _STATE, "append", "NoTimeout")


def watch_transitions(
    spark: SparkSession, closed: str, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Writes the transitions of the captures closed under ``closed`` to ``path``.

    A query that starts again goes on with the states of its checkpoint.
    """
    captures = spark.readStream.schema(CLOSED).parquet(closed)
    return _start(transitions(captures), path, checkpoint, interval)
