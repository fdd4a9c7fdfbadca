"""Arriving catalog snapshots checked against their baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftkit import model as M
from driftkit.operators.drift import drift_of_snapshots
from driftkit.sources.history import REPORT_TIME


Source = DataFrame | Callable[[], DataFrame]


def _now(source: Source | None) -> DataFrame | None:
    return source() if callable(source) else source


def snapshot_stream(spark: SparkSession, path: str) -> DataFrame:
    """Catalog snapshots as they arrive under ``path``."""
    return spark.readStream.schema(M.CATALOG).parquet(path)


def watch(
    snapshots: DataFrame,
    baseline: Source,
    report_path: str,
    checkpoint: str,
    interval: str | None = None,
    baseline_indexes: Source | None = None,
    indexes: Source | None = None,
) -> StreamingQuery:
    """Writes one report row per arriving snapshot of a database with a baseline.

    A member that could not be read is reported with its error and the watch
    goes on. Reports are kept by batch, so a batch that runs again after a
    failure replaces its own rows. Without an ``interval`` the query handles
    what has arrived and stops. ``indexes`` are the stored index snapshots; save
    those of a capture before its catalog, so they are there when it arrives. A
    frame read from files keeps the files it found; give a function that reads
    them to look again for every batch.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read several times below
        report = drift_of_snapshots(_now(baseline), batch, _now(baseline_indexes), _now(indexes))
        report = report.withColumn("batch_id", F.lit(batch_id))
        (
            report.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("timestampFormat", REPORT_TIME)
            .partitionBy("batch_id")
            .json(report_path)
        )
        batch.unpersist()

    writer = snapshots.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
