"""Baselines: captured catalogs kept by capture date."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit import model as M

_DATE = "captured_date"


def _save(rows: DataFrame, schema: T.StructType, path: str, captured_at: datetime.datetime | None) -> None:
    at = F.lit(captured_at).cast("timestamp") if captured_at else F.coalesce("captured_at", F.current_timestamp())
    (
        rows.filter(F.col("error").isNull())
        .withColumn("captured_at", at)
        .withColumn(_DATE, F.to_date("captured_at"))
        .select(*schema.fieldNames(), _DATE)
        .repartition("database")
        .write.mode("append")
        .partitionBy(_DATE)
        .parquet(path)
    )


def _load(spark: SparkSession, schema: T.StructType, path: str, since: datetime.date | None) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(_DATE, T.DateType())])).parquet(path)
    if since is not None:
        stored = stored.filter(F.col(_DATE) >= F.lit(since))
    return stored.select(*schema.fieldNames())


def save_snapshot(catalog: DataFrame, path: str, captured_at: datetime.datetime | None = None) -> None:
    """Appends the readable members of a catalog to the snapshots at ``path``.

    All rows of a member go to one file, so a stream never sees half a snapshot.
    """
    _save(catalog, M.CATALOG, path, captured_at)


def load_snapshots(spark: SparkSession, path: str, since: datetime.date | None = None) -> DataFrame:
    """Stored snapshots; ``since`` prunes the folders of earlier days.

    No snapshots yet is a state of its own, not an error: the result is empty.
    """
    return _load(spark, M.CATALOG, path, since)


def save_index_snapshot(indexes: DataFrame, path: str, captured_at: datetime.datetime | None = None) -> None:
    """Appends the index lists that belong to a snapshot taken at the same time."""
    _save(indexes, M.INDEXES, path, captured_at)


def load_index_snapshots(spark: SparkSession, path: str, since: datetime.date | None = None) -> DataFrame:
    """Stored index lists, as ``load_snapshots``."""
    return _load(spark, M.INDEXES, path, since)
