"""Drift reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit import model as M


# Report times keep their microseconds and zone.
REPORT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_report(drift: DataFrame, path: str) -> None:
    """Appends drift report rows, one JSON line each."""
    drift.select(*M.DRIFT_REPORT.fieldNames()).write.mode("append").option("timestampFormat", REPORT_TIME).json(path)


def load_history(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """All reports at ``path``, oldest first if ``ordered``; blank lines are skipped, a malformed one fails."""
    reader = spark.read.schema(M.DRIFT_REPORT).option("mode", "FAILFAST").option("timestampFormat", REPORT_TIME)
    reports = reader.json(path)
    reports = reports.select(*M.DRIFT_REPORT.fieldNames())
    return reports.orderBy("checked_at") if ordered else reports


def to_json_report(df: DataFrame) -> DataFrame:
    """Every row as one JSON text; NULL fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
