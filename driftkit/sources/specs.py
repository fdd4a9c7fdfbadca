"""Expectation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.operators.validation import spec_changes, spec_ranges


def read_spec(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Spec documents: one JSON document per file, or per line with ``lines``."""
    docs = spark.read.schema(M.SPEC).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return docs.withColumn("version", F.coalesce("version", F.lit(1)))


def load_spec(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Expected changes and expected row ranges."""
    spec = read_spec(spark, path, lines)
    return spec_changes(spec), spec_ranges(spec)


def save_spec(spec: DataFrame, path: str) -> None:
    """Writes spec documents as JSON, one per line."""
    spec.write.mode("overwrite").json(path)
