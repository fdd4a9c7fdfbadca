"""The list of fleet members as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.functions.text import redact


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Members stored at ``path``; a malformed line fails."""
    return spark.read.schema(M.REGISTRY).option("mode", "FAILFAST").json(path)


def save_registry(registry: DataFrame, path: str) -> None:
    """Writes the members; tokens in their addresses are never stored."""
    members = registry.withColumn("dsn", redact(F.col("dsn")))
    members.select(*[c for c in M.REGISTRY.fieldNames() if c in members.columns]).write.mode("overwrite").json(path)
