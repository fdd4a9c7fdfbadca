"""A directory, or a metastore schema, of tables treated as one database."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Prefixes of tables a database keeps for itself.
INTERNAL_PREFIXES = ("sqlite_", "_cf_")


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path``, on whatever file system it names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in fs.listStatus(folder)]


def load_tables(
    spark: SparkSession,
    path: str,
    names: Iterable[str] | None = None,
    fmt: str = "parquet",
    schemas: Mapping[str, T.StructType] | None = None,
    **options: str,
) -> dict[str, DataFrame]:
    """The user tables under ``path``, by name and in name order.

    ``fmt`` is a file format, with one file or folder ``<name>.<fmt>`` or
    ``<name>`` per table, or ``"table"`` to read metastore schema ``path``.
    """
    schemas = schemas or {}
    if fmt == "table":
        found = {t.name: f"{path}.{t.name}" for t in spark.catalog.listTables(path)}
    else:
        suffix = f".{fmt}"
        found = {}
        for entry in _listed(spark, path):
            name = entry.removesuffix(suffix)
            if not entry.startswith((".", "_")) and (name != entry or "." not in entry):
                found[name] = f"{path}/{entry}"
    wanted = list(names) if names is not None else [n for n in found if not n.startswith(INTERNAL_PREFIXES)]
    missing = sorted(set(wanted) - set(found))
    if missing:
        raise ValueError(f"no such tables in {path}: {', '.join(missing)}")
    loaded = {}
    for name in sorted(wanted):
        if fmt == "table":
            loaded[name] = spark.table(found[name])
        else:
            reader = spark.read.format(fmt).options(**options)
            if name in schemas:
                reader = reader.schema(schemas[name])
            loaded[name] = reader.load(found[name])
    return loaded
