"""What the operators share: stored intermediates, safe column access, row emission."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir


def scratch(df: DataFrame, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{work_dir(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    A lost executor then costs a read of files, not a recomputation of all
    that came before. The shuffle files of the steps up to here are garbage
    now; Spark deletes them when the driver collects its own, so it is asked to.
    """
    path = scratch(df, name)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_and_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator reads, as (``doc_id`` long, ``text`` string).

    Whatever else the table holds, under whatever name, stays out of the plan.
    """
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))


def by_batch(df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]) -> DataFrame:
    """Runs ``work`` over the Arrow batches of each partition; it yields columns by name."""
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches):
        for columns in work(batches):
            arrays = [pa.array(columns[f.name], f.type, from_pandas=False) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def fold(column: Column | str, parts: int) -> Column:
    """0 to ``parts`` - 1, the same for equal values."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), parts)


_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of SplitMix64); different by ``salt``."""
    x = x + np.uint64((salt * int(_GOLD) + int(_GOLD)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))
