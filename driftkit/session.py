"""Session settings and the shared work folder."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession

_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "driftkit", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots.

    Master, memory and shuffle parallelism belong to the submitting cluster and
    are left alone.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in {**_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local path would be invisible to the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _own_dir(spark.sparkContext.applicationId).name


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@functools.cache
def _own_dir(application: str) -> tempfile.TemporaryDirectory:
    """A folder that goes when this process ends."""
    return tempfile.TemporaryDirectory(prefix=f"driftkit-{application}-", ignore_cleanup_errors=True)
