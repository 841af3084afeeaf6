"""Sessions: the package on the executors, the shared folder, and cutting a loop's lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes of rows in one Arrow batch, on the JVM's side and in each Python worker, unless the session sets its own.
ARROW_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, through Spark's own file server."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.join("ledgerloom", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only where none is set and driver and executors are one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: a round of a loop is computed once and survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
