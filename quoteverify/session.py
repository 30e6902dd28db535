"""What a session needs before its workers can run this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the session's workers, once; without it they can import the package only where it
    happens to be on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "quoteverify_sources.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)


def work_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all machines share. Only a session that runs on this machine
    alone (as in tests) may leave it unset: it gets a temporary one. On a cluster that would be a folder which other
    machines don't see, so there it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quoteverify-")
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """A query that starts in here drops its shuffle files as it ends, since its result is a table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def work_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared work folder, which goes when the session's JVM ends."""
    context = spark.sparkContext
    path = f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def held(rows: DataFrame, name: str = "held", by: str | None = None) -> DataFrame:
    """rows as a table in the shared work folder, for what more than one branch of a plan reads. Plans end there, so they
    stay small, and a lost executor costs no more than its tasks. The table goes when the session's JVM ends. ``by``: a column
    whose values get folders of their own."""
    path = work_table(rows.sparkSession, name)
    with shuffles_dropped(rows.sparkSession):
        (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
