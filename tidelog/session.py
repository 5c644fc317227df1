"""Making the package importable in Python workers, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from tidelog.errors import InvalidState

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the workers of the session's context, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidelog-package-")) / "tidelog_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one, on a local master alone: executors of a cluster would write to different disks, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise InvalidState("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one. It is removed when the application ends, as results that read it may live as long."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4()}"
    fs, at = hadoop_path(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    fs, at = hadoop_path(spark, folder)
    fs.delete(at, True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
