"""Helpers around the Spark session."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run: once per application, through the driver."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="orfspark-code-")
    path = os.path.join(folder, "orfspark_code.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def local_master(spark: SparkSession) -> bool:
    """Whether Spark runs in this process alone, so that a folder of this machine is seen by all of it."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session; where it is unset a temporary folder, but none on a cluster, whose executors
    would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and local_master(spark):
        folder = tempfile.mkdtemp(prefix="orfspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if folder else None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever it is; nothing once the session has ended."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def work_folder(spark: SparkSession, name: str) -> str | None:
    """A new folder's path under the shared one, removed when the driver ends; None where there is no shared one."""
    folder = shared_folder(spark)
    if not folder:
        return None
    path = f"{folder}/orfspark/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read again, so that what reads it twice computes it once. Without a shared folder
    it is ``df`` itself."""
    path = work_folder(df.sparkSession, name)
    if not path:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
