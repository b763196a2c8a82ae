"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="wardwise-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; one of its own only where that is unset, as in local tests.

    On a cluster each machine would have a folder of its own, so there the setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or _own_folder(spark.sparkContext.applicationId)


def materialized(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows, written once to the shared folder (or to ``path`` in it) and read again, so that loops keep short lineages."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what was written under a path of one's own and nobody reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@lru_cache
def _shipped(application: str, spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with tempfile.TemporaryDirectory() as folder:
        for path, _, names in os.walk(os.path.join(root, "wardwise")):
            for name in (n for n in names if n.endswith(".py")):
                to = os.path.join(folder, "package", os.path.relpath(path, root))
                os.makedirs(to, exist_ok=True)
                shutil.copy(os.path.join(path, name), to)
        kept = tempfile.mkdtemp(prefix="wardwise-package-")  # the driver serves it to executors as long as it runs
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(kept, "wardwise"), "zip", os.path.join(folder, "package")))


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once an application, so that their Python finds it wherever the job was started."""
    _shipped(spark.sparkContext.applicationId, spark)
    return spark
