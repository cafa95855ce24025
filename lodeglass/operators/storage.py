"""Where jobs keep what several steps read: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where that isn't set, a local session (as in a test) gets a temporary folder; on a cluster it is an error, as
    executors would not see a folder of the driver's own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver see")
        top = shared_folder.fallback = getattr(shared_folder, "fallback", None) or tempfile.mkdtemp(prefix="spark-")
    return top.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path there that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store Spark finds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(rows: DataFrame) -> DataFrame:
    """The same rows with a short lineage, held in the shared folder until nothing refers to them."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()
