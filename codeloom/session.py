"""Folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which is the session's own part of the one
    that ``spark.checkpoint.dir`` names.

    Only a local session may do without the setting: a folder in the machine's
    temp folder is used there.  What lies in the session's own folder goes when
    the session's JVM ends.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not is_local(spark):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "codeloom-checkpoints")
        sc.setCheckpointDir(named)
        current = sc._jsc.sc().getCheckpointDir()
    path = sc._jvm.org.apache.hadoop.fs.Path(current.get())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return current.get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for results that a query reads again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder that isn't read any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
