"""Rows in one order over many tasks: numbers, and text in numbered parts.

Rows are sorted by range, so that each task has the next stretch of the order.
The tasks' counts, a row for each task, give where each stretch begins.  No
task has more than its share, and none has all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder

_AT = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """``rows`` in the order of their numbers (long, from 0).  Rows alike by
    ``order`` have neighbouring numbers in any order.  What was sorted is
    written once, so that numbers hold."""
    shared_folder(rows.sparkSession)
    ranged = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_AT))}).checkpoint()
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each task of the sort.
    begins = counts.select("_part", before.alias("_begin"))
    return ranged.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_at")).drop("_part", "_at", "_begin")


def write_parts(rows: DataFrame, order: list[Column], line: Column, path: str, head: str = "", tail: str = "") -> dict:
    """Lines in numbered files under ``path``/parts: put together in the order
    of their names they are in ``order``.  ``head`` and ``tail`` are files of
    their own, before the first and after the last.  The manifest (also in
    ``path``/manifest) lists the files with their rows and where each begins.

    Lines may hold line breaks: rows are counted before they become text."""
    spark = rows.sparkSession
    shared_folder(spark)
    lines = rows.orderBy(*order).select(line.alias("line")).checkpoint()
    counts = {r[0]: r[1] for r in lines.groupBy(F.spark_partition_id()).count().collect()}  # a row for each task
    lines.write.text(f"{path}/parts")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {int(n.split("-")[1]): n for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("part-")}
    files, at = [], 0
    for part in sorted(counts):
        files.append({"file": names[part], "rows": counts[part], "first_row": at})
        at += counts[part]
    manifest = {"rows": at, "head": head, "tail": tail, "files": files}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def put_together(spark: SparkSession, path: str):
    """The whole text, file by file, for one that fits on the driver."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    jvm = spark.sparkContext._jvm
    yield manifest["head"]
    for file in manifest["files"]:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/parts/{file['file']}")
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
        try:
            yield jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    yield manifest["tail"]
