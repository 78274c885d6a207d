"""Incremental indexing from a stream of file changes.

The stream is an append-only log (file_path, content, changed_at).  Each
micro-batch keeps the last change of a file, drops files whose hash the cache
has, and replaces the symbols of the rest.  Both tables lie in buckets by file:
a batch costs what it changes, not what the index holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.text import content_hash
from ..operators.guard import outside_ignored, supported
from ..operators.index import latest, stale_files, upsert_file_cache
from ..operators.symbols import line_symbols
from .buckets import MergeTable, query_id

SYMBOLS = "file_path STRING, name STRING, line_no INT, signature STRING"
CHANGES = "file_path STRING, content STRING, changed_at BIGINT"


def replace_file_symbols(index: DataFrame, files: DataFrame) -> DataFrame:
    """``index`` with the symbols of ``files`` (file_path, content) in place of
    those that it has of them."""
    gone = files.select(F.col("file_path").alias("_t")).distinct()
    return index.join(gone, F.col("file_path") == F.col("_t"), "left_anti").unionByName(line_symbols(files.select("file_path", "content")))


class Indexer:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.cache = MergeTable(spark, f"{path}/file_cache", schemas.FILE_CACHE, ["file_path"], buckets)
        self.symbols = MergeTable(spark, f"{path}/symbols", SYMBOLS, ["file_path"], buckets)

    def apply(self, changes: DataFrame, batch: int, source: str | None = None) -> None:
        """Apply a batch of a source, once; without one, of the source that
        wrote last.  The cache is committed last: until then a batch that is
        run again finds the same files stale."""
        source = source if source is not None else self.cache.manifest()["last"] or ""
        if self.cache.done(source, batch):
            return
        wanted = changes.filter(supported(F.col("file_path")) & outside_ignored(F.col("file_path")))
        now = latest(wanted, ["file_path"], ["changed_at"]).withColumn("hash", content_hash(F.col("content"))).persist()
        stale = stale_files(now, self.cache.read_for(now)).persist()
        self.symbols.merge(stale, replace_file_symbols, source, batch)
        seen = stale.select("file_path", "hash", F.col("changed_at").alias("last_indexed_at"))
        self.cache.merge(seen, upsert_file_cache, source, batch)
        stale.unpersist()
        now.unpersist()

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over what there is and end."""
        step = lambda rows, batch: self.apply(rows, batch, query_id(rows.sparkSession, checkpoint))
        return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
