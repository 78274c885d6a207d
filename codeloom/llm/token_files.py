"""Operator 7: token ids in ORC files, in ascending order of document ids.

ORC's integer run-length encoding packs the ids; each stripe has a row index
and a Bloom filter on the document id, so a reader skips stripes that a
predicate on doc_id rules out, and reads stripes in parallel.  A row knows
where its ids start among those that its task wrote; the tasks' totals, summed
in the order of their numbers, give where they start in the corpus.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _pieces, quoted, shuffle_partitions
from .encoding import encoder

#: Bytes of Arrow data that a worker encodes at once.
STEP_BYTES = 4 << 20
#: Bytes of input for each file, as far as the plan tells.
FILE_BYTES = 128 << 20
#: Tasks up to this many get their starts by a broadcast of one row for each.
BROADCAST_TASKS = 100_000

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _encode(batches, tokenizer: str, end_id: int):
    enc, before = encoder(tokenizer), 0
    schema = to_arrow_schema(ROW)
    for batch in batches:
        for b in _pieces(batch, 4 * STEP_BYTES):
            ids, at = enc.encode(b["text"], end_id)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(at[:-1] + before), pa.array(np.diff(at)), lists.cast(schema.field("ids").type)], schema=schema)
            before += int(at[-1])


def files_for(docs: DataFrame) -> int:
    """Files by the input's size in the plan's statistics (of file scans: what
    is read), and at least as many as the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # An unknown size counts as beyond all bounds.
    return max(shuffle_partitions(docs.sparkSession), -(-size // FILE_BYTES) if size < 1 << 60 else 0)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None, stripe_bytes: int = 16 << 20) -> None:
    """Encode each whole text, append ``end_id`` and write ORC files under
    ``path``: doc_id, at (the task's ids before it), n_tokens and ids.

    Tasks hold ascending ranges of ids in the order of the numbers in their
    files' names, rows ascending ids.  Null ids come first; rows with one id follow
    each other by a hash of their texts, and many alike in both are dealt out to
    more than one task.  A null or empty text has just ``end_id``.  Other
    columns are not written; an empty table gives files without rows.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    n_files = n_files or files_for(rows)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n_files, "doc_id", "tie", "number").sortWithinPartitions("doc_id", "tie")
    encoded = rows.select("doc_id", "text").mapInArrow(partial(_encode, tokenizer=tokenizer, end_id=end_id), ROW)
    options = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_bytes), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    encoded.write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids.  A
    filter on doc_id reaches the files' indexes and Bloom filters."""
    rows = spark.read.schema(ROW).orc(path)
    # By number: names with more than five digits aren't in the order of text.
    named = rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long").alias("task"))
    totals = named.groupBy("task").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("task", before.alias("base"))
    if len(rows.inputFiles()) <= BROADCAST_TASKS:
        bases = F.broadcast(bases)
    return named.join(bases, "task").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def _digest(batches, schema: pa.Schema):
    for batch in batches:
        ids = batch["ids"]
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in list(schema)[:-1]], pa.array(crc, pa.int64())], schema=schema)


def with_crc(rows: DataFrame) -> DataFrame:
    """``rows`` with ids_crc32 in place of ids (little-endian, 32 bits each)."""
    kept = [f for f in rows.schema.fields if f.name != "ids"]
    schema = T.StructType([*kept, T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(partial(_digest, schema=to_arrow_schema(schema)), schema)
