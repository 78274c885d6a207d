"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage works on all that the one before kept.  A stage takes (spark, docs,
sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and reads it back as the next one's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import quoted, read_table
from codeloom.llm.decontaminate import find_leaks
from codeloom.llm.packing import pack, token_pieces
from codeloom.llm.quality import quality_rules
from codeloom.llm.similar import keep_one_of_each
from codeloom.llm.substrings import dedup_substrings
from codeloom.session import delete, scratch_folder

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096


def _columns(docs: DataFrame):
    return [quoted(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    held = docs.select("text", F.struct(*_columns(docs)).alias("document"))
    return quality_rules(held).filter("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the least doc_id.  Links of
    SimHash by multi-index hashing, each verified, then those it can't see."""
    return keep_one_of_each(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows of earlier ones, n_chars as the
    text is then; those that had nothing else go."""
    cut = dedup_substrings(docs, window=13).filter("n_removed < n_words")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or an edited copy of one."""
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens."""
    pieces = token_pieces(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), end_id=1, capacity=CAPACITY)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), CAPACITY)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Groups by similarity, alignment and packing are beyond SQL;
#: ``test_stages_match_their_plain_versions`` holds each stage, on what the one
#: before kept, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows.  Of what the stages
    write, only the last is kept, until the session ends."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        out, folder = stage(spark, docs, sf_dir), scratch_folder(spark, "pipeline")
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        if before is not None:
            delete(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
