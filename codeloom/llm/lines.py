"""Operator 11: line dedup across documents.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends, A-Z
in lower case.  Lines are exploded to one row for each document and key, with
the places where the key stands in the text.  Keys are counted by their 128-bit
hash over distinct documents; the lines of a key in too many of them are
dropped, and each text is put together again by position.

Only hashes and places are shuffled, and each text once, to its dropped places.
A key in a third of all documents is counted in parts before the shuffle, and
its rows are dealt out when they meet its count.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _pieces, checkpointed, dealt_join, fair_share, free_name, hot_keys, quoted, without

STEP_BYTES = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ENDS = b" \t\n\x0b\x0c\r"

KEYS = T.StructType([T.StructField("id", T.LongType()), T.StructField("print", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
KEYS_ARROW = to_arrow_schema(KEYS)


def line_keys(text: str, min_chars: int) -> dict[bytes, list[int]]:
    """The places of each key of at least ``min_chars`` code points, by the
    key's 128-bit hash."""
    found: dict[bytes, list[int]] = {}
    for place, line in enumerate(text.encode().translate(_LOWER).split(b"\n")):
        key = line.strip(_ENDS)
        # A code point has one byte to four.
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
    return found


def _explode(batches, min_chars: int):
    for batch in batches:
        for b in _pieces(batch, 4 * STEP_BYTES):
            row, hashes, sizes, places = [], [], [], []
            for k, text in enumerate(b["text"].to_pylist()):
                if text:
                    for key, at in line_keys(text, min_chars).items():
                        row.append(k)
                        hashes.append(key)
                        sizes.append(len(at))
                        places += at
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(places, pa.int32()))
            own = [b[c].take(pa.array(row, pa.int64())) for c in ("id", "print")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(both[:, 0]), pa.array(both[:, 1]), at.cast(KEYS_ARROW.field("places").type)], schema=KEYS_ARROW)


def _cut(batches, text_col: str, schema: pa.Schema):
    for batch in batches:
        texts, dropped = batch[text_col].to_pylist(), batch["dropped"].to_pylist()
        n_lines = [1 if t is None else t.count("\n") + 1 for t in texts]
        for k, gone in enumerate(dropped):
            if gone:
                out = set(gone)
                texts[k] = "\n".join([line for place, line in enumerate(texts[k].split("\n")) if place not in out])
        new = {text_col: texts, "n_lines": n_lines, "n_dropped": [len(g) for g in dropped]}
        yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch[f.name] for f in schema], schema=schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows of ``docs``, ``text`` without repeated lines, and n_lines,
    n_dropped (long, before and of the cut) and dropped (the lines' places).

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines, but for those of the largest id that
    holds it.  A null or empty text is one empty line; null stays null.  Rows
    with one id are one document; null ids are one document, less than any
    other.  Columns of ``docs`` named like an added one give way; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped", "dropped")
    name_id, name_print = free_name("_id", docs), free_name("_print", docs)
    own, own_text = quoted(id_col).cast("long"), quoted(text_col)
    # Rows alike in id and text have their lines in the same places.
    mark = F.xxhash64(own_text)
    keys = docs.select(own.alias("id"), mark.alias("print"), own_text.alias("text")).filter("text is not null").mapInArrow(partial(_explode, min_chars=min_chars), KEYS)

    counts = keys.select("hi", "lo", "id").distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    repeated = checkpointed(counts.filter(F.col("n") >= min_docs))
    share = fair_share(repeated.agg(F.sum("n")).first()[0] or 0, spark)
    met = dealt_join(keys, repeated.select("hi", "lo", "last"), ["hi", "lo"], hot_keys(repeated, ["hi", "lo"], share))
    # Copies of a row are counted once before anything is gathered.
    gone = met.filter(~F.col("id").eqNullSafe(F.col("last"))).select("id", "print", "places").distinct()
    places = gone.groupBy(F.col("id").alias(name_id), F.col("print").alias(name_print)).agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("dropped"))

    same = own.eqNullSafe(F.col(name_id)) & (mark == F.col(name_print))
    found = docs.join(places, same, "left").select(*[quoted(c) for c in docs.columns], F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("dropped", T.ArrayType(T.IntegerType()))])
    return found.mapInArrow(partial(_cut, text_col=text_col, schema=to_arrow_schema(schema)), schema)
