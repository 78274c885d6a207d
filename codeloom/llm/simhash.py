"""Operator 9: SimHash near-dedup by multi-index hashing.

A fingerprint has four 16-bit quarters.  Four overlapping 48-bit segments each
leave one quarter out.  If two fingerprints differ in at most two bits, let j
be the last quarter in which they differ: in the segment without j they are
equal, or differ in one bit of an earlier quarter.  So the table of each
segment, probed with its own key and with the keys one bit away (in earlier
quarters, from 0 to 1 only, as the other fingerprint probes the other way),
meets every such pair; the complete distance is then verified.

Equal fingerprints are one entry, and the rows of a frequent one are dealt out
when they get their component.  A 48-bit key has at most 2^16 entries
however often a text is copied, and a fingerprint has at most 2,080 others
within two bits, so the number of links stays in proportion to the entries.
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

from .common import checkpointed, dealt_join, fair_share, hot_keys, quoted, text_buffers, without
from .components import connected_components


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words, A-Z in lower case and joined by a
    space; of all words if there are fewer; empty without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[k : k + _CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _add_fingerprints(batches, text_col: str, width: int, schema: pa.Schema):
    for batch in batches:
        data, at = text_buffers(batch[text_col])
        raw = data.tobytes()
        fps = [fingerprint(shingle_hashes(raw[at[k] : at[k + 1]], width)) for k in range(batch.num_rows)]
        columns = [batch[f.name] if f.name != "fp" else pa.array(fps, pa.int64()) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def simhash(docs: DataFrame, text_col: str = "text", words: int = 5, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or just ``columns`` of it) with fp (long): the 64-bit SimHash
    of their word shingles.  A text without words, or null, has fingerprint 0."""
    docs = without(docs, "fp")
    kept = [f for f in docs.schema.fields if columns is None or f.name in columns]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return docs.mapInArrow(partial(_add_fingerprints, text_col=text_col, width=words, schema=to_arrow_schema(schema)), schema)


def _probes() -> list[tuple[int, int, int]]:
    """(segment, mask, bit to set) of all probes; bit 0: the own key."""
    out = []
    for seg in range(4):
        mask = ~(0xFFFF << (16 * seg)) & 0xFFFFFFFFFFFFFFFF
        out += [(seg, mask, 0)] + [(seg, mask, 1 << b) for b in range(16 * seg)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(s, signed(m), signed(f)) for s, m, f in out]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of different fingerprints within two bits, once each.
    ``fps``: distinct values in column fp."""
    plan = "array(" + ", ".join(f"named_struct('s', {s}, 'm', {_long(m)}, 'f', {_long(f)})" for s, m, f in _probes()) + ")"
    exact = "array(" + ", ".join(f"named_struct('s', {s}, 'm', {_long(m)})" for s, m, f in _probes() if f == 0) + ")"
    table = fps.select("fp", F.explode(F.expr(exact)).alias("p")).select(F.col("p.s").alias("seg"), F.col("fp").bitwiseAND(F.col("p.m")).alias("key"), F.col("fp").alias("b"))
    probe = fps.select("fp", F.explode(F.expr(plan)).alias("p")).filter("fp & p.f = 0")
    probe = probe.select(F.col("p.s").alias("seg"), F.expr("(fp & p.m) | p.f").alias("key"), F.col("fp").alias("a"), (F.col("p.f") == 0).alias("own"))
    met = probe.join(table, ["seg", "key"]).filter("a != b and bit_count(a ^ b) <= 2 and (not own or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or just ``columns`` of it, the id among them) with fp (long, the SimHash) and component_id (the least id in
    the component of documents whose fingerprints link at two bits or fewer).

    Documents with one fingerprint are linked, those without words too.  Null
    ids are passed over in the least id, which is null if a component has no
    other.  Repeated rows stay, each with its component.  Columns named like an
    added one give way; an empty table gives no rows.
    """
    marked = checkpointed(simhash(without(docs, "component_id"), text_col, words, columns))
    classes = checkpointed(marked.groupBy("fp").agg(F.min(quoted(id_col)).alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    share = fair_share(classes.agg(F.sum("n")).first()[0] or 0, docs.sparkSession)
    # Few components have many fingerprints, but one may have most of them.
    sizes = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = dealt_join(rooted.select("fp", "root"), sizes.select("root", "component_id"), ["root"], hot_keys(sizes, ["root"], share)).select("fp", "component_id")
    return dealt_join(marked, named, ["fp"], hot_keys(classes, ["fp"], share)).select(*[quoted(c) for c in marked.columns], "component_id")
