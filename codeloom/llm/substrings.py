"""Operator 6: substring dedup across documents by difference-cover anchors.

A window is ``window`` consecutive words of one document.  A word goes if a
window that covers it also starts in a document with a smaller id.

With a difference cover D of a period p, any two places i and j have a shift
below p that takes both into D modulo p.  So two equal windows of w + p - 1
words share an aligned anchor: w words that start at a cover place of either
document.  Only anchors are hashed and exchanged (3 of 7 places at 13 words).
The windows around anchors that occur in more than one document are the
candidates; they extend to whole windows, which are compared by a 96-bit hash
over the whole corpus.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLOCK_BYTES, PARTS_PER_PARTITION, Words, answer, ask, blocks_of, exchange_tasks, full_windows, quoted, window_hash, with_answers, without, words_of

# Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

_ANCHOR = np.dtype([("h", "<u4"), ("two", "u1")])
_WINDOW = np.dtype([("hi", "<u8"), ("lo", "<u4"), ("id", "<i8")])
_LAST = np.iinfo(np.int64).max


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length: the longest period whose anchors have
    at least as many words as the period."""
    period = max(p for p in COVERS if p == 1 or 2 * p - 1 <= window)
    return period, COVERS[period], window - period + 1


def _hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    codes, distinct = words.coded()
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in distinct]), "<u8").reshape(-1, 2)
    return both[codes, 0], both[codes, 1]


def _anchors(words: Words, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors and their hashes."""
    period, cover, width = cover_for(window)
    h = window_hash(first, width, seed=6)
    place = (np.arange(len(words)) - np.repeat(words.first[:-1], words.counts))[: len(h)]
    at = np.flatnonzero(np.isin(np.arange(period), cover)[place % period] & full_windows(words, width))
    return at, h[at]


def _split(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _groups(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted arrays."""
    if not len(x):
        return np.zeros(0, np.int64)
    new = x[1:] != x[:-1]
    for y in more:
        new |= y[1:] != y[:-1]
    return np.flatnonzero(np.r_[True, new])


def _ask_anchors(table: pa.Table, _: list[bytes], text_col: str, window: int, parts: int):
    words = words_of(table[text_col])
    at, h = _anchors(words, _hashes(words)[0], window)
    order = np.argsort(h, kind="stable")
    h, row = h[order], words.owner[at][order]
    new = _groups(h)
    last = np.r_[new[1:], len(h)] - 1 if len(new) else new
    keys = np.zeros(len(new), _ANCHOR)
    part, keys["h"] = _split(h[new], parts)
    keys["two"] = row[new] != row[last]
    return part, keys


def _shared(part: np.ndarray, block: np.ndarray, keys: np.ndarray):
    """For each block, which of its anchors occur in another document."""
    full = (part.astype(np.uint64) << np.uint64(32)) | keys["h"]
    order = np.argsort(full, kind="stable")
    full, block, two = full[order], block[order], keys["two"][order]
    new = _groups(full)
    size = np.diff(np.r_[new, len(full)])
    hit = np.repeat((size > 1) | (np.add.reduceat(two, new) > 0), size) if len(new) else np.zeros(0, bool)
    return block[hit], full[hit]


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    ids = table[id_col].combine_chunks().cast(pa.int64())
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _windows(words: Words, hashes: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    lo = (window_hash(hashes[1], window, seed=66) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return window_hash(hashes[0], window, seed=13), lo


def _least(hi, lo, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by window, where each window's group starts, its size and least id."""
    order = np.argsort(hi, kind="stable")
    new = _groups(hi[order], lo[order])
    size = np.diff(np.r_[new, len(hi)])
    return order, new, size, np.minimum.reduceat(ids[order], new) if len(new) else ids[:0]


def _ask_windows(table: pa.Table, bodies: list[bytes], text_col: str, id_col: str, window: int, parts: int):
    """Windows with an anchor that another document has too."""
    words = words_of(table[text_col])
    hashes = _hashes(words)
    at, h = _anchors(words, hashes[0], window)
    part, low = _split(h, parts)
    full = (part.astype(np.uint64) << np.uint64(32)) | low
    known = np.sort(np.frombuffer(b"".join(bodies), "<u8"))
    hit = np.zeros(len(words) + 1, np.int64)
    if len(known) and len(full):
        hit[at[known[np.minimum(np.searchsorted(known, full), len(known) - 1)] == full]] = 1
    before = np.r_[0, np.cumsum(hit)]
    hi, lo = _windows(words, hashes, window)
    q = np.arange(len(hi))
    period = cover_for(window)[0]
    q = q[(before[q + period] > before[q]) & full_windows(words, window)]
    hi, lo, ids = hi[q], lo[q], _ids(table, id_col)[words.owner[q]]
    order, new, _, least = _least(hi, lo, ids)
    keys = np.zeros(len(new), _WINDOW)
    keys["hi"], keys["lo"], keys["id"] = hi[order[new]], lo[order[new]], least
    return (keys["hi"] % np.uint64(parts)).astype(np.int64), keys


def _earlier(part: np.ndarray, block: np.ndarray, keys: np.ndarray):
    """For each block, its windows that start in a document with an id below
    the block's own least one for it, and that id."""
    order, new, size, least = _least(keys["hi"], keys["lo"], keys["id"])
    out = keys[order]
    least = np.repeat(least, size)
    hit = least < out["id"]
    out["id"] = least
    return block[order][hit], out[hit]


def _cut(table: pa.Table, bodies: list[bytes], text_col: str, id_col: str, window: int, schema: pa.Schema) -> pa.Table:
    words = words_of(table[text_col])
    hashes = _hashes(words)
    hi, lo = _windows(words, hashes, window)
    q = np.flatnonzero(full_windows(words, window))
    hi, lo, own = hi[q], lo[q], _ids(table, id_col)[words.owner[q]]
    told = np.frombuffer(b"".join(bodies), _WINDOW)
    order, _, size, least = _least(np.r_[hi, told["hi"]], np.r_[lo, told["lo"]], np.r_[own, told["id"]])
    lowest = np.empty(len(order), np.int64)
    lowest[order] = np.repeat(least, size)
    gone_at = q[lowest[: len(q)] < own]
    del hi, lo, own, hashes, order, lowest, q
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, gone_at, 1)
    np.add.at(edge, gone_at + window, -1)
    gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
    del edge, gone_at

    # A word goes with the white space after it; the text's other bytes stay.
    n = len(words.data)
    limit = np.repeat(words.text_at[1:], words.counts)
    until = np.minimum(np.r_[words.start[1:], n], limit) if len(words) else words.start
    # The cuts don't overlap, so a byte's sum is 0 or 1; one may start where another ends.
    cut = np.r_[0, np.cumsum(np.where(gone, until - words.start, 0))]
    kept_before = words.text_at - cut[words.first]
    step = np.zeros(n + 1, np.int8)
    step[words.start[gone]] += 1
    step[until[gone]] -= 1
    stay = np.cumsum(step, dtype=np.int8)[:-1] == 0
    del step, until, limit, cut
    data = words.data[stay]
    del stay
    text = pa.Array.from_buffers(pa.large_string(), table.num_rows, [None, pa.py_buffer(np.ascontiguousarray(kept_before)), pa.py_buffer(np.ascontiguousarray(data))])
    old = table[text_col].combine_chunks()
    text = pa.compute.if_else(old.is_null(), pa.scalar(None, pa.large_string()), text)

    before = np.r_[0, np.cumsum(gone)]
    edges = np.diff(np.r_[0, gone.astype(np.int8), 0])
    begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # A run may reach over the end of a text: cut it there.
    inner = words.first[1:-1]
    inner = inner[(inner > 0) & (inner < len(words))]
    inner = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
    begins, stops = np.sort(np.r_[begins, np.unique(inner)]), np.sort(np.r_[stops, np.unique(inner)])
    owner = words.owner
    to = owner[begins] if len(begins) else begins
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(to, np.arange(table.num_rows + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(begins - words.first[to], pa.int64()), pa.array(stops - begins, pa.int64())], names=["start", "length"]),
    )
    columns = {c: table[c] for c in table.column_names} | {
        text_col: text,
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(before[words.first[1:]] - before[words.first[:-1]], pa.int64()),
        "removed": spans,
    }
    return pa.table({f.name: _as(columns[f.name], f.type) for f in schema}, schema=schema)


def _as(column, kind: pa.DataType):
    return column if column.type == kind else column.cast(kind)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, ``text`` without the words that repeat a document
    with a smaller id, and n_words, n_removed (long, before and of the cut) and
    removed (spans of word places: start, length).

    Windows are judged on the input.  A removed word takes the white space
    after it along; other white space stays.  A null text has no words and
    stays null.  A null id counts as larger than any other.  Rows with one id
    (repeated rows too) don't remove each other's words.  Columns of ``docs``
    named like an added one give way to it; an empty table gives no rows.
    """
    docs = without(docs, "n_words", "n_removed", "removed")
    docs = docs.withColumn(id_col, quoted(id_col).cast("long")) if dict(docs.dtypes)[id_col] != "bigint" else docs
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)

    blocks = blocks_of(docs, block_bytes)
    tasks = exchange_tasks(blocks)
    parts = PARTS_PER_PARTITION * tasks
    anchors = ask(blocks, partial(_ask_anchors, text_col=text_col, window=window, parts=parts))
    shared = answer(anchors, _shared, _ANCHOR, tasks)
    windows = ask(blocks, partial(_ask_windows, text_col=text_col, id_col=id_col, window=window, parts=parts), shared)
    earlier = answer(windows, _earlier, _WINDOW, tasks)
    return with_answers(blocks, earlier, partial(_cut, text_col=text_col, id_col=id_col, window=window, schema=arrow), schema)
