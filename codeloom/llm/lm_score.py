"""Operator 8: language-model scores by cross-entropy difference.

A target and a background model of one form share one vocabulary: for word w
after v, with counts c that leave out the scored document itself,

    P(w | v) = L2 c(v w) / c(v) + L1 c(w) / N + L0 / V

(without c(v), its share goes to c(w) / N).  A document's score is the mean
over its words of the loss under the target model less the loss under the
background model: the lower, the more like the target.

Counts are exact 64-bit sums over the whole corpus.  Each block of documents
asks once for each of its distinct words and word pairs, with its own counts,
and gets the corpus' counts back in the same order.  A word or pair is known by
a 64-bit hash, whatever the number of partitions: of n distinct ones some
n^2 / 2^65 pairs are taken for one (one in 30 corpora of 10^9).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BLOCK_BYTES, PARTS_PER_PARTITION, answer_each, ask, blocks_of, by_range, checkpointed, exchange_tasks, from_planes, from_sorted, lower_hashes, mix64, squeezed, to_planes, to_sorted, unpack, unsqueezed, with_answers, without, words_of

L2, L1, L0 = 0.6, 0.35, 0.05
_ASK = np.dtype([("h", "<u8"), ("t", "<u2"), ("b", "<u2")])
_TOLD = np.dtype([("t", "<i8"), ("b", "<i8")])
_NARROW = np.dtype([("t", "<u4"), ("b", "<u4")])
_WORD = np.dtype([("h", "<u8")])
_MOST = 65_535


class _Counted:
    """Words and pairs of a block, as entries: hashes, places and counts."""

    def __init__(self, table: pa.Table, text_col: str, target: np.ndarray):
        words = words_of(table[text_col])
        codes, distinct = words.coded()
        h = lower_hashes(distinct)[codes]
        n = len(h)
        self.owner, self.first, self.n = words.owner, words.first, n
        pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if n else h
        self.follows = np.zeros(n, bool)  # has a word before it in its text
        self.follows[1:] = self.owner[1:] == self.owner[:-1]
        both = np.r_[mix64(h), pair[self.follows[1:]]]
        self.keys, self.place = np.unique(both, return_inverse=True)
        self.target = target
        of = np.r_[self.owner, self.owner[self.follows]]
        self.of = of
        self.b = np.bincount(self.place, minlength=len(self.keys))
        self.t = np.bincount(self.place, weights=target[of], minlength=len(self.keys)).astype(np.int64)


def _targets(table: pa.Table, bodies: list[bytes]) -> np.ndarray:
    """Which rows of a block are of the target: the bodies marked R name them."""
    target = np.zeros(table.num_rows, bool)
    for b in bodies:
        if b[:1] == b"R":
            target[np.frombuffer(b[1:], "<i4")] = True
    return target


def _entries(c: _Counted) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each asked row; a count over the most goes in portions."""
    times = np.maximum(1, -(-c.b // _MOST))
    at = np.repeat(np.arange(len(c.keys)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _ask(table: pa.Table, bodies: list[bytes], text_col: str, parts: int):
    c = _Counted(table, text_col, _targets(table, bodies))
    at, nth = _entries(c)
    out = np.zeros(len(at), _ASK)
    out["h"] = c.keys[at]
    out["b"] = np.clip(c.b[at] - nth * _MOST, 0, _MOST)
    out["t"] = np.clip(c.t[at] - nth * _MOST, 0, _MOST)
    return by_range(out["h"], parts), out


def _total(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys["h"], kind="stable")
    key = keys["h"][order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[begin, len(key)])
    del key
    out = np.zeros(len(keys), _TOLD)
    for x in ("t", "b"):
        total = np.add.reduceat(keys[x][order].astype(np.int64), begin)
        out[x][order] = np.repeat(total, size)
    return out


def _answer(told: np.ndarray) -> bytes:
    """Counts in planes of 32 bits where they fit, else of 64; a last byte
    tells which."""
    wide = len(told) and max(told["t"].max(), told["b"].max()) > 0xFFFFFFFF
    return squeezed(to_planes(told)) + b"W" if wide else squeezed(to_planes(told.astype(_NARROW))) + b"N"


def _counts(body: bytes) -> np.ndarray:
    return from_planes(unsqueezed(body[:-1]), _TOLD if body[-1:] == b"W" else _NARROW).astype(_TOLD)


def _told(bodies: list[bytes]) -> np.ndarray:
    """The answers by part, which is the order of the keys."""
    parts = sorted((int.from_bytes(b[1:5], "little"), k) for k, b in enumerate(bodies) if b[:1] == b"A")
    return np.concatenate([_counts(bodies[k][5:]) for _, k in parts]) if parts else np.zeros(0, _TOLD)


def _scored(table: pa.Table, bodies: list[bytes], text_col: str, sizes: tuple[int, int, float], schema: pa.Schema) -> pa.Table:
    c = _Counted(table, text_col, _targets(table, bodies))
    at, nth = _entries(c)
    told = _told(bodies)[nth == 0]
    t, b = told["t"].astype(np.int64), told["b"].astype(np.int64)
    del told, at, nth
    # Less what the document itself has of each entry.
    cell, inverse, own = np.unique(c.of * max(1, len(c.keys)) + c.place, return_inverse=True, return_counts=True)
    own = own[inverse]
    n, texts = c.n, table.num_rows
    length = np.diff(c.first)
    word, pair_of = c.place[:n], c.place[n:]
    loss = {}
    for name, count, total, drop in (("target", t, sizes[0], c.target), ("background", b, sizes[1], np.ones(texts, bool))):
        mine = drop[c.owner]
        left = np.maximum(count[word] - np.where(mine, own[:n], 0), 0)
        all_left = np.maximum(total - np.where(drop, length, 0), 1)[c.owner]
        one = left / all_left
        before, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        f = np.flatnonzero(c.follows)
        before[f] = left[f - 1]
        two[f] = np.maximum(count[pair_of] - np.where(drop[c.owner[f]], own[n:], 0), 0)
        p = np.where(before > 0, L2 * two / np.maximum(before, 1) + L1 * one, (L2 + L1) * one) + L0 / sizes[2]
        loss[name] = np.bincount(c.owner, weights=-np.log(p), minlength=texts) / np.maximum(length, 1)
    empty = length == 0
    made = {"n_tokens": pa.array(length, pa.int64())}
    for name, x in (("loss_target", loss["target"]), ("loss_background", loss["background"]), ("score", loss["target"] - loss["background"])):
        made[name] = pa.array(x, pa.float64(), mask=empty)
    return pa.table([made[f.name] if f.name in made else table[f.name] for f in schema], schema=schema)


ROWS = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])


def _sizes(batches, text_col: str, id_col: str):
    """The rows of the blocks, with their ids and numbers of words."""
    for batch in batches:
        for k in range(batch.num_rows):
            table = unpack(batch["payload"][k].as_buffer())
            n = table.num_rows
            columns = [pa.array(np.full(n, batch["block"][k].as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), table[id_col].combine_chunks().cast(pa.int64()), pa.array(words_of(table[text_col]).counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=ROWS.names)


def _ask_words(table: pa.Table, _: list[bytes], text_col: str, parts: int):
    h = np.unique(lower_hashes(words_of(table[text_col]).coded()[1]))
    out = np.zeros(len(h), _WORD)
    out["h"] = h
    return by_range(h, parts), out


def _distinct(batches):
    """How many words the parts of a task have, held as one sorted array."""
    held, fresh, size = np.zeros(0, np.uint64), [], 0
    for b in batches:
        for x in b["body"]:
            fresh.append(from_sorted(x.as_buffer(), _WORD)["h"])
            size += len(fresh[-1])
            if size > max(1 << 20, len(held)):
                held, fresh, size = np.unique(np.concatenate([held, *fresh])), [], 0
    yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(np.concatenate([held, *fresh])))], pa.int64())], names=["n"])


def vocabulary_size(blocks: DataFrame, text_col: str, tasks: int) -> int:
    """Distinct words of all blocks, exactly: each block sends each of its
    words once."""
    asked = ask(blocks, partial(_ask_words, text_col=text_col, parts=PARTS_PER_PARTITION * tasks), None, to_sorted)
    counts = asked.repartition(tasks, "part").mapInArrow(_distinct, "n long")
    return max(1, counts.agg(F.sum("n")).first()[0] or 0)


def _marks(batches):
    """(block, body): the rows of the target, marked R."""
    for batch in batches:
        block, row = batch["block"].to_numpy(), batch["row"].to_numpy().astype("<i4")
        order = np.argsort(block, kind="stable")
        block, row = block[order], row[order]
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
        ends = np.r_[cut[1:], len(block)] if len(block) else cut
        yield pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array([b"R" + row[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["block", "body"])


def score_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_tokens, loss_target, loss_background and score.

    ``target``: its first column names the ids of the target's documents (null
    and repeated ones don't matter); all documents are the background.  Words
    compare with A-Z in lower case.  ``vocabulary``: V, else the number of
    distinct words of all documents.  A text without words, or null, has null losses and score.  Repeated
    rows count as often as they occur, and each leaves out itself only.
    Columns named like an added one give way; an empty table gives no rows.
    """
    added = ("n_tokens", "loss_target", "loss_background", "score")
    docs = without(docs, *added)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(a, T.LongType() if a == "n_tokens" else T.DoubleType()) for a in added]])
    blocks = blocks_of(docs, block_bytes)
    tasks = exchange_tasks(blocks)
    rows = checkpointed(blocks.mapInArrow(partial(_sizes, text_col=text_col, id_col=id_col), ROWS))
    ids = target.select(F.col(target.columns[0]).cast("long").alias("target_id")).filter("target_id is not null").distinct()
    chosen = checkpointed(rows.join(ids, F.col("id") == F.col("target_id"), "left_semi").select("block", "row", "n"))
    n_all = rows.agg(F.sum("n")).first()[0] or 0
    n_target = chosen.agg(F.sum("n")).first()[0] or 0
    v = vocabulary or vocabulary_size(blocks, text_col, tasks)
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("body", T.BinaryType())])
    marks = chosen.select("block", "row").mapInArrow(_marks, kind)
    asked = ask(blocks, partial(_ask, text_col=text_col, parts=PARTS_PER_PARTITION * tasks), marks, to_sorted)
    told = answer_each(asked, _total, _ASK, _answer, tasks)
    # An answer goes back marked A, with its part before it.
    part = F.unhex(F.concat(*[F.substring(F.lpad(F.hex("part"), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
    both = marks.unionByName(told.select("block", F.concat(F.lit(b"A"), part, "body").alias("body")))
    make = partial(_scored, text_col=text_col, sizes=(n_target, n_all, v), schema=to_arrow_schema(schema))
    return with_answers(blocks, both, make, schema)


def labelled_good(labels: DataFrame) -> DataFrame:
    """The documents that a label of quality 1 names."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id")
