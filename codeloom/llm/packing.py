"""Operator 1: packing pieces into sequences by patterns and least squares.

The driver sees only the histogram of piece lengths (at most ``capacity``
numbers, however many pieces there are).  It enumerates patterns of few
lengths that fill a sequence, on a grid of bins; fits how often to use each by
non-negative least squares; rounds; and packs what remains, longest first,
into the room left where it fits best.  The plan says, for ranges of ranks
among the pieces of one length, the sequence and the place of each.  Pieces
find their rank by counts for each partition, and then their place: no task
gathers the pieces of a length.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _pieces, checkpointed, quoted, without
from .encoding import encoder

STEP_BYTES = 4 << 20
BINS = 64
MOST_IN_PATTERN = 4


# ---------------------------------------------------------------- pieces


def _cut(batches, text_col: str, tokenizer: str, end_id: int, capacity: int, schema: pa.Schema):
    enc = encoder(tokenizer)
    for batch in batches:
        for b in _pieces(batch, 4 * STEP_BYTES):
            ids, at = enc.encode(b[text_col], end_id)
            total = np.diff(at)
            n = np.maximum(1, -(-total // capacity))
            row = np.repeat(np.arange(b.num_rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, total[row] - start)
            begin = np.r_[at[row] + start, at[-1]] if len(row) else np.zeros(1, np.int64)
            body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((begin * 4).astype(np.int32)), pa.py_buffer(ids)])
            made = {"piece": pa.array(piece.astype(np.int32)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": body}
            kept = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else kept[f.name] for f in schema], schema=schema)


def token_pieces(docs: DataFrame, tokenizer: str, text_col: str = "text", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """A row for each piece of each document: the columns of ``docs`` without
    the text, and piece (from 0), start, length and ids (binary, little-endian
    unsigned 32-bit).  A null or empty text is one piece with just ``end_id``;
    only documents of over ``capacity`` ids are cut.  Columns named like an
    added one give way."""
    docs = without(docs, "piece", "start", "length", "ids")
    kept = [f for f in docs.schema.fields if f.name != text_col]
    added = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([*kept, *added])
    return docs.mapInArrow(partial(_cut, text_col=text_col, tokenizer=tokenizer, end_id=end_id, capacity=capacity, schema=to_arrow_schema(schema)), schema)


# ---------------------------------------------------------------- the plan


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-10:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 1e-12
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            gone = at[x[at] <= 1e-12]
            if not len(gone):
                gone = at[low]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
    return x


def patterns(bins: int = BINS, most: int = MOST_IN_PATTERN) -> list[tuple[int, ...]]:
    """Multisets of up to ``most`` bin numbers that add up to ``bins``."""
    found = []
    for k in range(1, most):
        for head in combinations_with_replacement(range(1, bins), k):
            last = bins - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    return found


class Plan:
    """Runs (length, first rank, count, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = {}
        self._fit()
        self._residuals()

    def _put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.rank[length]), count, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count

    def _fit(self) -> None:
        """Patterns with rounded repeat counts, as far as pieces last."""
        width = -(-self.capacity // BINS)
        bins = -(-self.capacity // width)
        if not self.left.any():
            return
        self.bin_of = -(-np.arange(self.capacity + 1) // width)
        have = np.bincount(self.bin_of, weights=self.left, minlength=bins + 1)[1:]
        options = patterns(bins)
        a = np.zeros((bins, len(options)))
        for k, p in enumerate(options):
            for b in p:
                a[b - 1, k] += 1
        # Long pieces are hard to place: they weigh more.
        weight = np.arange(1, bins + 1) / bins
        if not options:
            return
        x = nnls(a * weight[:, None], have / have.sum() * weight) * have.sum()
        for k in np.argsort(-x, kind="stable"):
            repeats = int(round(x[k]))
            if repeats <= 0:
                break
            *heads, _ = sorted(options[k], reverse=True)
            have = np.bincount(self.bin_of, weights=self.left, minlength=bins + 1).astype(np.int64)
            repeats = min(repeats, *(int(have[h]) // heads.count(h) for h in heads))
            if repeats > 0:
                self._use(heads, repeats, width)

    def _use(self, heads: list[int], repeats: int, width: int) -> None:
        """``repeats`` new sequences with a piece of each bin of ``heads``, and
        for the last bin of the pattern the longest piece that still fits."""
        groups = [(self.sequences, repeats, 0)]  # first sequence, count, used
        self.sequences += repeats
        for b in heads:
            groups = self._next(groups, lambda used, b=b: min(b * width, self.capacity))
        for seq, count, used in self._next(groups, lambda used: self.capacity - used):
            if used < self.capacity:
                self.room.setdefault(self.capacity - used, []).append((seq, count))

    def _next(self, groups: list[tuple[int, int, int]], most) -> list[tuple[int, int, int]]:
        """The groups with one more piece each: the longest of up to ``most(used)``."""
        out = []
        for seq, count, used in groups:
            length = most(used)
            while count:
                there = np.flatnonzero(self.left[1 : length + 1])
                if not len(there):
                    out.append((seq, count, used))
                    break
                length = int(there[-1]) + 1
                k = min(count, int(self.left[length]))
                self._put(length, k, seq, used)
                out.append((seq, k, used + length))
                seq, count = seq + k, count - k
        return out

    def _residuals(self) -> None:
        """Best fit, longest first, a group of like sequences at a time."""
        heap_free = np.zeros(self.capacity + 2, bool)
        for room in self.room:
            heap_free[room] = True
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                n = int(self.left[length])
                fit = length + int(np.argmax(heap_free[length : self.capacity + 1]))
                if heap_free[fit]:
                    seq, count = self.room[fit].pop()
                    k = min(n, count)
                    self._put(length, k, seq, self.capacity - fit)
                    if k < count:
                        self.room[fit].append((seq + k, count - k))
                    heap_free[fit] = bool(self.room[fit])
                    if fit > length:
                        self.room.setdefault(fit - length, []).append((seq, k))
                        heap_free[fit - length] = True
                else:
                    each = self.capacity // length
                    k, many = (n // each, each) if n >= each else (1, n)
                    for j in range(many):
                        self._put(length, k, self.sequences, j * length)
                    rest = self.capacity - many * length
                    if rest:
                        self.room.setdefault(rest, []).append((self.sequences, k))
                        heap_free[rest] = True
                    self.sequences += k

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys (length and first rank), and for each: first rank, sequence, offset."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << 44) | runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]


# ---------------------------------------------------------------- packing


def _place(batches, plan: tuple, schema: pa.Schema):
    keys, first, sequence, offset = plan
    for b in batches:
        length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
        run = np.searchsorted(keys, (length.astype(np.int64) << 44) | rank, side="right") - 1
        made = {"sequence_id": pa.array(sequence[run] + rank - first[run]), "offset": pa.array(offset[run])}
        yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b[f.name] for f in schema], schema=schema)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (each with a length from 1 to ``capacity``) with sequence_id
    and offset.  The pieces of a sequence lie from 0 on without gaps and have
    at most ``capacity`` ids together.  Equal lengths are interchangeable;
    repeated rows are pieces of their own.  No pieces give no rows; columns
    named like an added one give way."""
    pieces = without(pieces, "sequence_id", "offset", "_chunk", "_row", "_rank", "_local", "_base")
    held = checkpointed(pieces.withColumn("length", F.col("length").cast("long")).withColumn("_chunk", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = checkpointed(held.groupBy("_chunk", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 1 <= length <= capacity for length in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = Plan(histogram, capacity).arrays()
    earlier = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_chunk", "length").orderBy("_row")) - 1
    ranked = held.withColumn("_local", local).join(base, ["_chunk", "length"])
    ranked = ranked.select(*[quoted(c) for c in pieces.columns], (F.col("_local") + F.col("_base")).cast("long").alias("_rank"))
    schema = T.StructType([*[f for f in ranked.schema.fields if f.name != "_rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(partial(_place, plan=plan, schema=to_arrow_schema(schema)), schema)
