"""Operator 13: vectors as product codes, by Exponion search.

A component x becomes the integer floor(1024 x).  Vectors are cut into equal
consecutive parts, and each part is coded by the nearest entry of its place's
codebook.  A round assigns every part, then moves each entry to the floor of
its parts' mean.

Assignment is exact and in integers.  A part starts at the entry e it had
before, at squared distance u.  An entry that is as near lies, by the triangle
inequality, within twice that distance of e: only the entries at a squared
distance of at most 4u from e can win.  They are the front of the list of e's
neighbours sorted by distance; fronts are taken in powers of two, so that parts
with fronts alike are compared in one product of matrices.  Ties go to the
least index.

Vectors are held as integers of the least width that takes them all, with their
codes, and each round writes them once.  What reaches the driver is the
codebooks: a number that depends on the vectors' length, never on how many.
"""

from __future__ import annotations

import decimal
import hashlib
import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, dealt_join, fair_share, free_name, hot_keys, quoted, release, without

SCALE = 1024
#: Rows that a worker codes at once.
STEP_ROWS = 1 << 14
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """What is common to all vectors."""

    parts: int
    width: int  # positions in a part
    bound: int  # no component is larger

    @property
    def stored(self) -> str:
        return next((f"<i{n}" for n in (2, 4) if self.bound < 1 << (8 * n - 1)), "<i8")

    @property
    def exact(self) -> type:
        """A type in which all squared distances and their steps are exact:
        floats up to 2^53, longs, or else Python's integers."""
        most = 16 * self.width * self.bound**2
        return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


class Codebook:
    """The entries of one place, and of each its neighbours by distance."""

    def __init__(self, entries: np.ndarray, kind: type):
        self.entries = entries.astype(kind)
        self.norms = (self.entries * self.entries).sum(1)
        apart = self.norms[:, None] + self.norms - 2 * self.entries.dot(self.entries.T)
        order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, order, 1)
        self.order = order

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its squared distance."""
        e = self.entries
        first = x - e[start]
        u = (first * first).sum(1)
        best, least = start.copy(), u.copy()
        norms = (x * x).sum(1)
        by_start = np.argsort(start, kind="stable")
        edges = np.searchsorted(start[by_start], np.arange(len(e) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            rows = by_start[edges[s] : edges[s + 1]]
            front = np.searchsorted(self.apart[s], 4 * u[rows], side="right")
            # The power of two that takes the front.
            steps = np.ceil(np.log2(np.maximum(front, 1))).astype(np.int64)
            for step in np.unique(steps[front > 1]):
                of = rows[(steps == step) & (front > 1)]
                near = np.sort(self.order[s, : 1 << step])
                far = norms[of, None] + self.norms[near] - 2 * x[of].dot(e[near].T)
                at = np.argmin(far, axis=1)
                best[of], least[of] = near[at], far[np.arange(len(of)), at]
        return best, least


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), within the range of longs."""
    with np.errstate(over="ignore"):
        low = np.floor(values.astype(np.float64) * SCALE)
    inside = np.abs(low) < 2.0**63
    return np.where(inside, np.where(inside, low, 0).astype(np.int64), np.where(low > 0, LONG, -LONG))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list array."""
    at = column.offsets.to_numpy()
    return at - at[0], column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


def _measure(batches):
    """Rows, longest vector and largest component of each batch."""
    for b in batches:
        at, values = _lists(b["v"])
        most = int(np.abs(_integers(values)).max()) if len(values) else 0
        size = int(np.diff(at).max()) if b.num_rows else 0
        yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "size": pa.array([size], pa.int64()), "most": pa.array([most], pa.int64())})


def _padded(column: pa.Array, length: int) -> np.ndarray:
    at, values = _lists(column)
    out = np.zeros((len(column), length), np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    out[row, np.arange(len(values)) - at[:-1][row]] = _integers(values)
    return out


def _assign(x: np.ndarray, start: np.ndarray, books: list[Codebook], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and the squared distances summed over parts."""
    codes = np.empty((len(x), shape.parts), np.int64)
    error = np.zeros(len(x), shape.exact)
    for p, book in enumerate(books):
        part = x[:, p * shape.width : (p + 1) * shape.width].astype(shape.exact)
        codes[:, p], far = book.nearest(part, start[:, p])
        error = error + far
    return codes, error


def _steps(batch: pa.RecordBatch):
    for k in range(0, batch.num_rows, STEP_ROWS):
        yield batch.slice(k, STEP_ROWS)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype, (at[-1] - at[0]) // np.dtype(dtype).itemsize, at[0]).reshape(-1, width)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    at = np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])


def _code(batches, books: list[np.ndarray], shape: Shape, schema: pa.Schema, first: bool, last: bool):
    """Rows with their vectors (x) and codes; in the last round code and error."""
    made = [Codebook(b, shape.exact) for b in books]
    length = shape.parts * shape.width
    for batch in batches:
        for b in _steps(batch):
            x = _padded(b["v"], length) if first else _matrix(b["x"], shape.stored, length)
            start = np.zeros((len(x), shape.parts), np.int64) if first else _matrix(b["codes"], "u1", shape.parts).astype(np.int64)
            codes, error = _assign(x, start, made, shape)
            new = {"codes": _binary(codes.astype(np.uint8)), "x": _binary(x.astype(shape.stored))}
            if last:
                new = {"code": pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()), "error": pa.array([min(int(e), LONG) for e in error], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else b[f.name] for f in schema], schema=schema)


def _sums(batches, shape: Shape, schema: pa.Schema):
    """(part, entry, n, s): how many parts an entry has, and their sum."""
    entries, length = 256, shape.parts * shape.width
    total = np.zeros((shape.parts, entries, shape.width), object)
    n = np.zeros((shape.parts, entries), np.int64)
    # Longs take this many rows before they are added to Python's integers.
    room = max(1, min(STEP_ROWS, LONG // max(1, shape.bound)))
    for batch in batches:
        for k in range(0, batch.num_rows, room):
            b = batch.slice(k, room)
            x, codes = _matrix(b["x"], shape.stored, length).astype(np.int64), _matrix(b["codes"], "u1", shape.parts)
            for p in range(shape.parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, at = np.unique(codes[order, p], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p * shape.width : (p + 1) * shape.width], at, axis=0)
                n[p] += np.bincount(codes[:, p], minlength=entries)
    part, entry = np.nonzero(n)
    kind = schema.field("s").type
    number = decimal.Decimal if pa.types.is_decimal(kind.value_type) else int
    sums = [[number(int(v)) for v in row] for row in total[part, entry]]
    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(sums, kind)], schema=schema)


def _moved(state: DataFrame, books: list[np.ndarray], shape: Shape, rows: int) -> list[np.ndarray]:
    """The entries at the floor of their parts' means; unused ones stay."""
    number = T.LongType() if shape.bound * max(1, rows) < 1 << 62 else T.DecimalType(38, 0)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(number))])
    sums = state.select("x", "codes").mapInArrow(partial(_sums, shape=shape, schema=to_arrow_schema(schema)), schema)
    each = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(shape.width)])
    out = [b.copy() for b in books]
    for row in each.collect():
        out[row[0]][row[1]] = [int(s) // row[2] for s in row[3:]]
    return out


@dataclass
class Coded:
    rows: DataFrame  # with code and error
    codebooks: list[np.ndarray]  # of each place: entries x positions

    @property
    def sha256(self) -> str:
        """Of all entries' components, by place, entry and position."""
        return hashlib.sha256(",".join(str(int(v)) for b in self.codebooks for v in b.ravel()).encode()).hexdigest()


def code_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> Coded:
    """``vectors`` without ``vec_col``, with code (two hex digits for each
    part) and error (long, the squared distances to the entries).

    Rows whose vector is null or holds a null, NaN or infinite component are
    dropped.  The codebooks start with the rows of the least ids (at most
    ``entries`` <= 256; null ids last, rows with one id by their components),
    so that repeated rows are entries each.  Vectors are as long as the longest
    one, or on to the next multiple of ``parts``: what is missing is 0.
    Components beyond longs, once scaled, count as the longest long, and so
    does an error.  Columns named code or error give way; without any vector
    there are no rows and no entries.
    """
    spark = vectors.sparkSession
    others = without(vectors, vec_col, "code", "error")
    row, v = F.struct(*[quoted(c) for c in others.columns]).alias("row"), quoted(vec_col).cast("array<double>").alias("v")
    whole = F.forall(quoted(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(quoted(vec_col).isNotNull()).filter(whole)
    sized = kept.select(v).mapInArrow(_measure, "n long, size long, most long").agg(F.sum("n"), F.max("size"), F.max("most")).first()
    rows, length, most = (int(x or 0) for x in sized)
    width = max(1, math.ceil(length / parts))
    shape = Shape(parts, width, max(1, most))

    least = kept.select(quoted(id_col).alias("id"), v).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()["v"].combine_chunks()
    first = _padded(least, parts * width)
    books = [first[:, p * width : (p + 1) * width].astype(object) for p in range(parts)]

    field = kept.select(row).schema.fields[0]
    held = T.StructType([field, T.StructField("x", T.BinaryType()), T.StructField("codes", T.BinaryType())])
    final = T.StructType([field, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    state, first_round = kept.select(row, v), True
    for _ in range(rounds if rows else 0):
        before = state
        state = checkpointed(before.mapInArrow(partial(_code, books=books, shape=shape, schema=to_arrow_schema(held), first=first_round, last=False), held))
        if not first_round:
            release(spark, before)
        books, first_round = _moved(state, books, shape, rows), False
    coded = state.mapInArrow(partial(_code, books=books, shape=shape, schema=to_arrow_schema(final), first=first_round, last=True), final)
    return Coded(coded.select("row.*", "code", "error"), books)


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with label_error (long): the errors summed over equal labels,
    nulls together; a sum beyond longs is the longest long.  A frequent label's
    rows are dealt out to its sum.  A column of that name gives way."""
    coded = checkpointed(without(coded, "label_error"))
    name, none = free_name("_label", coded), free_name("_none", coded)
    keyed = coded.withColumns({name: F.coalesce(quoted(label_col).cast("string"), F.lit("")), none: quoted(label_col).isNull()})
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = checkpointed(keyed.groupBy(F.col(name).alias("label"), F.col(none).alias("none")).agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")))
    sums = sums.withColumnsRenamed({"label": name, "none": none})
    share = fair_share(sums.agg(F.sum("n")).first()[0] or 0, coded.sparkSession)
    return dealt_join(keyed, sums.select(name, none, "label_error"), [name, none], hot_keys(sums, [name, none], share)).select(*[quoted(c) for c in coded.columns], "label_error")
