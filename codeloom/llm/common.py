"""What the operators of this subpackage share: words of an Arrow batch as
numpy arrays, column naming, shared storage and the block exchange.

*Words* are maximal runs of bytes other than 0x20 and 0x09-0x0D.

*Blocks* are bounded groups of whole input rows, each one compressed Arrow
payload with a fixed number.  Blocks let an operator ask the whole corpus a
question ("which of my hashes occur elsewhere?") with one compact row for each
block and hash part, and get the answers back beside the block's own rows:

    blocks --ask--> (part, block, keys) --shuffle by part--> answers
           --shuffle by block--> blocks with their answers

Each key is sent once for each block however often it occurs, so a key in a
third of all rows costs one entry for each block, and no task ever sees a
group that grows with a key's frequency.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_folder

#: Bytes of Arrow data in a block.  Larger blocks mean fewer, longer messages;
#: a Python worker holds about ten times this.
BLOCK_BYTES = 8 << 20
#: zstd level of a block, which is written once and shuffled once or twice.
BLOCK_LEVEL = 9
#: Hash parts for each shuffle partition, to even out how parts are dealt.
PARTS_PER_PARTITION = 4
#: Compressed bytes of blocks whose keys one answering task holds at most: with
#: more of them there are more tasks than the session's shuffle partitions.
TASK_BYTES = 64 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# ---------------------------------------------------------------- session


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: later reads don't compute it again,
    and its rows and partitions stay as they are when executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_path(df: DataFrame):
    """Where a checkpointed frame lies, and its file system."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(file)
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


def exchange_tasks(blocks: DataFrame) -> int:
    """Tasks of an exchange between blocks: enough that one holds the keys of
    ``TASK_BYTES`` at most, whatever the session's setting."""
    path, fs = checkpoint_path(blocks)
    return max(shuffle_partitions(blocks.sparkSession), -(-fs.getContentSummary(path).getLength() // TASK_BYTES))


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove checkpoints that nothing will read any more, and let Spark's
    cleaner find the shuffles that went out of use."""
    for df in frames:
        path, fs = checkpoint_path(df)
        fs.delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` of a mapInArrow, after which its Python worker gives the memory
    that it has freed back to the system.  Workers live on, and without this
    each keeps the most that any task before took, beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


# ---------------------------------------------------------------- columns


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add (any case)."""
    low = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in low])


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fair_share(rows: int, spark: SparkSession) -> int:
    """Rows of one key from which it is dealt out to more than one task."""
    return max(1, rows // (PARTS_PER_PARTITION * shuffle_partitions(spark)))


def hot_keys(counts: DataFrame, keys: list[str], share: int) -> DataFrame:
    """(keys, salts) of the keys with over ``share`` rows; ``counts``: keys and
    n.  Of all rows there are ``fair_share`` times PARTS_PER_PARTITION times
    the shuffle partitions, so there are at most so many such keys: a bound
    that doesn't grow with the rows."""
    return counts.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / F.lit(share)).cast("int").alias("salts"))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` by columns without nulls that both have.
    The rows of a hot key are dealt out to its salts, and its rows of ``right``
    (one for each key, or few) go to each of them."""
    salt, salts = free_name("salt", left, right), free_name("salts", left, right)
    few = F.broadcast(hot.withColumnRenamed("salts", salts))
    mixed = F.xxhash64(*[quoted(c) for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]) + F.spark_partition_id()
    dealt = left.join(few, keys, "left").withColumn(salt, F.when(quoted(salts).isNull(), 0).otherwise(F.pmod(mixed, quoted(salts))).cast("int")).drop(salts)
    each = right.join(few, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(quoted(salts), F.lit(1)) - 1))).drop(salts)
    return dealt.join(each, [*keys, salt], how).drop(salt)


# ---------------------------------------------------------------- words


@dataclass
class Words:
    """Words of a batch of texts, in order."""

    data: np.ndarray  # uint8: bytes of all texts
    text_at: np.ndarray  # where each text starts in data, and the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # first word of each text, and the number of words

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """A code for each word, and the distinct words by code."""
        lens = self.end - self.start
        at = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=at[1:])
        inside = ~_SPACE[self.data]
        flat = np.ascontiguousarray(self.data[inside])
        arr = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(at), pa.py_buffer(flat)])
        coded = arr.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def text_buffers(text: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array of strings, and offsets from 0; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(text: pa.Array | pa.ChunkedArray) -> Words:
    data, at = text_buffers(text)
    n = len(data)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = at[:-1][at[:-1] < n]
    begins[inner] = inside[inner]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_hashes(distinct: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, A-Z in lower case."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.translate(_SMALL)) for w in distinct), np.uint64, len(distinct))


def window_hash(word_hash: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by the place of its first word;
    runs across texts are the caller's to leave out."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    keys = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += word_hash[k : k + n] * keys[k]
    return mix64(out)


def full_windows(words: Words, width: int) -> np.ndarray:
    """True where a run of ``width`` words of one text starts; as many as
    ``window_hash`` gives."""
    n = max(0, len(words) - width + 1)
    ok = np.ones(n, bool)
    if n and width > 1:
        left = np.repeat(words.first[1:], words.counts)[:n] - np.arange(n)
        ok = left >= width
    return ok


# ---------------------------------------------------------------- blocks


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    codec = pa.Codec("zstd", compression_level=BLOCK_LEVEL)
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes | pa.Buffer) -> pa.Table:
    """The rows of a block."""
    return pa.ipc.open_stream(payload).read_all()


BLOCK_TYPE = T.StructType([T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType())])
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("payload", pa.binary())])


def blocks_of(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` in blocks (block long, payload binary), written to the shared
    folder so that their numbers hold.  A row is never split; a longer row is
    a block of its own.

    They are dealt out by their numbers and sorted once; Spark keeps this in
    mind for the checkpoint, so that only answers are shuffled to them later.
    (It does so for a plan that isn't adaptive.)"""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            out = pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([_ipc(held)], pa.binary())], schema=BLOCK_ARROW)
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            for piece in _pieces(batch, block_bytes):
                if held and size + piece.nbytes > block_bytes:
                    yield flush()
                held.append(piece)
                size += piece.nbytes
        if held:
            yield flush()

    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df.mapInArrow(pack, BLOCK_TYPE).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _pieces(batch: pa.RecordBatch, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about a quarter of a block at most, or one row."""
    todo = [batch] if batch.num_rows else []
    while todo:
        b = todo.pop()
        if b.num_rows > 1 and b.nbytes > block_bytes // 4:
            half = b.num_rows // 2
            todo += [b.slice(half), b.slice(0, half)]
        else:
            yield b


ASK_TYPE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("body", T.BinaryType())])
ASK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])


def to_planes(keys: np.ndarray) -> bytes:
    """A structured array field by field and byte by byte, so that the bytes
    that hardly vary lie together and a shuffle's codec takes them out."""
    return b"".join(np.ascontiguousarray(keys[f]).view(np.uint8).reshape(len(keys), keys.dtype[f].itemsize).T.tobytes() for f in keys.dtype.names)


def from_planes(body: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(body) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        out[f] = np.ascontiguousarray(planes.T).view(dtype[f]).reshape(n)
        at += n * size
    return out


def squeezed(body: bytes) -> bytes:
    """``body`` by zstd, with its length."""
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unsqueezed(body: bytes | pa.Buffer) -> bytes:
    size = int.from_bytes(bytes(body[:8]), "little")
    return pa.decompress(body[8:], size, "zstd", asbytes=True)


def to_sorted(keys: np.ndarray) -> bytes:
    """An array with its keys, ascending 64-bit numbers, in field h: planes of
    the steps from key to key, squeezed."""
    steps = keys.copy()
    steps["h"][1:] -= keys["h"][:-1]
    return squeezed(to_planes(steps))


def from_sorted(body: bytes, dtype: np.dtype) -> np.ndarray:
    out = from_planes(unsqueezed(body), dtype)
    out["h"] = np.cumsum(out["h"], dtype=np.uint64)
    return out


def by_range(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key: equal ranges, so that the keys of a part
    are neighbours and their steps short."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def ask(blocks: DataFrame, question: Callable[[pa.Table, list[bytes]], tuple[np.ndarray, np.ndarray]], answers: DataFrame | None = None, encode: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """A row (part, block, body) for each block and hash part with a key.

    ``question(table, bodies)`` gives the parts and the keys, two arrays of one
    length; bodies: what ``answers`` holds for the block.
    """

    def rows(block: int, asked: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        part, keys = asked
        order = np.argsort(part, kind="stable")
        part, keys = part[order], keys[order]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
        ends = np.r_[cut[1:], len(part)] if len(part) else cut
        return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(np.full(len(cut), block, np.int64)), pa.array([encode(keys[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], schema=ASK_ARROW)

    if answers is None:

        def run(batches):
            for b in batches:
                for k in range(b.num_rows):
                    block, payload = b["block"][k].as_py(), b["payload"][k].as_buffer()
                    yield rows(block, question(unpack(payload), []))

        return blocks.mapInArrow(run, ASK_TYPE)

    return _beside(blocks, answers, lambda block, table, bodies: pa.Table.from_batches([rows(block, question(table, bodies))]), ASK_TYPE)


def answer(asked: DataFrame, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], dtype: np.dtype, tasks: int) -> DataFrame:
    """Rows (part, block, body) for the blocks.

    ``reduce(part, block, keys)`` gets all keys of whole parts and gives
    (block, structured array) pairs as two arrays of one length.
    """

    def run(batches):
        part, block, bodies = [], [], []
        for b in batches:
            part.append(b["part"].to_numpy())
            block.append(b["block"].to_numpy())
            bodies += [x.as_py() for x in b["body"]]
        if not bodies:
            return
        sizes = np.array([len(x) // dtype.itemsize for x in bodies])
        keys = np.frombuffer(b"".join(bodies), dtype)
        del bodies
        to, found = reduce(np.repeat(np.concatenate(part), sizes), np.repeat(np.concatenate(block), sizes), keys)
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, found = to[order], found[order]
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        ends = np.r_[cut[1:], len(to)]
        for i in range(0, len(cut), 1000):
            c, e = cut[i : i + 1000], ends[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(c), np.int32)), pa.array(to[c]), pa.array([found[a:b].tobytes() for a, b in zip(c, e, strict=True)], pa.binary())], schema=ASK_ARROW)

    return asked.repartition(tasks, "part").mapInArrow(run, ASK_TYPE)


def answer_each(asked: DataFrame, reduce: Callable[[np.ndarray], np.ndarray], dtype: np.dtype, encode: Callable[[np.ndarray], bytes], tasks: int) -> DataFrame:
    """An answer (part, block, body) to each asked row, asked in sorted keys:
    ``reduce(keys)`` gives an answer for each key, in their order."""

    def run(batches):
        part, block, bodies = [], [], []
        for b in batches:
            part.append(b["part"].to_numpy())
            block.append(b["block"].to_numpy())
            bodies += [from_sorted(x.as_buffer(), dtype) for x in b["body"]]
        if not bodies:
            return
        part, block = np.concatenate(part), np.concatenate(block)
        sizes = np.array([len(x) for x in bodies])
        keys = np.concatenate(bodies)
        del bodies
        found = reduce(keys)
        del keys
        ends = np.cumsum(sizes)
        for i in range(0, len(part), 1000):
            e, n = ends[i : i + 1000], sizes[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part[i : i + 1000]), pa.array(block[i : i + 1000]), pa.array([encode(found[z - k : z]) for z, k in zip(e, n, strict=True)], pa.binary())], schema=ASK_ARROW)

    return asked.repartition(tasks, "part").mapInArrow(run, ASK_TYPE)


def _beside(blocks: DataFrame, answers: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """``fn(block, table, bodies)`` for each block with the bodies of all its
    answers; gives a table.  A task holds one block at a time."""
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        bodies = [x.as_py() for x in right["body"]]
        return fn(left["block"][0].as_py(), unpack(left["payload"][0].as_buffer()), bodies)

    return blocks.groupBy("block").cogroup(answers.select("block", "body").groupBy("block")).applyInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, list[bytes]], pa.Table], schema: T.StructType) -> DataFrame:
    """The rows ``fn(table, bodies)`` makes of each block and its answers."""

    return _beside(blocks, answers, lambda block, table, bodies: fn(table, bodies), schema)
