"""Near-dedup at a similarity: operator 9's SimHash, each link verified, and an
exact set join of what it leaves apart.

Texts are alike if their sets of shingles have Jaccard similarity J >= s, at
any size of the corpus.  First come the links of SimHash: fingerprints of the
sets, met by multi-index hashing within two bits.  Each text is compared with
the first of its fingerprint, and that one with the first of the least
fingerprint near its own, so a group of any size has no more than two
comparisons a text.

Two bits of 64 find copies with few edits only (a pair at 0.8 differs in some
ten), so the set join looks for all other links, and passes over pairs whose
texts SimHash linked to one text.  Its candidates come from prefixes: with all
shingles in one order, two sets with J >= s share a shingle among the first
n - ceil(s n) + 1 of each.  The order is by how many texts have a shingle, so
passages that unrelated texts share, and what a family of copies shares, stay
out of the prefixes of all that have enough of their own.  It may be any order,
so the counts behind it may be rough: those of the ``KNOWN`` most frequent
shingles come last, all others by ``CELLS`` counts of shingles with equal bits.
The more texts there are, the more shingles share a count, but a prefix takes
the lowest fifth of its text's counts, and a shingle of d texts is hardly there
unless d is within some roots of the mean count.  Of the texts that meet at a shingle those go on
whose sizes and places in the order leave room for the similarity (at the first
shingle they share, true pairs always do).  Every candidate is verified on the
complete sets.

In a bucket of up to ``SMALL`` texts all pairs are candidates.  In a larger one
each text first meets its neighbour by size and the ``HUBS`` texts with the
fewest shingles before and the most after the bucket's: a text is in a frequent
bucket only if it has few shingles of its own, so those in the middle of a group
of copies are alike to all the others there.  Then all pairs that aren't in one
component yet are compared.

Two texts meet for good at the first shingle that they share.  What each has
before it sets them apart, and so do at least as many shingles after it as there
are bits in which the parities of the two rests differ (a shingle flips one of
64 bits).  Where that is more than the similarity allows, the pair is no
candidate; neither is it where the texts share the shingle before, too.

Equal sets are one text.  Texts stay in their blocks: what moves is an entry for
each shingle of a prefix, and for candidates the compressed text.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PARTS_PER_PARTITION, _pieces, ask, blocks_of, checkpointed, dealt_join, exchange_tasks, fair_share, from_planes, full_windows, hot_keys, lean, lower_hashes, mix64, release, squeezed, text_buffers, to_planes, unpack, unsqueezed, window_hash, with_answers, words_of
from .components import connected_components
from .simhash import fingerprint, links

SMALL, HUBS = 16, 4
#: Frequent shingles that a task tells, a merging task, and the order knows.
TOLD, MERGED, KNOWN = 4096, 16_384, 65_536
#: Counts of shingles, and the slices in which they are added up.
CELLS, SLICES = 1 << 22, 16
_MERGERS = 16
#: A quarter of this is what a worker compares at once, in compressed bytes.
PAIR_BYTES = 16 << 20
#: Pairs that a task makes at once.
PAIRS_AT_ONCE = 1 << 20
_ENTRY = np.dtype([("key", "<u4"), ("before", "<u4"), ("before_more", "<u2"), ("row", "<u4"), ("size", "<u4"), ("pos", "<u4"), ("tail", "<u8"), ("label", "<i8")])
_COUNT = np.dtype([("h", "<u8"), ("n", "<i8")])
_CELL = np.dtype([("n", "<u4")])
_LABEL = np.dtype([("row", "<i4"), ("label", "<i8")])
_TOP = np.uint64(1 << 63)


def _uid(block: int | np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number for a row of a block: 23 bits of partition, 20 of block, 20 of row."""
    return ((np.int64(block) >> 32) << 40) | ((np.int64(block) & 0xFFFFF) << 20) | row


def _place(uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and row of a number."""
    return ((uid >> 40) << 32) | ((uid >> 20) & 0xFFFFF), (uid & 0xFFFFF).astype("<i4")


def _sorted_each(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``x`` with each text's part in order."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        x[a:b].sort()
    return x


def shingle_sets(text: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of all texts (runs of ``width``
    words, A-Z in lower case; of fewer words, their whole sequence), in order
    in each text, and where each text's start."""
    words = words_of(text)
    codes, distinct = words.coded()
    h, counts = lower_hashes(distinct)[codes], words.counts
    at = np.flatnonzero(full_windows(words, width))
    each, owner = [window_hash(h, width, seed=width)[at]], [words.owner[at]]
    for n in range(1, width):
        few = np.flatnonzero(counts == n)
        if len(few):
            each.append(window_hash(h, n, seed=n)[words.first[few]])
            owner.append(few)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    first = np.searchsorted(owner, np.arange(len(counts) + 1))
    h = _sorted_each(np.concatenate(each)[order], first)
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.r_[0, np.cumsum(new)][first]


SIGNED = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("fp", T.LongType())])


def _signed(block: np.ndarray, row: np.ndarray, ids: pa.Array, sig: list[bytes], fps: list[int] | None = None) -> pa.RecordBatch:
    fp = pa.array(fps or [None] * len(sig), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(row, pa.int32()), ids, pa.array(sig, pa.binary()), fp], names=SIGNED.names)


def _sign(batches, id_col: str, text_col: str, words: int):
    """A digest and the SimHash of each row's set; and, with block -1, the
    shingles that most texts of the task have, with block -2 its counts, a
    slice a row."""
    held: list[np.ndarray] = []
    cells = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for k in range(batch.num_rows):
            block, table = batch["block"][k].as_py(), unpack(batch["payload"][k].as_buffer())
            n = table.num_rows
            if n > 1 << 20:
                raise ValueError(f"a block has {n} rows")
            h, first = shingle_sets(table[text_col], words)
            sets = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            sigs = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield _signed(np.full(n, block, np.int64), np.arange(n, dtype=np.int32), table[id_col].combine_chunks().cast(pa.int64()), sigs, [fingerprint(x) for x in sets])
            cells += np.bincount(_cell(h), minlength=CELLS).astype(np.uint32)
            h, n = np.unique(h, return_counts=True)
            now = np.zeros(int((n > 1).sum()), _COUNT)
            now["h"], now["n"] = h[n > 1], n[n > 1]
            held = [_most([*held, now], 4 * TOLD)]
    if held:
        yield _signed(np.array([-1]), np.array([0]), pa.array([None], pa.int64()), [_most(held, TOLD).tobytes()])
        slices = [squeezed(to_planes(x.view(_CELL))) for x in np.split(cells, SLICES)]
        yield _signed(np.full(SLICES, -2), np.arange(SLICES), pa.array([None] * SLICES, pa.int64()), slices)


def _cell(h: np.ndarray) -> np.ndarray:
    """The count that a shingle shares with others."""
    return (h % np.uint64(CELLS)).astype(np.int64)


def _most(counts: list[np.ndarray], most: int) -> np.ndarray:
    """The greatest sums of counts."""
    both = np.concatenate([np.zeros(0, _COUNT), *counts])
    h, place = np.unique(both["h"], return_inverse=True)
    out = np.zeros(len(h), _COUNT)
    out["h"], out["n"] = h, np.bincount(place, weights=both["n"], minlength=len(h))
    return out[np.argsort(-out["n"], kind="stable")[:most]]


def _merged(batches):
    held = np.zeros(0, _COUNT)
    for batch in batches:
        held = _most([held, *[np.frombuffer(x.as_buffer(), _COUNT) for x in batch["sig"]]], MERGED)
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["body"])


def frequent_shingles(signed: DataFrame) -> np.ndarray:
    """The most frequent shingles by hash, the rarest of them first."""
    body = T.StructType([T.StructField("body", T.BinaryType())])
    rows = signed.filter("block = -1").select("sig").repartition(_MERGERS).mapInArrow(lean(_merged), body).collect()
    return _most([np.frombuffer(bytes(r.body), _COUNT) for r in rows], KNOWN)["h"][::-1].copy()


def _added(batches):
    """The sums of whole slices, as ranks: exact to 127, then eight an octave."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, body in zip(batch["row"].to_pylist(), batch["sig"], strict=True):
            n = from_planes(unsqueezed(body.as_buffer()), _CELL)["n"].astype(np.int64)
            held[k] = held[k] + n if k in held else n
    for k, n in held.items():
        rank = np.where(n < 128, n, np.minimum(128 + 8 * np.log2(np.maximum(n, 128) / 128), 255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeezed(rank.tobytes())], pa.binary())], names=["row", "body"])


def rough_counts(signed: DataFrame) -> np.ndarray:
    """A rank for each cell: the higher, the more texts have its shingles."""
    body = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("body", T.BinaryType())])
    rows = signed.filter("block = -2").select("row", "sig").repartition(SLICES, "row").mapInArrow(lean(_added), body).collect()
    out = np.zeros((SLICES, CELLS // SLICES), np.uint8)
    for r in rows:
        out[r.row] = np.frombuffer(unsqueezed(bytes(r.body)), np.uint8)
    return out.reshape(-1)


def _shared(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Least number of common shingles of two sets with so many together."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-9)


def _in_order(h: np.ndarray, frequent: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
    """A number for each shingle that tells its place in the order: by the rank
    of its cell; the frequent ones last, by their place among them."""
    place = mix64(h) & ~_TOP
    if ranks is not None:
        place = ranks[_cell(h)].astype(np.uint64) << np.uint64(55) | place >> np.uint64(8)
    if len(frequent) and len(h):
        by_hash = np.argsort(frequent)
        at = by_hash[np.minimum(np.searchsorted(frequent, h, sorter=by_hash), len(frequent) - 1)]
        known = frequent[at] == h
        place[known] = _TOP | at[known].astype(np.uint64)
    return place


def _entries(table: pa.Table, bodies: list[bytes], text_col: str, words: int, similarity: float, frequent: np.ndarray, parts: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An entry for each shingle in the prefixes of the rows that the bodies
    name, with their labels."""
    named = np.sort(np.frombuffer(b"".join(bodies), _LABEL), order="row")
    h, first = shingle_sets(table[text_col].take(pa.array(named["row"])), words)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    place = _sorted_each(_in_order(h, frequent, ranks), first)
    pos = np.arange(len(h)) - np.repeat(first[:-1], size)
    prefix = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    keep = pos < prefix[owner]
    key = mix64(place)
    flips = np.r_[np.uint64(0), np.bitwise_xor.accumulate(np.uint64(1) << (key >> np.uint64(58)))]
    tail = (flips[:-1] ^ flips[first[1:]][owner])[keep]  # of the shingles from here on
    key, owner, pos = key[keep], owner[keep], pos[keep]
    out = np.zeros(len(key), _ENTRY)
    # The shingle before by 47 bits of its hash; 0: none.
    before = (np.r_[np.uint64(0), mix64(place[:-1]) | np.uint64(1)] if len(place) else place)[keep]
    before[pos == 0] = 0
    out["before"], out["before_more"] = before & np.uint64(0xFFFFFFFF), before >> np.uint64(32) & np.uint64(0xFFFF)
    out["key"], out["row"], out["size"], out["pos"], out["tail"], out["label"] = key & np.uint64(0xFFFFFFFF), named["row"][owner], size[owner], pos, tail, named["label"][owner]
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), out


def _to_planes(entries: np.ndarray) -> bytes:
    return squeezed(to_planes(entries))


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _meet(batches, similarity: float, rest: bool):
    """Candidates (a, b); (a, a) marks a text of a large bucket.  ``rest``: all
    pairs of the large buckets whose labels differ."""
    held, uids, parts = [], [], []
    for batch in batches:
        for part, block, body in zip(batch["part"].to_pylist(), batch["block"].to_pylist(), batch["body"], strict=True):
            e = from_planes(unsqueezed(body.as_buffer()), _ENTRY)
            held.append(e)
            uids.append(_uid(block, e["row"].astype(np.int64)))
            parts.append(np.full(len(e), part, np.int64))
    if not held:
        return
    e, uid = np.concatenate(held), np.concatenate(uids)
    key = np.concatenate(parts) << 32 | e["key"]
    del held, uids, parts
    order = np.lexsort((uid, e["size"], key))
    key, e, uid = key[order], e[order], uid[order]
    size, pos, label, tail = e["size"].astype(np.int64), e["pos"].astype(np.int64), e["label"], e["tail"]
    before = e["before"].astype(np.uint64) | e["before_more"].astype(np.uint64) << np.uint64(32)
    left = size - pos
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[begin, len(key)])
    total, first, end = np.repeat(counts, counts), np.repeat(begin, counts), np.repeat(begin + counts, counts)

    def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        met = (before[x] == before[y]) & (before[x] > 0)
        small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        ok = (uid[x] != uid[y]) & ~met & ((label[x] != label[y]) | (label[x] < 0)) & (small >= similarity * large - 1e-9)
        x, y = x[ok], y[ok]
        both, need = size[x] + size[y], _shared(size[x] + size[y], similarity)
        ok = np.minimum(left[x], left[y]) >= need
        ok &= pos[x] + pos[y] + np.bitwise_count(tail[x] ^ tail[y]) <= both - 2 * need
        a, b = uid[x[ok]], uid[y[ok]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)

    def rows(found: list[np.ndarray]):
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        for k in range(0, len(both), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[k : k + 100_000, 0]), pa.array(both[k : k + 100_000, 1])], names=["a", "b"])

    if rest:
        # Of each bucket, those without its most frequent label meet all others.
        big = np.flatnonzero(total > SMALL)
        order = np.lexsort((label[big], first[big]))
        group, place = first[big][order], label[big][order]
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])]) if len(big) else np.zeros(0, np.int64)
        run = np.diff(np.r_[new, len(big)])
        most = np.lexsort((-run, group[new])) if len(new) else new
        top = most[np.r_[True, group[new][most][1:] != group[new][most][:-1]]] if len(new) else new
        major = np.full(len(key), -1, np.int64)
        for g, m in zip(group[new][top].tolist(), place[new][top].tolist(), strict=True):
            major[g : end[g]] = m
        minor = label != major
        few = big[minor[big]]
        reach = np.cumsum(total[few])
        at = 0
        while at < len(few):
            upto = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS_AT_ONCE)))
            x = few[at:upto]
            n = total[x]
            y = np.repeat(first[x] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            x = np.repeat(x, n)
            once = ~minor[y] | (y > x)
            yield from rows([pairs(x[once], y[once])])
            at = upto
        return
    out, held_rows = [], 0
    # Texts with the one so many places after them, while the sizes allow it.
    x, step = np.flatnonzero((total > 1) & (total <= SMALL)), 1
    while len(x):
        x = x[x + step < end[x]]
        x = x[size[x] >= similarity * size[x + step] - 1e-9]
        out.append(pairs(x, x + step))
        held_rows, step = held_rows + len(out[-1]), step + 1
        if held_rows > PAIRS_AT_ONCE:
            yield from rows(out)
            out, held_rows = [], 0
    big = np.flatnonzero(total > SMALL)
    if len(big):
        near = big[big + 1 < end[big]]
        out.append(pairs(near, near + 1))
        central = np.lexsort((mix64(uid.astype(np.uint64)), size - 2 * left, key))
        out += [pairs(central[first[big] + k], big) for k in range(HUBS)]
        out.append(np.stack([uid[big], uid[big]], 1))
    yield from rows(out)


def _compare(batches, words: int, similarity: float):
    for batch in batches:
        for b in _pieces(batch, PAIR_BYTES):
            n, uid = b.num_rows, np.concatenate([b["a"].to_numpy(), b["b"].to_numpy()])
            _, at, of = np.unique(uid, return_index=True, return_inverse=True)
            texts = [unsqueezed((b["ta"][k] if k < n else b["tb"][k - n]).as_buffer()) for k in at.tolist()]
            h, first = shingle_sets(pa.array(texts, pa.large_binary()).view(pa.large_string()), words)
            sets, size = [h[i:j] for i, j in zip(first[:-1], first[1:], strict=True)], np.diff(first)
            need = _shared(size[of[:n]] + size[of[n:]], similarity)
            near = pa.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= k for x, y, k in zip(of[:n].tolist(), of[n:].tolist(), need.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b["a"].filter(near), b["b"].filter(near)], names=["a", "b"])


def _texts(table: pa.Table, bodies: list[bytes], text_col: str) -> pa.Table:
    """The texts that are asked for, by number; a set of hashes is far larger
    than the compressed text."""
    named = np.sort(np.frombuffer(b"".join(bodies), _LABEL), order="row")
    data, at = text_buffers(table[text_col].take(pa.array(named["row"])))
    raw = data.tobytes()
    return pa.table([pa.array(named["label"]), pa.array([squeezed(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["uid", "text"])


BODY = T.StructType([T.StructField("block", T.LongType()), T.StructField("body", T.BinaryType())])


def _bodies(block: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(block, kind="stable")
    block, rows = block[order], rows[order]
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(block)] if len(block) else cut
    return pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["block", "body"])


def _labelled(batches):
    """(uid, label) for the blocks."""
    for batch in batches:
        block, row = _place(batch["uid"].to_numpy())
        rows = np.zeros(len(row), _LABEL)
        rows["row"], rows["label"] = row, batch["label"].to_numpy()
        yield _bodies(block, rows)


def near_fingerprints(least: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: each row (uid, fp) with the first of its
    fingerprint, and that one with the first of the least fingerprint within
    two bits."""
    classes = checkpointed(least.groupBy("fp").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")))
    share = fair_share(classes.agg(F.sum("n")).first()[0] or 0, least.sparkSession)
    first = classes.select("fp", "first")
    same = dealt_join(least.select("uid", "fp"), first, ["fp"], hot_keys(classes, ["fp"], share)).select(F.col("first").alias("x"), F.col("uid").alias("y"))
    ways = links(classes.select("fp")).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way"))
    near = ways.groupBy(F.col("way.a").alias("fp")).agg(F.min("way.b").alias("other"))
    near = near.join(first, "fp").select(F.col("first").alias("x"), F.col("other").alias("fp")).join(first, "fp").select("x", F.col("first").alias("y"))
    pairs = checkpointed(same.unionByName(near).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    release(least.sparkSession, classes)
    return pairs


def _links(blocks: DataFrame, pairs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Those of the candidates that are alike, by their complete sets."""
    spark = blocks.sparkSession
    pairs = pairs.filter("a != b")
    uids = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    asked = uids.select("uid", F.col("uid").alias("label")).mapInArrow(lean(_labelled), BODY)
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("text", T.BinaryType())])
    texts = checkpointed(with_answers(blocks, asked, partial(_texts, text_col=text_col), schema))
    both, share = pairs, fair_share(pairs.count(), spark)
    for side in "ab":  # a hub is in many pairs
        hot = hot_keys(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")), [side], share)
        both = dealt_join(both, texts.select(F.col("uid").alias(side), F.col("text").alias("t" + side)), [side], hot)
    found = checkpointed(both.select("a", "b", "ta", "tb").mapInArrow(lean(partial(_compare, words=words, similarity=similarity)), PAIR))
    release(spark, texts)
    return found


def groups(blocks: DataFrame, least: DataFrame, frequent: np.ndarray, ranks: np.ndarray, text_col: str, words: int, similarity: float) -> DataFrame:
    """(node, root) numbers of the rows that are like another one; ``least``:
    the rows (uid, fp) that are compared."""
    tasks = exchange_tasks(blocks)
    make = partial(_entries, text_col=text_col, words=words, similarity=similarity, frequent=frequent, parts=PARTS_PER_PARTITION * tasks, ranks=ranks)

    def candidates(rows: DataFrame, rest: bool) -> DataFrame:
        asked = ask(blocks, make, rows.mapInArrow(lean(_labelled), BODY), _to_planes)
        return checkpointed(asked.repartition(tasks, "part").mapInArrow(lean(partial(_meet, similarity=similarity, rest=rest)), PAIR).distinct())

    near = near_fingerprints(least)
    known = _links(blocks, near, text_col, words, similarity)
    release(blocks.sparkSession, near)
    # Of each text the least that it is linked to: equal ones are of one component.
    ends = known.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("end"))
    ends = ends.groupBy(F.col("end.a").alias("uid")).agg(F.min("end.b").alias("other"))
    label = F.when(F.col("other").isNull(), -1).otherwise(F.least("uid", "other")).cast("long").alias("label")
    pairs = candidates(least.join(ends, "uid", "left").select("uid", label), False)
    roots = connected_components(known.unionByName(_links(blocks, pairs, text_col, words, similarity)))
    crowd = pairs.filter("a = b").select(F.col("a").alias("uid"))
    if crowd.isEmpty():
        return roots
    rest = candidates(crowd.join(roots, F.col("uid") == F.col("node"), "left").select("uid", F.coalesce("root", "uid").alias("label")), True)
    release(blocks.sparkSession, pairs)
    if rest.isEmpty():
        return roots
    more = _links(blocks, rest, text_col, words, similarity)
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _keep(table: pa.Table, bodies: list[bytes]) -> pa.Table:
    rows = np.sort(np.frombuffer(b"".join(bodies), "<i4"))
    return table.take(pa.array(rows))


def _kept(batches):
    for batch in batches:
        yield _bodies(batch["block"].to_numpy(), batch["row"].to_numpy().astype("<i4"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group of similar texts: that with the
    least id (nulls last; of equal ids, any one).

    Groups are components of texts whose sets of shingles of ``words`` words,
    A-Z in lower case, have this Jaccard similarity at least.  Texts without
    words, null ones too, are one group.  Of repeated rows one stays.  All
    columns stay as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pick = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "block", "row")).alias("best")
    blocks = blocks_of(docs)
    signed = checkpointed(blocks.mapInArrow(lean(partial(_sign, id_col=id_col, text_col=text_col, words=words)), SIGNED))
    # The least of equal sets first, so that a group of copies is one entry.
    uid = F.expr("(shiftright(best.block, 32) << 40) | ((best.block & 1048575L) << 20) | best.row").alias("uid")
    least = checkpointed(signed.filter("block >= 0").groupBy("sig").agg(pick, F.first("fp").alias("fp")).select("best.block", "best.row", "best.id", uid, "fp"))
    frequent, ranks = frequent_shingles(signed), rough_counts(signed)
    release(spark, signed)
    roots = groups(blocks, least.select("uid", "fp"), frequent, ranks, text_col, words, similarity)
    numbered = least.join(roots, F.col("uid") == F.col("node"), "left")
    best = numbered.groupBy(F.coalesce("root", "uid").alias("leader")).agg(pick).select("best.block", "best.row")
    return with_answers(blocks, best.mapInArrow(lean(_kept), BODY), _keep, docs.schema)
