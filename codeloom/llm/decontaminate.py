"""Operator 5: benchmark decontamination by n-gram seeds and alignment.

Words are compared in lower case without anything but letters and digits.  The
limits of score and size tell how many pairs of neighbouring words an edited
copy has in common with an item at least (``least_hits``); items so long or
short that a leak need not have a pair are sought by their single words.  If a
leak has at least h of an item's p n-grams, it has at least s of any p - h + s
of them: the item's rarest ones are its seeds, its most frequent ones are none.
Where a document has s seeds of an item as near to each other as a leak allows,
the passage around them is aligned with the item (Smith-Waterman on words).  So
edits, insertions and left-out words lower the score but don't hide a copy.  A
passage has room on both sides for all the words that a leak can have beside
the item's; passages that overlap are aligned as one.

A place of a document is one hit for each item that has its n-gram as a seed,
however often either repeats it.  Hits are counted by item first, and made in
portions of items with a bounded number of them.

The benchmark is the query set: it is taken in blocks of bounded size, each of
which goes to all tasks and is held against all documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _pieces, mix64, quoted, window_hash, without, words_of

STEP_BYTES = 2 << 20
#: Bytes of benchmark text in a block that is sent to all tasks.
BLOCK_BYTES = 4 << 20
#: Words of windows that are aligned at once.
CELLS = 1 << 17
#: Places of seeds that are looked at at once.
HITS = 1 << 20
_NO_WORD = re.compile(r"[\W_]+")
_ASCII = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Match:
    """What counts as a leak."""

    width: int = 4  # words of an item at least
    similarity: float = 0.6  # score over the score of the unchanged item ...
    words: int = 30  # ... or a passage that scores like so many equal words
    equal: int = 2
    other: int = -1
    gap: int = -1


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes between two offsets: a sum of the bytes' codes
    times a random factor for each place, mixed; 0 for an empty one."""
    size = np.diff(at)
    if not len(data):
        return np.zeros(len(size), np.uint64)
    place = np.arange(1, len(data) + 1) - np.repeat(at[:-1], size)
    most = int(size.max())
    factor = mix64(np.arange(most + 1, dtype=np.uint64) + np.uint64(0x5EED)) | np.uint64(1)
    some = np.flatnonzero(size)
    out = np.zeros(len(size), np.uint64)
    out[some] = mix64(np.add.reduceat(_CODES[data] * factor[place], at[:-1][some])) | np.uint64(1)
    return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)


def plain_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's start.  Words
    of ASCII letters and other signs are cut down byte by byte; others, once
    for each distinct one."""
    words = words_of(text)
    kept = _ASCII[words.data]
    upto = np.r_[0, np.cumsum(kept)]
    at = np.r_[upto[words.start], upto[-1]] if len(words) else np.zeros(1, np.int64)
    h = _hashes(_FOLD[words.data[kept]], at)
    odd = np.r_[0, np.cumsum(words.data >= 128)]
    other = np.flatnonzero(odd[words.end] > odd[words.start])
    if len(other):
        raw = words.data.tobytes()
        coded = pa.array([raw[i:j] for i, j in zip(words.start[other].tolist(), words.end[other].tolist(), strict=True)], pa.binary()).dictionary_encode()
        plain = [_NO_WORD.sub("", w.decode("utf-8").lower()).encode("utf-8") for w in coded.dictionary.to_pylist()]
        h[other] = _hashes(*_joined(plain))[coded.indices.to_numpy()]
    keep = h != 0
    return h[keep], np.r_[0, np.cumsum(keep)][words.first]


def _grams(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the n-grams within texts."""
    grams = window_hash(h, width, seed=5)
    left = np.repeat(first[1:], np.diff(first))[: len(grams)] - np.arange(len(grams))
    at = np.flatnonzero(left >= width)
    return at, grams[at]


class Finder:
    """Which of many hashes are among a sorted few."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.low = np.zeros(1 << 20, bool)
        self.low[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h, and in known."""
        at = np.flatnonzero(self.low[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        to = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        ok = self.known[to] == h[at]
        return at[ok], to[ok]


def align(items: np.ndarray, windows: np.ndarray, m: Match) -> np.ndarray:
    """Best local score of each row's item and window (0: padding).

    Cells hold their score and what gaps from the window's start would cost, so
    that gaps along the window are a running maximum."""
    n, width = windows.shape
    kind = np.int16 if m.equal * items.shape[1] - m.gap * (width + 1) < 32_000 else np.int32
    ramp = (np.arange(width + 1) * -m.gap).astype(kind)
    row, best = np.tile(ramp, (n, 1)), np.tile(ramp, (n, 1))
    new, step = np.empty_like(row), np.empty((n, width), kind)
    # A word that isn't the item's, and the way to the next place.
    other, more = kind(m.other - m.gap), kind(m.equal - m.other)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        np.multiply((windows == word) & (word != 0), more, out=step)
        step += other
        np.add(row[:, :-1], step, out=new[:, 1:])
        new[:, 0] = 0
        np.add(row, kind(m.gap), out=row)
        np.maximum(new, row, out=new)
        np.maximum(new, ramp, out=new)
        np.maximum.accumulate(new, axis=1, out=row)
        np.maximum(best, row, out=best)
    return (best - ramp).max(1).astype(np.int64)


def equal_words(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """How many words of each row's item are in its window, at any place."""
    found = np.zeros(len(items), np.int64)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        found += ((windows == word) & (word != 0)).any(1)
    return found


@dataclass
class Seeds:
    """A block of the benchmark."""

    ids: list[int | None]
    words: Finder  # of all items
    items: list[np.ndarray]  # the items, as places in these, from 1
    need: np.ndarray  # seeds of each item that a leak has at least
    widths: list[int]  # of the seeds
    grams: Finder  # all seeds
    item: np.ndarray  # of each item's seeds: the item, ascending,
    gram: np.ndarray  # and the place in grams


def least_score(sizes: np.ndarray, m: Match) -> np.ndarray:
    """Of a leak, for items of these sizes."""
    return np.ceil(np.minimum(m.similarity * m.equal * sizes, m.equal * m.words) - 1e-9).astype(np.int64)


def least_hits(sizes: np.ndarray, m: Match) -> tuple[np.ndarray, np.ndarray]:
    """Whether a leak must have pairs of neighbouring words in common with an
    item of such a size, and how many: or else, how many words.

    With k equal words a leak has at most e = (equal k - least) / cost errors,
    which leave k - 1 - e pairs of equal neighbours.  That is linear in k."""
    least, cost = least_score(sizes, m), min(-m.other, -m.gap)
    few = -(-least // m.equal)
    pairs = np.minimum(*(k - 1 - (m.equal * k - least) // cost for k in (few, np.maximum(sizes, few))))
    return pairs > 0, np.where(pairs > 0, pairs, few)


def hits_of(h: np.ndarray, first: np.ndarray, seeds: Seeds):
    """Items and the places of their seeds in the texts, by both: a portion of
    items at a time, with about ``HITS`` hits, or one item's."""
    found = []
    for width in seeds.widths:
        at, g = _grams(h, first, width)
        hit, to = seeds.grams(g)
        found.append((at[hit], to))
    place, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    often = np.bincount(gram, minlength=len(seeds.grams.known))
    by_gram, begin = place[np.argsort(gram, kind="stable")], np.cumsum(often) - often
    n = often[seeds.gram]
    total = np.bincount(seeds.item, weights=n, minlength=len(seeds.items)).astype(np.int64)
    todo = np.flatnonzero((n > 0) & (total >= seeds.need)[seeds.item])
    upto = np.cumsum(n[todo])
    at = 0
    while at < len(todo):
        # Whole items: to the one with which the portion is full.
        last = seeds.item[todo[min(int(np.searchsorted(upto, upto[at] + HITS)), len(todo) - 1)]]
        end = int(np.searchsorted(seeds.item[todo], last, side="left"))
        end = end if end > at else int(np.searchsorted(seeds.item[todo], last, side="right"))
        part = todo[at:end]
        size = n[part]
        pick = np.repeat(begin[seeds.gram[part]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key = np.sort(np.repeat(seeds.item[part], size) * (len(h) + 1) + by_gram[pick])
        yield key // (len(h) + 1), key % (len(h) + 1)
        at = end


def windows_of(item: np.ndarray, place: np.ndarray, first: np.ndarray, need: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Rows (item, doc, start, stop): where as many seeds as an item needs lie
    within its span, all that a leak with them can cover."""
    to = np.arange(len(item)) + need[item] - 1
    inside = to < len(item)
    to = np.minimum(to, len(item) - 1)
    at = np.flatnonzero(inside & (item[to] == item) & (place[to] - place <= span[item]))
    to, item = place[to[at]], item[at]
    doc = np.searchsorted(first, place[at], side="right") - 1
    rows = np.stack([item, doc, np.maximum(to - span[item], first[doc]), np.minimum(place[at] + span[item] + 2, first[doc + 1])], 1)
    return _merged(rows[to < first[doc + 1]])


def _merged(rows: np.ndarray) -> np.ndarray:
    """Windows by item, document and start, those that overlap as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Windows of one item and document begin and end in one order.
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1) | (rows[1:, 2] > rows[:-1, 3])]
    begin = np.flatnonzero(new)
    out = rows[begin]
    out[:, 3] = rows[np.r_[begin[1:], len(rows)] - 1, 3]
    return out


def _portions(todo: np.ndarray, sizes: np.ndarray):
    """Rows of ``todo`` with items about as long (to a power of two) and windows
    alike, so that little is padding: as many as have ``CELLS`` words."""
    kind = np.ceil(np.log2(sizes[todo[:, 0]])).astype(np.int64)
    span = todo[:, 3] - todo[:, 2]
    order = np.lexsort((span, kind))
    todo, kind, span = todo[order], kind[order], span[order]
    k = 0
    while k < len(todo):
        upto = int(np.searchsorted(kind, kind[k], side="right"))
        words = np.maximum(span[k:upto], 1 << int(kind[k])) * np.arange(1, upto - k + 1)
        n = max(1, int(np.searchsorted(words, CELLS)))
        yield todo[k : k + n]
        k += n


def _judge(todo: np.ndarray, code: np.ndarray, seeds: Seeds, sizes: np.ndarray, m: Match):
    """Document, item and similarity of each window that leaks; code: the word
    at each place, with 0 at the end."""
    least = least_score(sizes, m)
    for part in _portions(todo, sizes):
        t, d, start, stop = part.T
        cols = start[:, None] + np.arange(int((stop - start).max()))
        windows = code[np.where(cols < stop[:, None], cols, len(code) - 1)]
        items = np.zeros((len(part), int(sizes[t].max())), code.dtype)
        for r, x in enumerate(t):
            items[r, : sizes[x]] = seeds.items[x]
        # No alignment has more equal words than the window has of the item's.
        able = m.equal * equal_words(items, windows) >= least[t]
        d, t, items, windows = d[able], t[able], items[able], windows[able]
        if len(d):
            score = align(items, windows, m)
            for r in np.flatnonzero((score >= m.similarity * m.equal * sizes[t]) | (score >= m.equal * m.words)):
                yield int(d[r]), int(t[r]), float(score[r]) / (m.equal * sizes[t[r]])


def _leaks(batches, text_col: str, seeds: Seeds, m: Match, schema: pa.Schema):
    sizes = np.array([len(w) for w in seeds.items], np.int64)
    kind = np.uint16 if len(seeds.words.known) < 65_535 else np.uint32
    # Words of a passage that leaks, with those that it has beside the item's.
    span = sizes + np.maximum(0, (m.equal * sizes - least_score(sizes, m)) // -m.gap)
    for batch in batches:
        for b in _pieces(batch, 4 * STEP_BYTES):
            h, first = plain_words(b[text_col])
            code, (at, to) = np.zeros(len(h) + 1, kind), seeds.words(h)
            code[at] = to + 1
            found: dict[tuple[int, int], float] = {}
            for item, place in hits_of(h, first, seeds):
                for d, t, share in _judge(windows_of(item, place, first, seeds.need, span), code, seeds, sizes, m):
                    found[d, t] = max(found.get((d, t), 0.0), share)
            old = b["leaks"].to_pylist()
            for (d, t), share in sorted(found.items()):
                old[d] = [*(old[d] or []), {"item_id": seeds.ids[t], "similarity": share}]
            yield pa.RecordBatch.from_arrays([pa.array(old, f.type) if f.name == "leaks" else b[f.name] for f in schema], schema=schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", match: Match = Match()) -> DataFrame:
    """``docs`` with leaks: an array of (item_id, similarity), empty for a clean
    document; similarity is the alignment's score over that of the whole item.

    Null texts on either side and items of fewer than four words match
    nothing.  Items alike are found each; a null item id stays null.  Repeated
    rows are judged alike.  A column of ``docs`` named leaks gives way.  With
    an empty benchmark all documents are clean.
    """
    leak = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())]))
    out = without(docs, "leaks")
    schema = T.StructType([*out.schema.fields, T.StructField("leaks", leak)])
    out = out.withColumn("leaks", F.array().cast(leak))
    arrow = to_arrow_schema(schema)
    items = benchmark.select(quoted(item_col).cast("long").alias("id"), quoted(item_text).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).orderBy("id", "text").toArrow()
        seeds = seeds_of(block, match)
        if seeds is not None:
            out = out.mapInArrow(partial(_leaks, text_col=text_col, seeds=seeds, m=match, schema=arrow), schema)
    return out


def seeds_of(block: pa.Table, match: Match) -> Seeds | None:
    """The rarest n-grams of each item, by how often the block has them: as many
    as make sure that a leak has a third of what it has of all of them."""
    h, first = plain_words(block["text"])
    sizes = np.diff(first)
    pairs, least = least_hits(sizes, match)
    # Where a leak has a few pairs only, single words say more.
    pairs &= least >= 6
    least = np.where(pairs, least, -(-least_score(sizes, match) // match.equal))
    need = np.maximum(np.where(least >= 4, 2, 1), least // 3)
    chosen = []
    for width in (1, 2):
        at, g = _grams(h, first, width)
        item = np.searchsorted(first, at, side="right") - 1
        own = np.flatnonzero((sizes[item] >= match.width) & (pairs[item] == (width == 2)))
        if len(own):
            g, item = g[own], item[own]
            _, of, n = np.unique(g, return_inverse=True, return_counts=True)
            order = np.lexsort((g, n[of], item))
            g, item = g[order], item[order]
            rank = np.arange(len(g)) - np.searchsorted(item, item, side="left")
            kept = rank < (sizes - width + 1 - least + need)[item]
            chosen.append((width, item[kept], g[kept]))
    if not chosen:
        return None
    item, g = np.concatenate([x[1] for x in chosen]), np.concatenate([x[2] for x in chosen])
    known, gram = np.unique(g, return_inverse=True)
    both = np.unique(item * len(known) + gram)
    words, code = np.unique(h, return_inverse=True)
    items = [code[a:b] + 1 for a, b in zip(first[:-1], first[1:], strict=True)]
    return Seeds(block["id"].to_pylist(), Finder(words), items, need, [x[0] for x in chosen], Finder(known), both // len(known), both % len(known))
