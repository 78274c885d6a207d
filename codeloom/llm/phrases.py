"""Operator 12: collocations by hierarchical pair naming.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
words ``[^\\x20\\x09]+``.  A phrase of k words is named by a pair: the id of its
first k - 1 words and the id of its last k - 1 words.  Each level replaces the
occurrences of frequent (k - 1)-grams, which the blocks hold as their ids, by
the adjacent pairs of them:

    blocks --distinct pairs with counts--> parts of pairs: sums, ids of those
    that are frequent --ids, in the order asked--> blocks

A phrase is at most as frequent as any part of it, so no frequent phrase is
lost.  A block asks once for each distinct pair, however often it occurs, so a
pair in every document costs one entry for each block.  Ids follow from the
pairs' order in their part, so a lost task gives the same ids again.

The two ids of a pair stay as its parents.  Following them gives the counts of
all ways to cut a phrase, and a phrase's children tell whether a longer one
subsumes it: of the longer phrases around it, the most frequent is a child.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASK_ARROW, ASK_TYPE, BLOCK_BYTES, _pieces, checkpointed, dealt_join, fair_share, from_sorted, hot_keys, mix64, quoted, release, shuffle_partitions, squeezed, text_buffers, to_sorted, unsqueezed, words_of

#: Rows beside the messages to parts: a block's state, its counts of words by
#: language, the words it names, and the frequent pairs of a part.
STATE, TALLY, NAMES, PAIRS = -1, -2, -3, -4

_KEY = np.dtype([("h", "<u8"), ("g", "<u8"), ("n", "<u8")])
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_ENDS] = 0x20
_ONE = np.uint64(1)
#: Bytes of text for each part of the words and pairs, which are about as large
#: as the text; parts of small corpora, and parts that one task sums.
PART_BYTES = 8 << 20
LEAST_PARTS = 32
PARTS_OF_A_TASK = 2


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, block, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], schema=ASK_ARROW)


def _asked(block: int, part: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Messages with the keys, which are in the order of parts."""
    if not len(part):
        return []
    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    return [(int(part[a]), block, to_sorted(keys[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _keys(h: np.ndarray, g: np.ndarray, n: np.ndarray, part: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys by part and value, their parts, the order, and ``of`` (the key of
    each occurrence) in that order."""
    order = np.lexsort((g, h, part))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    keys = np.empty(len(order), _KEY)
    keys["h"], keys["g"], keys["n"] = h[order], g[order], n[order]
    return keys, part[order], order, rank[of]


def _pack(state: dict) -> bytes:
    return squeezed(pickle.dumps(state))


def pieces_of(text: pa.Array | pa.ChunkedArray):
    """Words of lower-cased texts, and whether the next one is in the same piece."""
    data, at = text_buffers(text)
    plain = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(_PLAIN[data])])
    words = words_of(plain)
    ends = np.cumsum(_ENDS[data], dtype=np.int64)[words.start] if len(words) else np.zeros(0, np.int64)
    owner = words.owner
    follows = np.zeros(len(words), bool)
    follows[:-1] = (ends[1:] == ends[:-1]) & (owner[1:] == owner[:-1])
    return words, owner, follows


def _first(batches, parts: int, block_bytes: int):
    """Blocks of texts: the state, counts by language, and messages by word."""
    base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        for piece in _pieces(batch, block_bytes):
            if held and size + piece.nbytes > block_bytes:
                yield _rows(_words_of_block(base + number, pa.Table.from_batches(held), parts))
                number, held, size = number + 1, [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield _rows(_words_of_block(base + number, pa.Table.from_batches(held), parts))


def _words_of_block(block: int, table: pa.Table, parts: int) -> list[tuple[int, int, bytes]]:
    words, owner, follows = pieces_of(table["text"])
    codes, distinct = words.coded()
    coded = table["lang"].combine_chunks().dictionary_encode()
    langs = coded.dictionary.to_pylist()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    each, of, n = np.unique(lang * max(1, len(distinct)) + codes, return_inverse=True, return_counts=True)
    lang_of, word_of = each // max(1, len(distinct)), each % max(1, len(distinct))
    heads = [len(x).to_bytes(4, "little") + x for x in (x.encode() for x in langs)]
    digests = [xxhash.xxh3_128_digest(heads[a] + distinct[b]) for a, b in zip(lang_of.tolist(), word_of.tolist(), strict=True)]
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    part = ((both[:, 0] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    keys, part, order, codes = _keys(both[:, 0], both[:, 1], n, part, of)
    state = {"codes": codes, "follows": np.packbits(follows), "langs": langs, "lang": lang_of[order].astype(np.int32), "words": [distinct[w] for w in word_of[order]]}
    tally = dict(zip(langs, np.bincount(lang, minlength=len(langs)).tolist(), strict=True))
    return [(STATE, block, _pack(state)), (TALLY, block, _pack(tally)), *_asked(block, part, keys)]


def _name(batches, least: int):
    """Sums over whole parts: an answer to each message, and the frequent pairs.
    An answer is twice the id, or 0, and one more for the block that names it."""
    part, block, bodies = [], [], []
    for b in batches:
        part.append(b["part"].to_numpy())
        block.append(b["block"].to_numpy())
        bodies += [from_sorted(x.as_buffer(), _KEY) for x in b["body"]]
    if not bodies:
        return
    part, block = np.concatenate(part), np.concatenate(block)
    sizes = np.array([len(x) for x in bodies])
    keys = np.concatenate(bodies)
    del bodies
    of_part, of_block = np.repeat(part, sizes), np.repeat(block, sizes)
    order = np.lexsort((keys["g"], keys["h"], of_part))
    h, g, p = keys["h"][order], keys["g"][order], of_part[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
    total = np.add.reduceat(keys["n"][order], new)
    often = total >= least
    # Numbered within the part, in the order of keys.
    upto = np.cumsum(often)
    begins = np.searchsorted(p[new], p[new], side="left")
    number = upto - 1 - (upto - often)[begins]
    ids = np.where(often, (p[new].astype(np.uint64) + _ONE) << np.uint64(32) | number.astype(np.uint64), np.uint64(0))
    namer = np.minimum.reduceat(of_block[order], new)
    length = np.diff(np.r_[new, len(order)])
    told = np.empty(len(order), np.uint64)
    told[order] = np.repeat(ids << _ONE, length) + ((np.repeat(namer, length) == of_block[order]) & np.repeat(often, length))
    ends = np.cumsum(sizes)
    for i in range(0, len(part), 1000):
        yield _rows([(int(a), int(b), squeezed(told[z - k : z].tobytes())) for a, b, k, z in zip(part[i : i + 1000], block[i : i + 1000], sizes[i : i + 1000], ends[i : i + 1000], strict=True)])
    found = [x[often].astype(np.int64) for x in (ids, h[new].view(np.int64), g[new].view(np.int64), total)]
    yield _rows([(PAIRS, int(part[0]), _pack({"rows": found}))])


def _next(state: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """A block's next level: its state, messages by pair, and at the first
    level the words that it names."""
    if not state.num_rows:
        return ASK_ARROW.empty_table()
    block, s = state["block"][0].as_py(), pickle.loads(unsqueezed(state["body"][0].as_buffer()))
    bodies = [answers["body"][k].as_buffer() for k in np.argsort(answers["part"].to_numpy(), kind="stable")]
    told = np.frombuffer(b"".join([unsqueezed(x) for x in bodies]), "<u8")
    out = []
    if "words" in s:
        at = np.flatnonzero(told & _ONE)
        out.append((NAMES, block, _pack({"ids": (told[at] >> _ONE).astype(np.int64), "words": [s["words"][k] for k in at], "langs": [s["langs"][k] for k in s["lang"][at]]})))
    ids = told >> _ONE
    codes, follows = s["codes"], np.unpackbits(s["follows"], count=len(s["codes"])).astype(bool)
    kept = np.flatnonzero(ids[codes] > 0) if len(codes) else np.zeros(0, np.int64)
    pair = np.flatnonzero(follows[kept[:-1]] & (kept[1:] == kept[:-1] + 1))
    if len(pair):
        code = codes[kept].astype(np.int64)
        each, of, n = np.unique(code[pair] * len(ids) + code[pair + 1], return_inverse=True, return_counts=True)
        left, right = ids[each // len(ids)], ids[each % len(ids)]
        part = (mix64(left * np.uint64(0x9E3779B97F4A7C15) + right) % np.uint64(parts)).astype(np.int64)
        keys, part, _, codes = _keys(left, right, n, part, of)
        follows = np.r_[pair[1:] == pair[:-1] + 1, False]
        out += [(STATE, block, _pack({"codes": codes, "follows": np.packbits(follows)})), *_asked(block, part, keys)]
    return pa.Table.from_batches([_rows(out)])


def _tallies(batches):
    for b in batches:
        rows = [x for body in b["body"] for x in pickle.loads(unsqueezed(body.as_buffer())).items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], names=["lang", "n"])


def _names(batches):
    for b in batches:
        for body in b["body"]:
            x = pickle.loads(unsqueezed(body.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(x["ids"]), pa.array(x["langs"], pa.string()), pa.array([w.decode() for w in x["words"]], pa.string())], names=["id", "lang", "word"])


def _pairs(batches):
    for b in batches:
        for body in b["body"]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pickle.loads(unsqueezed(body.as_buffer()))["rows"]], names=["id", "left", "right", "f"])


def _levels(docs: DataFrame, least: int, longest: int, block_bytes: int) -> list[DataFrame]:
    """The frequent phrases of each number of words: id, left and right (the
    parents), lang, n, phrase, last (its last word), f, and the counts of its
    proper beginnings (pre) and ends (suf) by their number of words."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    tasks = max(shuffle_partitions(spark), parts // PARTS_OF_A_TASK)
    now = checkpointed(docs.mapInArrow(partial(_first, parts=parts, block_bytes=block_bytes), ASK_TYPE))
    totals = checkpointed(now.filter(F.col("part") == TALLY).mapInArrow(_tallies, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
    out: list[DataFrame] = []
    for k in range(1, longest + 1):
        named = checkpointed(now.filter("part >= 0").repartition(tasks, "part").mapInArrow(partial(_name, least=least), ASK_TYPE))
        pairs = named.filter(F.col("part") == PAIRS).mapInArrow(_pairs, "id long, left long, right long, f long")
        before = now
        if k < longest:
            states, answers = now.filter(F.col("part") == STATE), named.filter("part >= 0")
            now = checkpointed(states.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(partial(_next, parts=parts), ASK_TYPE))
        if k == 1:
            words = (now if longest > 1 else before).filter(F.col("part") == NAMES).mapInArrow(_names, "id long, lang string, word string")
            level = checkpointed(pairs.select("id", "f").join(words, "id"))
            counts = level.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
            share = fair_share(counts.agg(F.sum("n")).first()[0] or 0, spark)
            level = dealt_join(level, totals, ["lang"], hot_keys(counts, ["lang"], share))
            none = F.array().cast("array<bigint>")
            level = level.select("id", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), "lang", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("pre"), none.alias("suf"))
        else:
            one = lambda side, *columns: out[-1].select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
            # A word that begins many phrases is split by the adaptive plan.
            level = pairs.join(one("left", "lang", "n", "phrase", "f", "pre"), "left").join(one("right", "last", "f", "suf"), "right")
            more = lambda side, c: F.concat(f"{side}_{c}", F.array(f"{side}_f")).alias(c)
            level = level.select("id", "left", "right", F.col("left_lang").alias("lang"), F.col("left_n").alias("n"), F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"), "f", more("left", "pre"), more("right", "suf"))
        out.append(checkpointed(level))
        release(spark, before, named)
    if longest > 1:
        release(spark, now)
    return out


def find_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, covered: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, cut): the phrases of 2 to
    ``longest`` words that occur at least ``least`` times among the documents of
    a language.

    a counts all occurrences within pieces, overlaps included; n all words of
    the language.  A cut after k words gives l and r, the counts of both sides,
    and the score floor(1000 a n / (l r)), by exact decimals of 38 digits; the
    lowest score counts, ties to the smallest cut.  A phrase goes if a longer
    one that holds it is frequent and has at least ``covered`` percent of its
    count.  A null language is ``und``, a null or empty text has no words.
    Repeated rows count each; other columns don't matter; an empty table gives
    no rows.
    """
    texts = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"), quoted(text_col).alias("text"))
    levels = _levels(texts, least, longest, block_bytes)
    found = []
    for k in range(2, longest + 1):
        level = levels[k - 1]
        if k < longest:
            above = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("more")).groupBy("id").agg(F.max("more").alias("more"))
            level = level.join(above, "id", "left").filter(f"more is null or 100 * more < {int(covered)} * f")
        number = lambda c: f"cast({c} as decimal(19, 0))"
        score = f"({number('f')} * {number('n')} * cast(1000 as decimal(4, 0))) div ({number('pre[i - 1]')} * {number(f'suf[{k} - i - 1]')})"
        best = f"array_min(transform(sequence(1, {k - 1}), i -> struct({score} as score, i as cut, pre[i - 1] as l, suf[{k} - i - 1] as r)))"
        found.append(level.withColumn("best", F.expr(best)).select("lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), "best.l", "best.r", "n", "best.score", "best.cut"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def best_phrases(found: DataFrame, count: int = 2000) -> DataFrame:
    """The first ``count`` phrases of each language by score, count and phrase,
    with rank (long, from 1).  Each task passes on its first ones only."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).withColumn("rank", F.col("rank").cast("long"))
