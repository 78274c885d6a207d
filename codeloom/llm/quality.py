"""Operator 4: quality rules with suffix-array repetition.

The words of a batch of whole texts get one suffix array, by prefix doubling
over the suffixes that are still tied; texts never share a prefix, as a word
counts with its text.  The ranks of each doubling (kept for the tied suffixes
only) give the longest common prefixes of neighbours.  The larger of a suffix's two neighbour values is the
value of its deepest LCP interval: the longest repeated substring that starts
there.  The spans of repeats of ``min_repeat`` words or more are united; the
share of words they cover and the longest of them are limited.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _SPACE, Words, _pieces, without, words_of

STEP_BYTES = 4 << 20


@dataclass(frozen=True)
class Rules:
    """Limits; the base rules first, then those of the suffix array."""

    min_words: int = 20
    base_window: int = 8
    max_base_percent: int = 30
    min_repeat: int = 5  # words of a repeat that counts
    max_covered: float = 0.4  # share of words in such repeats
    max_longest: int = 100  # words of the longest repeat


def longest_repeats(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run of words that starts there
    and also elsewhere in its text (runs may overlap)."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    key = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    begin = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(begin, np.diff(np.r_[begin, n]))
    tied = np.repeat(np.diff(np.r_[begin, n]) > 1, np.diff(np.r_[begin, n]))
    active = order[tied]
    ties = active  # all suffixes that shared a first word with another
    levels, step = [], 1
    while len(active):
        levels.append((step, active, rank[active].astype(np.int32 if n < 1 << 31 else np.int64)))
        after = np.where(active + step < end[active], rank[np.minimum(active + step, n)], -1)
        sort = np.lexsort((after, rank[active]))
        active, after = active[sort], after[sort]
        old = rank[active]
        group = np.r_[True, old[1:] != old[:-1]]
        new = group | np.r_[True, after[1:] != after[:-1]]
        place = np.arange(len(active))
        place -= np.maximum.accumulate(np.where(group, place, 0))  # within the old group
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(active)])
        rank[active] = old + np.repeat(place[starts], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    best = np.zeros(n, np.int64)
    if not levels:
        return best
    # Only ties can share a prefix with a neighbour; their ranks are final.
    suffix = ties[np.argsort(rank[ties])]
    x, y = suffix[:-1], suffix[1:]
    lcp = np.zeros(len(x), np.int64)
    for step, which, old in reversed(levels):
        rank[which] = old  # as it was then; the others were final
        a, b = np.minimum(x + lcp, n), np.minimum(y + lcp, n)
        lcp += np.where(rank[a] == rank[b], step, 0)
    best[suffix[:-1]] = lcp
    best[suffix[1:]] = np.maximum(best[suffix[1:]], lcp)
    return best


def covered(best: np.ndarray, at_least: int, width: int | None = None) -> np.ndarray:
    """Words in the union of the repeats of ``at_least`` words or more (of
    their first ``width`` words if given)."""
    at = np.flatnonzero(best >= at_least)
    edge = np.zeros(len(best) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (best[at] if width is None else width), -1)
    return np.cumsum(edge)[:-1] > 0


def _repeated_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][at])


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True

ADDED = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(), "covered_words": T.LongType(), "longest_repeat": T.LongType(), "n_repeats": T.LongType()}


def measure(text: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    words: Words = words_of(text)
    n = words.counts
    best = longest_repeats(words.coded()[0], words.first)
    base = _sums(covered(best, rules.base_window, rules.base_window), words.first)
    mine = _sums(covered(best, rules.min_repeat), words.first)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, words.owner, best)
    # A span that the span before it contains is no repeat of its own.
    inner = np.zeros(len(best), bool)
    inner[1:] = (best[:-1] > best[1:]) & (words.owner[1:] == words.owner[:-1])
    raw = words.data.tobytes()
    chars = ~_SPACE[words.data] & ((words.data & 0xC0) != 0x80)
    failed = (n < rules.min_words) | (100 * base > rules.max_base_percent * n)
    good = (mine <= rules.max_covered * n) & (longest <= rules.max_longest)
    return {
        "n_words": n,
        "word_chars": _sums(chars, words.text_at),
        "n_symbols": _sums(_SYMBOL[words.data], words.text_at),
        "n_dup_lines": np.array([_repeated_lines(raw[a:b]) for a, b in zip(words.text_at[:-1], words.text_at[1:], strict=True)], np.int64),
        "n_repeat_words": base,
        "base_failed": failed,
        "kept": ~failed & good,
        "covered_words": mine,
        "longest_repeat": longest,
        "n_repeats": _sums((best >= rules.min_repeat) & ~inner, words.first),
    }


def _judge(batches, text_col: str, rules: Rules, schema: pa.Schema):
    for batch in batches:
        for b in _pieces(batch, 4 * STEP_BYTES):
            found = measure(b[text_col], rules)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else b[f.name] for f in schema], schema=schema)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the measures of each whole text and the verdict kept.

    A null or empty text has no words and fails the base rules.  Every row is
    judged by itself, so order, ties and repeated rows don't matter.  Columns
    named like an added one give way; an empty table gives no rows.
    """
    docs = without(docs, *ADDED)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in ADDED.items()]])
    return docs.mapInArrow(partial(_judge, text_col=text_col, rules=rules, schema=to_arrow_schema(schema)), schema)
