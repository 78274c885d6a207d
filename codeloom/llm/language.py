"""Operator 10: language ID by error-correcting output codes.

Each language has a codeword; each of its bits is predicted by a binary
classifier over hashed letter trigrams.  A classifier weighs a trigram by the
logarithm of how much more likely it is in the languages whose bit is 1 (each
language counts alike) than in the others.  Decoding adds up, for each
codeword, the logistic losses of its bits, weighted by how well each
classifier parts its two sides; the codeword with the least loss wins, and a
second one close by flags ambiguity.

Trigram counts come from all labelled rows and stay in Spark as rows (language,
trigram, count): a classifier's two sides are sums over them by trigram, its
trust one over languages.  What the driver gets are ``FEATURES`` numbers for
each classifier, of which there are some ten for each doubling of the
languages, and the languages' names and codewords; any number of languages will
do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _pieces, checkpointed, quoted, text_buffers, without

FEATURES = 1 << 15
#: Languages whose losses are held at once.
CODES_AT_ONCE = 1024
STEP_BYTES = 1 << 20
#: Trigrams that a margin counts for at most, and the gap of two losses below
#: which a text is ambiguous.
EVIDENCE, CLOSE = 24, 0.5

# A-Z lower-cased; other ASCII than letters is a space; other bytes stay.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashed trigram around each byte; a text has spaces around it, and
    three spaces are no trigram (-1)."""
    n = len(data)
    here = _FOLD[data].astype(np.uint32)
    before, after = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    before[1:], after[:-1] = here[:-1], here[1:]
    begins, ends = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    before[begins], after[ends] = 32, 32
    gram = before | (here << 8) | (after << 16)
    code = ((gram * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    code[gram == 0x202020] = -1
    return code


def _count(batches, text_col: str, lang_col: str):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for b in _pieces(batch, 4 * STEP_BYTES):
            data, at = text_buffers(b[text_col])
            code, langs = trigrams(data, at), b[lang_col].to_pylist()
            kinds = {x: k for k, x in enumerate(sorted(set(langs)))}
            row = np.repeat(np.array([kinds[x] for x in langs], np.int64), np.diff(at))
            good = code >= 0
            got = np.bincount(row[good] * FEATURES + code[good], minlength=len(kinds) * FEATURES).reshape(-1, FEATURES)
            for x, k in kinds.items():
                counts[x] = counts.get(x, 0) + got[k]
    for x, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["lang", "h", "n"])


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # bits x FEATURES
    trust: np.ndarray  # of each bit


def codewords(k: int) -> np.ndarray:
    """Codewords of k languages: all ways to part up to seven in two; for more,
    random bits from a fixed seed, ten for each doubling of k."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 7:
        bits = [[1] + [1 if (c >> j) & 1 else -1 for j in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(10)
    while True:
        code = rng.choice(np.array([-1, 1], np.int8), (k, int(np.ceil(10 * np.log2(k)))))
        mixed = (abs(code.sum(0)) < k).all()
        if mixed and len(np.unique(code, axis=0)) == k:
            return code


SIDES = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("up", T.ArrayType(T.DoubleType())), T.StructField("every", T.DoubleType())])
HEIGHTS = T.StructType([T.StructField("least", T.ArrayType(T.DoubleType()))])


def _sides(batches, code: np.ndarray):
    """For each trigram of the task: the languages' shares of it, summed over
    those whose bit is 1 for each bit, and over all."""
    up, every = np.zeros((FEATURES, code.shape[1])), np.zeros(FEATURES)
    for b in batches:
        h, share, place = (b[c].to_numpy() for c in ("h", "share", "place"))
        for bit in range(code.shape[1]):
            up[:, bit] += np.bincount(h, weights=share * (code[place, bit] > 0), minlength=FEATURES)
        every += np.bincount(h, weights=share, minlength=FEATURES)
    at = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(up[at]), pa.list_(pa.float64())), pa.array(every[at])], schema=to_arrow_schema(SIDES))


def _heights(batches, code: np.ndarray, weights: np.ndarray, flat: np.ndarray):
    """How far on its side the least language of the task lies, for each bit;
    ``flat``: of each language, what its unseen trigrams share."""
    sums: dict[int, np.ndarray] = {}
    whole = weights.sum(1)
    for b in batches:
        h, share, place = (b[c].to_numpy() for c in ("h", "share", "place"))
        for k in np.unique(place):
            own = place == k
            sums[k] = sums.get(k, 0) + weights[:, h[own]] @ share[own]
    if sums:
        least = np.min([code[k] * (flat[k] * whole + x) for k, x in sums.items()], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([least.tolist()], pa.list_(pa.float64()))], schema=to_arrow_schema(HEIGHTS))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams of all rows with a language and a text, and weigh them.
    A language whose texts have no trigram isn't learned."""
    labelled = rows.select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).filter("lang is not null and text is not null")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("n", T.LongType())])
    counts = checkpointed(labelled.mapInArrow(partial(_count, text_col="text", lang_col="lang"), schema).groupBy("lang", "h").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = dict(totals.toArrow().select(["lang", "total"]).to_pandas().itertuples(index=False, name=None))
    langs = sorted(sizes)
    code = codewords(len(langs))
    if not code.shape[1]:
        return Model(langs, code, np.zeros((0, FEATURES), np.float32), np.zeros(0))
    # A share is (n + 0.5) / (total + 0.5 FEATURES): a flat part, and n's.
    whole = np.array([sizes[x] for x in langs]) + 0.5 * FEATURES
    place = rows.sparkSession.createDataFrame(pa.table({"lang": langs, "place": np.arange(len(langs)), "whole": whole}))
    shares = checkpointed(counts.join(place, "lang").select("h", "place", (F.col("n") / F.col("whole")).alias("share")))
    sides = shares.repartition("h").mapInArrow(partial(_sides, code=code), SIDES).toArrow()
    up, every = np.zeros((FEATURES, code.shape[1])), np.zeros(FEATURES)
    at = sides["h"].to_numpy()
    up[at], every[at] = np.array(sides["up"].to_pylist()).reshape(-1, code.shape[1]), sides["every"].to_numpy()
    ones, flat = (code > 0).sum(0), 0.5 / whole
    up_mean = (up + flat @ (code > 0)) / ones
    down_mean = (every[:, None] - up + flat @ (code < 0)) / (len(langs) - ones)
    weights = np.log(up_mean / down_mean).T
    heights = shares.repartition("place").mapInArrow(partial(_heights, code=code, weights=weights, flat=flat), HEIGHTS)
    least = heights.select(*[F.min(F.col("least")[k]) for k in range(code.shape[1])]).first()
    trust = np.maximum(np.array(list(least), float), 1e-3)
    return Model(langs, code, weights.astype(np.float32), trust / trust.sum())


def _decoded(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language with the least loss for each row of margins, its chance,
    and how much more the next one loses; a portion of codewords at a time."""
    right, wrong = np.logaddexp(0, -margin) * model.trust, np.logaddexp(0, margin) * model.trust
    best, least, second = np.zeros(len(margin), np.int64), np.full(len(margin), np.inf), np.full(len(margin), np.inf)
    others = np.zeros(len(margin))  # sum of exp(least - loss)
    for k in range(0, len(model.langs), CODES_AT_ONCE):
        ones = (model.code[k : k + CODES_AT_ONCE] > 0).astype(float)
        loss = wrong.sum(1, keepdims=True) + (right - wrong) @ ones.T
        two = np.sort(loss, 1)[:, :2]
        now, at = two[:, 0], loss.argmin(1)
        lower = np.minimum(least, now)
        others = others * np.exp(lower - least) + np.exp(lower[:, None] - loss).sum(1)
        second = np.sort(np.stack([least, second, *two.T], 1), 1)[:, 1]
        best = np.where(now < least, k + at, best)
        least = lower
    return best, 1 / others, second - least


def _predict(batches, model: Model, text_col: str, schema: pa.Schema):
    for batch in batches:
        for b in _pieces(batch, 4 * STEP_BYTES):
            text = b[text_col]
            data, at = text_buffers(text)
            code = trigrams(data, at)
            good = code >= 0
            code = np.where(good, code, 0)
            n = np.diff(np.r_[0, np.cumsum(good)][at])
            margin = np.zeros((b.num_rows, len(model.weights)))
            for k, w in enumerate(model.weights):
                margin[:, k] = np.diff(np.r_[0.0, np.cumsum(np.where(good, w[code], 0), dtype=np.float64)][at]) / np.maximum(n, 1)
            margin *= np.minimum(n, EVIDENCE)[:, None]
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score, close = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if model.langs:
                best, chance, gap = _decoded(margin, model)
                score = np.where(letters, chance, 0.0)
                close = ~letters | (gap < CLOSE)
                pred = [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
            made = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(close)}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b[f.name] for f in schema], schema=schema)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous, from whole texts
    alone.  A text that is null or has no letter is ``und`` with score 0, and
    so is every text if nothing was learned.  Columns named like an added one
    give way; an empty table gives no rows."""
    docs = without(docs, "lang_pred", "score", "ambiguous")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(partial(_predict, model=model, text_col=text_col, schema=to_arrow_schema(schema)), schema)
