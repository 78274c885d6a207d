"""Fuzzy symbol search.

The tiers of the score that are plain string tests are column expressions.
Only rows that none of the earlier tiers settles go to Python, in Arrow
batches, for word tokens and Jaro-Winkler; the two parts are united.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim

# Fixed values.
TOKEN_SIMILARITY, NAME_SIMILARITY, WINKLER_FROM, WINKLER_STEP = 0.82, 0.80, 0.7, 0.1
_SEPARATORS = set("_-./\\:")


def tokenize(name: str) -> list[str]:
    """Lower-case words of an identifier.  A capital starts a word after a
    small letter, or before one if the word so far has over one byte."""
    out, word = [], ""
    for k, c in enumerate(name):
        if c in _SEPARATORS or c.isspace():
            if word:
                out.append(word)
            word = ""
            continue
        if c.isupper() and word:
            after = name[k + 1 : k + 2]
            if name[k - 1].islower() or (after.islower() and len(word.encode()) > 1):
                out.append(word)
                word = ""
        word += c.lower()
    return [*out, word] if word else out


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken, strict=True) if t), strict=True))
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    if j < WINKLER_FROM:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * WINKLER_STEP * (1 - j)


def token_score(query: str, name: str) -> int | None:
    """90 if every word of the query has a like one in the name; a share of 80
    if that is 50 at least; else none."""
    q, s = tokenize(query), tokenize(name)
    if not q or not s:
        return None
    hits = sum(any(x == t or x.startswith(t) or t.startswith(x) or jaro_winkler(t, x) >= TOKEN_SIMILARITY for x in s) for t in q)
    if hits == len(q):
        return 90
    score = math.floor(80 * hits / len(q))
    return score if hits and score >= 50 else None


def match_score(query: str, name: str, path: str = "", doc: str | None = None) -> int:
    """The whole score for one pair; the table operator gives the same."""
    q, s = query.strip().lower(), name.strip().lower()
    if q == s:
        return 100
    if s.startswith(q):
        return 95
    if q in s:
        return 85
    if s in q:
        return 80
    by_token = token_score(query, name)
    if by_token is not None:
        return by_token
    near = jaro_winkler(q, s)
    if near >= NAME_SIMILARITY:
        return math.floor(85 * near)
    if doc and q in doc.lower():
        return 70
    return 50 if q in path.lower() else 0


def _plain(query: Column, name: Column) -> Column:
    q, s = F.lower(trim(query)), F.lower(trim(name))
    return F.when(q == s, 100).when(F.startswith(s, q), 95).when(F.contains(s, q), 85).when(F.contains(q, s), 80)


def _fallback(query: Column, path: Column, doc: Column) -> Column:
    q = F.lower(trim(query))
    return F.when(F.contains(F.lower(F.coalesce(doc, F.lit(""))), q), 70).when(F.contains(F.lower(F.coalesce(path, F.lit(""))), q), 50).otherwise(0)


@F.pandas_udf(T.IntegerType())
def _similar(query: pd.Series, name: pd.Series) -> pd.Series:
    def one(q: str, s: str) -> int | None:
        by_token = token_score(q, s)
        if by_token is not None:
            return by_token
        near = jaro_winkler(q.strip().lower(), s.strip().lower())
        return math.floor(85 * near) if near >= NAME_SIMILARITY else None

    # Names repeat: each pair is scored once in a batch.
    pairs = pd.DataFrame({"q": query, "s": name}).fillna("")
    few = pairs.drop_duplicates()
    few = few.assign(v=[one(q, s) for q, s in zip(few.q, few.s, strict=True)])
    return pairs.merge(few, on=["q", "s"], how="left").v.astype("Int32")


def scored(symbols: DataFrame, queries: list[str], similar: bool = True) -> DataFrame:
    """(query, id, symbol_name, file_path, score) of all pairs over 0.

    The queries are a short list of literals.  ``similar`` off leaves out the
    tiers that need Python.
    """
    pairs = symbols.select("id", "symbol_name", "file_path", "docstring", F.explode(F.array(*[F.lit(q) for q in queries])).alias("query"))
    first = pairs.withColumn("score", _plain(F.col("query"), F.col("symbol_name")))
    last = _fallback(F.col("query"), F.col("file_path"), F.col("docstring"))
    done = first.filter("score is not null")
    rest = first.filter("score is null").withColumn("score", F.coalesce(_similar("query", "symbol_name"), last) if similar else last)
    return done.unionByName(rest).filter("score > 0").select("query", "id", "symbol_name", "file_path", "score")


def top_k(matches: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of each query, ties by id.  Spark keeps only so many
    rows of a query in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return matches.withColumn("rank", rank).filter(F.col("rank") <= limit)


def resolve(symbols: DataFrame, queries: list[str]) -> DataFrame:
    """The one symbol that a free text names: exact, then name holds query,
    then query holds name, then path holds query."""
    pairs = symbols.select("id", "symbol_name", "file_path", F.explode(F.array(*[F.lit(q) for q in queries])).alias("query"))
    q, s = F.lower(trim(F.col("query"))), F.lower(F.col("symbol_name"))
    score = F.when(s == q, 100).when(F.contains(s, q), 80).when(F.contains(q, s), 60).when(F.contains(F.lower("file_path"), q), 40)
    best = pairs.withColumn("score", score).filter("score is not null").groupBy("query").agg(F.max(F.struct("score", (-F.col("id")).alias("_o"), "symbol_name", "file_path")).alias("r"))
    return best.select("query", F.col("r.symbol_name").alias("symbol_name"), F.col("r.file_path").alias("file_path"), F.col("r.score").alias("score"))


def filtered(symbols: DataFrame, text: str, limit: int = 30) -> DataFrame:
    """Names or files that hold the text; all for a blank one."""
    q = text.strip().lower()
    kept = symbols if not q else symbols.filter(F.contains(F.lower("symbol_name"), F.lit(q)) | F.contains(F.lower("file_path"), F.lit(q)))
    return kept.orderBy("id").limit(limit)


def spiral(hits: DataFrame, order: list, limit: int = 1000) -> DataFrame:
    """Places on a spiral by rank, of so many hits at most as a picture takes."""
    hits = hits.orderBy(*order).limit(limit)
    i = F.row_number().over(Window.partitionBy().orderBy(*order)) - 1
    angle, radius = F.pmod(i * 0.4, F.lit(2 * math.pi)), 120 + i * 4.0
    return hits.withColumn("place", i).withColumn("x", 400 + F.cos(angle) * radius).withColumn("y", 260 + F.sin(angle) * radius)


def named_in(questions: DataFrame, names: list[str]) -> DataFrame:
    """The first of the names that a question mentions, else the first."""
    hit = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower("question"), F.lower(n)))
    return questions.withColumn("symbol", F.coalesce(F.get(hit, F.lit(0)), F.lit(names[0])))


#: Characters of the grams by which texts that hold others are found: of short
#: words, and of all from the greater length on.
GRAM, LONG_GRAM = 3, 6

#: The first names, which are tried without a join.
SOON = 64


#: Portions of the words that one text may hold: each takes the text along.
PORTIONS = 16


def _word_grams(word: Column) -> Column:
    """The distinct grams of a word; a shorter one is its own."""
    size = F.when(F.char_length(word) < LONG_GRAM, GRAM).otherwise(LONG_GRAM)
    each = F.transform(F.sequence(F.lit(1), F.char_length(word) - size + 1), lambda i: F.substring(word, i, size))
    return F.when(F.char_length(word) < GRAM, F.array(word)).otherwise(F.array_distinct(each))


def _text_grams(batches):
    """(key, gram): the distinct grams of each text, and its shorter ones."""
    for batch in batches:
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            grams = list({text[i : i + n] for n in (*range(1, GRAM + 1), LONG_GRAM) for i in range(len(text) - n + 1)})
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(grams), pa.string()), pa.array(grams, pa.string())], names=["key", "gram"])


def holding(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(key, word): which of the distinct ``words`` (word) each of the distinct
    ``texts`` (key, text) holds.  A blank word or text is passed over.

    A text that holds a word holds each gram of it.  So a word waits under the
    one of its grams that the fewest words have, texts come by with all their
    grams, and what meets is tried.  Texts themselves move once for a portion of
    the words that they may hold.
    """
    words = words.select("word").filter("word is not null and word <> ''").distinct()
    each = words.select("word", F.explode(_word_grams(F.col("word"))).alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(often, "gram").groupBy("word").agg(F.min(F.struct("n", "gram")).alias("r")).select("word", F.col("r")["gram"].alias("gram"))
    texts = texts.select("key", "text").filter("text is not null and text <> ''")
    met = texts.mapInArrow(_text_grams, "key string, gram string").join(rarest, "gram").select("key", "word")
    tried = met.groupBy("key", F.pmod(F.xxhash64("word"), F.lit(PORTIONS)).alias("_portion")).agg(F.collect_list("word").alias("_words"))
    return texts.join(tried, "key").select("key", F.explode(F.filter("_words", lambda w: F.contains(F.col("text"), w))).alias("word"))


def first_named(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``questions`` (question, ...) with symbol: of the ``names`` (ord, name),
    a table of any size, the first that the question holds in any case, else
    the first of all.  A blank name is held by every question that isn't null.

    Names after a blank one are never the first.  The ``SOON`` first of the
    others are tried one by one; only questions that hold none of them meet the
    rest of the table."""
    low = names.filter("name is not null").select("ord", "name", F.lower("name").alias("word"))
    # One row: the first name, and the first blank one.
    ends = low.agg(F.min(F.struct("ord", "name")).alias("_first"), F.min(F.when(F.col("word") == "", F.struct("ord", "name"))).alias("_blank")).withColumn("_one", F.lit(1))
    first = low.filter("word <> ''").groupBy("word").agg(F.min(F.struct("ord", "name")).alias("first")).withColumn("_one", F.lit(1))
    first = first.join(F.broadcast(ends), "_one").filter("_blank is null or first < _blank").select("word", "first")
    entry = first.schema["first"].dataType
    literal = lambda r: F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["name"]).alias("name")).cast(entry)
    soon = first.orderBy("first", "word").limit(SOON).collect()
    low_question = F.lower("question")
    tried = F.coalesce(F.lit(None).cast(entry), *[F.when(F.contains(low_question, F.lit(r["word"])), literal(r["first"])) for r in soon])
    both = questions.withColumn("_found", tried)
    if len(soon) == SOON:
        later = first.join(F.broadcast(first.sparkSession.createDataFrame([(r["word"],) for r in soon], "word string")), "word", "left_anti")
        left = both.withColumn("key", F.when(F.col("_found").isNull(), F.sha2(low_question, 256)))
        asked = left.filter("key is not null").select("key", low_question.alias("text")).distinct()
        found = holding(asked, later).join(later, "word").groupBy("key").agg(F.min("first").alias("_later"))
        both = left.join(found, "key", "left").withColumn("_found", F.coalesce("_found", "_later"))
    both = both.withColumn("_one", F.lit(1)).join(F.broadcast(ends), "_one")
    blank = F.when(low_question.isNotNull(), F.col("_blank"))
    return both.select(*questions.columns, F.coalesce(F.least("_found", blank), F.col("_first"))["name"].alias("symbol"))
