"""Fuzzy join of a table of queries with a table of symbols.

The score of a pair is that of ``search.match_score``; only pairs over 0 come
out, and no pair is scored that can't be one:

* a name that holds a query, or the other way round, by their rarest grams;
* words of a query alike to words of a name: a name must have a certain number
  of a query's words, so it has one of the query's rarest ones;
* names alike as a whole (Jaro-Winkler), and words alike: two texts alike have
  a number of letters in common that follows from their lengths and first
  letters.  Texts meet others of the lengths that this allows, by the bits of
  their letters (two ANDed numbers bound the letters in common), and few go on;
* documents and paths that hold a query, by its rarest gram.

Everything is made of distinct texts; symbols are joined last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim
from ..session import shared_folder
from .search import NAME_SIMILARITY, TOKEN_SIMILARITY, WINKLER_FROM, WINKLER_STEP, _similar, holding, jaro_winkler, tokenize

#: Texts of one length that a task compares with all texts that may be alike.
ONE_LENGTH = 50_000


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(names: pd.Series) -> pd.Series:
    return names.map(lambda name: tokenize(name or ""))


@F.pandas_udf(T.StructType([T.StructField("bits", T.LongType()), T.StructField("more", T.IntegerType())]))
def _letters(texts: pd.Series) -> pd.DataFrame:
    """A bit for the first and one for the second letter of each of 32 kinds,
    and how many letters are left."""
    bits, more = [], []
    for text in texts:
        n: dict[int, int] = {}
        for c in text:
            n[ord(c) % 32] = n.get(ord(c) % 32, 0) + 1
        b = sum(1 << k for k in n) | sum(1 << (k + 32) for k, v in n.items() if v > 1)
        bits.append(b - (1 << 64) if b >> 63 else b)
        more.append(sum(max(0, v - 2) for v in n.values()))
    return pd.DataFrame({"bits": bits, "more": more})


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def least_jaro(similarity: float, prefix: int) -> float:
    """The least Jaro similarity of texts that are so similar and begin with so
    many equal letters."""
    gain = prefix * WINKLER_STEP
    return max(WINKLER_FROM, (similarity - gain) / (1 - gain))


def alike(a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of distinct texts (column text) with at least this
    Jaro-Winkler similarity, which is over 0.7.  Empty texts are passed over.

    m equal letters make m/|a| + m/|b| + 1 >= 3 j.  That bounds the lengths (by
    m = the shorter one) and m, which the letters' bits bound from above."""
    lowest = least_jaro(similarity, 4)
    shown = lambda rows, side: rows.select("text").filter("text <> ''").distinct().withColumn("_l", _letters("text")).select(F.col("text").alias(side), F.char_length("text").alias(f"{side}_n"), F.col("_l.bits").alias(f"{side}_bits"), F.col("_l.more").alias(f"{side}_more"))
    left, right = shown(a, "a"), shown(b, "b").checkpoint()
    lengths = right.groupBy("b_n").agg(F.ceil(F.count(F.lit(1)) / ONE_LENGTH).cast("int").alias("_shares"))
    # Lengths that a text can be like, and the shares of a frequent one.
    room = (F.col("b_n") >= F.ceil((3 * lowest - 2) * F.col("a_n") - 1e-9)) & ((3 * lowest - 2) * F.col("b_n") - 1e-9 <= F.col("a_n"))
    left = left.join(F.broadcast(lengths), room).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    right = right.join(F.broadcast(lengths), "b_n").withColumn("_share", F.pmod(F.xxhash64("b"), F.col("_shares")).cast("int")).drop("_shares")
    common = F.bit_count(F.col("a_bits").bitwiseAND(F.col("b_bits"))) + F.least("a_more", "b_more")
    begin = lambda n: F.substring("a", 1, n) == F.substring("b", 1, n)
    least = F.when(~begin(1), least_jaro(similarity, 0)).when(~begin(2), least_jaro(similarity, 1)).otherwise(lowest)
    enough = common * (F.lit(1.0) / F.col("a_n") + F.lit(1.0) / F.col("b_n")) + 1 >= 3 * least - 1e-9
    met = left.join(right, ["b_n", "_share"]).filter(enough).select("a", "b")
    return met.filter(_jaro_winkler("a", "b") >= similarity)


def _beginnings(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda n: F.substring(text, F.lit(1), n))


def like_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct words (column text) of which one begins
    with the other or that are alike."""
    a, b = (rows.select("text").filter("text <> ''").distinct() for rows in (a, b))
    one, other = a.select(F.col("text").alias("a")), b.select(F.col("text").alias("b"))
    down = one.join(other.select("b", F.explode(_beginnings(F.col("b"))).alias("a")), "a")
    up = one.select("a", F.explode(_beginnings(F.col("a"))).alias("b")).join(other, "b").select("a", "b")
    return down.select("a", "b").unionByName(up).unionByName(alike(a, b, TOKEN_SIMILARITY)).distinct()


def by_words(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name) that may have the words for a score: a name has words like
    at least 50/80 of the query's.  So it has one like those that are left when
    all but one of so many, the ones that most names have, are taken off."""
    q = queries.select("query", _tokens("query").alias("words")).filter("size(words) > 0")
    n = names.select("name", F.explode(F.array_distinct(_tokens("name"))).alias("b")).checkpoint()
    each = q.select("query", F.size("words").alias("size"), F.explode("words").alias("a"))
    met = like_words(each.select(F.col("a").alias("text")), n.select(F.col("b").alias("text"))).checkpoint()
    # How many names a word is like.
    often = met.join(n.groupBy("b").agg(F.count(F.lit(1)).alias("k")), "b").groupBy("a").agg(F.sum("k").alias("k"))
    weighed = each.join(often, "a", "left").select("query", "size", F.struct(F.coalesce("k", F.lit(0).cast("long")).alias("k"), "a").alias("w"))
    need = F.ceil(F.lit(50) * F.col("size") / 80)
    rare = weighed.groupBy("query", "size").agg(F.sort_array(F.collect_list("w")).alias("w"))
    rare = rare.select("query", F.explode(F.array_distinct(F.expr("transform(w, x -> x.a)"))).alias("a"), F.slice("w", F.lit(1), (F.col("size") - need + 1).cast("int")).alias("w")).filter(F.expr("exists(w, x -> x.a = a)"))
    return rare.select("query", "a").join(met, "a").join(n, "b").select("query", "name").distinct()


def search_join(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, id, symbol_name, file_path, score) of all pairs of ``queries``
    (query) and ``symbols`` (id, symbol_name, file_path, docstring) over 0, as
    ``search.scored`` gives them.  Equal queries are one; blank queries and
    blank names, which fit everything, are passed over."""
    shared_folder(symbols.sparkSession)
    plain = lambda c: F.lower(trim(F.col(c)))
    queries = queries.select("query", plain("query").alias("q")).filter("q <> ''").distinct().checkpoint()
    names = symbols.select(F.col("symbol_name").alias("name"), plain("symbol_name").alias("s")).filter("s <> ''").distinct().checkpoint()
    text = lambda rows, c: rows.select(F.col(c).alias("key"), F.col(c).alias("text")).distinct()
    word = lambda rows, c: rows.select(F.col(c).alias("word"))

    held = holding(text(names, "s"), word(queries, "q")).select(F.col("key").alias("s"), F.col("word").alias("q"))
    holds = holding(text(queries, "q"), word(names, "s")).select(F.col("word").alias("s"), F.col("key").alias("q"))
    tier = F.when(F.col("q") == F.col("s"), 100).when(F.startswith("s", F.col("q")), 95).when(F.contains("s", F.col("q")), 85).otherwise(80)
    sure = held.unionByName(holds).distinct().join(queries, "q").join(names, "s").select("query", "name", tier.alias("score")).checkpoint()

    near = alike(queries.select(F.col("q").alias("text")), names.select(F.col("s").alias("text")), NAME_SIMILARITY)
    near = near.withColumnsRenamed({"a": "q", "b": "s"}).join(queries, "q").join(names, "s").select("query", "name")
    tried = by_words(queries, names).unionByName(near).distinct().join(sure.select("query", "name"), ["query", "name"], "left_anti")
    close = tried.withColumn("score", _similar("query", "name")).filter("score is not null")
    named = sure.unionByName(close)

    # Name before document before path, whatever their scores.
    rows = symbols.select("id", "symbol_name", "file_path", "docstring").filter(trim(F.col("symbol_name")) != "")
    ranked = lambda found, rank, score: found.select("query", "id", "symbol_name", "file_path", F.struct(F.lit(rank).alias("rank"), score.cast("int").alias("score")).alias("r"))
    by_name = ranked(rows.join(named, F.col("symbol_name") == F.col("name")), 0, F.col("score"))

    def by_text(column: str, rank: int, score: int) -> DataFrame:
        low = F.lower(column)
        texts = rows.select(F.sha2(low, 256).alias("key"), low.alias("text")).filter("text is not null").distinct()
        found = holding(texts, word(queries, "q")).join(queries, F.col("word") == F.col("q")).select("key", "query")
        return ranked(rows.withColumn("key", F.sha2(low, 256)).join(found, "key"), rank, F.lit(score))

    every = by_name.unionByName(by_text("docstring", 1, 70)).unionByName(by_text("file_path", 2, 50))
    best = every.groupBy("query", "id", "symbol_name", "file_path").agg(F.min("r").alias("r"))
    return best.select("query", "id", "symbol_name", "file_path", F.col("r")["score"].alias("score"))
