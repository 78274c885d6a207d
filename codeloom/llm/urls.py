"""Operator 3: URL filters as a sort-merge range join, in DataFrame functions.

A rule is a host and a path prefix; it fits the host and all subdomains.  The
rules of a host are intervals of paths that nest or are disjoint: from the
prefix itself to the prefix with a byte behind it that is in no UTF-8 text.  A
URL is a point for each suffix of its host.  Starts, ends and points of one
host are sorted together by the canonical key (the reversed host, a zero byte,
the path) and swept with a stack: a start puts its rule on it, an end takes one
off.  A running sum of both is the stack's height; the slot of each height
holds the last rule that was put there, so the slot at a point's own height is
the innermost rule around it.  The longest rule over the suffixes wins.

Points of one host (``com`` may have a third of all) are dealt out to salts in
proportion to their share, and its rules follow to each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, dealt_join, fair_share, hot_keys, quoted, without

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are sent to all tasks, so that points without a rule's
#: host needn't be sorted; with more, all points are.
SENT_RULES = 100_000


def parsed(pages: DataFrame, url_col: str) -> DataFrame:
    """``pages`` with host (after the first :// up to /, ?, # or the end, A-Z
    lower-cased) and path (what follows, up to ?, # or the end); both are empty
    without ://.  Each step reads the one before it, so nothing is cut twice."""
    url = quoted(url_col)
    at = F.locate("://", url)
    rest = F.when(at > 0, F.split(F.substr(url, at + 3), "[?#]", 2)[0]).otherwise("")
    host = F.substring_index("path", "/", 1)
    cut = pages.withColumns({"host": F.lit(""), "path": F.coalesce(rest, F.lit(""))}).withColumn("host", host)
    return cut.withColumns({"host": F.translate("host", _UPPER, _LOWER), "path": F.substr("path", F.char_length("host") + 1)})


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(at: Column, path: Column) -> Column:
    return F.concat(F.encode(at, "UTF-8"), F.lit(b"\x00"), F.encode(path, "UTF-8"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule, or null) and
    verdict (the rule's, else ``default``).

    ``rules``: host, path, verdict.  A rule with a null among these is left
    out; of rules alike in host and path the one with the greater verdict
    ("block" over "allow") counts; of two that tie in length the one with the
    longer host wins.  A null url or one without :// has an empty host and
    path, which no rule fits unless its host and path are empty too.  Repeated
    rows are judged alike; columns named like an added one give way; an empty
    table gives no rows.
    """
    pages = parsed(without(pages, "host", "path", "rule", "verdict"), url_col)
    clean = rules.filter("host is not null and path is not null and verdict is not null")
    clean = clean.groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    top = F.struct((F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    clean = clean.select(F.array_join(_labels(F.col("host")), ".").alias("at"), "path", top.alias("top"))

    # Written once: points, their counts and hot URLs come from it.
    urls = checkpointed(pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    share = fair_share(urls.agg(F.sum("n")).first()[0] or 0, pages.sparkSession)
    # Only suffixes with as many labels as a rule's host can be one.  There are
    # few such numbers: k of them take at least k * k / 2 labels of rules.
    depths = sorted(r[0] for r in clean.select(F.size(F.split("at", r"\.", -1))).distinct().collect())
    depths = F.filter(F.array(*[F.lit(n) for n in depths]).cast("array<int>"), lambda n: n <= F.size("labels"))
    suffixes = F.transform(depths, lambda n: F.array_join(F.slice("labels", F.lit(1), n), "."))
    points = urls.withColumn("labels", _labels(F.col("host"))).select("host", "path", F.explode(suffixes).alias("at"))
    if clean.count() <= SENT_RULES:
        points = points.join(F.broadcast(clean.select("at").distinct()), "at", "left_semi")
    hot = F.broadcast(hot_keys(points.groupBy("at").agg(F.count(F.lit(1)).alias("n")), ["at"], share))

    none, no_rule = F.lit(None).cast("string"), F.lit(None).cast(clean.schema["top"].dataType)
    salt = F.pmod(F.xxhash64("host", "path"), F.coalesce("salts", F.lit(1))).cast("int")
    points = points.join(hot, "at", "left").select("at", salt.alias("salt"), _key(F.col("at"), F.col("path")).alias("key"), F.lit(0).alias("step"), no_rule.alias("top"), "host", "path")
    every = clean.join(hot, "at", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    starts = every.select("at", "salt", _key(F.col("at"), F.col("path")).alias("key"), F.lit(1).alias("step"), "top", none.alias("host"), none.alias("path"))
    ends = every.select("at", "salt", F.concat(_key(F.col("at"), F.col("path")), F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"), no_rule.alias("top"), none.alias("host"), none.alias("path"))

    # A start comes before the points with its key; no point has an end's key.
    so_far = Window.partitionBy("at", "salt").orderBy("key", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = Window.partitionBy("at", "salt", "height").orderBy("key", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(ends).unionByName(points).withColumn("height", F.sum("step").over(so_far))
    found = swept.filter("step >= 0 and height > 0").withColumn("top", F.last("top", ignorenulls=True).over(slot)).filter("step = 0")
    best = found.groupBy("host", "path").agg(F.max("top").alias("_best"))
    judged = dealt_join(pages, best, ["host", "path"], hot_keys(urls, ["host", "path"], share), "left")
    return judged.select(*[quoted(c) for c in pages.columns], F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
