"""Symbol index and content-hash cache, as table operations without MERGE:
the latest row of each key is kept by one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, ties by the other columns.
    A partial aggregate keeps one row for each key and task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest(old.unionByName(new), keys, order)


def upsert_file_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["file_path"], ["last_indexed_at"])


def stale_files(current: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (file_path, hash) the cache doesn't have."""
    known = cache.select(F.col("file_path").alias("_p"), F.col("hash").alias("_h"))
    return current.join(known, (F.col("file_path") == F.col("_p")) & F.col("hash").eqNullSafe(F.col("_h")), "left_anti")


def freshness(current: DataFrame, cache: DataFrame) -> DataFrame:
    """``current`` with is_cached: false for an unknown file."""
    known = cache.select(F.col("file_path").alias("_p"), F.col("hash").alias("_h"))
    return current.join(known, F.col("file_path") == F.col("_p"), "left").withColumn("is_cached", F.coalesce(F.col("hash") == F.col("_h"), F.lit(False))).drop("_p", "_h")


def unique_symbols(found: DataFrame) -> DataFrame:
    """One symbol for each (file_path, symbol_name): the first, widest one."""
    rest = [c for c in found.columns if c not in ("file_path", "symbol_name", "start_line", "end_line")]
    best = found.groupBy("file_path", "symbol_name").agg(F.min(F.struct("start_line", (-F.col("end_line")).alias("_w"), *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in ("file_path", "symbol_name") else (-F.col("_r._w")).alias(c) if c == "end_line" else F.col("_r")[c].alias(c) for c in found.columns])


def replace_symbols(index: DataFrame, touched: DataFrame, found: DataFrame) -> DataFrame:
    """``index`` with all symbols of the ``touched`` files replaced."""
    gone = touched.select(F.col("file_path").alias("_t")).distinct()
    return index.join(gone, F.col("file_path") == F.col("_t"), "left_anti").unionByName(unique_symbols(found))


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The symbol of each wanted (file_path, symbol_name), the least id of many."""
    keys = wanted.select(F.col("file_path").alias("_f"), F.col("symbol_name").alias("_s")).distinct()
    met = index.join(keys, (F.col("file_path") == F.col("_f")) & (F.col("symbol_name") == F.col("_s"))).drop("_f", "_s")
    rest = [c for c in index.columns if c not in ("file_path", "symbol_name")]
    best = met.groupBy("file_path", "symbol_name").agg(F.min(F.struct(*sorted(rest, key=lambda c: c != "id"))).alias("_r"))
    return best.select(*[F.col(c) if c in ("file_path", "symbol_name") else F.col("_r")[c].alias(c) for c in index.columns])


def cache_get(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """Cached records of the asked content hashes."""
    asked = hashes.select(F.col("content_hash").alias("_h")).distinct()
    return cache.join(asked, F.col("content_hash") == F.col("_h"), "left_semi")


def cache_put(cache: DataFrame, records: DataFrame) -> DataFrame:
    return upsert(cache, records, ["content_hash"], ["cached_at"])


def cache_delete(cache: DataFrame, hashes: DataFrame) -> DataFrame:
    """``cache`` without the records of some content hashes."""
    gone = hashes.select(F.col("content_hash").alias("_h")).distinct()
    return cache.join(gone, F.col("content_hash") == F.col("_h"), "left_anti")


def cache_count(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("records"))


PAYLOAD = "id string, symbol_name string, file_path string, kind string, language string, start_line int, end_line int, docstring string"


def payloads(symbols: DataFrame) -> DataFrame:
    """Symbols as stored: (file_path, symbol_name, payload), a JSON document."""
    return symbols.select("file_path", "symbol_name", F.to_json(F.struct(*symbols.columns)).alias("payload"))


def from_payloads(stored: DataFrame) -> DataFrame:
    """The symbols of stored payloads; rows that can't be read, or lack an id
    or a name, are passed over."""
    node = F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"})
    return stored.select(node.alias("n")).filter("n.id is not null and n.symbol_name is not null").select("n.*")
