"""A graph kept from a feed of changes, in whatever order they come.

Each change has a version.  A node's state is its newest fields and the version
of its last delete (a tombstone, which stays); an edge's state its newest
fields.  A node is there if its fields are newer than its tombstone, an edge if
both its ends are there and neither was deleted at its version or later.  All
of this is a maximum over changes, so the same changes give the same graph
however the feed is shuffled and cut into batches, and whichever are repeated.

So an edge that comes before an end of it waits for that end, and a node that
is deleted and added again doesn't bring its old edges back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import EDGE_TYPES
from .buckets import MergeTable, query_id

EDGE_KEY = ["source_id", "edge_type", "target_id"]


def _newest(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """For each key the fields of the newest upsert (ties: the greatest fields)
    and the newest tombstone.  One partial aggregate."""
    best = rows.groupBy(*keys).agg(F.max(F.when(F.col("version").isNotNull(), F.struct("version", *fields))).alias("_r"), F.max("deleted_at").alias("deleted_at"))
    return best.select(*keys, *[F.col("_r")[f].alias(f) for f in fields], F.col("_r")["version"].alias("version"), "deleted_at")


class GraphFeed:
    """Changes: op (node, delete, edge or unlink), the fields of nodes and
    edges, and version.  ``node`` and ``edge`` name the fields beside the keys."""

    def __init__(self, spark: SparkSession, path: str, node: str = "name STRING", edge: str = "", buckets: int = 16):
        columns = lambda text: spark.createDataFrame([], text).columns if text else []
        more = lambda text: f", {text}" if text else ""
        self._node, self._edge = columns(node), columns(edge)
        self._nodes = MergeTable(spark, f"{path}/nodes", f"id STRING{more(node)}, version BIGINT, deleted_at BIGINT", ["id"], buckets)
        self._edges = MergeTable(spark, f"{path}/edges", f"source_id STRING, edge_type STRING, target_id STRING{more(edge)}, version BIGINT, deleted_at BIGINT", EDGE_KEY, buckets)

    def apply(self, changes: DataFrame, batch: int, source: str = "") -> None:
        """Apply a batch of a source, once.  Edges of unknown types, and changes
        without a key or a version, are passed over."""
        version, none = F.col("version").cast("long"), F.lit(None).cast("long")

        def states(put: str, drop: str, keys: list[str], fields: list[str]) -> DataFrame:
            some = changes.filter(F.col("op").isin(put, drop)).filter(" and ".join(f"{c} is not null" for c in [*keys, "version"]))
            is_put = F.col("op") == put
            return some.select(*keys, *fields, F.when(is_put, version).otherwise(none).alias("version"), F.when(is_put, none).otherwise(version).alias("deleted_at"))

        nodes = states("node", "delete", ["id"], self._node)
        edges = states("edge", "unlink", EDGE_KEY, self._edge).filter(F.col("edge_type").isin(EDGE_TYPES))
        self._edges.merge(edges, lambda old, new: _newest(old.unionByName(new), EDGE_KEY, self._edge), source, batch)
        self._nodes.merge(nodes, lambda old, new: _newest(old.unionByName(new), ["id"], self._node), source, batch)

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over what there is and end."""
        step = lambda rows, batch: self.apply(rows, batch, query_id(rows.sparkSession, checkpoint))
        return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()

    def nodes(self) -> DataFrame:
        there = F.col("version") > F.coalesce("deleted_at", F.col("version") - 1)
        return self._nodes.read().filter(there).select("id", *self._node, "version")

    def edges(self) -> DataFrame:
        """Edges between nodes that are there: a join for each end, which the
        adaptive plan splits for a node with very many edges."""
        there = F.col("version") > F.coalesce("deleted_at", F.col("version") - 1)
        nodes = self._nodes.read().filter(there).select("id", "deleted_at")
        found = self._edges.read().filter(there).drop("deleted_at")
        for end in ("source_id", "target_id"):
            known = nodes.select(F.col("id").alias("_n"), F.col("deleted_at").alias("_d"))
            found = found.join(known, F.col(end) == F.col("_n")).filter("_d is null or version > _d").drop("_n", "_d")
        return found.select(*EDGE_KEY, *self._edge, "version")
