"""Push events from a stream: an outbox with states, each key once ever; and
keys once within a watermark, where late ones may be lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import outbox
from .buckets import MergeTable, query_id
from .feed import EDGE_KEY, GraphFeed
from .tables import VersionedTable


def once(events: DataFrame, time: str = "created_at", late: str = "1 day") -> DataFrame:
    """State holds the keys of the last ``late`` only, and rows older than
    that are dropped, also those whose key was never seen: ``OutboxStore``
    keeps late keys."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["idempotency_key"])


def to_table(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start()


class OutboxStore:
    """An outbox as a table merged by key: an event comes out once however
    late it or its copies are, and each state is kept until it is settled.

    ``enqueue`` and ``settle`` are streams of their own; a batch that is run
    again changes nothing.  Rows that wait for their next try come back with
    ``due`` when their time has come."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 5, wait_ms: int = 60_000, buckets: int = 16):
        self.table = MergeTable(spark, f"{path}/outbox", outbox.STATES, ["idempotency_key"], buckets)
        self.tries, self.wait_ms = tries, wait_ms

    def add(self, events: DataFrame, batch: int, source: str) -> None:
        """Null keys are passed over."""
        self.table.merge(events.filter("idempotency_key is not null"), outbox.enqueued, source, batch)

    def settle(self, attempts: DataFrame, batch: int, source: str) -> None:
        self.table.merge(attempts.filter("idempotency_key is not null"), lambda rows, tried: outbox.settled(rows, tried, self.tries, self.wait_ms), source, batch)

    def due(self, now: int, limit: int | None = None) -> DataFrame:
        return outbox.due(self.table.read(), now, limit)

    def empty(self, before: int, batch: int, source: str = "expiry") -> None:
        """Drop the payloads of what was settled and made before a time."""
        old = self.table.read().filter((F.col("status") != outbox.PENDING) & (F.col("created_at") < before) & F.col("payload").isNotNull())
        self.table.merge(old, lambda rows, _: outbox.emptied(rows, before), source, batch)

    def start_adding(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return self._start(events, checkpoint, self.add)

    def start_settling(self, attempts: DataFrame, checkpoint: str) -> StreamingQuery:
        return self._start(attempts, checkpoint, self.settle)

    @staticmethod
    def _start(rows: DataFrame, checkpoint: str, apply) -> StreamingQuery:
        step = lambda some, batch: apply(some, batch, query_id(some.sparkSession, checkpoint))
        return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def apply_graph_changes(changes: DataFrame, nodes: VersionedTable, edges: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Changes (op: node, delete or edge; then the fields of nodes and edges
    and a version) kept by a ``GraphFeed`` beside the nodes' table, and after
    each batch the whole graph as the next version of both tables.  Readers
    that can should read the feed, which only rewrites what changes."""
    table = lambda t, keys: ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in t.read().schema if c.name not in [*keys, "version"])
    feed = GraphFeed(nodes.spark, f"{nodes.path}/_feed", table(nodes, ["id"]), table(edges, EDGE_KEY))

    def step(rows: DataFrame, batch: int) -> None:
        source = query_id(rows.sparkSession, checkpoint)
        feed.apply(rows, batch, source)
        for held, found in ((edges, feed.edges()), (nodes, feed.nodes())):
            held.write_batch(found.select(*[F.col(c.name).cast(c.dataType) for c in held.read().schema]), source, batch)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
