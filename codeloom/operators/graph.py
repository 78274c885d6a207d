"""Code graph: upserts, deltas and bounded blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .index import latest

# Fixed values.
EDGE_TYPES = ["CALLS", "IMPORTS", "INHERITS", "MUTATES_SCHEMA"]
IMPACT_TYPES = ["CALLS", "MUTATES_SCHEMA", "IMPORTS"]


def existing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of known types of which both ends exist."""
    ids = nodes.select(F.col("id").alias("_n")).distinct()
    kept = edges.filter(F.col("edge_type").isin(EDGE_TYPES))
    return kept.join(ids, F.col("source_id") == F.col("_n"), "left_semi").join(ids, F.col("target_id") == F.col("_n"), "left_semi")


def upsert_nodes(old: DataFrame, new: DataFrame, order: str = "version") -> DataFrame:
    return latest(old.unionByName(new), ["id"], [order])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, order: str = "version") -> DataFrame:
    return latest(old.unionByName(existing_edges(new, nodes)), ["source_id", "edge_type", "target_id"], [order])


def apply_delta(nodes: DataFrame, edges: DataFrame, upserted: DataFrame, deleted: DataFrame, new_edges: DataFrame, order: str = "version") -> tuple[DataFrame, DataFrame]:
    """Deletes first, with the edges of deleted nodes; then upserts."""
    gone = deleted.select(F.col("id").alias("_d")).distinct()
    left = upsert_nodes(nodes.join(gone, F.col("id") == F.col("_d"), "left_anti"), upserted, order)
    return left, upsert_edges(existing_edges(edges, left), new_edges, left, order)


#: Edges of one node that a task takes in its stride, and nodes at most whose
#: edges are dealt out: their list goes to all tasks.
HUB_EDGES, MOST_HUBS = 100_000, 10_000


def blast_radius(edges: DataFrame, seeds: DataFrame, hops: int = 2, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(seed, id, depth): what each seed reaches over impact edges within
    ``hops``, at its least depth.

    Seeds are numbered, and 64 of them share a row for each node they reach, as
    the bits of a number.  A hop goes on from what the one before found newly
    only; what seeds reached before is taken off their bits.  The edges of a
    hub are dealt out, and its row of the front follows to each share.  What a
    hop found is written, so that later hops don't make it again.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    step = edges.filter(F.col("edge_type").isin(IMPACT_TYPES)).select(F.col("source_id").alias("id"), F.col("target_id").alias("_t")).filter("id is not null and _t is not null").distinct()
    hub_edges = max(hub_edges, step.count() // MOST_HUBS)
    hubs = step.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hub_edges).select("id", F.ceil(F.col("_n") / hub_edges).cast("int").alias("_shares")).checkpoint()
    shares = F.coalesce("_shares", F.lit(1))
    step = step.join(F.broadcast(hubs), "id", "left").select("id", F.pmod(F.xxhash64("_t"), shares).cast("int").alias("_share"), "_t")

    number = F.monotonically_increasing_id()
    named = seeds.select("id").filter("id is not null").distinct().withColumn("_k", number).select(F.col("id").alias("seed"), F.shiftright("_k", 6).alias("chunk"), F.col("_k").bitwiseAND(F.lit(63)).cast("int").alias("bit")).checkpoint()
    one = lambda c: F.expr(f"shiftleft(1L, {c})")
    front = named.groupBy(F.col("seed").alias("id"), "chunk").agg(F.bit_or(one("bit")).alias("bits"))
    reached, found = None, None
    for depth in range(1, hops + 1):
        dealt = front.join(F.broadcast(hubs), "id", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
        near = dealt.join(step, ["id", "_share"]).groupBy(F.col("_t").alias("id"), "chunk").agg(F.bit_or("bits").alias("bits"))
        if reached is not None:
            near = near.join(reached.withColumnRenamed("bits", "_had"), ["id", "chunk"], "left").select("id", "chunk", F.expr("bits & ~coalesce(_had, 0L)").alias("bits")).filter("bits <> 0")
        front = near.checkpoint()
        at = front.withColumn("depth", F.lit(depth))
        found = at if found is None else found.unionByName(at)
        reached = front if reached is None else reached.unionByName(front).groupBy("id", "chunk").agg(F.bit_or("bits").alias("bits"))
        if depth < hops and front.isEmpty():
            break
    each = found.select("id", "chunk", "depth", F.explode(F.expr("filter(sequence(0, 63), b -> (bits & shiftleft(1L, b)) <> 0)")).alias("bit"))
    return each.join(named, ["chunk", "bit"]).select("seed", "id", "depth")


def node_statement(nodes: DataFrame) -> DataFrame:
    """Parameterised MERGE statements for a graph store."""
    text = "MERGE (n:Symbol {id: $id}) SET n.name = $name, n.file = $file, n.language = $language, n.hash = $hash"
    return nodes.select(F.lit(text).alias("statement"), F.to_json(F.struct("id", "name", "file", "language", "hash")).alias("parameters"))


def edge_statement(edges: DataFrame) -> DataFrame:
    text = F.concat(F.lit("MATCH (a:Symbol {id: $source_id}) MATCH (b:Symbol {id: $target_id}) MERGE (a)-[r:"), "edge_type", F.lit("]->(b) SET r.weight = $weight"))
    return edges.filter(F.col("edge_type").isin(EDGE_TYPES)).select(text.alias("statement"), F.to_json(F.struct("source_id", "target_id", "weight")).alias("parameters"))


def duplicate_ids(nodes: DataFrame, label: str = "file") -> DataFrame:
    """(label, id) that break uniqueness."""
    return nodes.groupBy(label, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
