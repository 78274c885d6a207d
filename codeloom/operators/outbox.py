"""Push events to an outbox, once each, and agents' locks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idempotency_key
from .index import latest


def from_pushes(pushes: DataFrame) -> DataFrame:
    """A pending outbox row for each push (repository, branch, commit_sha ...)."""
    key = idempotency_key(F.col("repository"), F.col("branch"), F.col("commit_sha"))
    return pushes.select(F.uuid().alias("id"), F.lit("git_push").alias("event_type"), F.col("repository").alias("aggregate_id"), F.to_json(F.struct(*pushes.columns)).alias("payload"), key.alias("idempotency_key"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"))


def insert_new(outbox: DataFrame, rows: DataFrame) -> DataFrame:
    """``outbox`` and the rows whose key it lacks, one for each key."""
    had = outbox.select(F.col("idempotency_key").alias("_k"))
    new = rows.dropDuplicates(["idempotency_key"]).join(had, F.col("idempotency_key") == F.col("_k"), "left_anti")
    return outbox.unionByName(new, allowMissingColumns=True)


def first_of_each_key(rows: DataFrame, order: str) -> DataFrame:
    """One row for each idempotency key: the least by ``order``."""
    rest = [c for c in rows.columns if c not in ("idempotency_key", order)]
    best = rows.groupBy("idempotency_key").agg(F.min(F.struct(order, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c == "idempotency_key" else F.col("_r")[c].alias(c) for c in rows.columns])


def pending(outbox: DataFrame, order: list[str]) -> DataFrame:
    return outbox.filter("status = 'PENDING'").orderBy(*order)


def changed_files(pushes: DataFrame) -> DataFrame:
    """(repository, commit_sha, file_path, change) of each push."""
    each = [pushes.select("repository", "commit_sha", F.explode(c).alias("file_path"), F.lit(c).alias("change")) for c in ("modified", "added", "removed")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def locks(handshakes: DataFrame, order: str) -> DataFrame:
    """The files each agent holds: what it named last."""
    return latest(handshakes, ["agent_id"], [order])


def swarm_size(held: DataFrame) -> DataFrame:
    return held.agg(F.countDistinct("agent_id").alias("swarm_peers_count"))


def seeded(rows: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of the seed whose key they lack."""
    had = rows.select(F.col(key).alias("_k"))
    return rows.unionByName(seed.dropDuplicates([key]).join(had, F.col(key) == F.col("_k"), "left_anti"))


def relations(organizations: DataFrame, repositories: DataFrame, commits: DataFrame) -> DataFrame:
    """For each organisation (org_id, ...): its repositories, their commits, and
    those that are pending.  Commits are counted before they meet anything."""
    per = commits.groupBy("repository_id").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("status") == "PENDING", 1)).alias("p"))
    of = repositories.join(per, "repository_id", "left").groupBy("org_id").agg(F.countDistinct("repository_id").alias("repositories"), F.sum("c").alias("commits"), F.sum("p").alias("pending"))
    return organizations.join(of, "org_id", "left").fillna(0, ["repositories", "commits", "pending"])


# The states of an outbox row.
PENDING, PROCESSED, FAILED = "PENDING", "PROCESSED", "FAILED"

STATES = "idempotency_key STRING, aggregate_id STRING, payload STRING, status STRING, retry_count INT, created_at BIGINT, next_try_at BIGINT, processed_at BIGINT"


def enqueued(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """``outbox`` (of ``STATES``) and the events (idempotency_key, aggregate_id,
    payload, created_at in ms) whose key it never had, the earliest of each."""
    none = F.lit(None).cast("long")
    first = events.groupBy("idempotency_key").agg(F.min(F.struct("created_at", "aggregate_id", "payload")).alias("_r"))
    new = first.select("idempotency_key", "_r.aggregate_id", "_r.payload", F.lit(PENDING).alias("status"), F.lit(0).alias("retry_count"), "_r.created_at", F.col("_r.created_at").alias("next_try_at"), none.alias("processed_at"))
    had = outbox.select(F.col("idempotency_key").alias("_k"))
    return outbox.unionByName(new.join(had, F.col("idempotency_key") == F.col("_k"), "left_anti"))


def due(outbox: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Pending rows whose time has come, the oldest first."""
    rows = outbox.filter((F.col("status") == PENDING) & (F.col("next_try_at") <= now))
    rows = rows.orderBy("created_at", "idempotency_key")
    return rows if limit is None else rows.limit(limit)


def settled(outbox: DataFrame, attempts: DataFrame, tries: int = 5, wait_ms: int = 60_000) -> DataFrame:
    """``outbox`` after attempts (idempotency_key, at in ms, ok).

    In the order of ``at`` (a failure before a success of one time), an attempt
    at a pending row makes it processed, or counts as one retry more; after the
    k-th failure it waits ``wait_ms`` times 2^(k-1), and with ``tries`` of them
    it has failed.  Attempts at other rows change nothing.  Of a key's attempts
    the first ``tries`` matter, so each task passes on so many at most.
    """
    order = Window.partitionBy("idempotency_key").orderBy("at", "ok")
    first = attempts.select("idempotency_key", "at", "ok").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= tries)
    each = first.groupBy(F.col("idempotency_key").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("_n", "at", "ok"))).alias("_a"))
    done = F.expr("get(filter(_a, x -> x.ok), 0)")
    fails = F.coalesce(done["_n"] - 1, F.size("_a"))
    met = outbox.join(each, F.col("idempotency_key") == F.col("_k"), "left")
    moved = (F.col("status") == PENDING) & F.col("_a").isNotNull()
    retries = F.least(F.col("retry_count") + fails, F.lit(tries))
    over = retries >= tries
    status = F.when(over, FAILED).when(done.isNotNull(), PROCESSED).otherwise(PENDING)
    # The failure that counted last.
    last = F.get(F.col("_a"), F.least(fails, F.lit(tries) - F.col("retry_count")) - 1)["at"]
    wait = F.when(status == PENDING, last + wait_ms * F.pow(F.lit(2), retries - 1)).otherwise(F.lit(None))
    new = {
        "status": F.when(moved, status).otherwise(F.col("status")),
        "retry_count": F.when(moved, retries).otherwise(F.col("retry_count")),
        "next_try_at": F.when(moved, wait.cast("long")).otherwise(F.col("next_try_at")),
        "processed_at": F.when(moved & ~over & done.isNotNull(), done["at"]).otherwise(F.col("processed_at")),
    }
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in outbox.columns])


def emptied(outbox: DataFrame, before: int) -> DataFrame:
    """``outbox`` with the payloads of rows that were settled and made before
    a time gone.  Keys and states stay: a late copy is still known."""
    old = (F.col("status") != PENDING) & (F.col("created_at") < before)
    return outbox.withColumn("payload", F.when(~old, F.col("payload")))
