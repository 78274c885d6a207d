"""Merged tables, the index, the outbox and the graph under late, mixed,
repeated and newly started batches."""

import itertools
import random

import pytest

from codeloom.operators import outbox
from codeloom.streaming.buckets import MergeTable
from codeloom.streaming.feed import GraphFeed
from codeloom.streaming.outbox import OutboxStore
from codeloom.streaming.reindex import CHANGES, Indexer
from codeloom.streaming.tables import VersionedTable


def upsert(old, new):
    gone = new.selectExpr("k as _k").distinct()
    return old.join(gone, old.k == gone._k, "left_anti").unionByName(new)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v int")


# ---------------------------------------------------------------- tables


def test_a_change_rewrites_its_bucket_only(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], buckets=8)
    assert t.read().count() == 0 and t.merge(rows(spark, [(f"k{i}", i) for i in range(100)]), upsert, "a", 0) == 0
    before = t.manifest()["buckets"]
    assert len(before) == 8
    t.merge(rows(spark, [("k5", -5)]), upsert, "a", 1)
    after = t.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert sorted((r.k, r.v) for r in t.read().collect()) == sorted((f"k{i}", -5 if i == 5 else i) for i in range(100))
    assert t.read(0).filter("k = 'k5'").first().v == 5
    assert t.read_for(rows(spark, [("k5", 0)])).count() < 40


def test_no_batch_is_lost_or_applied_twice(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], buckets=2)
    assert t.merge(rows(spark, [("a", 1)]), upsert, "first", 0) == 0
    # Another source begins with batch 0 as well.
    assert t.merge(rows(spark, [("b", 2)]), upsert, "second", 0) == 1
    assert t.merge(rows(spark, [("a", 9)]), upsert, "first", 0) is None and t.done("first", 0) and not t.done("first", 1)
    assert t.merge(rows(spark, []), upsert, "first", 1) == 2
    assert sorted((r.k, r.v) for r in t.read().collect()) == [("a", 1), ("b", 2)]


def test_buckets_that_become_empty_and_old_commits_go(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], buckets=2, keep=2)
    for n in range(6):
        t.merge(rows(spark, [(f"k{n}", n)]), upsert, "s", n)
    assert t.versions() == [4, 5]
    folders = {f.name for f in (tmp_path / "t" / "data").iterdir()}
    assert folders == set(t.manifest(4)["buckets"].values()) | set(t.manifest(5)["buckets"].values())
    (tmp_path / "t" / "data" / "left-behind").mkdir()
    assert t.clean_up() == 1 and t.read().count() == 6
    t.merge(t.read(), lambda old, new: old.limit(0), "s", 6)
    assert t.read().count() == 0 and t.manifest()["buckets"] == {}
    # The number of buckets stays as the table was made.
    assert MergeTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], buckets=99).manifest()["n"] == 2


def test_two_writers_and_strayed_rows_are_errors(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], buckets=64)
    t.merge(rows(spark, [("a", 1)]), upsert, "s", 0)
    old = t.manifest()
    t.merge(rows(spark, [("b", 1)]), upsert, "s", 1)
    with pytest.raises(RuntimeError):
        t._commit({**old, "version": 1})
    with pytest.raises(ValueError):
        t.merge(rows(spark, [("c", 1)]), lambda o, new: rows(spark, [(f"z{n}", n) for n in range(50)]), "s", 2)
    assert sorted(r.k for r in t.read().collect()) == ["a", "b"]


def test_versions_by_batch(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k string, v int")
    assert [t.write_batch(rows(spark, [("a", n)]), source, batch) for n, (source, batch) in enumerate([("x", 0), ("y", 0), ("x", 0), ("x", 1)])] == [0, 1, None, 2]
    assert t.read().first().v == 3 and t.keep(1) == 2 and t.versions() == [2] and t.read().count() == 1


# ---------------------------------------------------------------- index


def test_index_with_new_checkpoints_and_repeated_batches(spark, tmp_path):
    indexer, log = Indexer(spark, str(tmp_path / "index"), buckets=4), str(tmp_path / "log")

    def run(checkpoint, changes, folder=log):
        spark.createDataFrame(changes, CHANGES).coalesce(1).write.mode("append").parquet(folder)
        indexer.start(spark.readStream.schema(CHANGES).parquet(folder), str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.file_path, r.name) for r in indexer.symbols.read().collect())

    assert run("one", [("a.ts", "function f() {}", 1)]) == [("a.ts", "f")]
    # A new checkpoint begins with batch 0 again.
    assert run("two", [("b.ts", "function g() {}", 2)], log + "2") == [("a.ts", "f"), ("b.ts", "g")]
    before = indexer.symbols.manifest()["buckets"]
    assert run("one", [("b.ts", "function h() {}", 3)]) == [("a.ts", "f"), ("b.ts", "h")]
    after = indexer.symbols.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    # The old log read anew changes nothing that is newer.
    indexer.apply(spark.createDataFrame([("b.ts", "function x() {}", 9)], CHANGES), 0, indexer.cache.manifest()["last"])
    assert indexer.symbols.manifest()["buckets"] == after
    # A batch whose symbols were written, but whose cache wasn't.
    changes = spark.createDataFrame([("c.ts", "function c() {}", 4)], CHANGES)
    indexer.symbols.merge(changes, lambda old, new: old.unionByName(old.limit(0)), "third", 0)
    indexer.apply(changes, 0, "third")
    assert indexer.cache.done("third", 0)


# ---------------------------------------------------------------- outbox

EVENT = "idempotency_key string, aggregate_id string, payload string, created_at long"
ATTEMPT = "idempotency_key string, at long, ok boolean"


def test_late_keys_come_out_once(spark, tmp_path):
    store, log = OutboxStore(spark, str(tmp_path)), str(tmp_path / "in")
    day = 86_400_000
    for batch in ([("x", "1", "p", 10 * day)], [("y", "2", "p", 2 * day), ("x", "1", "late copy", day)], [("x", "1", "p", 30 * day), (None, "3", "p", 5)]):
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(log)
        store.start_adding(spark.readStream.schema(EVENT).parquet(log), str(tmp_path / "ck")).awaitTermination()
    assert [(r.idempotency_key, r.payload, r.created_at) for r in store.due(50 * day).collect()] == [("y", "p", 2 * day), ("x", "p", 10 * day)]
    assert sorted((r.idempotency_key, r.payload, r.created_at) for r in store.table.read().collect()) == [("x", "p", 10 * day), ("y", "p", 2 * day)]
    assert [r.idempotency_key for r in store.due(3 * day).collect()] == ["y"] and store.due(20 * day, limit=1).first().idempotency_key == "y"


def plain_states(attempts, keys, tries, wait):
    out = {k: ("PENDING", 0, 1, None) for k in keys}
    for key, at, ok in attempts:
        if key in out and out[key][0] == "PENDING":
            n = out[key][1]
            if ok:
                out[key] = ("PROCESSED", n, None, at)
            elif n + 1 >= tries:
                out[key] = ("FAILED", n + 1, None, None)
            else:
                out[key] = ("PENDING", n + 1, at + wait * 2**n, None)
    return out


@pytest.mark.parametrize("cuts", [1, 3, 10])
def test_states_match_the_plain_version(spark, tmp_path, cuts):
    rng = random.Random(3)
    keys = [f"k{n}" for n in range(40)]
    attempts = [(rng.choice([*keys, "unknown"]), at, rng.random() < 0.2) for at in range(1, 300)]
    store = OutboxStore(spark, str(tmp_path), tries=4, wait_ms=100)
    store.add(spark.createDataFrame([(k, "a", "p", 1) for k in keys], EVENT), 0, "events")
    size = -(-len(attempts) // cuts)
    for batch in range(cuts):
        some = attempts[batch * size : (batch + 1) * size]
        for _ in range(2):  # run twice
            store.settle(spark.createDataFrame(some, ATTEMPT), batch, "tries")
    got = {r.idempotency_key: (r.status, r.retry_count, r.next_try_at, r.processed_at) for r in store.table.read().collect()}
    want = plain_states(attempts, keys, 4, 100)
    assert got == want and {s[0] for s in want.values()} >= {"PROCESSED", "FAILED"}


def test_a_hot_key_and_expiry(spark, tmp_path):
    store = OutboxStore(spark, str(tmp_path), tries=3)
    store.add(spark.createDataFrame([("hot", "a", "p", 1), ("new", "a", "p", 9)], EVENT), 0, "events")
    store.settle(spark.range(5000).selectExpr("'hot' as idempotency_key", "id as at", "false as ok"), 0, "tries")
    assert {r.idempotency_key: r.status for r in store.table.read().collect()} == {"hot": outbox.FAILED, "new": outbox.PENDING}
    store.empty(5, 0)
    assert {r.idempotency_key: r.payload for r in store.table.read().collect()} == {"hot": None, "new": "p"}
    store.add(spark.createDataFrame([("hot", "a", "again", 1)], EVENT), 1, "events")
    assert store.table.read().count() == 2


# ---------------------------------------------------------------- graph

CHANGE = "op string, id string, name string, source_id string, edge_type string, target_id string, version long"


def plain_graph(changes):
    nodes, gone, edges, cut = {}, {}, {}, {}
    for op, i, name, a, kind, b, v in changes:
        if v is None:
            continue
        if op == "node":
            nodes[i] = max(nodes.get(i, (0, "")), (v, name))
        elif op == "delete":
            gone[i] = max(gone.get(i, 0), v)
        elif kind in ("CALLS", "IMPORTS") and None not in (a, b):
            held = edges if op == "edge" else cut
            held[a, kind, b] = max(held.get((a, kind, b), 0), v)
    alive = {i: x for i, x in nodes.items() if x[0] > gone.get(i, 0)}
    there = {e: v for e, v in edges.items() if v > cut.get(e, 0) and all(i in alive and v > gone.get(i, 0) for i in (e[0], e[2]))}
    return sorted((i, n, v) for i, (v, n) in alive.items()), sorted((*e, v) for e, v in there.items())


def changes_of(rng, count):
    some = lambda: f"n{rng.randrange(12)}"
    out = []
    for _ in range(count):
        op, v = rng.choices(["node", "delete", "edge", "unlink"], [4, 1, 6, 1])[0], rng.randrange(1, 40)
        if op in ("node", "delete"):
            out.append((op, some(), f"name{rng.randrange(3)}" if op == "node" else None, None, None, None, v))
        else:
            out.append((op, None, None, some(), rng.choice(["CALLS", "IMPORTS", "ODD"]), rng.choice([some(), None]), rng.choice([v, v, None])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_a_graph_does_not_depend_on_how_its_feed_is_cut(spark, tmp_path, seed):
    changes = changes_of(random.Random(seed), 150)
    want = plain_graph(changes)
    assert want[0] and want[1]
    for cuts in (1, 3, 10):
        random.Random(cuts).shuffle(changes)
        feed = GraphFeed(spark, str(tmp_path / f"g{cuts}"), "name STRING", buckets=3)
        size = -(-len(changes) // cuts)
        for batch in range(cuts):
            feed.apply(spark.createDataFrame(changes[batch * size : (batch + 1) * size], CHANGE), batch, "feed")
        feed.apply(spark.createDataFrame(changes[:9], CHANGE), 0, "read again")
        assert sorted(tuple(r) for r in feed.nodes().collect()) == want[0]
        assert sorted(tuple(r) for r in feed.edges().collect()) == want[1]


def test_adds_and_deletes_of_one_batch(spark, tmp_path):
    made, gone = ("node", "a", "A", None, None, None, 1), ("delete", "a", None, None, None, None, 2)
    for n, order in enumerate(itertools.permutations([made, gone, ("node", "a", "B", None, None, None, 3)])):
        feed = GraphFeed(spark, str(tmp_path / f"x{n}"), "name STRING", buckets=1)
        feed.apply(spark.createDataFrame(list(order[:2]), CHANGE), 0)
        feed.apply(spark.createDataFrame(list(order[2:]), CHANGE), 1)
        assert [tuple(r) for r in feed.nodes().collect()] == [("a", "B", 3)]
    feed = GraphFeed(spark, str(tmp_path / "y"), "name STRING", buckets=1)
    feed.apply(spark.createDataFrame([made, gone], CHANGE), 0)
    assert feed.nodes().count() == 0
