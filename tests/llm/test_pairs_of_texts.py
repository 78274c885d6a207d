"""Substring dedup, SimHash and the similarity stage against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import defaultdict

import xxhash
from codeloom.llm import common, components, queries
from codeloom.llm.similar import keep_one_of_each
from codeloom.llm.simhash import near_duplicates
from codeloom.llm.substrings import cover_for, dedup_substrings
from pyspark.sql import functions as F

from .helpers import DOCS, awkward, split, words


def test_cover_takes_every_pair_of_places_in():
    for window in (2, 5, 13, 30, 64):
        period, cover, width = cover_for(window)
        assert period + width - 1 == window
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def plain_substrings(rows, window=13):
    starts = defaultdict(lambda: 1 << 63)
    key = lambda i: (1 << 63) - 1 if i is None else i
    for i, text, *_ in rows:
        w = split(text)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            starts[s] = min(starts[s], key(i))
    out = []
    for i, text, *_ in rows:
        w = split(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def test_substrings_match_the_plain_version(spark):
    rows = awkward()
    for block_bytes in (1 << 11, 8 << 20):
        got = dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(3), block_bytes=block_bytes)
        assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "removed"]
        found = got.collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, b" ".join(split(r.text))) for r in found], key=str) == plain_substrings(rows)
        assert all(sum(s.length for s in r.removed) == r.n_removed for r in found)
        assert sum(r.text is None for r in found) == sum(r[1] is None for r in rows)


def test_substrings_of_empty_and_clashing_tables(spark):
    assert dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, N_Words int, block string")
    assert dedup_substrings(odd).columns == ["doc_id", "text", "block", "n_words", "n_removed", "removed"]


def test_substring_query_digests(spark, sf):
    got = {r.doc_id: r for r in queries.op6_substring_dedup(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(rows)
    for i, n, gone, kept in plain_substrings(rows):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())


def plain_fingerprint(text, width):
    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in split(text)]
    shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rng = random.Random(9)
    rows = awkward(9)
    base = words(rng, 4000)
    for k in range(12):  # a chain of small edits
        base[rng.randrange(len(base))] = f"edit{k}"
        rows.append((1000 + k, " ".join(base), "en"))
    got = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), words=3).collect()
    fps = sorted({plain_fingerprint(t, 3) for _, t, _ in rows})
    group = {f: f for f in fps}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2:
                group[top(a)] = top(b)
    least = {}
    for i, t, _ in rows:
        r = top(plain_fingerprint(t, 3))
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted([(i, plain_fingerprint(t, 3), least[top(plain_fingerprint(t, 3))]) for i, t, _ in rows], key=str)
    assert sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], key=str) == want
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x", "y", "z")], "doc_id long, text string, FP int, code string, root string, least string")
    assert near_duplicates(odd).columns == ["doc_id", "text", "code", "root", "least", "fp", "component_id"]


def test_components_with_a_hub_and_a_chain(spark, monkeypatch):
    rng = random.Random(21)
    edges = [(5000, k) for k in range(2000)] + [(k, k + 1) for k in range(6000, 6200)] + [(7000, 7000), (None, 3), (7001, 7002)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "x long, y long")
    want = {k: 0 for k in [*range(2000), 5000]} | {k: 6000 for k in range(6000, 6201)} | {7001: 7001, 7002: 7001}
    for least in (components.DEALT_FROM, 1):
        monkeypatch.setattr(components, "DEALT_FROM", least)
        got = [(r.node, r.root) for r in components.connected_components(frame, "x", "y").collect()]
        assert len(got) == len(want) and dict(got) == want


def test_rows_of_a_frequent_text_are_dealt_out(spark):
    left = spark.createDataFrame([(k % 7 if k % 3 else 1, k % 5, {"a": 1}) for k in range(3000)], "k long, salt long, m map<string,int>").repartition(6)
    right = spark.createDataFrame([(k, f"r{k}") for k in range(6)], "k long, SALTS string")
    counts = left.groupBy("k").agg({"*": "count"}).toDF("k", "n")
    hot = common.hot_keys(counts, ["k"], 200)
    assert sorted((r.k, r.salts) for r in hot.collect()) == [(k, -(-n // 200)) for k, n in sorted(counts.collect()) if n > 200]
    for how in ("inner", "left"):
        got = common.dealt_join(left, right, ["k"], hot, how)
        plain = left.join(right, "k", how)
        assert got.columns == plain.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_one_of_each_similar_group_stays(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        text = words(rng, 300, 5000)
        rows.append((10 * k, " ".join(text), "en"))
        for c in range(k % 4):
            copy = list(text)
            for _ in range(2):
                copy[rng.randrange(300)] = f"new{k}-{c}"
            rows.append((10 * k + 1 + c, " ".join(copy), "en"))
    rows += [(2000, None, None), (2001, "", "en"), (2001, "", "en"), (None, rows[0][1], "en")]
    kept = keep_one_of_each(spark.createDataFrame(rows, DOCS).repartition(4))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in kept.collect()) == [*[10 * k for k in range(60)], 2000]
    assert keep_one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_large_groups_of_copies(spark):
    rng = random.Random(7)
    text = words(rng, 400, 5000)
    rows = [(0, " ".join(text), "en")]
    for k in range(1, 150):
        copy = list(text)
        copy[rng.randrange(400)] = f"new{k}"
        rows.append((k, " ".join(copy), "en"))
    assert [r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()] == [0]


def plain_groups(rows, similarity=0.8, width=5):
    """The least id of each component, by the exact similarity of all pairs."""
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (t.lower().split() for _, t, *_ in rows)]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= similarity * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                a, b = sorted((top(x), top(y)))
                group[b] = a
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted(least.values())


def changed(rng, text, n, tag):
    copy = list(text)
    for j, at in enumerate(rng.sample(range(len(copy)), n)):
        copy[at] = f"{tag}.{j}"
    return copy


def test_pairs_inside_a_large_template_group(spark):
    rng = random.Random(11)
    template = words(rng, 200, 5000)
    rows = []
    for k in range(500):  # alike at 0.6 to 0.7, each with a copy at about 0.9
        text = changed(rng, template, 4, f"t{k}")
        rows += [(2 * k, " ".join(text), "en"), (2 * k + 1, " ".join(changed(rng, text, 2, f"c{k}")), "en")]
    want = plain_groups(rows)
    assert 400 < len(want) <= 500
    assert sorted(r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()) == want


def near_the_limit(rng, n=150):
    """Pairs of texts alike at 0.7 to 0.9."""
    rows = []
    for k in range(n):
        text = words(rng, 120, 5000)
        rows += [(2 * k, " ".join(text), "en"), (2 * k + 1, " ".join(changed(rng, text, rng.randrange(1, 5), f"p{k}")), "en")]
    return rows


def test_similarity_is_that_of_the_shingles(spark):
    rows = near_the_limit(random.Random(12))
    want = plain_groups(rows)
    assert len(rows) * 0.55 < len(want) < len(rows) * 0.95
    assert sorted(r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()) == want


def test_links_do_not_depend_on_the_corpus_size(spark):
    rng = random.Random(13)
    rows = near_the_limit(rng)
    strangers = [(1000 + k, " ".join(words(rng, 30, 5000)), "en") for k in range(6000)]
    want = plain_groups(rows)
    for more in ([], strangers):
        kept = keep_one_of_each(spark.createDataFrame([*rows, *more], DOCS).repartition(4)).collect()
        assert sorted(r.doc_id for r in kept) == want + [r[0] for r in more]


def test_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """Each of twelve passages once in every partition, so that no task sees it
    twice: its texts are not alike, and aren't compared, while copies are."""
    from codeloom.llm import similar

    rng = random.Random(17)
    passages = [words(rng, 30, 5000) for _ in range(12)]
    rows = [(12 * k + j, " ".join(words(rng, 200, 5000) + passage + words(rng, 200, 5000)), "en") for k in range(40) for j, passage in enumerate(passages)]
    copies = [(1000 + k, " ".join(changed(rng, rows[7 * k][1].split(), 3, f"s{k}")), "en") for k in range(20)]
    compared, links = [], similar._links

    def counted(blocks, pairs, *more):
        compared.append(pairs.filter("a != b").count())
        return links(blocks, pairs, *more)

    monkeypatch.setattr(similar, "_links", counted)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 40), DOCS).union(spark.createDataFrame(copies, DOCS))
    assert sorted(r.doc_id for r in keep_one_of_each(docs).collect()) == list(range(480))
    assert 20 <= sum(compared) < 40


def within_two(fps):
    return {(x, y) for x in range(len(fps)) for y in range(x + 1, len(fps)) if (fps[x] ^ fps[y]).bit_count() <= 2}


def test_simhash_finds_its_links_before_the_set_join(spark, monkeypatch):
    """The first pairs compared are those within two bits by brute force, the
    set join doesn't compare them again, and the groups are the exact ones."""
    import pyarrow as pa
    from codeloom.llm import similar
    from codeloom.llm.simhash import fingerprint

    rng = random.Random(21)
    rows = near_the_limit(rng, 30)
    for k in range(30):
        text = words(rng, 1000, 5000)
        rows += [(100 + 2 * k, " ".join(text), "en"), (101 + 2 * k, " ".join(changed(rng, text, 1, f"q{k}")), "en")]
    h, first = similar.shingle_sets(pa.array([t for _, t, _ in rows]), 5)
    near = within_two([fingerprint(h[a:b]) & (1 << 64) - 1 for a, b in zip(first[:-1], first[1:])])
    compared, links = [], similar._links

    def seen(blocks, pairs, *more):
        compared.append({tuple(r) for r in pairs.filter("a != b").collect()})
        return links(blocks, pairs, *more)

    monkeypatch.setattr(similar, "_links", seen)
    kept = sorted(r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == plain_groups(rows)
    assert len(compared[0]) == len(near) > 10
    assert len(compared[1]) > 10 and not compared[0] & compared[1]


def test_pairs_of_near_fingerprints(spark):
    """Each fingerprint with another near it is met, by two pairs a row at most."""
    from codeloom.llm.similar import near_fingerprints

    rng = random.Random(22)
    fps = [0] * 40 + [(1 << 63) - 1]
    for _ in range(60):
        base = rng.getrandbits(64) - (1 << 63)
        fps += [base, base ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63), base ^ 7 << rng.randrange(60)]
    uids = rng.sample(range(10_000), len(fps))
    fp_of = dict(zip(uids, fps))
    got = [tuple(r) for r in near_fingerprints(spark.createDataFrame(list(fp_of.items()), "uid long, fp long")).collect()]
    assert len(got) == len(set(got)) <= 2 * len(fps) and all(a < b for a, b in got)
    assert all(((fp_of[a] ^ fp_of[b]) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    met = {fp_of[x] for pair in got for x in pair}
    assert met == {x for x in fps if sum(((x ^ y) & (1 << 64) - 1).bit_count() <= 2 for y in fps) > 1}
    assert sum(fp_of[a] == 0 == fp_of[b] for a, b in got) == 39


def test_simhash_links_are_verified(spark, monkeypatch):
    """Wrong links of fingerprints join nothing, and part nothing."""
    from codeloom.llm import similar

    rows = near_the_limit(random.Random(23), 40)
    monkeypatch.setattr(similar, "near_fingerprints", lambda least: common.checkpointed(least.selectExpr("least(uid, uid ^ 1) as a", "greatest(uid, uid ^ 1) as b").distinct().join(least.select("uid"), F.col("b") == F.col("uid")).select("a", "b")))
    assert sorted(r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()) == plain_groups(rows)


def test_workers_give_back_what_earlier_tasks_took():
    """Python workers live on, and so did what a task had freed: the groups are
    found beside the least memory (in a session of its own)."""
    code = """
import sys
import pyarrow as pa
from pyspark.sql import SparkSession
from codeloom.llm.similar import keep_one_of_each

def taken(batches):
    for b in batches:
        many = [bytes(5000) for _ in range(40_000)]
        sys.last_taken = bytes(5000)  # a cache, say: what lies before it stays with the process
        del many
        yield b

def held(batches):
    for b in batches:
        with open("/proc/self/status") as f:
            yield pa.RecordBatch.from_arrays([pa.array([int(f.read().split("RssAnon:")[1].split()[0]) >> 10])], names=["mb"])

spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").getOrCreate()
most = lambda: max(r.mb for r in spark.range(0, 2, 1, 2).mapInArrow(held, "mb long").collect())
spark.range(0, 2, 1, 2).mapInArrow(taken, "id long").collect()
print("before", most())
docs = spark.createDataFrame([(k, f"a b c d e f g h {k // 2}") for k in range(8)], "doc_id long, text string")
print("kept", keep_one_of_each(docs).count())
print("after", most())
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    said = {k: int(v) for k, v in (line.split() for line in ran.stdout.splitlines())}
    assert said.get("kept") == 4, ran.stderr[-2000:]
    assert said["before"] > 200 and said["after"] < said["before"] - 150, said


def test_no_pair_is_lost_before_it_is_verified():
    """Candidates without Spark, all labels different: every true pair is there,
    in groups around a template, among fragments and in short texts."""
    import numpy as np
    import pyarrow as pa
    from codeloom.llm import similar

    rng = random.Random(5)
    base, texts = words(rng, 200, 5000), []
    for k in range(250):
        text = changed(rng, base, rng.randrange(9), f"x{k}")
        texts.append(" ".join(text[: rng.randrange(120, 200)] if rng.random() < 0.3 else text))
    for k in range(200):
        text = words(rng, rng.randrange(3, 300), 5000)
        texts += [" ".join(text), " ".join(changed(rng, text, rng.randrange(min(5, len(text))), f"y{k}"))]
    texts = list(dict.fromkeys(texts))
    h, first = similar.shingle_sets(pa.array(texts), 5)
    sets = [set(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    true = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                true.add((i, j))
    shingle, count = np.unique(h, return_counts=True)
    frequent = shingle[count > 5][np.argsort(count[count > 5], kind="stable")]
    named = np.zeros(len(texts), similar._LABEL)
    named["row"] = named["label"] = np.arange(len(texts))
    part, entries = similar._entries(pa.table({"text": texts}), [named.tobytes()], "text", 5, 0.8, frequent, 7)
    order = np.argsort(part, kind="stable")
    bodies = [similar._to_planes(entries[order][part[order] == p]) for p in range(7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int32()), pa.array([0] * 7, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "block", "body"])
    found = set()
    for rest in (False, True):
        for b in similar._meet([batch], 0.8, rest):
            found |= {(x, y) for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist()) if x != y}
    assert len(true) > 2000 and true <= found
    assert len(found) < 2 * len(true) < len(texts) ** 2 / 20
