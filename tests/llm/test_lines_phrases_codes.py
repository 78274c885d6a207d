"""Line dedup, phrases and vector codes against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import common, queries
from codeloom.llm.codes import Codebook, code_vectors, with_label_error
from codeloom.llm.lines import dedup_lines
from codeloom.llm.phrases import best_phrases, find_phrases

from .helpers import DOCS, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- lines


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and (-1 if i is None else i) != max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g), [k for k, g in enumerate(gone) if g]))
    return sorted(out, key=repr)


def lined(seed, n=60):
    rng = random.Random(seed)
    pool = [f"A common line, number {k} of some that recur" for k in range(12)] + ["ééééé ééééé ééééé ééé", "ééééé ééééé ééééé éé", " nineteen and spaces  "]
    dress = [lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: f"{x}\x0b"]
    rows = []
    for k in range(n):
        lines = [rng.choice(dress)(rng.choice(pool)) if rng.random() < 0.3 else f"only here {k} {rng.random()}" for _ in range(rng.randrange(1, 30))]
        rows.append((k, "\n".join(lines), "en"))
    return [*rows, rows[5], rows[5], (5, "other text of one id\nA common line, number 1 of some that recur", "en"), (None, pool[2], None), (None, pool[2], None), (n, None, "en"), (n + 1, "", "en"), (n + 2, "\n\n", "en"), (n + 3, f"{pool[0]}\n" * 3000, "en")]


def test_lines_match_the_plain_version(spark):
    for seed, limits in ((1, (20, 3)), (2, (1, 2)), (3, (5, 1))):
        rows = lined(seed) + awkward(seed)
        got = dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3), min_chars=limits[0], min_docs=limits[1])
        assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped", "dropped"]
        found = got.collect()
        assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "", r.dropped) for r in found], key=repr) == plain_lines(rows, *limits)
        assert sum(r.text is None for r in found) == sum(r[1] is None for r in rows)


def test_a_line_in_a_third_of_all_documents_is_dealt_out(spark):
    line = "all rights reserved by whoever"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(f"{line}\nx")).otherwise(F.concat(F.lit("a line of its own "), "id", F.lit(" of many"))).alias("text"))
    got = dedup_lines(docs)
    assert got.agg(F.sum("n_dropped")).first()[0] == 999
    assert [r.doc_id for r in got.filter(F.col("text").contains(line)).collect()] == [2997]


def test_copies_of_a_row_are_alike(spark):
    text = "a line that three documents have\nmine"
    docs = spark.range(2000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    got = dedup_lines(docs).groupBy("n_lines", "n_dropped", "text").count().collect()
    assert sorted((r.n_dropped, r.text, r["count"]) for r in got) == [(0, text, 1), (1, "mine", 1999)]


def test_lines_of_empty_and_clashing_tables(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x", "y")], "doc_id long, text string, N_Lines int, id string, _print string")
    got = dedup_lines(odd)
    assert got.columns == ["doc_id", "text", "id", "_print", "n_lines", "n_dropped", "dropped"] and got.first()[2:6] == ("x", "y", 1, 0)


# ---------------------------------------------------------------- phrases


def plain_phrases(rows, least, longest=5, covered=100):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang, text = lang or "und", (text or "").translate(LOWER)
        for mark in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    gone = set()
    for (lang, words), c in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                if 100 * c >= covered * f[part]:
                    gone.add(part)
    out = []
    for (lang, words), a in often.items():
        if (lang, words) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
            score, cut, l, r = min(cuts)  # noqa: E741
            out.append((lang, " ".join(words), len(words), a, l, r, n[lang], score, cut))
    return sorted(out)


def spoken(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "red", "fox", "a", "A", "of", "ümlaut", "x-1", "don't", " ", " z"]
    ends = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "! ", "\x0b"]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))
    rows = [(k, text(), rng.choice(["en", "en", "de", None, "und"])) for k in range(n)]
    return [*rows, rows[0], rows[0], (n, None, "en"), (n + 1, "", None), (n + 2, " .,; ", "fr"), (n + 3, "a " * 5000, "en"), (n + 4, "new york city, " * 30, "xx")]


@pytest.mark.parametrize("least, longest, covered, block_bytes", [(10, 5, 100, 8 << 20), (3, 4, 100, 1 << 11), (5, 5, 60, 1 << 12), (1, 2, 100, 8 << 20), (40, 6, 90, 1 << 13)])
def test_phrases_match_the_plain_version(spark, least, longest, covered, block_bytes):
    rows = spoken(least)
    got = find_phrases(spark.createDataFrame(rows, DOCS).repartition(3), least=least, longest=longest, covered=covered, block_bytes=block_bytes)
    assert got.columns == ["lang", "phrase", "words", "a", "l", "r", "n", "score", "cut"]
    want = plain_phrases(rows, least, longest, covered)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_first_phrases_by_score_count_and_bytes(spark):
    rows = spoken(4)
    found = spark.createDataFrame(plain_phrases(rows, 2), "lang string, phrase string, words int, a long, l long, r long, n long, score long, cut int")
    got = defaultdict(list)
    for r in sorted(best_phrases(found, 7).collect(), key=lambda r: (r.lang, r.rank)):
        got[r.lang].append((r.rank, r.phrase))
    for lang, ranked in got.items():
        want = sorted((r for r in plain_phrases(rows, 2) if r[0] == lang), key=lambda r: (-r[7], -r[3], r[1].encode()))[:7]
        assert ranked == [(k, r[1]) for k, r in enumerate(want, 1)]


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [tuple(rng.randrange(1, 10**12) for _ in range(4)) for _ in range(300)]
    frame = spark.createDataFrame([(a, n * 1000, a + x, a + y) for a, n, x, y in rows], "f long, n long, x long, y long")
    d = lambda c: f"cast({c} as decimal(19, 0))"
    got = frame.selectExpr("f", "n", "x", "y", f"({d('f')} * {d('n')} * cast(1000 as decimal(4, 0))) div ({d('x')} * {d('y')}) as s").collect()
    assert all(r.s == 1000 * r.f * r.n // (r.x * r.y) for r in got) and any(1000 * r.f * r.n > 1 << 64 for r in got)


def test_phrases_of_empty_and_clashing_tables(spark):
    assert find_phrases(spark.createDataFrame([], DOCS)).count() == 0
    assert find_phrases(spark.createDataFrame([(1, None, None)], DOCS), least=1).count() == 0
    odd = spark.createDataFrame([("a b", "en", 1, 2)], "text string, lang string, id int, part int")
    assert [tuple(r)[:4] for r in find_phrases(odd, least=1).collect()] == [("en", "a b", 2, 1)]


# ---------------------------------------------------------------- codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Codes and errors by id and vector, and the codebooks."""
    ok = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    length = max((len(v) for _, v, _ in ok), default=0)
    width = max(1, -(-length // parts))
    whole = lambda v: [min(max(int(np.floor(float(x) * 1024)) if abs(x) < 1e300 else int(np.sign(x)) << 70, -(2**63 - 1)), 2**63 - 1) for x in v] + [0] * (parts * width - len(v))
    ints = [(i, whole(v), label) for i, v, label in ok]
    first = sorted(zip(ok, ints), key=lambda r: (r[0][0] is None, r[0][0] or 0, [float(x) for x in r[0][1]]))[:entries]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, (_, v, _) in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: [min((far(x, e), k) for k, e in enumerate(book)) for x, book in zip(cut(v), books)]
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in ints:
            for p, (_, k) in enumerate(near(v)):
                held[p, k].append(cut(v)[p])
        for (p, k), xs in held.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = [(i, label, "".join(f"{k:02x}" for _, k in near(v)), min(sum(d for d, _ in near(v)), 2**63 - 1)) for i, v, label in ints]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(seed, n=90, length=8, scale=0.05):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), [rng.gauss(0, scale) for _ in range(length)], rng.choice([1, 2, None])) for _ in range(n)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], 3), (None, rows[6][1], 1), (7, [0.0] * length, 1), (8, [-0.0] * length, None)]
    return [*rows, (1, None, 1), (2, [None] + [0.5] * (length - 1), 1), (3, [float("nan")] * length, 1), (4, [float("inf")] * length, None), (5, [float("-inf")] + [0.0] * (length - 1), 2)]


@pytest.mark.parametrize("rows, entries", [(vectors(1), 16), (vectors(2), 256), (vectors(3, scale=3e4), 12), (vectors(4, scale=1e8), 5), (vectors(5, 40, 7), 9), ([*vectors(6, 30), (9, [0.25, 1.0], 5), (10, [], None)], 8), (vectors(7, 300, 4, 0.002), 32)])
def test_codes_match_the_plain_version(spark, rows, entries):
    coded = code_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries)
    want, digest = plain_codes(rows, entries=entries)
    assert coded.rows.columns == ["vec_id", "label", "code", "error"]
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in coded.rows.collect()], key=repr) == want
    assert coded.sha256 == digest


def test_components_beyond_longs(spark):
    rows = [(k, [x, -x, 0.5, x / 3], 1) for k, x in enumerate([1e300, 1e20, 1.0, 2.0, 9e14])]
    coded = code_vectors(spark.createDataFrame(rows, VECTORS), entries=2)
    want, digest = plain_codes(rows, entries=2)
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in coded.rows.collect()], key=repr) == want and coded.sha256 == digest
    assert {r.label_error for r in with_label_error(coded.rows).collect()} == {2**63 - 1}


def test_search_finds_the_nearest_whatever_the_start():
    rng = np.random.default_rng(3)
    for kind, scale in ((np.float64, 30), (np.float64, 3), (np.int64, 1 << 27), (object, 1 << 40)):
        book, x = rng.integers(-scale, scale, (40, 4)), rng.integers(-scale, scale, (300, 4)).astype(kind)
        book[7] = book[21]
        far = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
        best, least = Codebook(book, kind).nearest(x, rng.integers(0, 40, 300))
        assert [int(d) for d in least] == [min(r) for r in far.tolist()]
        assert best.tolist() == [r.index(min(r)) for r in far.tolist()]


def test_errors_of_labels(spark):
    coded = code_vectors(spark.createDataFrame(vectors(8), VECTORS), entries=16).rows
    sums = defaultdict(int)
    for r in coded.collect():
        sums[r.label] += r.error
    got = with_label_error(coded)
    assert got.columns == [*coded.columns, "label_error"]
    found = got.collect()
    assert {r.label: r.label_error for r in found} == sums and len(found) == coded.count() and None in sums


def test_codes_of_empty_and_clashing_tables(spark):
    empty = code_vectors(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert empty.rows.count() == 0 and empty.sha256 == hashlib.sha256(b"").hexdigest() and with_label_error(empty.rows).count() == 0
    odd = spark.createDataFrame([(1, [0.5, 1.0], "l", 5, 6, 7, 8)], "vec_id long, embedding array<float>, label string, Code int, row int, x int, codes int")
    got = code_vectors(odd, parts=2)
    assert got.rows.columns == ["vec_id", "label", "row", "x", "codes", "code", "error"] and got.rows.first() == (1, "l", 6, 7, 8, "0000", 0)


# ---------------------------------------------------------------- queries


def test_queries_of_lines_and_phrases(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in common.read_table(spark, sf, "documents").collect()]
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, sf).collect()], key=repr)
    assert got == sorted([(i, n, g, hashlib.sha256(kept.encode()).hexdigest()) for i, n, g, kept, _ in plain_lines(rows)], key=repr)
    found = defaultdict(list)
    for r in plain_phrases(rows, 100):
        found[r[0]].append(r)
    want = {(lang, k, r[1], *r[3:8]) for lang, all_of in found.items() for k, r in enumerate(sorted(all_of, key=lambda r: (-r[7], -r[3], r[1].encode()))[:2000], 1)}
    assert {tuple(r) for r in queries.op12_phrases(spark, sf).collect()} == want
