"""The fuzzy join against all pairs."""

import random

import pytest

from codeloom.operators import fuzzy, search


def word(rng, letters="abcdeé", most=7):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(1, most)))


def edited(rng, text):
    out = list(text)
    for _ in range(rng.randrange(3)):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.randrange(2)] = rng.choice(["", "x", "E"])
    return "".join(out)


@pytest.mark.parametrize("similarity", [0.8, 0.82, 0.93])
def test_alike_texts_are_all_found(spark, similarity):
    rng = random.Random(int(similarity * 100))
    a = [word(rng, "abc", 9) for _ in range(150)] + ["martha", "dwayne", "dixon", "aaaaaaaaaaaa", "x"]
    b = [edited(rng, x) for x in a] + ["marhta", "duane", "dicksonx", "aaaaaaaaaaab", ""]
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "text string")
    got = {tuple(r) for r in fuzzy.alike(frame(a), frame(b), similarity).collect()}
    assert got == {(x, y) for x in a for y in b if x and y and search.jaro_winkler(x, y) >= similarity} and len(got) > 100


def test_a_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "ONE_LENGTH", 5)
    rng = random.Random(7)
    vocabulary = [word(rng, "abcdegiolnrst", 8) for _ in range(40)] + ["get", "set", "user", "HTTP", "parse"]
    name = lambda: rng.choice(["_", "", " ", "."]).join(rng.choice([str, str.title])(rng.choice(vocabulary)) for _ in range(rng.randrange(1, 4)))
    names = [name() for _ in range(120)]
    symbols = [(k, n, f"src/{rng.choice(vocabulary)}.ts", rng.choice([None, f"about {rng.choice(vocabulary)} things"])) for k, n in enumerate([*names, *names[:20], "parseHTTPUser", "ÉTAT_a"])]
    asked = [edited(rng, rng.choice(names)) for _ in range(60)] + [" getUser ", "get user set", "get get", "http", "état", "zzzz", "a", names[0], names[0], "src/"]
    asked = [q for q in asked if q.strip()]
    frame = spark.createDataFrame(symbols, "id int, symbol_name string, file_path string, docstring string").repartition(3)
    got = {(r.query, r.id): r.score for r in fuzzy.search_join(spark.createDataFrame([(q,) for q in asked], "query string"), frame).collect()}
    want = {}
    for q in asked:
        for i, n, path, doc in symbols:
            score = search.match_score(q, n, path, doc)
            if score:
                want[q, i] = score
    assert got == want and {100, 95, 85, 80, 90, 70, 50} <= set(want.values()) and len(set(want.values())) > 12


def test_blank_queries_and_names_are_passed_over(spark):
    symbols = spark.createDataFrame([(1, "", "p", None), (2, " ", "p", None), (3, "name", "p", "doc"), (4, None, "p", None)], "id int, symbol_name string, file_path string, docstring string")
    queries = spark.createDataFrame([("",), (" ",), (None,), ("name",), ("name",)], "query string")
    assert [tuple(r) for r in fuzzy.search_join(queries, symbols).collect()] == [("name", 3, "name", "p", 100)]
    assert fuzzy.search_join(queries.limit(0), symbols).count() == fuzzy.search_join(queries, symbols.limit(0)).count() == 0
