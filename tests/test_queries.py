"""Every query with SQL gives DuckDB's rows; every query gives its columns on
empty tables' views too."""

from decimal import Decimal

import duckdb
import pytest

from codeloom.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value as both engines give it: numbers by value, lists in lists."""
    if isinstance(v, Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, values):
    """Typed rows with their columns by name, in an order of their own."""
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in at) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    mine, want = QUERIES[name](spark, sf).toArrow(), duck.sql(SQL[name])
    assert sorted(mine.column_names) == sorted(want.columns)
    assert rows(mine.column_names, zip(*[c.to_pylist() for c in mine.columns], strict=True)) == rows(want.columns, want.fetchall())


def test_search_equals_pair_by_pair(spark, sf):
    from codeloom.operators.search import match_score

    got = {(r.query, r.id): r.score for r in QUERIES["symbol_search_full"](spark, sf).collect()}
    want = {}
    for p in spark.read.parquet(f"{sf}/part.parquet").collect():
        for q in ("smal rign", "blueBolt", "old giszmo", "economy"):
            s = match_score(q, p.p_name, p.p_brand, p.p_type)
            if s:
                want[q, p.p_partkey] = s
    assert got == want and len(set(want.values())) > 3


def test_search_join_equals_pair_by_pair(spark, sf):
    from codeloom.operators.search import match_score
    from codeloom.plans.more_queries import _asked

    got = {(r.query, r.id): r.score for r in QUERIES["symbol_search_join"](spark, sf).collect()}
    parts, want = spark.read.parquet(f"{sf}/part.parquet").collect(), {}
    for q in {r.query for r in _asked(spark, sf).collect()}:
        scores = {x: match_score(q, *x) for x in {(p.p_name, p.p_brand, p.p_type) for p in parts}}
        want |= {(q, p.p_partkey): s for p in parts if (s := scores[p.p_name, p.p_brand, p.p_type])}
    assert got == want and len(set(want.values())) > 5


def test_bpe_counts_are_the_librarys(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.tokens for r in QUERIES["token_counts_bpe"](spark, sf).collect()} == {i: len(made.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
