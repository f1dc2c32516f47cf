"""Every registered query with SQL against DuckDB over the same files, at a small scale."""

import math

import duckdb
import pytest

from siftgraph.plans import answer_queries, catalog, exports_queries, queries, unit_queries, upkeep_queries  # noqa: F401  all but the catalog register theirs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [str(x) for x in r]
    left, right = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key), sorted(got.fetchall(), key=key)
    assert len(left) == len(right)
    assert all(same(x, y) for a, b in zip(left, right, strict=True) for x, y in zip(a, b, strict=True))


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10 and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
