import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgraph.llm import vector_blocks as vb
from siftgraph.llm.top_k import NONE, BlockIndex, search

SHAPE = "vec_id long, embedding array<float>, score string, shard int"


def brute(rows, asks, k, scale=64):
    """Rows as (id, vector): what the contract says, pair by pair."""
    sound = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(sound):
        if q is None or not asks(q):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), c is None, c or 0, c) for m, (c, w) in enumerate(sound) if m != n]
        out += [(q, rank, c, -s) for rank, (s, _, _, c) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SHAPE)
    return sorted((tuple(r) for r in search(df, F.col("vec_id") % 3 == 0, k, **sizes).select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "block": 7, "queries_of_cell": 9}])
def test_same_as_all_pairs(spark, sizes):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(300)]
    rows += [(2**60 + 3 * k, rows[6][1]) for k in range(90)]  # a hot vector, ids beyond doubles
    rows += rows[9:12] * 2  # repeated rows
    rows += [(None, rows[0][1]), (None, rows[0][1]), (901, None), (903, []), (906, [1.0, None]), (909, [float("nan")] * 6), (912, [float("inf")] * 6), (915, [0.5] * 9), (918, [-0.0] * 6)]
    assert found(spark, rows, **sizes) == brute(rows, lambda i: i % 3 == 0, 5)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert found(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5) == [(0, 1, 1, 64 * 128), (0, 2, 2, 64 * 128)]
    assert found(spark, [(0, [1.0])]) == found(spark, []) == found(spark, [(None, None)]) == []


def test_values_that_dont_fit_are_told(spark):
    with pytest.raises(Exception, match="smaller scale"):
        found(spark, [(0, [3e38]), (1, [1.0])])


def shard_of(vectors):
    s = vb.Shard.__new__(vb.Shard)
    s.number, s.vectors, s.starts = 0, vectors, np.arange(0, len(vectors) + 1, 10)
    s.ids, s.known, s.rank = np.arange(len(vectors)), np.ones(len(vectors), bool), np.arange(len(vectors))
    return s


def test_blocks_below_the_bound_are_not_scored():
    r = np.random.default_rng(1)
    centres = 40 * np.eye(20, dtype=np.int64)
    vectors = np.repeat(centres, 10, axis=0) + r.integers(-2, 3, (200, 20))
    index = BlockIndex(shard_of(vectors))
    scores, places = index.search(vectors[:50], np.full(50, NONE), 5)
    full = vectors[:50] @ vectors.T
    assert (scores == -np.sort(-full, axis=1)[:, :5]).all()
    assert index.scored < 3 * 50  # of 20 * 50 blocks
    assert (index.bounds(vectors[:50])[:, :, None] >= full.reshape(50, 20, 10)).all()


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**30, 1]], np.int64)
    assert vb.products(a, a)[0, 0] == 2**60 + 1
    with pytest.raises(ValueError, match="64 bits"):
        vb.products(4 * a, a)
