import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgraph.llm.hard_negatives import mine

SHAPE = "vec_id long, embedding array<float>, label int, rank string, shard int"


def brute(rows, asks, scale=256, positives=5, negatives=10):
    sound = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, v, y) in enumerate(sound):
        if a is None or not asks(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=False)), c is None, c or 0, c, z) for m, (c, w, z) in enumerate(sound) if m != n), key=lambda t: t[:3])
        for s, _, _, p, z in [t for t in scored if t[4] == y][:positives]:
            hard = [t for t in scored if t[4] != y and 30 * -s <= 100 * -t[0] <= 90 * -s]
            out += [(a, p, rank, t[3], -s, -t[0]) for rank, t in enumerate(hard[:negatives], 1)]
    return sorted(out, key=str)


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SHAPE)
    mined = mine(df, F.col("vec_id") % 10 == 0, F.col("label"), **sizes)
    return sorted((tuple(r) for r in mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard": 30, "anchors_of_cell": 4}])
def test_same_as_all_pairs(spark, sizes):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=4), 1)], int(r.integers(0, 4))) for i in range(250)]
    rows += [(2**60 + 10 * k, rows[7][1], 1 if k % 2 else rows[7][2]) for k in range(40)]  # a hot vector of two labels, ids beyond doubles
    rows += [rows[10], (10, rows[11][1], 2)]  # repeated and shared ids
    rows += [(None, rows[0][1], rows[0][2]), (None, rows[3][1], 9), (900, None, 1), (910, rows[1][1], None), (920, [1.0, None], 1), (930, [float("nan")] * 4, 1), (940, [], 1)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and found(spark, rows, **sizes) == want


def test_limits_are_included_and_negative_positives_have_none(spark):
    at = lambda hundredths: [hundredths / 100]
    rows = [(0, at(100), 1), (1, at(100), 1), (2, at(90.0), 2), (3, at(30.0), 2), (4, at(91), 2), (5, at(29), 2), (10, at(-100), 3), (11, at(50), 3)]
    got = found(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert not any(anchor == 10 for anchor, *_ in got)


def test_empty_tables_and_single_labels(spark):
    assert found(spark, []) == found(spark, [(0, [1.0], 1)]) == found(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
