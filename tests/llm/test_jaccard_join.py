import collections
import itertools
import random

import numpy as np
import pytest

from siftgraph.llm import jaccard_join as j
from siftgraph.llm.common import components, shingles


def brute(texts):
    """Links between different sets and the class of each row, by comparing all pairs."""
    sets = [set(shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = collections.Counter()
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            degree[a] += 1
            degree[b] += 1
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return [find(k) for k in range(len(texts))], [degree[k] for k in range(len(texts))]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    roots, degree = brute([texts[k] for k in ids])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.join(docs).collect()}
    assert got == {k: (ids[roots[i]], degree[i]) for i, k in enumerate(ids)}


@pytest.mark.parametrize(("small", "chunk"), [(3, 7), (24, 50), (24, 256)])
def test_a_large_group_of_near_copies(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(j, "SMALL", small)
    monkeypatch.setattr(j, "CHUNK", chunk)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(150):  # near copies of one text, each with a few words of its own
        words = list(base)
        for at in rng.sample(range(300), 3):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"z{k}q{i}" for i in range(120)) for k in range(60)]  # a shared passage, otherwise different
    roots, _ = brute(texts)
    got = {r["doc_id"]: r["class_id"] for r in j.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(roots))


@pytest.mark.parametrize("whole", [20, 1024])
def test_links_of_a_large_group_are_all_counted(spark, monkeypatch, whole):
    monkeypatch.setattr(j, "WHOLE", whole, raising=False)
    rng = random.Random(7)
    texts = []
    for k in range(100):  # near copies of one text, most of them linked with each other
        words = [f"w{i}" for i in range(300)]
        for at in rng.sample(range(300), 1 + k % 4):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    texts += [texts[5]] * 3 + [" ".join(f"z{i + k // 2}" for i in range(200)) for k in range(4)]
    _, degree = brute(texts)
    got = {r["doc_id"]: r["n_links"] for r in j.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(degree))


def test_parities_screen_loses_no_link():
    rng = np.random.default_rng(5)
    stopped = 0
    for n in (1, 2, 5, 31, 400, 5000):
        for _ in range(60):
            shared = rng.integers(0, 2**63, int(n * rng.uniform(0, 1))).astype(np.uint64)
            x, y = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, int(rng.integers(0, n + 1))).astype(np.uint64)])) for _ in range(2))
            both = len(np.intersect1d(x, y))
            may = j.may_link(j.parities(x), len(x), j.parities(y), len(y))
            assert may or both < 0.8 * (len(x) + len(y) - both)
            stopped += not may
    assert stopped > 200


def test_odd_rows(spark, documents):
    rows = [(r["doc_id"], r["class_id"], r["n_links"]) for r in j.join(documents).collect()]
    assert len(rows) == documents.count()
    of = collections.defaultdict(list)
    for k, c, n in rows:
        of[k].append((c, n))
    assert of[2] == [(2, 0)] and of[3] == [(3, 0)] and of[7] == [(7, 0)] and of[1] == of[4][:0] + [(1, 0)]
    assert of[5] == [(5, 1), (5, 1)] and of[None] == [(None, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert j.join(empty).count() == 0 and j.one_of_each(empty).count() == 0


def test_one_of_each_keeps_columns(spark, documents):
    left = j.one_of_each(documents)
    assert left.columns == documents.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, 6, 7, 8], key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + k) for k in range(1, 50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
