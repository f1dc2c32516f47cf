import collections
import hashlib

from siftgraph.llm import exact_dedup as e


def brute(rows):
    groups = collections.defaultdict(list)
    for k, text in rows:
        groups["".join(c for c in text or "" if c not in " \t\n\r\x0b\x0c")].append((k, text or ""))
    out = []
    for norm, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = [False] * len(own)
        kept[own.index(best)] = True
        out += [(k, best[0], len(own), f, sha) for (k, _), f in zip(own, kept, strict=True)]
    return sorted(out, key=str)


def test_small(spark, documents):
    got = sorted(map(tuple, e.exact_dedup(documents).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_hot_groups_and_supports(spark):
    rows = [(k, "same  text" if k % 3 == 0 else f"text {k % 50}" + " " * (k % 7)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for support in (0.001, 0.1, 0.5):
        assert sorted(map(tuple, e.exact_dedup(docs, support=support).collect()), key=str) == brute(rows)
        assert sorted(r["doc_id"] for r in e.keep_one(docs, support=support).collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_keep_one_and_empty(spark, documents):
    left = e.keep_one(documents)
    assert left.columns == documents.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((r[0] for r in brute([(r["doc_id"], r["text"]) for r in documents.collect()]) if r[3]), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert e.exact_dedup(empty).count() == 0 and e.keep_one(empty).count() == 0
