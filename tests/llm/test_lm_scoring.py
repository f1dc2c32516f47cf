import collections
import math
import re
import zlib

import pandas as pd
import pytest

from siftgraph.llm import lm_scoring as lm

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z)), None]


def rem(k):
    return 2 if k is None else zlib.crc32(str(k).encode()) % 10


def brute(rows):
    """The same model by plain dictionaries."""
    def count(which):
        one, two = collections.Counter(), collections.Counter()
        for k, text in rows:
            if which(rem(k)):
                t = tokens(text)
                one.update(t)
                two.update(zip(["<s>", *t], t))
        return one, two, sum(one.values()), len(one)

    def estimates(counts, text):
        one, two, n, v = counts
        t = tokens(text)
        for before, w in zip(["<s>", *t], t):
            c = one[None] if before == "<s>" else one[before]
            yield (0 if c == 0 else math.frexp(c)[1]), two[before, w] / max(c, 1), one[w] / max(n, 1), 1 / (v + 1), one[w]

    main, full = count(lambda r: r >= 2), count(lambda r: r != 0)
    cells = collections.Counter()
    step = lambda p: 1 if p == 0 else round(math.log2(p) * lm.STEPS)
    for k, text in rows:
        if rem(k) == 1:
            cells.update((b, step(p2), step(p1)) for b, p2, p1, _, _ in estimates(main, text))
    weights = lm.mixture(pd.DataFrame([(*c, n) for c, n in cells.items()], columns=["bucket", "bigram", "unigram", "n"]), main[3])
    out = []
    for k, text in rows:
        parts = list(estimates(full, text))
        base = sum(math.log10((c + 0.1) / (full[2] + 0.1 * (full[3] + 1))) for *_, c in parts)
        model = sum(math.log10(weights[b][0] * p2 + weights[b][1] * p1 + weights[b][2] * p0) for b, p2, p1, p0, _ in parts)
        out.append((k, rem(k) == 0, len(parts), sum(c > 0 for *_, c in parts), full[2], base, model))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block_tokens", [50, 10**6])
def test_small(spark, documents, block_tokens):
    more = spark.createDataFrame([(k, f"The word{k % 7} and word{k % 3} The end") for k in range(100, 160)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(more)
    same(lm.score(docs, block_tokens=block_tokens).collect(), brute([tuple(r) for r in docs.collect()]))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lm.score(docs).collect()
    same(got, brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_weights_recover_a_mixture():
    cells = pd.DataFrame({"bucket": 3, "bigram": [-8, 1], "unigram": [-80, -24], "n": [700, 300]})
    w = lm.mixture(cells, 10**9)[3]
    assert w[0] == pytest.approx(0.7, abs=0.02) and w[1] == pytest.approx(0.3, abs=0.02)


def test_empty_and_untrained(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(k for k in range(100) if rem(k) == 0)
    row = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


def test_probabilities_of_the_next_word_sum_to_one():
    cells = pd.DataFrame({"bucket": [0, 0, 1, 1, 3], "bigram": [1, 1, -8, 1, -4], "unigram": [-8, 1, -16, -8, 1], "n": [5, 2, 9, 3, 4]})
    one = collections.Counter(a=6, b=3, c=2, end=4)
    two = {"a": collections.Counter(a=1, b=3, end=2), "never": collections.Counter()}
    n, v = sum(one.values()), len(one)
    weights = lm.mixture(cells, v)
    for before, pairs in two.items():
        w = weights[math.frexp(one[before])[1] if one[before] else 0]
        total = sum(w[0] * pairs[x] / max(one[before], 1) + w[1] * one[x] / n + w[2] / (v + 1) for x in [*one, "unknown"])
        assert total == pytest.approx(1, abs=1e-12)


def test_clashing_columns(spark, documents):
    docs = documents.selectExpr("*", "1 as rem", "2 as block", "3 as score", "4 as n_tokens")
    same(lm.score(docs, range_tokens=20).collect(), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
