import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftgraph.llm.fill_in_middle import EliasFano, cut, restored, token_ends, transform

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def expected(doc_id, text):
    """What the contract says, with a regular expression and lists."""
    text = text or ""
    tokens = TOKEN.findall(text)
    seed = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(seed[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    output = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(output), sha(text)


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, digest string, part int")
    got = sorted(map(tuple, transform(df, **options).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    return got


ROWS = [(k, t) for k, t in enumerate(["", None, " ", "\t\r\n", "a", " a", "a ", "one two  three four ", "\x1c x", "a <P> b", "<S", "<M> x", "x <", "🎉 é 日本語\x0b y", "trailing \n"] * 6)]


@pytest.mark.parametrize("options", [{}, {"split": 3}, {"digest": lambda t: F.length(t) % 3, "split": 5}])  # the last makes most digests collide
def test_same_as_the_contract(spark, options):
    rows = ROWS + [(None, "a b c"), (None, "a b c"), (5, " a"), (2**60 + 3, "a b c d"), (-7, "neg ative"), (1000, "word " * 40_000 + "end")] + [(2000 + k, "the same hot text ") for k in range(200)]
    got = check(spark, rows, **options)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_empty_table_and_output(spark):
    assert transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = transform(spark.createDataFrame([(k, "one two three four") for k in range(40)], "doc_id long, text string"), texts=True).collect()
    assert all(restored(r["output"], r["form"]) == "one two three four" and sha(r["output"]) == r["output_sha256"] for r in rows)


@given(st.lists(st.integers(1, 3000), max_size=300), st.integers(0, 5))
def test_elias_fano_selects_what_was_packed(gaps, shift):
    numbers = np.cumsum([g << shift for g in gaps]).astype(np.int64)
    packed = EliasFano.pack(numbers)
    found = EliasFano(packed)
    assert found.n == len(numbers) and [found.select(k) for k in range(found.n)] == numbers.tolist()
    if len(numbers):
        assert len(packed) - 9 <= len(numbers) * (3 + np.log2(max(2, numbers[-1] / len(numbers)))) / 8 + 2


@given(st.text("ab <PSM>\t\n é", max_size=40), st.integers(0, 10**6))
def test_tokens_and_round_trip(text, doc_id):
    ends = token_ends(text)
    assert ends.tolist() == [m.end() for m in TOKEN.finditer(text)]
    form, output, _, _ = cut(text, EliasFano(EliasFano.pack(ends)), doc_id, 42)
    assert restored(output, form) == text and (form == "plain" or "<P>" in output)
