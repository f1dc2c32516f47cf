import collections
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftgraph.llm.common import tokenizer_path
from siftgraph.llm.packing import Windows, pack


def check_packed(rows, texts, size):
    """Every id in exactly one piece, crc of the library's ids, sequences gapless from 0."""
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size
    expected = collections.Counter()
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[doc_id, len(ids)] += 1
        own = by_doc[doc_id, len(ids)]
        assert sum(r["length"] for r in own) % len(ids) == 0
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert {k: sum(r["length"] for r in v) for k, v in by_doc.items()} == {k: k[1] * n for k, n in expected.items()}
    return by_sequence


def test_small(spark, documents):
    beside_nulls = spark.createDataFrame([(2**53 + 1, "an id beyond doubles"), (None, "x"), (2**60 + 3, "another")], "doc_id long, text string").coalesce(1)
    docs = documents.select("doc_id", "text").union(beside_nulls).withColumn("window", F.lit("x"))
    rows = pack(docs, tokenizer_path(), size=64, open_windows=2, group=3).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 64)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = check_packed(pack(docs, tokenizer_path()).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    filled = [sum(n for _, n in x) for x in found.values()]
    assert sum(2048 - n for n in filled if n & (n - 1)) < 0.02 * sum(filled)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_best_fit_and_fullest():
    w = Windows(10, 2)
    assert w.put(6, "a") is None and w.put(7, "b") is None
    assert w.put(3, "c") == (1, [(0, "b"), (7, "c")])  # best fit, and full
    w.put(8, "d")
    assert w.put(5, "e") == (2, [(0, "d")])  # none fits: the fullest goes
    assert sorted(x[1] for x in w.rest()) == [5, 6]
