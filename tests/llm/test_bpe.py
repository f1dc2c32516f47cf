import hashlib

from tokenizers import Tokenizer

from siftgraph.llm import bpe
from siftgraph.llm.common import tokenizer_path

ODD = ["", " ", "\x1c\x1d a\x85b　c", "İstanbul ΑΣ ΣΑΣ", "a<|endoftext|>b", "<|startoftext|> x", "don't 're it's 'S", "é Å ﬁ", "12345 ½ ² ٣", "日本語テスト 한국어 🎉", "a\x00b", "​‍ x", "Ǆ ẞ ß", "..!!?? __a_b", "ſ'ſ K's"]


def expected(text):
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_against_the_library(spark, documents):
    extra = spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string")
    both = documents.select("doc_id", "text").union(extra)
    got = sorted(map(tuple, bpe.encode(both, tokenizer_path()).collect()), key=str)
    assert got == sorted(((r["doc_id"], *expected(r["text"])) for r in both.collect()), key=str)


def test_ids_of_any_type_and_clashing_columns(spark):
    rows = [(None, "a"), (2**53 + 1, "b c"), (2**60 + 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as n_tokens", "'y' as ids").coalesce(1)
    assert {(r["doc_id"], r["n_tokens"]) for r in bpe.encode(df, tokenizer_path()).collect()} == {(i, expected(t)[0]) for i, t in rows}
    named = bpe.encode(df.selectExpr("cast(doc_id as string) as key", "text"), tokenizer_path(), id_col="key")
    assert {r["key"] for r in named.collect()} == {None, str(2**53 + 1), str(2**60 + 3)}


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode(docs, tokenizer_path()).collect()}
    assert got == {r["doc_id"]: expected(r["text"]) for r in docs.collect()}


def test_empty_table_and_round_trip(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
    row = bpe.encode(spark.createDataFrame([(1, "Hello  world")], "doc_id long, text string"), tokenizer_path(), with_ids=True).first()
    assert row["n_tokens"] == len(row["ids"]) and row["decoded"].replace("</w>", "").split() == ["hello", "world"]


def test_kept_outlives_a_full_table():
    made = []
    kept = bpe.Kept(lambda k: made.append(k) or k.upper(), 2)
    assert [kept[k] for k in "abacada"] == list("ABACADA") and made == list("abcd")


def test_short_words_need_no_queue(spark, monkeypatch):
    encoder = bpe.Encoder(tokenizer_path())
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in encoder.words(r["text"])} | {w for x in ODD for w in encoder.words(x)} | {"aaaa", "ababab" * 6}
    queued = {w: encoder._merge_queued(encoder._symbols(w)) for w in words if w not in encoder.special}
    monkeypatch.setattr(bpe.heapq, "heapify", None)
    assert {w: encoder.merge(w) for w in queued if len(w.encode()) <= bpe.SHORT} == {w: ids for w, ids in queued.items() if len(w.encode()) <= bpe.SHORT}
    assert bpe._packed([1, 70_000]) == b"\1\0\0\0\x70\x11\1\0"
