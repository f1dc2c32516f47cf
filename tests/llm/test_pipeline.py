import corpus_pipeline
from siftgraph.llm import secret_scan, toxicity
from siftgraph.llm.common import tokenizer_path

from .test_exact_dedup import brute as exact
from .test_jaccard_join import brute as near
from .test_packing import check_packed

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    clean = stages["toxicity"](spark, docs, SF)
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).collect() if r["predicted"]}
    assert clean.columns == docs.columns and texts(clean).keys() == texts(docs).keys() - toxic

    single = stages["exact dedup"](spark, clean, SF)
    assert single.columns == docs.columns and texts(single).keys() == {r[0] for r in exact(sorted(texts(clean).items())) if r[3]}

    apart = stages["n-gram Jaccard join"](spark, single, SF)
    own = texts(single)
    ids = sorted(own)
    roots, _ = near([own[k] for k in ids])
    assert apart.columns == docs.columns and texts(apart).keys() == {ids[r] for r in roots}

    masked = stages["secret scans"](spark, apart, SF)
    assert masked.columns == docs.columns and texts(masked).keys() == texts(apart).keys()
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(apart).collect()}
    assert all((texts(apart)[k] == t) == (spans[k] == "") for k, t in texts(masked).items())
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect())

    packed = stages["packing"](spark, masked, SF)
    check_packed(packed.collect(), sorted(texts(masked).items()), 2048)


def test_run(spark):
    assert tokenizer_path()
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, documents):
    """Nulls, repeated rows and ids, empty and long texts, columns whose names the stages use themselves, and an empty table."""
    docs = documents.selectExpr("*", "1 as score_", "2 as row_", "3 as doc_", "4 as text_", "5 as set", "6 as path", "7 as base", "8 as n_chars")
    for rows in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= rows.count()
