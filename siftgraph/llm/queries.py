"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.llm import bpe, fill_in_middle, hard_negatives, html_extract, jaccard_join, lm_scoring, media, packing, top_k, toxicity, url_filter
from siftgraph.llm.common import table, tokenizer_path
from siftgraph.llm.exact_dedup import exact_dedup
from siftgraph.llm.secret_scan import scan


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.pictures_of_vectors(table(spark, sf_dir, "embeddings")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.entries_of(pages, url_filter.RULES), url_filter.entries_of(pages, url_filter.BLOCKED))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


_ALL = [
    op1_media_columns, op2_html_extraction, op3_packing, op4_lm_scoring, op5_toxicity, op6_url_filters, op7_bpe, op8_jaccard_join, op9_exact_dedup, op10_secret_scans,
    op11_top_k_search, op12_fill_in_middle, op13_hard_negatives,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: Rows of embeddings that take part, each component x as floor(scale * x), and the inner product of two of them.
_VECTORS = """v AS (SELECT vec_id, label, row_number() OVER () AS row_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"""
_PRODUCT = "coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)"

_values = lambda rows: ", ".join(str(r) for r in rows)

ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": f"""
        WITH rules AS (SELECT * FROM (VALUES {_values(url_filter.RULES)}) AS v(rhost, rpath, rverdict)),
        listed AS (SELECT * FROM (VALUES {_values(url_filter.BLOCKED)}) AS v(lhost, lpath, lverdict)),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        m AS (SELECT page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS nth
              FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
        b AS (SELECT DISTINCT host AS bhost FROM p JOIN listed ON host = lhost OR ends_with(host, '.' || lhost))
        SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rverdict, CASE WHEN bhost IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.nth = 1 LEFT JOIN b ON p.host = b.bhost""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                          sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)""",
    "op11_top_k_search": f"""
        WITH {_VECTORS.format(scale=64)},
        s AS (SELECT a.row_id AS asks, a.vec_id AS query_id, b.vec_id, CAST({_PRODUCT} AS BIGINT) AS score FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY asks ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        t AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens FROM d),
        u AS (SELECT *, len(tokens) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:n], '') AS suf FROM c),
        o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END AS output FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN output ELSE pre || mid || suf END) AS restored_sha256 FROM o""",
    "op13_hard_negatives": f"""
        WITH {_VECTORS.format(scale=256)},
        l AS (SELECT vec_id, row_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
        s AS (SELECT a.row_id AS asks, a.vec_id AS anchor_id, b.vec_id, b.row_id, a.label = b.label AS alike, CAST({_PRODUCT} AS BIGINT) AS score
              FROM l a JOIN l b ON a.row_id <> b.row_id WHERE a.vec_id % 100 = 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY asks ORDER BY score DESC, vec_id) AS nth FROM s WHERE alike),
        m AS (SELECT f.asks, f.anchor_id, f.nth, f.vec_id AS positive_id, f.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY f.asks, f.nth ORDER BY s.score DESC, s.vec_id) AS rank
              FROM f JOIN s ON f.asks = s.asks AND NOT s.alike AND 30 * f.score <= 100 * s.score AND 100 * s.score <= 90 * f.score WHERE f.nth <= 5)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 10""",
}
