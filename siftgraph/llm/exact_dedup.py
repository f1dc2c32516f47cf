"""Exact deduplication: heavy hitters are removed map-side, the other digests are shuffled.

Misra-Gries (Spark's ``freqItems``) proposes frequent digests; a counting pass verifies them and finds
the row of each that stays. There are at most 1/support of them, so their table is broadcast: rows of
hot groups never shuffle. All other rows are aggregated by digest, in part before they shuffle, and join the winner of theirs.

Defined results: null text counts as empty, and all texts without letters form one group; null doc_ids
sort last, and of rows that tie in length and doc_id exactly one stays; an empty table gives no rows;
extra columns are ignored by ``exact_dedup`` and kept by ``keep_one``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgraph.llm.common import materialise, small_or_shuffled

#: A digest with more than this share of the rows is a heavy hitter; 1/SUPPORT bounds the broadcast table (128 KB).
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]."""
    return reduce(lambda c, x: F.replace(c, F.lit(x)), " \n\t\r\x0b\x0c", F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _best() -> Column:
    """The row that stays: the longest text, then the smallest id; what is smallest is largest among complements."""
    return F.max(F.struct("len", F.bitwise_not("id").alias("id"), F.bitwise_not("row").alias("row"))).alias("best")


def heavy_hitters(keys: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, hot_size, hot_len, hot_id, hot_row) of each frequent digest: verified counts and winners, 1/support rows at most."""
    proposed = keys.select("digest").freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = (
        keys.join(F.broadcast(proposed), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("hot_size"), _best())
    )
    return counted.filter("hot_size > 1").select("digest", "hot_size", F.col("best.len").alias("hot_len"), F.bitwise_not("best.id").alias("hot_id"), F.bitwise_not("best.row").alias("hot_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. The longest text of a group stays, then the smallest id."""
    keys = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(F.length(text_col), F.lit(0)).alias("len"),
            digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    hot = materialise(heavy_hitters(keys, support))
    marked = keys.join(F.broadcast(hot), "digest", "left")
    of_hot = marked.filter("hot_size is not null").select(
        "id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), (F.col("row") == F.col("hot_row")).alias("kept"), "digest"
    )
    rest = keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    found = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _best())  # before any shuffle, in part
    of_rest = rest.join(found, "digest").select("id", F.bitwise_not("best.id").alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not("best.row")).alias("kept"), "digest")
    return of_hot.union(of_rest).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns. Where ids are unique and known, texts never shuffle unless losers are too many to send."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
    if ids["n"] == ids["d"]:
        losers = materialise(exact_dedup(docs, id_col, text_col, support).filter(~F.col("kept")).select(id_col))
        return docs.join(small_or_shuffled(losers), id_col, "left_anti").select(docs.columns)
    whole = docs.select(
        F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("len"), digest(F.col(text_col)).alias("digest")
    )
    keys = materialise(whole.select("id", "len", "digest", F.lit(0).alias("row")))
    hot = materialise(heavy_hitters(keys, support))
    best = Window.partitionBy("digest").orderBy(F.desc("len"), F.asc_nulls_last("id"))
    of_hot = whole.join(F.broadcast(hot), "digest").filter((F.col("len") == F.col("hot_len")) & F.col("id").eqNullSafe(F.col("hot_id")))
    of_rest = whole.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    left = [x.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("doc.*") for x in (of_hot.select("doc", "id", "len", "digest"), of_rest.select("doc", "id", "len", "digest"))]
    return left[0].union(left[1])
