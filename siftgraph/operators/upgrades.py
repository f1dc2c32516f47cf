"""What the scan of calls to upgrade says: blocks and calls by language, first samples and notes, of a file or of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgraph.functions import text
from siftgraph.operators.views import UPGRADE
from siftgraph.operators.windows import first_distinct

# The calls that notes are about, and the notes.
LOTUS_CALL, JAVA_CALL = ("lotusscript", "GetDatabase"), ("java", "getDatabase")
BOTH = "Language scoping active: LotusScript GetDatabase and Java getDatabase are counted separately (no cross-language duplication)."
ONLY_LOTUS = "LotusScript database references found; no Java getDatabase hits (LS is not labeled as Java)."


def by_language(blocks: DataFrame, *by: str) -> DataFrame:
    """(by..., language, n_blocks); formulas and rows with only a note aren't among them."""
    return blocks.filter("language is not null").groupBy(*by, "language").agg(F.count(F.lit(1)).alias("n_blocks"))


def hits(blocks: DataFrame, *by: str) -> DataFrame:
    """(by..., language, pattern, n_hits): calls to upgrade, each language's own. Blocks are distinct in their file already."""
    counts = [F.struct(F.lit(language).alias("language"), F.lit(label).alias("pattern"), F.when(F.col("language") == language, F.regexp_count("body", F.lit(p))).alias("n")) for language, label, p in UPGRADE]
    each = blocks.select(*by, F.explode(F.array(*counts)).alias("x")).filter("x.n > 0")
    return each.groupBy(*by, "x.language", "x.pattern").agg(F.sum("x.n").cast("long").alias("n_hits"))


def samples(blocks: DataFrame, *by: str, per_block: int = 3, most: int = 5) -> DataFrame:
    """(by..., language, pattern, nth, sample): the first distinct surroundings of calls by file, block and place, of each block's first calls.

    Each task keeps no more than most samples of a key before they meet.
    """
    cut = lambda m: F.substring(F.replace(text.within_range(F.col("body"), m["start"] - 20, m["end"] + 40), F.lit("\n"), F.lit(" ")), 1, 120)
    of = lambda label, p: F.transform(F.slice(text.matches(F.col("body"), p), 1, per_block), lambda m: F.struct(F.lit(label).alias("pattern"), cut(m).alias("sample"), m["start"].alias("at")))
    found = F.filter(F.array(*(F.when(F.col("language") == language, of(label, p)) for language, label, p in UPGRADE)), lambda x: x.isNotNull())
    keep = list(dict.fromkeys([*by, "source_file", "pos"]))
    each = blocks.filter("language is not null").select(*keep, "language", F.explode(F.flatten(found)).alias("x")).select(*keep, "language", "x.pattern", "x.sample", "x.at")
    return first_distinct(each, [*by, "language", "pattern"], ["sample"], most, "source_file", "pos", "at").select(*by, "language", "pattern", "nth", "sample")


def notes(blocks: DataFrame) -> DataFrame:
    """(source_file, note), distinct: what reading a file met, and whether the two languages' calls occur beside each other."""
    is_ = lambda call: F.max((F.col("language") == call[0]) & (F.col("pattern") == call[1]))
    met = hits(blocks, "source_file").groupBy("source_file").agg(is_(LOTUS_CALL).alias("lotus"), is_(JAVA_CALL).alias("java"))
    scoped = met.filter("lotus").select("source_file", F.when(F.col("java"), BOTH).otherwise(ONLY_LOTUS).alias("note"))
    return blocks.filter("note is not null").select("source_file", "note").union(scoped).distinct()
