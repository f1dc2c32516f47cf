"""Secret scans: fixed rules, and character Markov models of random strings against ordinary identifiers.

Everything is built from DataFrame functions. A pattern's spans come from the pieces between its matches:
``split`` gives the gaps, ``regexp_extract_all`` the matches, and running sums of their lengths, made in chunks, the offsets.
The Markov models are first-order over characters, counted from labelled samples with a groupBy, and applied as one array lookup for
each pair of characters of a token: a run of token characters with a digit and a letter, or a longer one with letters of both cases. A token whose
log-likelihood ratio passes MARGIN for each character and LEAST_LLR in all is a further secret unless it touches a span of the rules: these are
blanked, by a mark that tokens may hold, before tokens are looked for.

Defined results: null text counts as empty and gives no spans; repeated rows are scanned alike; an empty
table gives no rows; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.functions.text import CHUNK, chunks, let, matches, running, within

# The rules' patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs that are long enough
#: Where rule spans have been blanked; part of a token there, so that what touches one is known.
BLANK = "\x01"
#: What the models judge: whole runs of token characters, of 8 or more with a digit and a letter, or of 16 or more with letters of both cases.
TOKEN = (
    r"(?<![A-Za-z0-9+/_=\x01-])(?:(?=[A-Za-z+/_=\x01-]*[0-9])(?=[0-9+/_=\x01-]*[A-Za-z])[A-Za-z0-9+/_=\x01-]{8,}"
    r"|(?=[A-Z+/_=\x01-]*[a-z])(?=[a-z+/_=\x01-]*[A-Z])[A-Za-z+/_=\x01-]{16,})"
)
KINDS = ("assign", "access", "hex", "markov")
#: Nats a character by which the random model must lead.
MARGIN, LEAST_LLR = 0.35, 9.0
MOST_SAMPLES = 20_000

_ALPHABET = "".join(map(chr, range(97, 123))) + "".join(map(chr, range(65, 91))) + "0123456789+/_=-"
_WORDS = "get set user name list count index value data file path read write open close node edge graph table column row key map hash tree page text line word item form view agent script field event query index start stop begin end first last next prev size total sum max min time date year month day hour minute second build parse load store save update insert delete remove add find search match replace split join merge sort filter group order limit offset config option flag state status error message handler manager factory service client server request response session cookie header body content type format version number string array object class method function param result output input buffer stream reader writer lock thread pool queue stack cache memory disk image color width height left right top bottom test mock spec main util helper common base core model".split()


def labelled_samples(spark: SparkSession, n: int = MOST_SAMPLES) -> DataFrame:
    """(sample, random): n samples by rule, half of them base64 or alphanumeric noise, half names joined in the usual styles. n bounds the fit."""
    words = F.array(*map(F.lit, _WORDS))
    pick = lambda k: F.element_at(words, (F.abs(F.xxhash64("id", F.lit(k))) % len(_WORDS) + 1).cast("int"))
    noise = F.base64(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)))
    styles = [
        F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat_ws("-", pick(1), pick(2), pick(3), pick(4)), F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4))),
        F.concat(F.upper(pick(1)), F.lit("_"), F.upper(pick(2)), F.lit("_"), F.upper(pick(3))), F.concat(F.lit("/"), pick(1), F.lit("/"), pick(2), F.lit("/"), pick(3), F.lit("_"), (F.col("id") % 2100).cast("string")),
        F.concat(pick(1), pick(2), F.lit("_v"), (F.col("id") % 10).cast("string"), F.lit("_"), (F.col("id") % 31).cast("string")), F.concat_ws("-", (F.col("id") % 40 + 1990).cast("string"), F.lit("0"), pick(3)),
    ]
    ordinary = F.element_at(F.array(*styles), (F.col("id") % len(styles) + 1).cast("int"))
    is_random = F.col("id") % 2 == 0
    return spark.range(n).select(F.when(is_random, F.when(F.col("id") % 4 == 0, F.regexp_replace(noise, "[+/=]", "")).otherwise(noise)).otherwise(ordinary).alias("sample"), is_random.alias("random"))


def llr_table(samples: DataFrame) -> dict[str, float]:
    """log P(b|a) under random minus under ordinary for every pair ab of the alphabet, add-one smoothed: 67 x 67 numbers at most."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring("sample", i, F.lit(2))))
    counts = samples.filter(F.length("sample") > 1).select("random", pair.alias("pair")).groupBy("random", "pair").count().collect()
    n: dict[tuple[bool, str], int] = {(r["random"], r["pair"]): r["count"] for r in counts}
    of: dict[tuple[bool, str], int] = {}
    for (kind, pair_), k in n.items():
        of[kind, pair_[0]] = of.get((kind, pair_[0]), 0) + k
    size = len(_ALPHABET)
    p = lambda kind, ab: math.log((n.get((kind, ab), 0) + 1) / (of.get((kind, ab[0]), 0) + size))
    return {a + b: round(p(True, a + b) - p(False, a + b), 4) for a in _ALPHABET for b in _ALPHABET}


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start,end,rank,kind,token>> of the pattern's matches, by code points."""
    span = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["hit"].alias("token"))
    return F.transform(matches(text, pattern), span)


def _filled(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """text with fill(its code points, whether it overlaps those before) in place of each of the sorted spans, or of what it adds to those before. Only for texts with spans.

    Texts are cut once for each chunk of spans, and again within it, as a substring is found by a walk from the start.
    """

    def cut(text: Column, starts: Column, stops: Column, ends: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))

        def chunk(c: Column) -> Column:
            first, last = c * CHUNK, F.least((c + 1) * CHUNK, F.size(starts)) - 1
            part = F.substring(text, before(first) + 1, F.get(ends, last) - before(first))

            def piece(part: Column, i: Column) -> Column:
                start, at = F.get(starts, i), before(i)
                return F.concat(F.substring(part, at - before(first) + 1, F.greatest(F.lit(0), start - at)), fill(F.greatest(F.lit(0), F.get(stops, i) - F.greatest(at, start)), start < at))

            return let(part, lambda p: F.array_join(F.transform(within(c, F.size(starts)), lambda i: piece(p, i)), ""))

        return F.concat(F.array_join(F.transform(chunks(F.size(starts)), chunk), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    of = lambda name: F.transform(spans, lambda s: s[name])
    return let(of("start"), lambda starts: let(of("end"), lambda stops: let(running(stops, F.lit(0), lambda at, x: F.greatest(at, x)), lambda ends: let(text, lambda t: cut(t, starts, stops, ends)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, samples: DataFrame | None = None) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans (all, joined) and n_markov. samples: (sample, random), else those of labelled_samples."""
    return _scanned(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_")), margin, samples).select(
        id_col, *(_count(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), F.size("more").cast("long").alias("n_markov"),
    )


def _scanned(docs: DataFrame, margin: float, samples: DataFrame | None) -> DataFrame:
    """docs, which have text_, with the arrays base, more and all."""
    ratios = [0.0] * 128 * 128  # by the codes of both characters
    for pair, value in llr_table(labelled_samples(docs.sparkSession) if samples is None else samples).items():
        ratios[ord(pair[0]) * 128 + ord(pair[1])] = value
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    value = lambda s: F.regexp_extract(s["token"], ASSIGN, 1)
    assign = F.filter(_spans(F.col("text_"), "assign", ASSIGN), lambda s: F.length(value(s)) >= 8)
    access = F.filter(_spans(F.col("text_"), "access", ACCESS), lambda s: F.length(s["token"]) >= 16)
    step = lambda acc, c: F.struct(F.ascii(c).alias("before"), (acc["llr"] + F.when(acc["before"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["before"] * 128 + F.ascii(c)))).alias("llr"))
    llr = lambda token: F.aggregate(F.split(token, ""), F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("llr")), step, lambda acc: acc["llr"])
    judged = lambda s: ~F.contains(s["token"], F.lit(BLANK)) & (llr(s["token"]) >= F.greatest(F.lit(LEAST_LLR), margin * (F.length(s["token"]) - 1)))
    plain = F.translate("text_", BLANK, " ")
    return (
        docs.withColumn("base", F.array_sort(F.concat(assign, access, _spans(F.col("text_"), "hex", HEX))))
        .withColumn("open_", F.when(F.size("base") > 0, _filled(plain, F.col("base"), lambda n, _: F.repeat(F.lit(BLANK), n))).otherwise(plain))
        .withColumn("more", F.filter(_spans(F.col("open_"), "markov", TOKEN), judged))
        .withColumn("all", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")))
        .drop("open_")
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", margin: float = MARGIN, samples: DataFrame | None = None) -> DataFrame:
    """docs with every span of the text masked, overlapping ones as one; rows without spans are left as they are, and all columns stay."""
    columns = docs.columns
    found = _scanned(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text_")), margin, samples)
    cut = _filled(F.col("text_"), F.col("all"), lambda _, within: F.when(within, F.lit("")).otherwise(F.lit(mask)))
    return found.select(*(F.when(F.size("all") > 0, cut).otherwise(F.col(f"doc_.`{c}`")).alias(c) if c == text_col else F.col(f"doc_.`{c}`").alias(c) for c in columns))
