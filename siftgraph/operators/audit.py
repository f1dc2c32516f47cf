"""Findings and function records: counts, rates, overlays, related rows and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.operators.windows import top_n
from siftgraph.schemas import SEVERITIES, severity_rank

# Labels and patterns of the keyword filter in their order, and whether case is ignored.
KEYWORDS = [
    ("session", r"\bsession\b", True),
    ("createDateTime", r"createDateTime", True),
    ("createName", r"createName", True),
    ("Database", r"\b(?:Database|NotesDatabase|getDatabase)\b", False),
    ("Document", r"\b(?:Document|NotesDocument|getDocument|getNextDocument)\b", False),
    ("View", r"\b(?:View|NotesView|getView|getNextEntry|ViewEntry)\b", False),
    ("recycle", r"\.recycle\s*\(", True),
    ("static", r"\bstatic\b", False),
    ("openntf", r"org\.openntf\.domino", True),
    ("lotus.domino", r"lotus\.domino", True),
    ("sessionScope", r"sessionScope|applicationScope|viewScope", True),
    ("getColumnValues", r"getColumnValue", True),
    ("Factory", r"Factory\.fromLotus", True),
    ("DbLookup", r"@Db(?:Lookup|Column)\b", True),
    ("formula_loop", r"@(?:While|For)\b", True),
    ("Connection", r"\b(?:getConnection|OpenConnection|DriverManager|JavaSession)\b", True),
    ("HTTPRequest", r"\b(?:NotesHTTPRequest|createHTTPRequest|HttpURLConnection)\b", True),
    ("IsSummary", r"\bIsSummary\b", True),
]
# Languages that are kept when no unit has a keyword.
FALLBACK_LANGUAGES = ["java", "lotusscript", "javascript", "jscript", "ssjs", "csjs", "source", "script", "formula"]


def keyword_labels(body: Column, patterns: list[tuple[str, str, bool]] = KEYWORDS) -> Column:
    """The labels of the patterns that occur, in the given order."""
    return F.filter(F.array(*(F.when(body.rlike("(?i)" * any_case + p), label) for label, p, any_case in patterns)), lambda x: x.isNotNull())


def prefilter(units: DataFrame, body: str = "body", patterns: list[tuple[str, str, bool]] = KEYWORDS) -> DataFrame:
    """Units with a keyword, and which."""
    return units.withColumn("keywords_matched", keyword_labels(F.coalesce(F.col(body), F.lit("")), patterns)).filter(F.size("keywords_matched") > 0)


def prefilter_or_all(units: DataFrame, body: str = "body") -> DataFrame:
    """Units with a keyword; if there is none, all units of the known languages, without keywords."""
    some = prefilter(units, body)
    if not some.isEmpty():
        return some
    return units.filter(F.col("language").isin(*FALLBACK_LANGUAGES)).withColumn("keywords_matched", F.array().cast("array<string>"))


def severity_counts(findings: DataFrame, *by: str, active: Column | None = None) -> DataFrame:
    """One column for each severity, zero where there is none; inactive findings do not count."""
    on = F.lit(True) if active is None else active
    return findings.groupBy(*by).agg(*(F.count_if(on & (F.col("severity") == s)).alias(s.lower()) for s in SEVERITIES))


def risk_level(critical: Column, high: Column, medium: Column) -> Column:
    return F.when((critical >= 3) | (critical >= 1) & (high >= 3), "CRITICAL").when((critical >= 1) | (high >= 3), "HIGH").when((high >= 1) | (medium >= 5), "MEDIUM").otherwise("LOW")


def inventory_summary(records: DataFrame, *by: str) -> DataFrame:
    """Counts and rates over function records (status, allocates, is_false_positive, severity); rates are 100 where there is nothing to count."""
    fp, alloc, status = F.col("is_false_positive"), F.col("allocates"), F.col("status")
    n = F.count(F.lit(1))
    covered, wanted = F.count_if(alloc & ~fp & (status == "PROTECTED")), F.count_if(alloc & ~fp)
    safe = F.count_if(~alloc & (status == "SAFE")) + F.count_if(alloc & ((status == "PROTECTED") | fp))
    count = lambda s: F.count_if((status == s) & ~fp)
    return records.groupBy(*by).agg(
        n.alias("total"), F.count_if(fp).alias("false_positives"), F.count_if(alloc).alias("allocators"), covered.alias("with_cleanup"), count("UNPROTECTED").alias("unprotected"),
        count("PARTIAL").alias("partial"), count("CONDITIONAL").alias("conditional"), count("ESCAPE_PATH_GAP").alias("escape_gap"), F.count_if(~fp & status.isin("PARTIAL", "CONDITIONAL", "ESCAPE_PATH_GAP")).alias("incomplete"),
        F.when(n == 0, 100.0).otherwise(100.0 * safe / n).alias("safety_rate"), F.when(wanted == 0, 100.0).otherwise(100.0 * covered / wanted).alias("coverage_rate"),
    )


def inventory_report(records: DataFrame, *by: str) -> DataFrame:
    """The summary over the functions whose language holds handles (language, element_name beside what the summary reads), with all_functions and lotus_functions of every language, protected
    (with all of its handles released, or judged harmless), any_cleanup and safe. Rates are rounded to one decimal; a group without such functions has zeros and rates of 100."""
    from siftgraph.operators.views import is_client

    low = F.lower(F.coalesce("language", F.lit("")))
    lotus = low.contains("lotus") | low.isin("ls", "lss", "notes")
    client = is_client(low, F.lit(""), F.lower(F.coalesce("element_name", F.lit("")))) | (low == "client")
    scoped = ~lotus & ~client & (low.rlike("java|ssjs|jscript|xpage|xsp") | low.isin("js", "source", "script"))
    fp, alloc, status = F.coalesce("is_false_positive", F.lit(False)), F.coalesce("allocates", F.lit(False)), F.col("status")
    every = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("all_functions"), F.count_if(lotus).alias("lotus_functions"), F.count_if(scoped & ~alloc).alias("safe"),
        F.count_if(scoped & alloc & ((status == "PROTECTED") | fp)).alias("protected"), F.count_if(scoped & alloc & ((status != "UNPROTECTED") | fp)).alias("any_cleanup"),
    )
    summary = inventory_summary(records.filter(scoped), *by)
    rates = ("safety_rate", "coverage_rate")
    counts = [c for c in summary.columns if c not in (*by, *rates)]
    met = every.join(summary, list(by), "left") if by else every.crossJoin(summary)
    return met.select(*by, "all_functions", "lotus_functions", "safe", "protected", "any_cleanup", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), *(F.round(F.coalesce(c, F.lit(100.0)), 1).alias(c) for c in rates))


def inventory_order(false_positives_first: bool = True) -> list[Column]:
    """False positives first, as the service has it, or last, as its client has it."""
    fp = F.col("is_false_positive")
    language = F.when(F.col("language") == "ssjs", 0).when(F.col("language") == "java", 1).when(F.col("language") == "csjs", 3).otherwise(2)
    return [fp.desc() if false_positives_first else fp.asc(), language, severity_rank(F.col("severity")), F.col("status"), F.col("element"), F.col("name")]


def triaged(items: DataFrame, overrides: DataFrame, *keys: str) -> DataFrame:
    """Items under the latest override: its flag wins, a reason or status replaces if given, a false positive is LOW; lifting the mark doesn't restore the severity."""
    latest = top_n(overrides, list(keys), 1, F.desc("at")).select(*keys, F.col("is_false_positive").alias("o_fp"), F.col("reason").alias("o_reason"), F.col("status").alias("o_status"))
    flag = F.coalesce("o_fp", "is_false_positive", F.lit(False))
    out = items.join(latest, list(keys), "left")
    return out.withColumns({
        "is_false_positive": flag, "reason": F.coalesce(F.nullif("o_reason", F.lit("")), "reason"), "severity": F.when(flag, "LOW").otherwise(F.col("severity")),
        "ai_status": F.coalesce(F.nullif("o_status", F.lit("")), F.when(F.col("o_fp"), "FALSE_POSITIVE"), "ai_status"),
    }).drop("o_fp", "o_reason", "o_status")


def with_verdicts(findings: DataFrame, verdicts: DataFrame, minimum: int = 75) -> DataFrame:
    """Findings under a model's verdicts (finding_id, verdict, confidence): too unsure ones only leave a note."""
    v = verdicts.select("finding_id", F.col("verdict").alias("v"), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.expr("try_cast(confidence as int)"), F.lit(0)))).alias("c"))
    sure = F.col("c") >= minimum
    guarded = F.col("rule_id").isin("DOM-004", "DOM-025") | (F.col("severity") == "CRITICAL")
    fp = sure & (F.col("v") == "FALSE_POSITIVE") & ~guarded
    out = findings.join(v, "finding_id", "left")
    return out.withColumns({
        "ai_status": F.when(F.col("v").isNull(), F.lit(None)).when(~sure, "LOW_CONFIDENCE").when((F.col("v") == "FALSE_POSITIVE") & guarded, "GUARDED").otherwise(F.col("v")),
        "confidence": F.when(fp, F.least("confidence", F.greatest(F.lit(40), 100 - F.col("c")))).otherwise(F.col("confidence")),
        "is_false_positive": F.coalesce(fp, F.lit(False)), "severity": F.when(fp, "LOW").otherwise(F.col("severity")),
    }).drop("v", "c")


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys the other frame lacks: token mining, suppressed gaps, units without findings."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def scoped_counts(texts: DataFrame, patterns: DataFrame, text: str = "text", scope: str = "language") -> DataFrame:
    """(scope, label, n_hits, n_texts) of patterns (scope, label, pattern) in the texts of their scope. patterns is a small fixed table."""
    met = texts.select(scope, text).join(F.broadcast(patterns), scope)
    hits = met.select(scope, "label", F.regexp_count(F.col(text), F.col("pattern")).alias("n"))
    return hits.groupBy(scope, "label").agg(F.sum("n").cast("long").alias("n_hits"), F.count_if(F.col("n") > 0).alias("n_texts"))


def related(items: DataFrame, others: DataFrame, tokens: Column, key: str, n: int, *order: Column | str) -> DataFrame:
    """Others that name an item, n at most for each item. tokens: array of the words in an other's texts, so that a word join stands for a substring scan of all pairs."""
    words = others.select("*", F.explode(F.array_distinct(tokens)).alias("word_"))
    met = words.join(items.select(key, F.lower(key).alias("word_")).distinct(), "word_").drop("word_")
    return top_n(met, [key], n, *order)


#: First characters of a name, by which it is found where it may stand in a text.
HEAD = 3


def containing(texts: DataFrame, keys: list[str], text: str, names: DataFrame, name: str) -> DataFrame:
    """(keys, name) for every text and distinct name that it holds, both in lower case. The keys name a row of texts and aren't null.

    At each place of a text where first characters of names stand (a shorter name whole), what stands there in the lengths of such names meets the
    names by equality. So no pair is missed, and what is made grows with the texts and the pairs that hold, not with names times texts. Texts are
    never broadcast, however small their file is. Null and empty names and texts hold nothing.
    """
    low = texts.select(*keys, F.lower(text).alias("text_")).filter("text_ <> ''")
    wanted = names.select(F.lower(name).alias("name_")).filter("name_ <> ''").distinct()
    heads = wanted.groupBy(F.substring("name_", 1, HEAD).alias("head_")).agg(F.collect_set(F.length("name_")).alias("lengths_"))
    ahead = F.regexp_extract_all("text_", F.lit(f"(?s)(?=(.{{1,{HEAD}}}))."), F.lit(1))  # a look ahead from each character: one walk
    starts = low.select(*keys, F.posexplode(ahead).alias("at_", "ahead_")).select(*keys, "at_", F.explode(F.array(*(F.substring("ahead_", 1, n) for n in range(1, HEAD)), "ahead_")).alias("head_"))
    spots = starts.join(heads, "head_").groupBy(*keys).agg(F.collect_list(F.struct("at_", "lengths_")).alias("spots_"))
    parts = F.flatten(F.transform("spots_", lambda x: F.transform(x["lengths_"], lambda n: F.substring("text_", x["at_"] + 1, n))))
    held = spots.join(low.hint("merge"), keys).select(*keys, F.explode(F.array_distinct(parts)).alias("name_"))
    return held.join(wanted, "name_").select(*keys, F.col("name_").alias(name))


def ci_gate(summary: DataFrame, critical: int = 0, high: int = 50, unprotected: int = 0, incomplete: int = 25) -> DataFrame:
    """summary (one row: critical, high, unprotected, incomplete) with the list of limits that it breaks."""
    limits = {"critical": critical, "high": high, "unprotected": unprotected, "incomplete": incomplete}
    broken = F.filter(F.array(*(F.when(F.col(k) > v, k) for k, v in limits.items())), lambda x: x.isNotNull())
    return summary.select(*limits, F.array_join(broken, ",").alias("broken"), (F.size(broken) == 0).alias("passed"))


def quality_gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, n_failures) of each check, which is true for a row that fails it. One pass."""
    one = df.agg(*(F.count_if(c).alias(k) for k, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).alias("n_failures")) for k in checks))).alias("x")).select("x.gate", "x.n_failures")


def discrepancies(findings: DataFrame, *by: str) -> DataFrame:
    """What a model's review changed: counts of verified, lifted, unsure, guarded and new findings."""
    ai = F.coalesce(F.col("ai_status"), F.lit(""))
    kinds = {"verified": "VERIFIED", "false_positives": "FALSE_POSITIVE", "low_confidence": "LOW_CONFIDENCE", "guarded": "GUARDED", "blind_spots": "BLIND_SPOT"}
    return findings.groupBy(*by).agg(*(F.count_if(ai == v).alias(k) for k, v in kinds.items()))


def escalated(records: DataFrame, proposals: DataFrame, *keys: str, minimum: int = 60) -> DataFrame:
    """Records with a proposed severity (keys, proposed, confidence) where it is graver than their own and sure enough; severities only rise."""
    p = proposals.filter(F.col("confidence") >= minimum).groupBy(*keys).agg(F.min_by("proposed", severity_rank(F.col("proposed"))).alias("proposed_"))
    out = records.join(p, list(keys), "left")
    graver = severity_rank(F.col("proposed_")) < severity_rank(F.col("severity"))
    return out.withColumn("severity", F.when(graver, F.col("proposed_")).otherwise(F.col("severity"))).drop("proposed_")


def blind_spots(findings: DataFrame, proposed: DataFrame, minimum: int = 75, critical: int = 60) -> DataFrame:
    """findings with the proposed ones that are sure enough; a gap in ownership goes where the engine has found one in the same element."""
    sure = proposed.filter(F.col("confidence") >= F.when(F.col("severity") == "CRITICAL", critical).otherwise(minimum)).withColumn("ai_status", F.lit("BLIND_SPOT"))
    known = findings.filter(F.col("rule_id") == "DOM-OWN-001").select(F.lower("element_name").alias("low_")).distinct()
    gaps = sure.filter("rule_id = 'DOM-BS-002'").withColumn("low_", F.lower("element_name")).join(known, "low_", "left_anti").drop("low_")
    return findings.unionByName(sure.filter("rule_id <> 'DOM-BS-002'"), allowMissingColumns=True).unionByName(gaps, allowMissingColumns=True)
