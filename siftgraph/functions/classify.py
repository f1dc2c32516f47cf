"""Ordered classifiers as CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Business domains and the substrings that tell them, first match wins.
DOMAINS = [
    ("Order Management", "order|line\\s*item|shipment|invoice"),
    ("Quoting", "quote|quotation|bid"),
    ("Customer", "cust|customer|client|account"),
    ("Product / Catalog", "product|catalog|item|sku|prefix"),
    ("Web / Self-Service", "web|portal|self"),
    ("Administration", "admin|config|setup|profile|user"),
    ("Reporting", "report|export|print"),
    ("Integration", "import|sync|api|edi"),
]
# Logic categories by event, by body, and by language.
EVENT_CATEGORIES = [
    ("hidewhen", "hidewhen"), ("inputvalidation validation", "validation"), ("querysave postsave presave", "state_transition"), ("queryopen postopen queryclose", "lifecycle"),
    ("selection", "view_selection"), ("options declarations initialize terminate", "agent_setup"),
]
LANGUAGE_CATEGORIES = [
    ("lotusscript", "lotusscript_logic"), ("java", "java_logic"), ("javascript jscript ssjs", "javascript_logic"), ("csjs client_javascript", "client_javascript_logic"), ("xpages xsp", "xpages_logic"),
]
# The 18 rules whose severity depends on a loop.
LOOP_RULES = [
    "DOM-001", "DOM-002", "DOM-003", "DOM-010", "DOM-011", "DOM-012", "DOM-013", "DOM-014", "DOM-015", "DOM-016",
    "DOM-017", "DOM-018", "DOM-019", "DOM-021", "DOM-022", "DOM-OWN-001", "DOM-BS-001", "DOM-BS-002",
]
PRIORITIES = ["validation", "state_transition", "view_selection", "lifecycle", "conditional_logic", "hidewhen", "lotusscript_logic", "agent_setup", "general_formula"]
STAGES = ["queryopen", "postopen", "inputvalidation", "validation", "querysave", "webquerysave", "postsave", "presave", "queryclose"]


def first_match(c: Column, patterns: Iterable[tuple[str, str]], otherwise: str | None) -> Column:
    """The label of the first pattern that c holds, ignoring ASCII case."""
    low, out = F.lower(c), None
    for label, pattern in patterns:
        out = (F if out is None else out).when(low.rlike(pattern), label)
    return out.otherwise(F.lit(otherwise))


def by_words(c: Column, groups: Iterable[tuple[str, str]]) -> Column:
    out = None
    for words, label in groups:
        out = (F if out is None else out).when(c.isin(*words.split()), label)
    return out


def domain(name: Column) -> Column:
    return first_match(F.coalesce(name, F.lit("")), DOMAINS, "General")


def logic_category(event: Column, body: Column, language: Column) -> Column:
    by_body = F.when(F.lower(F.coalesce(body, F.lit(""))).rlike("@if|@isnewdoc|@userroles"), "conditional_logic")
    return F.coalesce(by_words(F.lower(event), EVENT_CATEGORIES), by_body, by_words(F.lower(language), LANGUAGE_CATEGORIES), F.lit("general_formula"))


def rule_priority(category: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, PRIORITIES)), category)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(9)).otherwise((at - 1).cast("int"))


def calibrated(rule: Column, severity: Column, in_loop: Column) -> Column:
    """Severity by loop: inside, middle ones become critical; outside, all go down."""
    known = F.when(F.upper(severity).isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.upper(severity)).otherwise("MEDIUM")
    inside = F.when(known.isin("HIGH", "MEDIUM"), "CRITICAL").otherwise(known)
    outside = F.when(known.isin("CRITICAL", "HIGH"), "MEDIUM").otherwise("LOW")
    return F.when(~rule.isin(*LOOP_RULES), known).when(in_loop, inside).otherwise(outside)


def inventory_severity(status: Column, in_loop: Column, client: Column) -> Column:
    looped = lambda a, b: F.when(in_loop, a).otherwise(b)
    return (
        F.when(client | status.isin("PROTECTED", "SAFE"), "LOW").when(status == "CONDITIONAL", looped("HIGH", "MEDIUM")).when(status == "ESCAPE_PATH_GAP", looped("CRITICAL", "HIGH"))
        .otherwise(looped("CRITICAL", "MEDIUM"))
    )


def ring_class(allocators: Column, coverage: Column, safety: Column) -> Column:
    return F.when((allocators > 0) & (coverage < 50), "high").when(safety < 40, "high").when(safety < 75, "moderate").otherwise("low")


def cleanup_status(allocated: Column, cleaned: Column, transferred: Column, allocates: Column, n_cleanups: Column, conditional: Column, has_finally: Column, gap: Column) -> Column:
    """The status of a function's handles from the arrays of variables it allocates, cleans and hands over."""
    handed = F.when(F.size(cleaned) > 0, transferred).otherwise(F.array().cast("array<string>"))
    unclean = F.array_except(F.array_except(allocated, cleaned), handed)
    named, none = F.size(allocated) > 0, n_cleanups == 0
    base = (
        F.when(~(named | allocates), "SAFE").when(named & (F.size(cleaned) == 0) & none, "UNPROTECTED").when(named & (F.size(unclean) > 0), "PARTIAL").when(named & conditional & ~has_finally, "CONDITIONAL")
        .when(named, "PROTECTED").when(none, "UNPROTECTED").when(conditional, "CONDITIONAL").otherwise("PROTECTED")
    )
    return F.when(gap & base.isin("PROTECTED", "CONDITIONAL", "PARTIAL"), "ESCAPE_PATH_GAP").otherwise(base)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 90, "high").when(c >= 70, "medium").otherwise("low")


def family(rule: Column) -> Column:
    """What stands before the first dash; three longer prefixes are kept whole."""
    return F.when(rule.rlike("^(LS-DOM|DOM-OWN|DOM-BS)"), F.regexp_extract(rule, "^(LS-DOM|DOM-OWN|DOM-BS)", 1)).otherwise(F.substring_index(rule, "-", 1))


def agent_name(name: Column) -> Column:
    return F.when(F.trim(name).rlike(r"^\(.*\)$"), F.trim(name)).otherwise(F.concat(F.lit("("), F.trim(name), F.lit(")")))


def view_group(name: Column) -> Column:
    return F.when(name.startswith("(") | F.lower(name).rlike("lookup|lu"), "lookup_view").otherwise("view")


def database_id(path: Column, source_file: Column) -> Column:
    """The last segment of the path after a server's !!, else the file's stem."""
    last = F.regexp_extract(path, r"([^!/\\]+)$", 1)
    stem = F.regexp_replace(F.regexp_extract(source_file, r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    return F.when(F.coalesce(path, F.lit("")) != "", last).otherwise(stem)
