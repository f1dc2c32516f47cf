"""Reports over small results: markdown text, viewer payloads and the rules catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.functions import text
from siftgraph.operators import graph
from siftgraph.operators.audit import risk_level, severity_counts
from siftgraph.operators.views import OPEN
from siftgraph.operators.windows import top_n
from siftgraph.schemas import severity_rank

#: Findings that a report shows.
SHOWN = 40


def rules_catalog(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source_file, owner_name, field, default, validation, translation, hide_when, messages, lookups): each field's formulas, with fallbacks from the attribute to the block of its event."""
    context = F.regexp_extract("context", "/field:(.*)$", 1)
    events = ["defaultvalue", "inputvalidation", "inputtranslation", "hidewhen"]
    logic = blocks.filter(context != "").groupBy("source_file", "owner_type", "owner_name", context.alias("field")).pivot("event", events).agg(F.first("body", ignorenulls=True))
    f = fields.select("source_file", F.col("element_type").alias("owner_type"), "owner_name", F.col("name").alias("field"), "default_value", "input_validation", "input_translation", F.col("hidewhen").alias("hide_own"), "embedded")
    pick = lambda own, event: F.coalesce(F.nullif(F.col(own), F.lit("")), F.nullif(F.col(event), F.lit("")))
    rows = f.join(logic, ["source_file", "owner_type", "owner_name", "field"], "left").select(
        "source_file", "owner_type", "owner_name", "field", pick("default_value", "defaultvalue").alias("default"), pick("input_validation", "inputvalidation").alias("validation"), pick("input_translation", "inputtranslation").alias("translation"), pick("hide_own", "hidewhen").alias("hide_when"), "embedded",
    )
    all_ = F.concat_ws("\n", "default", "validation", "translation", "hide_when", F.array_join("embedded", "\n"))
    return rows.withColumns({"messages": F.array_join(text.failure_messages(F.col("validation")), "; "), "n_lookups": F.regexp_count(all_, F.lit(r"(?i)@db(?:lookup|column)\s*\(")).cast("int")}).drop("embedded")


def catalog_lookups(fields: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, owner_name, field, view, source): the lookup edges of a form (by its name) at the fields whose formulas name the view, and at the form where its own code looks up."""
    targets = edges.filter("type = 'LOOKUP_VIA_VIEW'").select(F.col("source_name").alias("owner_name"), F.col("target_name").alias("view")).distinct()
    formulas = fields.select("source_file", "owner_name", F.col("name").alias("field"), F.concat_ws("\n", "default_value", "input_validation", "input_translation", "hidewhen", F.array_join("embedded", "\n")).alias("all_"))
    at_fields = formulas.join(targets, "owner_name").filter(F.contains(F.col("all_"), F.col("view"))).select("source_file", "owner_name", "field", "view", F.lit("field").alias("source"))
    own = blocks.filter("not contains(context, '/field:')").select("source_file", "owner_name", "body").join(targets, "owner_name").filter(F.contains(F.col("body"), F.col("view")))
    return at_fields.union(own.select("source_file", "owner_name", F.lit(None).cast("string").alias("field"), "view", F.lit("form").alias("source")).distinct())


def catalog_totals(rows: DataFrame) -> DataFrame:
    """One row of counts over the rules catalog."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return rows.agg(F.count_distinct("source_file", "owner_name").alias("n_forms"), F.count(F.lit(1)).alias("n_fields"), has("default").alias("n_defaults"), has("validation").alias("n_validations"), has("translation").alias("n_translations"), has("hide_when").alias("n_hide_when"), F.sum("n_lookups").alias("n_lookups"))


def field_sentence(name: Column, validation: Column, hide_when: Column, default: Column) -> Column:
    """What a field does in one line."""
    parts = [F.when(F.coalesce(default, F.lit("")) != "", F.concat(F.lit("Starts as a computed value. "), describe(default))), F.when(F.coalesce(validation, F.lit("")) != "", F.concat(F.lit("Is checked on save. "), describe(validation))), F.when(F.coalesce(hide_when, F.lit("")) != "", F.concat(F.lit("Is hidden by a rule. "), describe(hide_when)))]
    return F.concat(text.humanise(name), F.lit(": "), F.trim(F.concat_ws(" ", *parts)))


def describe(formula: Column) -> Column:
    """A sentence or two on what a formula does, from what occurs in it."""
    low = F.lower(F.coalesce(formula, F.lit("")))
    clauses = [("@if", "Decides by a condition."), ("@isnewdoc", "Depends on whether the document is new."), ("@userroles|@username", "Depends on who the user is."), ("@dblookup|@dbcolumn", "Looks up values in a view."), ("@failure", "Rejects values with a message."), ("@today|@now", "Uses the current date."), ("@trim|@propercase|@uppercase|@lowercase", "Tidies the text.")]
    return F.array_join(F.filter(F.array(*(F.when(low.rlike(p), s) for p, s in clauses)), lambda x: x.isNotNull()), " ")


# What a formula's one-line summary says if a pattern occurs, in this order; {} is the pattern's group. The branch counts only where nothing before it does.
CLAUSES = [
    (r'(?i)@Failure\s*\(\s*"([^"]+)"', 'Validation error: "{}"'),
    (r"(?i)@DbLookup\s*\(", "Resolves a value via @DbLookup from another view/database."),
    (r"(?i)@UserRoles", "Checks current user roles for authorization."),
    (r"(?i)@IsNewDoc", "Behavior differs for new vs existing documents."),
    (r"(?i)runmacro", "Invokes a shared macro/agent."),
    (r"(?i)@Command\s*\(\s*\[([^\]]+)\]", "Runs Domino @Command [{}]."),
]
BRANCH, PROCEDURE, NO_LOGIC, MOST_EXCERPT = "Conditional branching based on field or document state.", "LotusScript procedure.", "Empty logic block.", 120


def formula_summary(formula: Column) -> Column:
    """What a formula does in one line: the clauses that hold, else its beginning. Null counts as empty."""
    bare = F.regexp_replace(F.coalesce(formula, F.lit("")), r"^\s+|\s+$", "")
    low = F.lower(bare)
    said = lambda p, s: F.when(bare.rlike(p), F.concat(*(F.lit(x) if k == 0 else F.concat(F.regexp_extract(bare, p, 1), F.lit(x)) for k, x in enumerate(s.split("{}")))))
    clauses = F.concat_ws(" ", *(said(*c) for c in CLAUSES))
    branch = F.when(low.contains("@if") & (clauses == ""), F.lit(BRANCH))
    procedure = F.when(F.substring(low, 1, 20).contains("sub "), F.lit(PROCEDURE))
    all_ = F.concat_ws(" ", F.nullif(clauses, F.lit("")), branch, procedure)
    excerpt = F.concat(F.lit("Formula logic: "), F.substring(F.replace(bare, F.lit("\n"), F.lit(" ")), 1, MOST_EXCERPT), F.when(F.length(bare) > MOST_EXCERPT, "…").otherwise(""))
    return F.when(bare == "", F.lit(NO_LOGIC)).when(all_ == "", excerpt).otherwise(all_)


def synthesis(elements: DataFrame, blocks: DataFrame, agents: DataFrame, edges: DataFrame, rules: DataFrame, most_rules: int = 50) -> DataFrame:
    """(section, item): the synthesis of an application as JSON items, so that nothing is gathered in one row.

    Sections: databases, capabilities, business_rules (the first of rules by their id), document_lifecycles, application_flow and category_counts.
    elements: element_type, name, database_id; blocks: category, owner_name, event; agents: trigger; edges: type; rules: id and what else they show.
    """
    sections = {
        "databases": elements.groupBy("database_id").agg(F.count(F.lit(1)).alias("n_elements")),
        "capabilities": graph.capability_map(elements, blocks),
        "business_rules": rules.orderBy("id").limit(most_rules),
        "document_lifecycles": graph.lifecycles(blocks, elements.filter("element_type = 'form'")),
        "application_flow": graph.flow(agents, edges),
        "category_counts": blocks.groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    }
    made = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("item")) for name, df in sections.items()]
    return reduce(DataFrame.union, made)


def viz_nodes(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, grp, field_count, declared): declared elements once each, and what edges name besides; ids have the database where there are several."""
    several = elements.select("database_id").distinct().limit(2).agg((F.count(F.lit(1)) > 1).alias("several"))
    own = elements.select("element_type", "name", "database_id", F.when(F.col("element_type") == "view", F.col("n_columns")).otherwise(F.size("fields")).alias("field_count"), F.struct("source_file", "pos").alias("place"))
    first = top_n(own, ["element_type", "name", "database_id"], 1, "place").drop("place").withColumn("declared", F.lit(True))
    ends = edges.select(F.col("source_type").alias("element_type"), F.col("source_name").alias("name"), F.col("source_database").alias("database_id")).union(edges.select("target_type", "target_name", "target_database")).distinct()
    implicit = ends.join(first.select("element_type", "name"), ["element_type", "name"], "left_anti")
    nodes = first.unionByName(implicit.select("element_type", "name", "database_id", F.lit(0).alias("field_count"), F.lit(False).alias("declared"))).join(F.broadcast(several))
    key = F.when(F.col("several"), F.concat_ws(":", "database_id", "element_type", "name")).otherwise(F.concat_ws(":", "element_type", "name"))
    return nodes.select(key.alias("id"), F.when(F.col("several"), F.concat(F.lit("["), F.coalesce("database_id", F.lit("")), F.lit("] "), "name")).otherwise(F.col("name")).alias("label"), F.col("element_type").alias("grp"), "field_count", "declared")


def node_issues(findings: DataFrame) -> DataFrame:
    """(node, n, worst): active findings of each element."""
    return findings.groupBy(F.concat_ws(":", "element_type", "element_name").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", severity_rank(F.col("severity"))).alias("worst"))


def node_issues_of(findings: DataFrame, functions: DataFrame, most: int = 5) -> DataFrame:
    """(node, n, worst, items): findings of each element and functions to act on, with the gravest of them in words.

    findings: element_type, element_name, rule_id, severity, is_false_positive; functions: the same without rule_id but with name and status.
    """
    node = F.concat_ws(":", "element_type", "element_name").alias("node")
    from_findings = findings.filter(~F.coalesce(F.col("is_false_positive"), F.lit(False))).select(node, severity_rank(F.col("severity")).alias("rank"), "severity", F.col("rule_id").alias("item"))
    acted = functions.filter(~F.coalesce(F.col("is_false_positive"), F.lit(False)) & F.col("status").isin(*OPEN))
    both = from_findings.unionByName(acted.select(node, severity_rank(F.col("severity")).alias("rank"), "severity", F.concat("name", F.lit(" "), "status").alias("item")))
    counted = both.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min_by("severity", "rank").alias("worst"))
    shown = top_n(both.select("node", "rank", "item").distinct(), ["node"], most, "rank", "item").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("x"))  # most items at most
    return counted.join(shown, "node").select("node", "n", "worst", F.array_join(F.transform("x", lambda x: x["item"]), "; ").alias("items"))


def snapshot(findings: DataFrame, at: str) -> DataFrame:
    """One row for the audit history."""
    c = severity_counts(findings)
    return c.select(F.lit(at).alias("at"), "critical", "high", "medium", "low", risk_level(F.col("critical"), F.col("high"), F.col("medium")).alias("risk"))


def markdown(findings: DataFrame, title: str = "Code audit", most: int = SHOWN) -> str:
    """A report of the counts and the gravest findings; only those come to the driver."""
    c = snapshot(findings, "").first()
    top = findings.orderBy(severity_rank(F.col("severity")), "rule_id", "element_name", "line").limit(most).select("severity", "rule_id", "element_name", "line", "evidence").collect()
    lines = [f"# {title}", "", f"Risk: **{c['risk']}**. Critical {c['critical']}, high {c['high']}, medium {c['medium']}, low {c['low']}.", "", "| severity | rule | element | line | evidence |", "| --- | --- | --- | --- | --- |"]
    clean = lambda s: " ".join(str(s or "").split()).replace("|", "\\|")[:120]
    return "\n".join(lines + [f"| {r['severity']} | {r['rule_id']} | {clean(r['element_name'])} | {r['line']} | `{clean(r['evidence'])}` |" for r in top]) + "\n"
