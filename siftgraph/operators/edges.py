"""Dependency edges from parsed exports: nine types, each a selection of elements or blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.functions import classify, text
from siftgraph.operators.windows import first_per_key
from siftgraph.sources import exports

# How code names views, agents, libraries and forms.
GET_VIEW = r"""(?i)GetView\s*\(\s*["']([^"']+)["']\s*\)"""
BY_KEY = r"""(?i)GetDocumentByKey\s*\(\s*["'][^"']+["']\s*(?:,\s*[^)]+)?\s*\)"""
USE_LIBRARY = r"""(?im)^\s*Use\s+"([^"]+)\""""
SELECTS = r"""(?i)Form\s*=\s*["']([^"']+)["']"""
MACROS = [r"""(?i)@Command\s*\(\s*\[ToolsRunMacro\]\s*;\s*["']?\(([^)]+)\)["']?""", r"""(?i)RunMacro\s*\(\s*["']\(([^)]+)\)["']"""]
LOOKUPS = ["@DbLookup", "@DbColumn"]
#: Characters of the evidence that count for an edge's identity.
EVIDENCE_KEY = 120

_COLUMNS = ["type", "source_type", "source_name", "source_database", "target_type", "target_name", "target_database", "evidence", "source_file", "metadata", "place"]


def _edge(df: DataFrame, kind: str, target_type: str, target: Column, evidence: Column, metadata: Column | None = None, target_database: Column | None = None, source_type: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"), (F.col("owner_type") if source_type is None else source_type).alias("source_type"), F.col("owner_name").alias("source_name"), F.col("database_id").alias("source_database"),
        F.lit(target_type).alias("target_type"), target.alias("target_name"), (F.col("database_id") if target_database is None else target_database).alias("target_database"), evidence.alias("evidence"), "source_file",
        (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"), "place",
    )


def _map(**parts: Column) -> Column:
    return F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))))


def _context() -> Column:
    return _map(language=F.col("language"), event=F.col("event"), context=F.col("context"))


def lookup_edges(blocks: DataFrame) -> DataFrame:
    """Lookups through a view, and the databases that they name."""
    calls = [blocks.filter(F.lower("body").contains(name.lower())).withColumn("call", F.lit(name)) for name in LOOKUPS]
    rows = reduce(DataFrame.unionByName, calls).withColumn("argument", F.explode(text.call_bodies(F.col("body"), F.col("call"))))
    rows = rows.withColumn("x", text.lookup_arguments(text.split_arguments(F.col("argument")))).filter("x.view is not null")
    by_key = F.col("call") == "@DbLookup"
    shown = F.substring(F.concat("call", F.lit("("), "argument", F.lit(")")), F.lit(1), F.lit(500))
    more = F.map_concat(_context(), F.when(F.col("x.database").isNotNull(), _map(database_ref=F.col("x.database"))).otherwise(F.create_map().cast("map<string,string>")),
                        F.when(by_key, _map(lookup_field=F.col("x.key"), return_field=F.col("x.ret"))).otherwise(_map(column_field=F.col("x.ret"), key_field=F.col("x.key"))))
    rows = rows.withColumns({"shown": shown, "more": more})
    lookups = _edge(rows, "LOOKUP_VIA_VIEW", "view", F.col("x.view"), F.col("shown"), F.col("more"))
    named = rows.filter("x.database is not null")
    return lookups.union(_edge(named, "REFERENCES_DATABASE", "database", F.col("x.database"), F.col("shown"), F.map_concat("more", _map(view_name=F.col("x.view"))), F.lit(None).cast("string")))


def _matched(blocks: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """Blocks with one row for each match, its text and its group."""
    whole, part = (F.regexp_extract_all("body", F.lit(pattern), F.lit(g)) for g in (0, group))
    return blocks.filter(F.col("body").rlike(pattern)).select("*", F.inline(F.arrays_zip(whole.alias("whole"), part.alias("part"))))


def code_edges(blocks: DataFrame) -> DataFrame:
    agents = [_edge(m := _matched(blocks, p), "INVOKES_AGENT", "agent", classify.agent_name(m["part"]), F.substring("whole", 1, 500), _context()) for p in MACROS]
    views = _edge(_matched(blocks, GET_VIEW), "ACCESSES_VIEW", "view", F.col("part"), F.col("whole"), _context())
    keyed = _edge(_matched(blocks, BY_KEY, 0), "ACCESSES_VIEW", "view", F.lit("ByKey"), F.col("whole"), _context())
    used = _edge(_matched(blocks, USE_LIBRARY), "USES_SCRIPT_LIBRARY", "scriptlibrary", F.col("part"), F.trim(F.col("whole")), _context())
    return reduce(DataFrame.union, [lookup_edges(blocks), *agents, views, keyed, used])


def element_edges(elements: DataFrame) -> DataFrame:
    """Subforms that forms include, parents of response documents, forms that views select. A subform counts as a form here, as readers of these edges expect."""
    e = elements.withColumnsRenamed({"name": "owner_name", "element_type": "owner_type"})
    forms = e.filter(F.col("owner_type").isin("form", "subform"))
    sub = forms.select("*", F.explode("subform_refs").alias("ref"))
    included = _edge(sub, "INCLUDES_SUBFORM", "subform", F.col("ref"), F.concat(F.lit('<subformref name="'), F.col("ref"), F.lit('">')), source_type=F.lit("form"))
    parents = _edge(forms.filter(F.exists("fields", lambda f: f["is_ref"])), "PARENT_CHILD_REF", "form", F.lit("ParentDocument"), F.lit("Response document field $REF establishes parent linkage"), source_type=F.lit("form"))
    views = e.filter("owner_type = 'view' and selection is not null")
    chosen = views.select("*", F.explode(F.array_distinct(F.regexp_extract_all("selection", F.lit(SELECTS), F.lit(1)))).alias("form"))
    return included.union(parents).union(_edge(chosen, "SELECTS_FORM", "form", F.col("form"), F.concat(F.lit('Form="'), F.col("form"), F.lit('"'))))


def deduped(edges: DataFrame) -> DataFrame:
    """The first of edges with the same type, ends, file and beginning of the evidence."""
    keyed = edges.withColumn("evidence_key", F.substring("evidence", 1, EVIDENCE_KEY))
    keys = [c for c in _COLUMNS if c not in ("evidence", "metadata", "place")] + ["evidence_key"]
    return first_per_key(keyed, keys, "place").drop("evidence_key")


def from_exports(files: DataFrame) -> DataFrame:
    """All edges of parsed exports. Of subforms' fields only code that isn't a field's counts; broken files give what their text alone shows."""
    place = lambda *c: F.struct(*(F.col(x).cast("int") if isinstance(x, str) else F.lit(x) for x in c))
    elements = exports.elements(files).withColumn("place", place("pos", -1, 0))
    blocks = exports.blocks(files).withColumn("place", place("pos", "part", "nth"))
    read = blocks.filter("part = 0 or part >= 2 and owner_type = 'form'")
    broken = files.filter("error is not null").select(
        "source_file", F.col("source_file").alias("database_id"), F.lit("database").alias("owner_type"), F.col("source_file").alias("owner_name"), F.lit("unknown").alias("language"), F.lit(None).cast("string").alias("event"), F.lit("raw").alias("context"), F.col("text").alias("body"),
        F.struct(F.lit(0).alias("pos"), F.lit(0).alias("col2"), F.lit(0).alias("col3")).alias("place"),
    )
    columns = broken.columns
    return deduped(element_edges(elements).union(code_edges(read.select(columns))).union(code_edges(broken)))
