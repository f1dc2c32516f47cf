"""Measures and views of a typed dependency graph given as edges (src, dst, type, ...) and nodes (node, ...).

A hub may touch a third of all edges: every count aggregates before it shuffles, and no plan gathers a node's edges in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.operators.windows import first_distinct, top_n
from siftgraph.schemas import clamped, ratio

# Weights of the complexity score and its bands.
WEIGHTS = {"coupling": 0.30, "cross": 0.25, "hardcoded": 0.25, "orphans": 0.20}
# What counts as hard-coded.
HARDCODED = {
    "drive": r"[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*",
    "unc": r"\\\\[^\s\"']+",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "name": r"(?i)\bCN=[A-Za-z0-9 _.-]+(?:/(?:O|OU|C)=[A-Za-z0-9 _.-]+)+",
    "nsf": r"(?i)[A-Za-z]:\\[^\s\"']+\.nsf|\\\\[^\s\"']+\.nsf|[A-Za-z0-9_.\\/-]+\.nsf",
}
MOST_NSF = 15
# Kinds that share a list of samples, samples in a list, and the parts of an application that a capability lists by name.
SAMPLES = {"drive": "file_paths", "unc": "file_paths", "ip": "ip_addresses", "name": "domino_names", "nsf": "nsf_references"}
MOST_SAMPLES = 20
LISTED = {"form": "forms", "view": "views", "agent": "agents"}


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over distinct pairs: parallel edges collapse, a self-loop adds two."""
    return endpoints(edges.select("src", "dst").distinct()).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(node, n_edges) over all edges."""
    return endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("n_edges"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


def hubs(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n targets that most edges lead to; ties by name."""
    return edges.groupBy(F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("n_links")).orderBy(F.desc("n_links"), "target").limit(n)


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, declared): declared nodes, and endpoints that no one declared."""
    declared = nodes.select("node").distinct()
    implicit = endpoints(edges).distinct().join(declared, "node", "left_anti")
    return declared.withColumn("declared", F.lit(True)).union(implicit.withColumn("declared", F.lit(False)))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(endpoints(edges).distinct(), "node", "left_anti")


def top_coupled(edges: DataFrame, n: int = 8) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(n)


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: max_degree, max_node (the first by name), n_nodes, coupling."""
    best = degrees(edges).agg(F.max("degree").alias("max_degree"), F.min_by("node", F.struct(-F.col("degree"), "node")).alias("max_node"))
    one = best.join(all_nodes(nodes, edges).agg(F.count(F.lit(1)).alias("n_nodes")))
    return one.select(F.coalesce("max_degree", F.lit(0)).alias("max_degree"), "max_node", "n_nodes", clamped(F.coalesce("max_degree", F.lit(0)) / F.greatest("n_nodes", F.lit(1))).alias("coupling"))


def bundles(edges: DataFrame, *titles: str) -> DataFrame:
    """Edges with the same ends and type as one, with their count."""
    return edges.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n_edges"), *(F.max(t).alias(t) for t in titles))


def neighbourhood(edges: DataFrame, focus: Column, edge_type: str | None = None) -> DataFrame:
    """Nodes one step from the focus, itself among them."""
    own = edges.filter((F.col("src") == focus) | (F.col("dst") == focus))
    return endpoints(own.filter(F.col("type") == edge_type) if edge_type else own).distinct()


def matrix(edges: DataFrame, columns: list | None = None) -> DataFrame:
    """Sources by targets: counts, zero where there is no edge, and the row's total."""
    wide = edges.groupBy("src").pivot("dst", columns).agg(F.count(F.lit(1))) if columns else edges.groupBy("src").pivot("dst").agg(F.count(F.lit(1)))
    names = [c for c in wide.columns if c != "src"]
    filled = wide.na.fill(0, names)
    return filled.withColumn("total", sum((F.col(f"`{c}`") for c in names), F.lit(0)).cast("long"))


def matrix_cells(edges: DataFrame) -> DataFrame:
    """(src, dst, n, heat): cells, with row, column and grand totals where an end is null; heat is ceil(4 n / the largest cell)."""
    cube = edges.groupingSets([["src", "dst"], ["src"], ["dst"], []], "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    most = edges.groupBy("src", "dst").count().agg(F.max("count").alias("most"))
    return cube.join(F.broadcast(most)).select("src", "dst", "n", F.when(F.col("level") == 0, F.ceil(4 * F.col("n") / F.col("most"))).otherwise(0).cast("long").alias("heat"))


def matrix_order(edges: DataFrame, hide_empty: bool = True, ends: DataFrame | None = None) -> DataFrame:
    """(side, node, total) of a matrix: its rows and columns, the fullest first, ties by name. ends (side, node): what else it may show, with a total of 0."""
    totals = edges.select(F.explode(F.array(F.struct(F.lit("row").alias("side"), F.col("src").alias("node")), F.struct(F.lit("column").alias("side"), F.col("dst").alias("node")))).alias("x"))
    counted = totals.groupBy("x.side", "x.node").agg(F.count(F.lit(1)).alias("total"))
    if ends is not None and not hide_empty:
        counted = counted.unionByName(ends.select("side", "node").distinct().join(counted, ["side", "node"], "left_anti").withColumn("total", F.lit(0).cast("long")))
    return counted.orderBy("side", F.desc("total"), "node")


def validation(edges: DataFrame, agents: DataFrame, least_forms: int = 22) -> DataFrame:
    """(gate, n, passed): lookups to impossible view names, edges that select forms, agents, agents without a trigger."""
    e = edges.agg(
        F.count_if((F.col("type") == "LOOKUP_VIA_VIEW") & F.col("target_name").rlike('[":]')).alias("bad_lookup_targets"), F.count_if(F.col("type") == "SELECTS_FORM").alias("form_selections"),
    )
    a = agents.agg(F.count(F.lit(1)).alias("agents"), F.count_if(F.coalesce("trigger", F.lit("")) == "").alias("agents_without_trigger"))
    gates = {"bad_lookup_targets": F.col("bad_lookup_targets") == 0, "form_selections": F.col("form_selections") >= least_forms, "agents": F.col("agents") > 0, "agents_without_trigger": F.col("agents_without_trigger") == 0}
    return e.join(a).select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("n"), ok.alias("passed")) for g, ok in gates.items()))).alias("x")).select("x.*")


def hardcoded(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, kind, value) distinct: drive and UNC paths, addresses, hierarchical names, database files."""
    of = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return texts.select(group, F.explode(F.concat(*(of(*x) for x in HARDCODED.items()))).alias("x")).select(group, "x.kind", "x.value").distinct()


def hardcoded_counts(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, n_hardcoded, ratio): database files count up to a bound; the ratio saturates at n / (n + 12)."""
    kinds = hardcoded(texts, group, text).groupBy(group, "kind").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum(F.when(F.col("kind") == "nsf", F.least(F.col("n"), F.lit(MOST_NSF))).otherwise(F.col("n")))
    return kinds.groupBy(group).agg(n.alias("n_hardcoded")).withColumn("ratio", F.col("n_hardcoded") / (F.col("n_hardcoded") + 12))


def hardcoded_samples(texts: DataFrame, group: str, text: str = "text", most: int = MOST_SAMPLES) -> DataFrame:
    """(group, sample, values): the first values of each list of samples in their order, drive paths before network paths; no list is longer than most."""
    rank, names = F.create_map(*(F.lit(x) for k, kind in enumerate(HARDCODED) for x in (kind, k))), F.create_map(*(F.lit(x) for pair in SAMPLES.items() for x in pair))
    found = hardcoded(texts, group, text).select(group, F.element_at(names, F.col("kind")).alias("sample"), F.element_at(rank, F.col("kind")).alias("rank"), "value")
    few = first_distinct(found, [group, "sample"], ["rank", "value"], most, "rank", "value")
    return few.groupBy(group, "sample").agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("x")).select(group, "sample", F.col("x.value").alias("values"))


def cross_ratio(edges: DataFrame, src_db: str = "src_db", dst_db: str = "dst_db", always: tuple[str, ...] = ("REFERENCES_DATABASE", "CROSS_DATABASE_LOOKUP"), lookup: str = "LOOKUP_VIA_VIEW") -> DataFrame:
    """One row: n_edges, n_cross, cross. Two types always cross; lookups do if their ends' databases differ."""
    crosses = F.col("type").isin(*always) | (F.col("type") == lookup) & (F.col(src_db) != F.col(dst_db))
    out = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.coalesce(crosses, F.lit(False))).alias("n_cross"))
    return out.withColumn("cross", ratio(F.col("n_cross"), F.col("n_edges")))


def complexity(coupling_: Column, cross: Column, hard: Column, orphans_: Column) -> Column:
    """struct<score,rating>: 0 to 100, of the four clamped ratios."""
    parts = {"coupling": coupling_, "cross": cross, "hardcoded": hard, "orphans": orphans_}
    raw = sum((clamped(c) * WEIGHTS[k] for k, c in parts.items()), F.lit(0.0)) * 100
    return F.struct(raw.alias("score"), F.when(F.bround(raw, 0) <= 33, "Low").when(F.bround(raw, 0) <= 66, "Moderate").otherwise("High").alias("rating"))


def score(nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """One row with the four ratios, the score and the rating of a graph. edges: src, dst, type, src_db, dst_db; texts: text."""
    one = coupling(nodes, edges).join(cross_ratio(edges)).join(orphans(all_nodes(nodes, edges).select("node"), edges).agg(F.count(F.lit(1)).alias("n_orphans")))
    hard = hardcoded_counts(texts.select(F.lit(0).alias("g"), "text"), "g").agg(F.coalesce(F.sum("n_hardcoded"), F.lit(0)).alias("n_hardcoded"))
    one = one.join(hard).withColumn("orphan_ratio", F.col("n_orphans") / F.greatest("n_nodes", F.lit(1))).withColumn("hard_ratio", F.col("n_hardcoded") / (F.col("n_hardcoded") + 12))
    return one.withColumn("c", complexity(F.col("coupling"), F.col("cross"), F.col("hard_ratio"), F.col("orphan_ratio"))).select("*", "c.score", "c.rating").drop("c")


def resolve_databases(edges: DataFrame, databases: DataFrame, views: DataFrame) -> DataFrame:
    """Lookups whose database argument names another known database that has the view: one CROSS_DATABASE_LOOKUP edge each.

    edges: src, dst, type, src_db, db_ref; databases: database_id, path, title, source_file, pos; views: database_id, view.
    """
    alias = databases.select("database_id", "pos", F.explode(F.array("database_id", "path", "title", "source_file")).alias("name")).filter("name is not null and name <> ''")
    alias = top_n(alias.withColumn("key", F.lower("name")), ["key"], 1, F.desc("pos")).select("key", F.col("database_id").alias("dst_db"))
    own = edges.filter((F.col("type") == "LOOKUP_VIA_VIEW") & F.col("db_ref").isNotNull()).withColumn("key", F.lower("db_ref"))
    found = own.join(alias, "key").filter(F.col("dst_db") != F.col("src_db"))
    known = views.select(F.col("database_id").alias("dst_db"), F.col("view").alias("dst")).distinct()
    return found.join(known, ["dst_db", "dst"], "left_semi").select("src", "dst", F.lit("CROSS_DATABASE_LOOKUP").alias("type"), "src_db", "dst_db", "db_ref")


def capability_map(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """(domain, n_elements, n_rules, names): blocks count for a domain if their owner's name is one of its distinct names."""
    from siftgraph.functions.classify import domain

    placed = elements.withColumn("domain", domain(F.col("name")))
    per_name = blocks.groupBy(F.col("owner_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rules = placed.select("domain", "name").distinct().join(per_name, "name").groupBy("domain").agg(F.sum("n").alias("n_rules"))
    counted = placed.groupBy("domain").agg(F.count(F.lit(1)).alias("n_elements"), F.count_distinct("name").alias("n_names"))
    return counted.join(rules, "domain", "left").select("domain", "n_elements", "n_names", F.coalesce("n_rules", F.lit(0)).alias("n_rules")).orderBy(F.desc("n_elements"), "domain")


def capability_names(elements: DataFrame) -> DataFrame:
    """(domain, part, name, n): the forms, views and agents of each domain by name, one row for a name, however many a domain has; order by name for a list."""
    from siftgraph.functions.classify import domain

    part = F.element_at(F.create_map(*(F.lit(x) for pair in LISTED.items() for x in pair)), F.lower("element_type"))
    placed = elements.select(domain(F.col("name")).alias("domain"), part.alias("part"), "name")
    return placed.filter("part is not null").groupBy("domain", "part", "name").agg(F.count(F.lit(1)).alias("n"))


def lifecycle_summaries(blocks: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, stage, pos, summary): what each block (owner_name, event, category, pos, summary) of a form's stages does; by pos they are in order. A block without an event goes by its category."""
    from siftgraph.functions.classify import STAGES

    stage = F.coalesce(F.nullif(F.lower("event"), F.lit("")), F.col("category"))
    own = blocks.withColumn("stage", stage).filter(F.col("stage").isin(*STAGES)).join(forms.select(F.col("name").alias("owner_name")).distinct(), "owner_name", "left_semi")
    return own.select(F.col("owner_name").alias("form"), "stage", "pos", "summary")


def lifecycles(blocks: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, stages, n_stages): the stages that a form's blocks serve, in fixed order; forms without a qualifying event are left out."""
    from siftgraph.functions.classify import STAGES

    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.lower("event"))
    qualifies = (stage > 0) | F.col("category").isin("validation", "state_transition", "lifecycle")
    own = blocks.filter(qualifies).join(forms.select(F.col("name").alias("owner_name")).distinct(), "owner_name", "left_semi")
    met = own.withColumn("stage", stage).groupBy("owner_name").agg(F.array_sort(F.collect_set(F.when(F.col("stage") > 0, F.col("stage")))).alias("met"))  # nine values at most
    names = F.transform("met", lambda k: F.element_at(F.array(*map(F.lit, STAGES)), k.cast("int")))
    return met.select(F.col("owner_name").alias("form"), F.array_join(names, ",").alias("stages"), F.size("met").alias("n_stages")).orderBy(F.desc("n_stages"), "form")


def flow(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): scheduled and other agents, macro calls and links across databases."""
    scheduled = F.lower(F.coalesce("trigger", F.lit(""))).rlike("schedul|daily|hourly|weekly|monthly")
    a = agents.groupBy(F.when(scheduled, "scheduled_agents").otherwise("other_agents").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = F.create_map(F.lit("INVOKES_AGENT"), F.lit("macro_calls"), F.lit("CROSS_DATABASE_LOOKUP"), F.lit("cross_database"), F.lit("REFERENCES_DATABASE"), F.lit("cross_database"))
    return a.union(edges.filter(F.col("type").isin("INVOKES_AGENT", "CROSS_DATABASE_LOOKUP", "REFERENCES_DATABASE")).groupBy(F.element_at(kinds, F.col("type")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))
