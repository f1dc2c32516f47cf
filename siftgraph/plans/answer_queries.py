"""Queries of what a reader of stored results asks: related findings, summaries, listings, gates and samples, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.functions import classify, text
from siftgraph.operators import graph, remedies, reports, views
from siftgraph.plans import queries
from siftgraph.plans.catalog import ORACLE_SQL, query, table
from siftgraph.sources import store

SEVERITY = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
_SEVERITY_SQL = "CASE {k} % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Suppliers stand for functions and customers for findings: names are parts of other names, so that containment matters.
NAMED_SQL = f"""f AS (SELECT s_suppkey AS function_id, CASE WHEN s_suppkey % 3 = 0 THEN 'lib' || s_suppkey % 50 || '_open' ELSE 'Fn' || s_suppkey END AS name, 'lib' || s_suppkey % 7 AS element,
        CASE WHEN s_suppkey % 5 = 0 THEN 'lotusscript' ELSE 'java' END AS language FROM supplier),
    g AS (SELECT c_custkey AS finding_id, 'DOM-' || c_custkey % 9 AS rule_id, {_SEVERITY_SQL.format(k='c_custkey')} AS severity, c_custkey % 4 AS rank, 'Lib' || c_custkey % 50 AS element_name, 'title fn' || c_nationkey AS title,
        'calls fn' || c_custkey || '()' AS evidence, 'at fn' || c_custkey % 30 AS location, c_custkey AS line, c_custkey % 11 = 0 AS fp FROM customer),
    p AS (SELECT function_id, finding_id, rank, rule_id, g.element_name, line, lower(name) AS n, lower(element) AS e, lower(element_name) AS o, title, evidence, location, language FROM f, g WHERE NOT fp)"""


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    functions = table(spark, sf_dir, "supplier").select(
        s.alias("function_id"), F.when(s % 3 == 0, _text("lib", s % 50, "_open")).otherwise(_text("Fn", s)).alias("name"), _text("lib", s % 7).alias("element"), F.when(s % 5 == 0, "lotusscript").otherwise("java").alias("language"),
    )
    findings = table(spark, sf_dir, "customer").select(
        c.alias("finding_id"), _text("DOM-", c % 9).alias("rule_id"), _pick(SEVERITY, c).alias("severity"), _text("Lib", c % 50).alias("element_name"), _text("title fn", F.col("c_nationkey")).alias("title"),
        _text("calls fn", c, "()").alias("evidence"), _text("at fn", c % 30).alias("location"), F.lit("f.dxl").alias("source_file"), c.alias("line"), (c % 11 == 0).alias("is_false_positive"),
    )
    return functions, findings


@query(f"""WITH {NAMED_SQL} SELECT function_id, finding_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY rank, rule_id, element_name, line, finding_id) AS nth FROM p
    WHERE language <> 'lotusscript' AND (contains(o, n) OR contains(title, n) OR contains(evidence, n) AND contains(o, e))) WHERE nth <= 3""")
def findings_of_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.related_findings(*_named(spark, sf_dir))


@query(f"""WITH {NAMED_SQL} SELECT function_id, finding_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY rank, rule_id, finding_id) AS nth FROM p
    WHERE contains(o, n) OR contains(n, o) OR contains(title, n) OR contains(evidence, n) OR contains(location, n) AND (contains(o, e) OR contains(location, e) OR contains('f.dxl', e))) WHERE nth <= 8""")
def findings_of_functions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.related_findings(*_named(spark, sf_dir), wide=True)


@query(f"""WITH {NAMED_SQL}, a AS (SELECT 'agent:' || element_name AS node, rank, rule_id AS item FROM g WHERE NOT fp
        UNION ALL SELECT 'agent:L' || substr(element, 2), function_id % 4, name || ' ' || CASE function_id % 2 WHEN 0 THEN 'PARTIAL' ELSE 'UNPROTECTED' END FROM f WHERE function_id % 3 <> 2),
    d AS (SELECT node, rank, item, row_number() OVER (PARTITION BY node ORDER BY rank, item) AS nth FROM (SELECT DISTINCT node, rank, item FROM a))
    SELECT node, n, worst, items FROM (SELECT node, count(*) AS n, {_SEVERITY_SQL.format(k='min(rank)')} AS worst FROM a GROUP BY node) JOIN (SELECT node, string_agg(item, '; ' ORDER BY nth) AS items FROM d WHERE nth <= 5 GROUP BY node) USING (node)""")
def issues_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, findings = _named(spark, sf_dir)
    k = F.col("function_id")
    acted = functions.select(F.lit("agent").alias("element_type"), F.regexp_replace("element", "^l", "L").alias("element_name"), "name", _pick(SEVERITY, k).alias("severity"), F.when(k % 3 == 2, "SAFE").when(k % 2 == 0, "PARTIAL").otherwise("UNPROTECTED").alias("status"), F.lit(None).cast("boolean").alias("is_false_positive"))
    return reports.node_issues_of(findings.withColumn("element_type", F.lit("agent")), acted)


@query("""WITH t AS (SELECT doc_id, lower(text) AS t, CAST(length(text) // 2 AS BIGINT) AS mid FROM documents), x AS (SELECT *, substr(t, 1, mid + 3) AS head, strpos(substr(t, mid + 1), 'and') AS b FROM t),
    y AS (SELECT *, strpos(reverse(head), 'eht') AS a FROM x)
    SELECT doc_id, CAST(length(head) - a - 2 AS INTEGER) AS loop_start, CAST(CASE WHEN b > 0 THEN mid + b + 2 ELSE length(t) END AS INTEGER) AS loop_end FROM y WHERE a > 0""")
def loops_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region around the middle of each text, with words in place of the loop's keywords."""
    low = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("body"))
    found = low.select("doc_id", text.loop_around(F.col("body"), F.floor(F.length("body") / 2), "the", "and").alias("x")).filter("x is not null")
    return found.select("doc_id", F.col("x.start").alias("loop_start"), F.col("x.end").alias("loop_end"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'doc' || o_orderkey || ',db' WHEN 1 THEN 'v' || o_orderkey ELSE 'f' || o_orderkey END AS params, o_orderkey % 3 = 0 OR o_orderkey % 3 = 2 AS gives FROM orders""")
def handle_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    signature = F.when(k % 3 == 0, _text("Function f(doc", k, " As NotesDocument, n As Integer, db As NotesDatabase) As NotesView")).when(k % 3 == 1, _text("public void f(View v", k, ", int n)")).otherwise(_text("private static Document f", k, "(String s)"))
    language = F.when(k % 3 == 0, "LotusScript").otherwise("java")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.handle_params(signature, language), ",").alias("params"), text.returns_handle(signature, language).alias("gives"))


_FORMULAS = ['@If(@IsNewDoc; @Failure("No {k}"); 1)', "@If(a{k}; 1; 2)", ' @Command([Save{k}]) ', "Sub x{k}\nEnd Sub", "", '@DbLookup(""; "V{k}"; 1) + @UserRoles', "a := {k};\nb", "x" * 118 + "{k} and more"]


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Validation error: "No ' || o_orderkey || '" Behavior differs for new vs existing documents.' WHEN 1 THEN 'Conditional branching based on field or document state.'
    WHEN 2 THEN 'Runs Domino @Command [Save' || o_orderkey || '].' WHEN 3 THEN 'LotusScript procedure.' WHEN 4 THEN 'Empty logic block.' WHEN 5 THEN 'Resolves a value via @DbLookup from another view/database. Checks current user roles for authorization.'
    WHEN 6 THEN 'Formula logic: a := ' || o_orderkey || '; b' ELSE 'Formula logic: ' || substr(repeat('x', 118) || o_orderkey || ' and more', 1, 120) || '…' END AS said FROM orders""")
def formula_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.formula_summary(F.replace(_pick(_FORMULAS, k), F.lit("{k}"), k.cast("string"))).alias("said"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'p' || page_id || '.dxl' WHEN 1 THEN 'db' || page_id || '.nsf' WHEN 2 THEN 'in' || page_id END AS source_name FROM pages")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    first, base = F.when(k % 4 == 0, _text("Upload:x/y\\p", k, ".dxl")).when(k % 4 == 1, " "), F.when(k % 4 == 1, _text("C:\\data\\db", k, ".nsf"))
    return table(spark, sf_dir, "pages").select("page_id", store.source_name(first, base, F.when(k % 4 == 2, _text("a/in", k, "//"))).alias("source_name"))


@query("""WITH s AS (SELECT o_custkey AS graph_id, o_orderkey % 5 AS n_critical, CASE WHEN o_orderkey % 10 = 0 THEN 100.0 ELSE round(100.0 * (o_orderkey % 3) / (o_orderkey % 10), 1) END AS safety_rate,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders)
    SELECT c_custkey AS graph_id, n_critical, CAST(safety_rate AS DOUBLE) AS safety_rate FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 50) LEFT JOIN (SELECT * FROM s WHERE nth = 1) ON c_custkey = graph_id""")
def listed_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), k.alias("at"), (k % 5).alias("critical"), (k % 3).alias("safe"), (k % 10).alias("total"))
    return store.listed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_custkey").alias("parsed_at")), snapshots).select("graph_id", "n_critical", "safety_rate")


@query("SELECT 'row' AS side, CAST(c_nationkey AS VARCHAR) AS node, count(*) AS total FROM customer GROUP BY c_nationkey UNION ALL SELECT 'column', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment")
def matrix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matrix_order(queries._segments(spark, sf_dir))


@query("""SELECT 'bad_lookup_targets' AS gate, n, n = 0 AS passed FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 50 = 0) UNION ALL SELECT 'form_selections', n, n >= 22 FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'A')
    UNION ALL SELECT 'agents', n, n > 0 FROM (SELECT count(*) AS n FROM events) UNION ALL SELECT 'agents_without_trigger', n, n = 0 FROM (SELECT count(*) AS n FROM events WHERE event_type = 'error')""")
def graph_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    edges = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "LOOKUP_VIA_VIEW").otherwise("SELECTS_FORM").alias("type"), F.when(p % 50 == 0, _text("x:", p)).otherwise(_text("V", p)).alias("target_name"))
    return graph.validation(edges, table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("trigger")))


@query("""WITH b AS (SELECT o_orderkey, 'a' || o_custkey % 40 AS source_file, 'x = s.getDatabase(' || o_orderkey || ');' AS body FROM orders WHERE o_orderkey % 2 = 0)
    SELECT source_file, 'java' AS language, 'getDatabase' AS pattern, nth, sample FROM (SELECT source_file, body AS sample, row_number() OVER (PARTITION BY source_file ORDER BY body) AS nth FROM b) WHERE nth <= 5""")
def upgrade_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    units = table(spark, sf_dir, "orders").select(_text("a", F.col("o_custkey") % 40).alias("source_file"), F.when(k % 2 == 0, "java").otherwise("lotusscript").alias("language"), F.when(k % 2 == 0, _text("x = s.getDatabase(", k, ");")).otherwise("x = 1").alias("body"))
    return views.upgrade_samples(units)


@query(f"WITH {queries.BLOCKS_SQL} SELECT o_orderkey FROM b WHERE owner_name = '{queries.NAMES[0]}'")
def blocks_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.blocks_of(queries._blocks(spark, sf_dir), queries.NAMES[0]).select("o_orderkey")


_CAPABILITY_SQL = f"""WITH {queries.BLOCKS_SQL}, e AS (SELECT name, {queries._case('name', classify.DOMAINS, 'General')} AS domain FROM (SELECT {queries._NAME_SQL.replace('k %', 'p_partkey %')} AS name FROM part)),
    r AS (SELECT domain, sum(n) AS n_rules FROM (SELECT DISTINCT domain, name FROM e) JOIN (SELECT owner_name AS name, count(*) AS n FROM b GROUP BY owner_name) USING (name) GROUP BY domain)
    SELECT domain, count(*) AS n_elements, count(DISTINCT name) AS n_names, CAST(coalesce(max(n_rules), 0) AS BIGINT) AS n_rules FROM e LEFT JOIN r USING (domain) GROUP BY domain"""


def _items(section: str, sql: str, order: str = "") -> str:
    return f"SELECT '{section}' AS section, CAST(to_json(t) AS VARCHAR) AS item FROM (SELECT * FROM ({sql}) {order}) t"


@query(" UNION ALL ".join([
    _items("databases", "SELECT 'db' || p_size AS database_id, count(*) AS n_elements FROM part GROUP BY p_size"), _items("capabilities", _CAPABILITY_SQL), _items("business_rules", ORACLE_SQL["rules_budgeted"], "ORDER BY id LIMIT 50"),
    _items("document_lifecycles", ORACLE_SQL["lifecycle_stages"]), _items("application_flow", ORACLE_SQL["flow_partition"]), _items("category_counts", ORACLE_SQL["category_counts"]),
]))
def synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "part").select(F.lit("form").alias("element_type"), queries._name(F.col("p_partkey")).alias("name"), _text("db", F.col("p_size")).alias("database_id"))
    agents = table(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("signup", "purchase"), "Scheduled: daily").otherwise(F.col("event_type")).alias("trigger"))
    edges = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "INVOKES_AGENT").when(F.col("l_returnflag") == "R", "CROSS_DATABASE_LOOKUP").otherwise("USES").alias("type"))
    return reports.synthesis(elements, queries._blocks(spark, sf_dir), agents, edges, queries.rules_budgeted(spark, sf_dir))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'walk' WHEN 1 THEN 'view' END AS topic, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'var v' || o_orderkey || ' = db.getView(name);  // before the loop' ELSE 'Set v' || o_orderkey || ' = db.GetView(name) '' before the loop' END
    WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'while (v' || o_orderkey || ' != null) {' ELSE 'try { use(v' || o_orderkey || '); } finally { if (v' || o_orderkey || ' != null) v' || o_orderkey || '.recycle(); }' END
    ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'Do Until v' || o_orderkey || ' Is Nothing' ELSE 'Call use(v' || o_orderkey || ')' END END AS first_line FROM orders""")
def remedies_of_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic and the first line of each finding's sketch, named by the variable of its evidence."""
    k = F.col("o_orderkey")
    findings = table(spark, sf_dir, "orders").select("o_orderkey", _pick(["DOM-002", "PERF-002", "NONE-1"], k).alias("rule_id"), _pick(["java", "LotusScript"], k).alias("language"), (k % 5 == 0).alias("in_loop"), F.lit(None).cast("string").alias("variable"), _text("x == 1; v", k, " = c.getNextDocument(v", k, ")").alias("evidence"))
    return remedies.with_remedies(findings).select("o_orderkey", "topic", F.split_part("sketch", F.lit("\n"), F.lit(1)).alias("first_line"))
