"""The library's operators applied to the star-schema and text tables, each with the SQL that checks it.

The tables hold no code exports, so each operator runs on a column of the same shape: links of pages as edges,
orders as functions, line items as calls, events as signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.functions import classify, text
from siftgraph.operators import audit, graph, rules, windows
from siftgraph.plans.catalog import query, table
from siftgraph.sources import store

LINK = 'href="([^"]*)"'
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
SECRET = r"(password|secret|api_key|token)[ ]?[=:]"
SEVERITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, src, dst, type) of every link of the pages."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("pos", "dst"))
    kind = F.when(F.col("dst").startswith("#"), "anchor").when(F.col("dst").contains("://"), "absolute").otherwise("relative")
    return found.select("page_id", "pos", F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), "dst", kind.alias("type"))


LINKS_SQL = f"""m AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS dst, generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) - 1 AS pos FROM pages),
    links AS (SELECT page_id, pos, 'page:' || page_id AS src, dst, CASE WHEN starts_with(dst, '#') THEN 'anchor' WHEN contains(dst, '://') THEN 'absolute' ELSE 'relative' END AS type FROM m)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from suppliers to parts, one for each line item."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("type"))


SUPPLY_SQL = "supply AS (SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, l_returnflag AS type FROM lineitem)"
DEGREE_SQL = "degree AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM (SELECT DISTINCT src, dst FROM supply) UNION ALL SELECT dst FROM (SELECT DISTINCT src, dst FROM supply)) GROUP BY node)"


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, src, dst, type FROM links")
def edges_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir)


@query(f"WITH {LINKS_SQL} SELECT page_id, dst, min(pos) AS pos FROM links GROUP BY page_id, dst")
def edges_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_per_key(links(spark, sf_dir), ["page_id", "dst"], "pos").select("page_id", "dst", "pos")


@query(f"WITH {LINKS_SQL} SELECT type, count(*) AS n_edges FROM links GROUP BY type")
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_counts(links(spark, sf_dir))


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, dst FROM links WHERE type = 'relative' AND dst ILIKE '%the%' ORDER BY dst, src, pos LIMIT 500")
def edge_query_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = links(spark, sf_dir).select("page_id", "pos", "type", F.col("dst").alias("source_name"), F.col("src").alias("target_name"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("evidence"))
    return store.query_edges(edges, "relative", "the", 500).select("page_id", "pos", F.col("source_name").alias("dst"))

@query(f"WITH {SUPPLY_SQL} SELECT src, dst, type, count(*) AS n_edges FROM supply GROUP BY src, dst, type")
def edge_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bundles(supply(spark, sf_dir))


@query(f"WITH {SUPPLY_SQL} SELECT src AS node FROM supply WHERE src = 's:7' OR dst = 's:7' UNION SELECT dst FROM supply WHERE src = 's:7' OR dst = 's:7'")
def focus_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(supply(spark, sf_dir), F.lit("s:7"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("src"), F.col("c_mktsegment").alias("dst"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"SELECT CAST(c_nationkey AS VARCHAR) AS src, {', '.join(f'''count(*) FILTER (WHERE c_mktsegment = '{s}') AS "{s}"''' for s in SEGMENTS)}, count(*) FILTER (WHERE c_mktsegment IN {tuple(SEGMENTS)}) AS total FROM customer GROUP BY c_nationkey")
def matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matrix(_segments(spark, sf_dir), SEGMENTS)


@query("""WITH e AS (SELECT CAST(c_nationkey AS VARCHAR) AS src, c_mktsegment AS dst FROM customer), cells AS (SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst), most AS (SELECT max(n) AS most FROM cells)
    SELECT src, dst, n, CAST(ceil(4.0 * n / most) AS BIGINT) AS heat FROM cells, most UNION ALL SELECT src, NULL, count(*), 0 FROM e GROUP BY src
    UNION ALL SELECT NULL, dst, count(*), 0 FROM e GROUP BY dst UNION ALL SELECT NULL, NULL, count(*), 0 FROM e""")
def matrix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matrix_cells(_segments(spark, sf_dir))


@query(f"""WITH {SUPPLY_SQL}, {DEGREE_SQL}, nodes AS (SELECT 's:' || s_suppkey AS node FROM supplier UNION SELECT 'p:' || p_partkey FROM part UNION SELECT node FROM degree)
    SELECT (SELECT max(degree) FROM degree) AS max_degree, (SELECT node FROM degree ORDER BY degree DESC, node LIMIT 1) AS max_node, count(*) AS n_nodes, CAST((SELECT max(degree) FROM degree) AS DOUBLE) / count(*) AS coupling FROM nodes""")
def degree_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling(_nodes(spark, sf_dir), supply(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("node")
    return table(spark, sf_dir, "supplier").select(key("s:", "s_suppkey")).union(table(spark, sf_dir, "part").select(key("p:", "p_partkey")))


@query(f"WITH {SUPPLY_SQL} SELECT 'p:' || p_partkey AS node FROM part WHERE 'p:' || p_partkey NOT IN (SELECT dst FROM supply WHERE type = 'R') UNION SELECT 's:' || s_suppkey FROM supplier WHERE 's:' || s_suppkey NOT IN (SELECT src FROM supply WHERE type = 'R')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(_nodes(spark, sf_dir), supply(spark, sf_dir).filter("type = 'R'"))


@query(f"WITH {SUPPLY_SQL}, {DEGREE_SQL} SELECT node, degree FROM degree ORDER BY degree DESC, node LIMIT 8")
def top_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_coupled(supply(spark, sf_dir))


@query(f"WITH {SUPPLY_SQL} SELECT node, count(*) AS n_edges FROM (SELECT src AS node FROM supply UNION ALL SELECT dst FROM supply) GROUP BY node")
def node_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_counts(supply(spark, sf_dir))


@query("""WITH declared AS (SELECT DISTINCT 's:' || s_suppkey AS node FROM supplier WHERE s_nationkey < 12), ends AS (SELECT 's:' || l_suppkey AS node FROM lineitem)
    SELECT node, true AS declared FROM declared UNION ALL SELECT DISTINCT node, false FROM ends WHERE node NOT IN (SELECT node FROM declared)""")
def implicit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "supplier").filter("s_nationkey < 12").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node"))
    src = supply(spark, sf_dir).select("src", F.col("src").alias("dst"))
    return graph.all_nodes(declared, src)


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))  # noqa: E741
    own = l.select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("l_returnflag") == "A", "REFERENCES_DATABASE").otherwise("LOOKUP_VIA_VIEW")
    return own.select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), kind.alias("type"), F.col("s_nationkey").alias("src_db"), F.col("c_nationkey").alias("dst_db"))


NATION_SQL = """e AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'REFERENCES_DATABASE' ELSE 'LOOKUP_VIA_VIEW' END AS type, s_nationkey AS src_db, c_nationkey AS dst_db
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"WITH {NATION_SQL}, r AS (SELECT count(*) AS n_edges, count(*) FILTER (WHERE type = 'REFERENCES_DATABASE' OR src_db <> dst_db) AS n_cross FROM e) SELECT n_edges, n_cross, CAST(n_cross AS DOUBLE) / n_edges AS \"cross\" FROM r")
def cross_db_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_ratio(_nation_edges(spark, sf_dir))


@query("""WITH e AS (SELECT 'v' || l_partkey AS dst, 'l' || l_linenumber AS src, 'db' || (l_suppkey % 5) AS src_db, CASE l_linenumber % 3 WHEN 0 THEN 'PATH' || (l_partkey % 5) WHEN 1 THEN 'title' || (l_partkey % 5) END AS db_ref FROM lineitem),
    a AS (SELECT lower('Path' || k) AS key, 'db' || k AS dst_db FROM range(5) t(k) UNION ALL SELECT lower('Title' || k), 'db' || k FROM range(5) t(k))
    SELECT src, e.dst, 'CROSS_DATABASE_LOOKUP' AS type, src_db, dst_db, db_ref FROM e JOIN a ON lower(db_ref) = key
    WHERE src_db <> dst_db AND EXISTS (SELECT 1 FROM part WHERE 'v' || p_partkey = e.dst AND 'db' || (p_size % 5) = dst_db)""")
def cross_db_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("PATH"), (F.col("l_partkey") % 5).cast("string"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("title"), (F.col("l_partkey") % 5).cast("string")))
    edges = line.select(F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("src"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("LOOKUP_VIA_VIEW").alias("type"), F.concat(F.lit("db"), (F.col("l_suppkey") % 5).cast("string")).alias("src_db"), ref.alias("db_ref"))
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    databases = spark.range(5).select(name("db").alias("database_id"), name("Path").alias("path"), name("Title").alias("title"), F.lit(None).cast("string").alias("source_file"), F.col("id").alias("pos"))
    views = part.select(F.concat(F.lit("db"), (F.col("p_size") % 5).cast("string")).alias("database_id"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("view"))
    return graph.resolve_databases(edges, databases, views)


IP_SQL = graph.HARDCODED["ip"].replace("'", "''")


@query(f"""WITH v AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '{IP_SQL}', 0)) AS value FROM documents), n AS (SELECT lang, count(*) AS n_hardcoded FROM v GROUP BY lang)
    SELECT lang, n_hardcoded, CAST(n_hardcoded AS DOUBLE) / (n_hardcoded + 12) AS ratio FROM n""")
def hardcoded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hardcoded_counts(table(spark, sf_dir, "documents"), "lang")


@query(f"""WITH {NATION_SQL}, {SUPPLY_SQL}, {DEGREE_SQL}, nodes AS (SELECT 's:' || s_suppkey AS node FROM supplier UNION SELECT 'p:' || p_partkey FROM part UNION SELECT node FROM degree),
    c AS (SELECT CAST((SELECT max(degree) FROM degree) AS DOUBLE) / (SELECT count(*) FROM nodes) AS coupling),
    x AS (SELECT CAST(count(*) FILTER (WHERE type = 'REFERENCES_DATABASE' OR src_db <> dst_db) AS DOUBLE) / count(*) AS crossing FROM e),
    h AS (SELECT CAST(count(*) AS DOUBLE) / (count(*) + 12) AS hard FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{IP_SQL}', 0)) FROM documents)),
    o AS (SELECT CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM nodes) AS orphan FROM nodes WHERE node NOT IN (SELECT src FROM supply WHERE type = 'R') AND node NOT IN (SELECT dst FROM supply WHERE type = 'R'))
    SELECT coupling, crossing, hard, orphan, 100 * (0.30 * coupling + 0.25 * crossing + 0.25 * hard + 0.20 * orphan) AS score FROM c, x, h, o""")
def complexity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _nodes(spark, sf_dir), supply(spark, sf_dir)
    hard = graph.hardcoded_counts(table(spark, sf_dir, "documents").select(F.lit(0).alias("g"), "text"), "g").select(F.col("ratio").alias("hard"))
    alone = graph.orphans(graph.all_nodes(nodes, edges).select("node"), edges.filter("type = 'R'")).agg(F.count(F.lit(1)).alias("n_orphans"))
    one = graph.coupling(nodes, edges).join(graph.cross_ratio(_nation_edges(spark, sf_dir))).join(hard).join(alone)
    one = one.select("coupling", F.col("cross").alias("crossing"), "hard", (F.col("n_orphans") / F.col("n_nodes")).alias("orphan"))
    return one.select("*", graph.complexity(*map(F.col, ("coupling", "crossing", "hard", "orphan")))["score"].alias("score"))


@query(f"SELECT doc_id, k - 1 AS nth, lower(regexp_extract_all(text, '(?i){SECRET}', 1)[k]) AS kind FROM (SELECT doc_id, text, unnest(range(1, len(regexp_extract_all(text, '(?i){SECRET}', 1)) + 1)) AS k FROM documents)")
def secrets_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?i)" + SECRET), F.lit(1))).alias("nth", "kind"))
    return found.select("doc_id", "nth", F.lower("kind").alias("kind"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){SECRET}') AND regexp_matches(text, '{IP}')")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, rules.Rule("OWN-001", "HIGH", 80, ("text",), "(?i)" + SECRET, needs=(IP,), once=True)).select("doc_id")


def _ruled(spark: SparkSession, sf_dir: str, *own: rules.Rule) -> DataFrame:
    """Findings of a user's own rules over the documents."""
    units = table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("source_file"), F.col("doc_id").cast("string").alias("element_name"), F.lit("text").alias("element_type"), F.lit("text").alias("language"), F.lit(None).cast("string").alias("event"), F.col("text").alias("body"), F.lit(1).alias("start_line"))
    return rules.findings(units.withColumn("n", F.regexp_count("body", F.lit("the")).cast("long")), list(own))


@query("SELECT doc_id, len(regexp_extract_all(text, 'the', 0)) AS n FROM documents WHERE len(regexp_extract_all(text, 'the', 0)) >= 2")
def repeat_count_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, rules.Rule("OWN-002", "LOW", 60, ("text",), "the", once=True, least=2, words=("the",))).select("doc_id", "n")


@query("SELECT doc_id FROM documents WHERE strpos(text, ' of ') > 0 AND strpos(substr(text, strpos(text, ' of ') + 1), ' with ') > 0")
def position_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir, rules.Rule("OWN-003", "LOW", 60, ("text",), r"(?s) of(?: .*)? with ", once=True, words=(" of ",))).select("doc_id")


@query("SELECT l_orderkey, count(*) AS n_fields FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey HAVING count(*) >= 6")
def wide_form_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_fields")).filter("n_fields >= 6")


WORDS_ANY, WORDS_CASED = [("the", r"(^|\s)the\s"), ("von", r"(^|\s)von\s"), ("que", r"(^|\s)que\s")], [("The", r"(^|\s)The\s"), ("Der", r"(^|\s)Der\s")]


@query(f"""WITH k AS (SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{w}' END" for w, p in WORDS_ANY)}, {', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{w}' END" for w, p in WORDS_CASED)}) AS labels FROM documents)
    SELECT doc_id, labels FROM k WHERE labels <> ''""")
def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = audit.prefilter(table(spark, sf_dir, "documents"), "text", [(*x, True) for x in WORDS_ANY] + [(*x, False) for x in WORDS_CASED])
    return kept.select("doc_id", F.array_join("keywords_matched", ",").alias("labels"))


def _case(c: str, patterns: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{label}'" for label, p in patterns) + f" ELSE '{otherwise}' END"


PART_DOMAINS = [("Rings", "ring"), ("Widgets", "widget|gadget"), ("Red", "red"), ("Bolts", "bolt|nut")]


@query(f"SELECT domain, count(*) AS n_elements, count(DISTINCT p_name) AS n_names FROM (SELECT p_name, {_case('p_name', PART_DOMAINS, 'General')} AS domain FROM part) GROUP BY domain")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_name", classify.first_match(F.col("p_name"), PART_DOMAINS, "General").alias("domain"))
    return named.groupBy("domain").agg(F.count(F.lit(1)).alias("n_elements"), F.count_distinct("p_name").alias("n_names"))


NAMES = ["Order Form", "Quote List", "Customer Card", "Item Master", "Web Portal", "User Profile", "Print View", "Data Import", "Border", "Misc"]
_NAME_SQL = "CASE k % 10 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END"


def _name(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), (k % 10 + 1).cast("int"))


@query(f"""WITH e AS (SELECT name, {_case('name', classify.DOMAINS, 'General')} AS domain FROM (SELECT {_NAME_SQL.replace('k %', 'p_partkey %')} AS name FROM part)),
    b AS (SELECT name, count(*) AS n FROM (SELECT {_NAME_SQL.replace('k %', 'o_orderkey %')} AS name FROM orders) GROUP BY name),
    r AS (SELECT domain, sum(n) AS n_rules FROM (SELECT DISTINCT domain, name FROM e) JOIN b USING (name) GROUP BY domain)
    SELECT domain, count(*) AS n_elements, count(DISTINCT name) AS n_names, CAST(coalesce(max(n_rules), 0) AS BIGINT) AS n_rules FROM e LEFT JOIN r USING (domain) GROUP BY domain""")
def domain_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "part").select(_name(F.col("p_partkey")).alias("name"))
    return graph.capability_map(elements, table(spark, sf_dir, "orders").select(_name(F.col("o_orderkey")).alias("owner_name")))


EVENTS = ["QuerySave", "validation", "queryopen", "HideWhen", "selection", "initialize", "click", "webquerysave"]
LANGUAGES = ["lotusscript", "java", "ssjs", "csjs", "xpages", "formula"]
_EVENT_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(EVENTS)) + " END"
_LANGUAGE_SQL = "CASE (o_orderkey // 8) % 6 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(LANGUAGES)) + " END"
_CATEGORY_SQL = (
    "CASE " + " ".join(f"WHEN lower(event) IN ({', '.join(repr(w) for w in words.split())}) THEN '{c}'" for words, c in classify.EVENT_CATEGORIES) + " WHEN regexp_matches(lower(body), '@if|@isnewdoc|@userroles') THEN 'conditional_logic' "
    + " ".join(f"WHEN lower(language) IN ({', '.join(repr(w) for w in words.split())}) THEN '{c}'" for words, c in classify.LANGUAGE_CATEGORIES) + " ELSE 'general_formula' END"
)
BLOCKS_SQL = f"b AS (SELECT o_orderkey, {_NAME_SQL.replace('k %', 'o_custkey %')} AS owner_name, {_EVENT_SQL} AS event, {_LANGUAGE_SQL} AS language, CASE WHEN o_orderkey % 7 = 0 THEN '@If(a;b;c)' ELSE 'x := ' || o_orderkey END AS body FROM orders)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    k = F.col("o_orderkey")
    body = F.when(k % 7 == 0, "@If(a;b;c)").otherwise(F.concat(F.lit("x := "), k.cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _name(F.col("o_custkey")).alias("owner_name"), pick(EVENTS, k).alias("event"), pick(LANGUAGES, F.floor(k / 8)).alias("language"), body.alias("body"))
    return rows.withColumn("category", classify.logic_category(F.col("event"), F.col("body"), F.col("language")))


@query(f"WITH {BLOCKS_SQL} SELECT o_orderkey, {_CATEGORY_SQL} AS category FROM b")
def logic_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("o_orderkey", "category")


@query(f"WITH {BLOCKS_SQL} SELECT category, count(*) AS n FROM (SELECT {_CATEGORY_SQL} AS category FROM b) GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_STAGE_SQL = "CASE lower(event) " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(classify.STAGES, 1)) + " END"


@query(f"""WITH {BLOCKS_SQL}, q AS (SELECT DISTINCT owner_name, {_STAGE_SQL} AS stage, lower(event) AS event FROM b WHERE {_STAGE_SQL} IS NOT NULL OR {_CATEGORY_SQL} IN ('validation', 'state_transition', 'lifecycle'))
    SELECT owner_name AS form, string_agg(event, ',' ORDER BY stage) AS stages, CAST(count(*) AS INTEGER) AS n_stages FROM q WHERE stage IS NOT NULL GROUP BY owner_name""")
def lifecycle_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return graph.lifecycles(blocks, spark.createDataFrame([(n,) for n in NAMES], "name string"))


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT o_orderkey, owner_name, CASE {_CATEGORY_SQL} {' '.join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(classify.PRIORITIES))} ELSE 9 END AS priority FROM b),
    head AS (SELECT * FROM p WHERE priority <= 6), n AS (SELECT count(*) AS n_head FROM head),
    band AS (SELECT o_orderkey, owner_name, priority, row_number() OVER (ORDER BY priority, owner_name, o_orderkey) AS nth FROM p WHERE priority BETWEEN 7 AND 8), tail AS (SELECT * FROM p WHERE priority = 9),
    u AS (SELECT * FROM head UNION ALL SELECT o_orderkey, owner_name, priority FROM band, n WHERE nth <= greatest(0, 101 - n_head) UNION ALL SELECT * FROM tail)
    SELECT 'BR-' || lpad(CAST(row_number() OVER (ORDER BY priority, owner_name, o_orderkey) AS VARCHAR), 3, '0') AS id, o_orderkey, priority FROM u ORDER BY priority, owner_name, o_orderkey LIMIT 200""")
def rules_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("priority", classify.rule_priority(F.col("category")))
    kept = windows.budgeted(rows, "priority", 200, 7, 8, "owner_name", "o_orderkey")
    return kept.select(windows.sequential_id("BR", [], "priority", "owner_name", "o_orderkey").alias("id"), "o_orderkey", "priority")  # 200 rows at most


@query("""SELECT CASE WHEN event_type IN ('signup', 'purchase') THEN 'scheduled_agents' ELSE 'other_agents' END AS kind, count(*) AS n FROM events GROUP BY 1
    UNION ALL SELECT CASE l_returnflag WHEN 'A' THEN 'macro_calls' ELSE 'cross_database' END, count(*) FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def flow_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = table(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("signup", "purchase"), "Scheduled: daily").otherwise(F.col("event_type")).alias("trigger"))
    edges = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "INVOKES_AGENT").when(F.col("l_returnflag") == "R", "CROSS_DATABASE_LOOKUP").otherwise("USES").alias("type"))
    return graph.flow(agents, edges)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(table(spark, sf_dir, "events"), ["user_id"], 1, "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 24")
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(table(spark, sf_dir, "events"), ["user_id"], 24, "ts", "event_id").select("user_id", "event_id")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events WHERE props ILIKE '%k%' GROUP BY 1 ORDER BY day DESC LIMIT 20")
def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").filter(F.col("props").ilike("%k%")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return daily.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors")).orderBy(F.desc("day")).limit(20)


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).cast("long").alias("k"))


@query("""SELECT d.doc_id, coalesce(l.toxic = 1, false) AS is_false_positive, CASE WHEN l.toxic = 1 THEN 'LOW' WHEN n_chars > 2000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN l.quality = 1 THEN 'kept' ELSE 'first' END AS reason,
    CASE WHEN l.toxic = 1 THEN 'FALSE_POSITIVE' END AS ai_status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def triage_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, "HIGH").otherwise("MEDIUM").alias("severity"), F.lit("first").alias("reason"), F.lit(None).cast("string").alias("ai_status"), F.lit(False).alias("is_false_positive"))
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_false_positive"), F.when(F.col("quality") == 1, "kept").otherwise("").alias("reason"), F.lit("").alias("status"), F.lit(1).alias("at"))
    return audit.triaged(items, marks, "doc_id").select("doc_id", "is_false_positive", "severity", "reason", "ai_status")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings: a rule by key, a severity by priority, in a loop if their status is F."""
    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    severity = F.when(p == "1", "CRITICAL").when(p == "2", "HIGH").when(p == "3", "MEDIUM").otherwise("LOW")
    return o.select("o_orderkey", "o_custkey", F.element_at(F.array(*map(F.lit, RULES)), (F.col("o_orderkey") % len(RULES) + 1).cast("int")).alias("rule_id"), severity.alias("severity"), (F.col("o_orderstatus") == "F").alias("in_loop"))


RULES = ["DOM-001", "DOM-005", "DOM-013", "LS-DOM-004", "DOM-OWN-001", "FORM-003", "LS-EXT-001", "PERF-002"]
_RULE_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(RULES)) + " END"
FINDINGS_SQL = f"f AS (SELECT o_orderkey, o_custkey, {_RULE_SQL} AS rule_id, {SEVERITY_SQL} AS severity, o_orderstatus = 'F' AS in_loop FROM orders)"
_CALIBRATED_SQL = f"CASE WHEN rule_id NOT IN ({', '.join(repr(r) for r in classify.LOOP_RULES)}) THEN severity WHEN in_loop THEN CASE WHEN severity IN ('HIGH', 'MEDIUM') THEN 'CRITICAL' ELSE severity END WHEN severity IN ('CRITICAL', 'HIGH') THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"WITH {FINDINGS_SQL} SELECT o_orderkey, rule_id, {_CALIBRATED_SQL} AS severity FROM f")
def severity_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("o_orderkey", "rule_id", classify.calibrated(F.col("rule_id"), F.col("severity"), F.col("in_loop")).alias("severity"))


_FOUR = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))


@query(f"WITH {FINDINGS_SQL} SELECT o_custkey, {_FOUR} FROM f GROUP BY o_custkey")
def severity_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.severity_counts(_findings(spark, sf_dir), "o_custkey")


@query(f"WITH {FINDINGS_SQL}, c AS (SELECT o_custkey, {_FOUR} FROM f GROUP BY o_custkey) SELECT o_custkey, CASE WHEN critical >= 3 OR critical >= 1 AND high >= 3 THEN 'CRITICAL' WHEN critical >= 1 OR high >= 3 THEN 'HIGH' WHEN high >= 1 OR medium >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c")
def risk_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.severity_counts(_findings(spark, sf_dir), "o_custkey").select("o_custkey", audit.risk_level(F.col("critical"), F.col("high"), F.col("medium")).alias("risk"))


@query(f"WITH {FINDINGS_SQL} SELECT family, count(*) AS n FROM (SELECT CASE WHEN starts_with(rule_id, 'LS-DOM') THEN 'LS-DOM' WHEN starts_with(rule_id, 'DOM-OWN') THEN 'DOM-OWN' ELSE split_part(rule_id, '-', 1) END AS family FROM f) GROUP BY family")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy(classify.family(F.col("rule_id")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions: their lines allocate (A), clean (R) or neither (N) the part that is the variable."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("string")))).alias("allocated"), F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("string")))).alias("cleaned"),
    )  # an order has a few lines
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    rows = o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    none = F.array().cast("array<string>")
    status = classify.cleanup_status(F.col("allocated"), F.col("cleaned"), none, F.lit(False), F.size("cleaned"), F.col("o_orderstatus") == "P", F.lit(False), F.col("o_custkey") % 10 == 0)
    return rows.select("*", (F.size("allocated") > 0).alias("allocates"), status.alias("status"), (F.col("o_orderkey") % 13 == 0).alias("is_false_positive"))


RECORDS_SQL = """g AS (SELECT l_orderkey, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'A'), []) AS allocated, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_linestatus = 'F'), []) AS cleaned,
      count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS n_alloc, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS n_clean FROM lineitem GROUP BY l_orderkey),
    u AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_orderpriority, n_alloc, n_clean, len(list_filter(allocated, lambda x: NOT list_contains(cleaned, x))) AS n_unclean FROM orders JOIN g ON o_orderkey = l_orderkey),
    s AS (SELECT *, CASE WHEN n_alloc = 0 THEN 'SAFE' WHEN n_clean = 0 THEN 'UNPROTECTED' WHEN n_unclean > 0 THEN 'PARTIAL' WHEN o_orderstatus = 'P' THEN 'CONDITIONAL' ELSE 'PROTECTED' END AS base FROM u),
    r AS (SELECT *, n_alloc > 0 AS allocates, o_orderkey % 13 = 0 AS fp, CASE WHEN o_custkey % 10 = 0 AND base IN ('PROTECTED', 'CONDITIONAL', 'PARTIAL') THEN 'ESCAPE_PATH_GAP' ELSE base END AS status FROM s)"""


@query(f"WITH {RECORDS_SQL} SELECT o_orderkey, status FROM r")
def cleanup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("o_orderkey", "status")


@query(f"""WITH {RECORDS_SQL} SELECT o_orderstatus, count(*) AS total, count(*) FILTER (WHERE fp) AS false_positives, count(*) FILTER (WHERE allocates) AS allocators, count(*) FILTER (WHERE allocates AND NOT fp AND status = 'PROTECTED') AS with_cleanup,
    count(*) FILTER (WHERE NOT fp AND status = 'UNPROTECTED') AS unprotected, count(*) FILTER (WHERE NOT fp AND status = 'PARTIAL') AS partial, count(*) FILTER (WHERE NOT fp AND status = 'CONDITIONAL') AS conditional,
    count(*) FILTER (WHERE NOT fp AND status = 'ESCAPE_PATH_GAP') AS escape_gap, count(*) FILTER (WHERE NOT fp AND status IN ('PARTIAL', 'CONDITIONAL', 'ESCAPE_PATH_GAP')) AS incomplete,
    100.0 * (count(*) FILTER (WHERE NOT allocates AND status = 'SAFE') + count(*) FILTER (WHERE allocates AND (fp OR status = 'PROTECTED'))) / count(*) AS safety_rate,
    CASE WHEN count(*) FILTER (WHERE allocates AND NOT fp) = 0 THEN 100.0 ELSE 100.0 * count(*) FILTER (WHERE allocates AND NOT fp AND status = 'PROTECTED') / count(*) FILTER (WHERE allocates AND NOT fp) END AS coverage_rate FROM r GROUP BY o_orderstatus""")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.inventory_summary(_records(spark, sf_dir), "o_orderstatus")


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT o_custkey, count(*) FILTER (WHERE allocates AND NOT fp) AS n, count(*) FILTER (WHERE allocates AND NOT fp AND status = 'PROTECTED') AS c, count(*) AS t,
      count(*) FILTER (WHERE NOT allocates AND status = 'SAFE') + count(*) FILTER (WHERE allocates AND (fp OR status = 'PROTECTED')) AS s, count(*) FILTER (WHERE allocates) AS a FROM r GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN a > 0 AND (CASE WHEN n = 0 THEN 100.0 ELSE 100.0 * c / n END) < 50 THEN 'high' WHEN 100.0 * s / t < 40 THEN 'high' WHEN 100.0 * s / t < 75 THEN 'moderate' ELSE 'low' END AS ring FROM k""")
def ring_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = audit.inventory_summary(_records(spark, sf_dir), "o_custkey")
    return per.select("o_custkey", classify.ring_class(F.col("allocators"), F.col("coverage_rate"), F.col("safety_rate")).alias("ring"))


@query(f"""WITH {RECORDS_SQL} SELECT o_orderkey FROM r ORDER BY fp DESC, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, {SEVERITY_SQL.replace("'CRITICAL'", '0').replace("'HIGH'", '1').replace("'MEDIUM'", '2').replace("'LOW'", '3')}, status, o_orderpriority, o_orderkey LIMIT 200""")
def inventory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    rows = _records(spark, sf_dir).select("o_orderkey", "is_false_positive", F.when(F.col("o_orderstatus") == "F", "ssjs").when(F.col("o_orderstatus") == "O", "java").otherwise("other").alias("language"), "status", F.col("o_orderpriority").alias("element"), F.col("o_orderkey").alias("name"), F.when(p == "1", "CRITICAL").when(p == "2", "HIGH").when(p == "3", "MEDIUM").otherwise("LOW").alias("severity"))
    return rows.orderBy(*audit.inventory_order()).limit(200).select("o_orderkey")


@query("""SELECT a.l_orderkey AS caller, b.l_orderkey AS callee, a.l_partkey AS name FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey
    WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND a.l_suppkey = b.l_suppkey AND a.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY ALL""")
def call_graph_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftgraph.operators.ownership import gaps

    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    calls = l.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("scope"))
    defs = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("callee"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("scope"))
    return gaps(calls, defs, table(spark, sf_dir, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("scope")))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}', 0)) AS word FROM documents), i AS (SELECT DISTINCT split_part(lower(text), ' ', 1) AS item FROM benchmark)
    SELECT item, doc_id FROM (SELECT item, w.doc_id, row_number() OVER (PARTITION BY item ORDER BY n_chars DESC, w.doc_id) AS nth FROM w JOIN i ON word = item JOIN documents d ON d.doc_id = w.doc_id) WHERE nth <= 3""")
def theta_related_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.split_part(F.lower("text"), F.lit(" "), F.lit(1)).alias("item")).distinct()
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    return audit.related(items, table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text"), words, "item", 3, F.desc("n_chars"), "doc_id").select("item", "doc_id")


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) AS word FROM benchmark) WHERE word NOT IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) FROM documents WHERE lang = 'en') GROUP BY word ORDER BY n DESC, word LIMIT 80""")
def token_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counted = words(table(spark, sf_dir, "benchmark")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return audit.without(counted, words(table(spark, sf_dir, "documents").filter("lang = 'en'")), "word").orderBy(F.desc("n"), "word").limit(80)


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{IP}') AND doc_id NOT IN (SELECT doc_id FROM labels)")
def clean_but_hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.without(table(spark, sf_dir, "documents").filter(F.col("text").rlike(IP)), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


SCOPED = [("en", "articles", r"\s(the|a)\s"), ("de", "articles", r"\s(der|die|das)\s"), ("fr", "articles", r"\s(le|la|les)\s"), ("en", "of", r"\sof\s"), ("es", "de", r"\sde\s")]


@query(f"""WITH p AS (SELECT * FROM (VALUES {', '.join(str(t).replace(chr(92) * 2, chr(92)) for t in SCOPED)}) AS v(lang, label, pattern)), h AS (SELECT lang, label, len(regexp_extract_all(text, pattern, 0)) AS n FROM documents JOIN p USING (lang))
    SELECT lang, label, CAST(sum(n) AS BIGINT) AS n_hits, count(*) FILTER (WHERE n > 0) AS n_texts FROM h GROUP BY lang, label""")
def scoped_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame(SCOPED, "lang string, label string, pattern string")
    return audit.scoped_counts(table(spark, sf_dir, "documents"), patterns, scope="lang")


@query("SELECT doc_id, 1 + length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) AS line FROM (SELECT doc_id, text, strpos(text, ' with ') - 1 AS pos FROM documents) WHERE pos >= 0")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", " with ") - 1).filter("at >= 0")
    return hit.select("doc_id", text.line_of(F.col("text"), F.col("at")).cast("long").alias("line"))


@query("""SELECT doc_id, CASE WHEN length(cut) > 100 THEN substr(cut, 1, 100) || '...' ELSE cut END AS evidence FROM (SELECT doc_id, trim(substr(text, greatest(0, pos - 40) + 1, pos + 80 - greatest(0, pos - 40)), ' ') AS cut
    FROM (SELECT doc_id, text, strpos(text, ' with ') - 1 AS pos FROM documents) WHERE pos >= 0)""")
def evidence_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", " with ") - 1).filter("at >= 0")
    return hit.select("doc_id", text.evidence(F.col("text"), F.col("at"), 80, 100).alias("evidence"))


@query("""WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS ls, 1 + length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) AS line FROM (SELECT doc_id, text, strpos(text, ' with ') - 1 AS pos FROM documents) WHERE pos >= 0)
    SELECT doc_id, CAST(k AS INTEGER) AS line, ls[k] AS text, k = line AS highlight FROM (SELECT doc_id, ls, line, unnest(range(greatest(1, line - 2), least(len(ls), line + 2) + 1)) AS k FROM h)""")
def line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", " with ") - 1).filter("at >= 0").withColumn("hit", text.line_of(F.col("text"), F.col("at")))
    return hit.select("doc_id", F.inline(text.line_window(F.col("text"), F.col("hit"))))


@query("""SELECT event_id, user_id FROM (SELECT *, max(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE event_type = 'error' AND NOT coalesce(seen, false)""")
def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("seen", windows.seen_before(F.col("event_type") == "signup", ["user_id"], "ts", "event_id"))
    return e.filter("event_type = 'error' and not seen").select("event_id", "user_id")


@query("""SELECT 'no_text' AS gate, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_failures FROM documents UNION ALL SELECT 'quote', count(*) FILTER (WHERE contains(text, '"')) FROM documents UNION ALL SELECT 'short', count(*) FILTER (WHERE n_chars < 50) FROM documents""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"no_text": F.col("text").isNull() | (F.col("text") == ""), "quote": F.contains(F.col("text"), F.lit('"')), "short": F.col("n_chars") < 50}
    return audit.quality_gates(table(spark, sf_dir, "documents"), checks)


@query(f"WITH {FINDINGS_SQL}, c AS (SELECT {_FOUR} FROM f) SELECT critical, high, CAST(0 AS BIGINT) AS unprotected, CAST(26 AS BIGINT) AS incomplete, concat_ws(',', CASE WHEN critical > 0 THEN 'critical' END, CASE WHEN high > 50 THEN 'high' END, 'incomplete') AS broken, false AS passed FROM c")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audit.severity_counts(_findings(spark, sf_dir)).withColumns({"unprotected": F.lit(0).cast("long"), "incomplete": F.lit(26).cast("long")})
    return audit.ci_gate(counts)


LABELS = ["txtCustomerName", "order_total", "POId", "dtShipDate", "url"]


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Customer Name' WHEN 1 THEN 'Order Total' WHEN 2 THEN 'POId' WHEN 3 THEN 'Ship Date' ELSE 'URL' END AS label FROM part")
def humanise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.humanise(name).alias("label"))


@query('''SELECT p_partkey, n, CASE n WHEN 0 THEN '"":"NoCache"' WHEN 1 THEN '"srv' || p_partkey || '":"db.nsf"' WHEN 2 THEN '"v;' || p_size || '"' WHEN 3 THEN 'f(a;b' || p_partkey || ')' ELSE CAST(p_size AS VARCHAR) END AS argument
    FROM part, (VALUES (0), (1), (2), (3), (4)) AS v(n) WHERE n < 4 OR p_size % 2 = 0''')
def arg_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    call = F.concat(F.lit('"":"NoCache"; "srv'), key, F.lit('":"db.nsf"; "v;'), size, F.lit('"; f(a;b'), key, F.lit(")"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("; "), size)).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.split_arguments(call)).alias("n", "argument"))


@query('''SELECT p_partkey, n, CASE n WHEN 0 THEN 'a' || p_partkey || ';(b);")"' ELSE CAST(p_size AS VARCHAR) END AS body FROM part, (VALUES (0), (1)) AS v(n) WHERE n = 0 OR p_size % 3 > 0''')
def balanced_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    open_ = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("; y := @dblookup ("), size, F.lit(")")))
    source = F.concat(F.lit("x := @DbLookup(a"), key, F.lit(';(b);")")'), open_, F.lit(" + @DbColumn(d); @DbLookup(open"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.call_bodies(source, F.lit("@DbLookup"))).alias("n", "body"))


@query('''SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ' if (a' || p_partkey || ') { s = "}"; } ' END AS block FROM part''')
def brace_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    source = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("function f() { if (a"), key, F.lit(') { s = "}"; } } tail'))).otherwise(F.concat(F.lit("function g() { open"), key))
    return table(spark, sf_dir, "part").select("p_partkey", text.brace_block(source).alias("block"))


@query('''SELECT p_partkey, 'vw' || p_size AS "view", 'ret' AS ret, 'k' || p_partkey AS "key", CASE WHEN p_size % 2 = 0 THEN 'db' || p_partkey || '.nsf' END AS database FROM part''')
def lookup_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    where = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"srv":"db'), key, F.lit('.nsf"'))).otherwise('""')
    args = text.split_arguments(F.concat(F.lit('"":"NoCache"; '), where, F.lit('; "vw'), size, F.lit('"; "ret"; "k1":"k'), key, F.lit('"')))
    return table(spark, sf_dir, "part").select("p_partkey", text.lookup_arguments(args).alias("x")).select("p_partkey", F.col("x.view"), "x.ret", "x.key", "x.database")


# Code units by construction, with and without what a rule looks for: the template is chosen by the order's key, so where its rule must hit is known.
TEMPLATES = [
    ("DOM-001", "java", 'x{k} = session.createDateTime("x").getLocalTime();', 'd{k} = session.createDateTime("x"); d{k}.recycle();'),
    ("DOM-002", "java", "while (d{k} != null) { n = c.getNextDocument(d{k}); d{k} = n; }", "while (d{k} != null) { n = c.getNextDocument(d{k}); d{k}.recycle(); d{k} = n; }"),
    ("DOM-003", "java", 'use{k}(s.getDatabase("a", "b"));', 'try { use{k}(s.getDatabase("a", "b")); } finally { x.recycle(); }'),
    ("DOM-004", "java", "org.openntf.domino.Document d{k}; d{k}.recycle();", "lotus.domino.Document d{k}; d{k}.recycle();"),
    ("DOM-005", "java", "org.openntf.domino.Session s{k}; lotus.domino.Base b;", "org.openntf.domino.Session s{k};"),
    ("DOM-006", "java", "static Database cache{k};", "Database cache{k};"),
    ("DOM-007", "ssjs", 'sessionScope["d{k}"] = getDatabase("NotesDatabase");', 'sessionScope["d{k}"] = "text";'),
    ("DOM-008", "java", "for (int i = 0; i < {k}; i++) { v = e.getColumnValues(); }", "v{k} = e.getColumnValues();"),
    ("DOM-009", "java", "for (int i = 0; i < {k}; i++) { t = s.createDateTime(x); }", "t{k} = s.createDateTime(x);"),
    ("DOM-010", "java", "Document d{k} = db.createDocument();", "Document d{k} = db.createDocument(); try { d{k}.save(); } finally { d{k}.recycle(); }"),
    ("DOM-011", "java", "view.recycle(); x{k} = 1; y = doc.getUniversalID();", "y{k} = doc.getUniversalID(); view.recycle();"),
    ("DOM-012", "java", "while (d{k} != null) { if (ok()) { d{k}.recycle(); } }", "while (d{k} != null) { if (d{k} != null) { d{k}.recycle(); } }"),
    ("DOM-013", "java", "n{k} = c.getNextDocument(d); use(); d = n{k};", "n{k} = c.getNextDocument(d); d.recycle(); d = n{k};"),
    ("DOM-014", "java", 'i{k} = doc.getFirstItem("a"); i{k}.getText();', 'i{k} = doc.getFirstItem("a"); i{k}.recycle();'),
    ("DOM-015", "java", "ViewNavigator n{k} = view.createViewNav();", "ViewNavigator n{k} = view.createViewNav(); n{k}.recycle();"),
    ("DOM-016", "java", 'for (;;) { c{k} = db.search("x"); }', 'c{k} = db.search("x");'),
    ("DOM-017", "java", 'EmbeddedObject e{k} = item.getEmbeddedObject("f");', 'EmbeddedObject e{k} = item.getEmbeddedObject("f"); e{k}.recycle();'),
    ("DOM-018", "java", "d{k} = entry.getDocument();", "d{k} = entry.getDocument(); d{k}.recycle();"),
    ("DOM-019", "java", "c{k} = view.getAllDocumentsByKey(x);", "c{k} = view.getAllDocumentsByKey(x); c{k}.recycle();"),
    ("DOM-020", "ssjs", "session.recycle(); // {k}", "doc{k}.recycle();"),
    ("DOM-021", "java", "Stream s{k} = session.createStream();", "Stream s{k} = session.createStream(); s{k}.recycle();"),
    ("DOM-022", "java", "c{k} = db.search(q); d = c.getFirstDocument(); d.recycle();", "c{k} = db.search(q); d = c.getFirstDocument(); d.recycle(); c{k}.recycle();"),
    ("DOM-023", "java", 'viewScope.put("d{k}", doc);', 'viewScope.put("d{k}", 1);'),
    ("DOM-024", "java", "dominoNAF.recycle(); // {k}", "use(dominoNAF); // {k}"),
    ("DOM-025", "java", "org.openntf.domino.View v{k}; for (Object o : v{k}.getAllEntries()) { o.recycle(); }", "org.openntf.domino.View v{k}; for (Object o : v{k}.getAllEntries()) { toLotus(o).recycle(); }"),
    ("PERF-001", "ssjs", "var v{k} = db.getView(x); while (d != null) { d.replaceItemValue(a, b); }", "var v{k} = db.getView(x); v{k}.setAutoUpdate(false); while (d != null) { d.replaceItemValue(a, b); }"),
    ("PERF-002", "java", "for (int i = 0; i < {k}; i++) { v = db.getView(x); }", "v{k} = db.getView(x); for (;;) { go(); }"),
    ("PERF-003", "ssjs", "while (d{k} != null) { d{k}.save(); d{k} = c.getNextDocument(d{k}); }", "d{k}.save();"),
    ("PERF-004", "ssjs", "for (var i = 1; i < {k}; i++) { d = c.getNthDocument(i); }", "d{k} = c.getNthDocument(1);"),
    ("SEC-001", "java", 'String password = "hunter{k}"; String u = "http://a.b/c";', 'String password = "hunter{k}"; String u = "https://a.b/c";'),
    ("SEC-002", "ssjs", 'var u{k} = context.getUrlParameter("id"); var d = database.getDocumentByUNID(u{k});', "var d{k} = database.getDocumentByUNID(own);"),
    ("FORM-001", "formula", '@DbLookup("";"";"v{k}";"k";1) + @DbColumn("";"";"v";1)', '@DbLookup("";"";"v{k}";"k";1)'),
    ("FORM-002", "formula", '@For(n:=1;n<{k};n:=n+1; @DbLookup("";"";"v";n;1))', '@DbLookup("";"";"v{k}";"k";1)'),
    ("FORM-003", "formula", 'password := "hunter{k}"', 'word := "hunter{k}"'),
    ("FORM-004", "lotusscript", "item{k}.IsSummary = True", "item{k}.IsSummary = False"),
    ("EXT-001", "java", "Connection c{k} = ds.getConnection();", "Connection c{k} = ds.getConnection(); c{k}.close();"),
    ("EXT-002", "java", "HttpURLConnection c{k} = (HttpURLConnection) u.openConnection();", "HttpURLConnection c{k} = (HttpURLConnection) u.openConnection(); c{k}.disconnect();"),
    ("LS-EXT-001", "lotusscript", "Dim js{k} As JavaSession", "Dim js{k} As JavaSession\nSet js{k} = Nothing"),
    ("LS-EXT-002", "lotusscript", "Call con{k}.OpenConnection(a)", "Call con{k}.OpenConnection(a)\nCall con{k}.Disconnect()"),
]


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({2 * k}, '{t[0]}')" for k, t in enumerate(TEMPLATES)) + f") AS v(n, rule_id)) SELECT o_orderkey, rule_id FROM orders JOIN t ON o_orderkey % {2 * len(TEMPLATES)} = n")
def detector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each unit the findings of its template's rule: units of even templates have one, those of odd ones have none."""
    flat = [(t[1], t[2 + odd], t[0]) for t in TEMPLATES for odd in (0, 1)]
    pick = lambda n: F.element_at(F.array(*(F.lit(t[n]) for t in flat)), (F.col("o_orderkey") % len(flat) + 1).cast("int"))
    key = F.col("o_orderkey").cast("string")
    units = table(spark, sf_dir, "orders").select("o_orderkey", pick(2).alias("own_rule"), F.lit("orders").alias("source_file"), key.alias("element_name"), F.lit("scriptlibrary").alias("element_type"), pick(0).alias("language"), F.lit(None).cast("string").alias("event"), F.replace(pick(1), F.lit("{k}"), key).alias("body"), F.lit(1).alias("start_line"))
    return rules.findings(units).filter("rule_id = own_rule").select("o_orderkey", "rule_id")


@query("SELECT o_orderkey, 'f' || o_orderkey AS name, CASE o_orderkey % 4 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'UNPROTECTED' WHEN 2 THEN 'PROTECTED' ELSE 'PARTIAL' END AS status FROM orders")
def function_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftgraph.operators.inventory import inventory

    bodies = ["return 1;", 'var d = db.getView("x"); use(d);', 'var d = db.getView("x"); d.recycle();', 'var a = db.getView("x"); var b = db.getDatabase("y"); a.recycle();']
    key = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("function f"), key, F.lit("() { "), F.element_at(F.array(*map(F.lit, bodies)), (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(" }"))
    units = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("orders").alias("source_file"), key.alias("element_name"), F.lit("scriptlibrary").alias("element_type"), F.lit("ssjs").alias("language"), F.lit(None).cast("string").alias("event"), body.alias("body"), F.lit(1).alias("start_line"))
    return inventory(units).select("o_orderkey", "name", "status")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 20")
def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftgraph.sources.store import shared_dir
    from siftgraph.streaming import ingest

    events, top = table(spark, sf_dir, "events"), shared_dir(spark)
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    ingest.append_signals(stream, f"{top}/signals", f"{top}/checkpoint")
    return ingest.last_signals(spark.read.parquet(f"{top}/signals"), ["user_id"], 20, "ts", "event_id").select("event_id", "user_id")
