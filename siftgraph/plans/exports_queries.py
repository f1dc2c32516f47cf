"""Queries over exports, code and stored results. The inputs are made from the tables by construction, so that the SQL that checks them is plain.

Each customer gives an XML export of its own: a form with a validated field and a subform, a view that selects it, and an agent
with a lookup in the next customer's database. Each order gives a function or a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.functions import text
from siftgraph.operators import audit, edges, inventory, ownership, reports, rules, views
from siftgraph.plans.catalog import query, table
from siftgraph.sources import exports, store

TEMPLATE = (
    '<database title="T{k}" path="srv!!apps/db{k}.nsf"><form name="F{k}"><field name="Amount" type="number"><code event="inputvalidation"><formula>@If(Amount &gt; {k}; @Success; @Failure("Over {k}"))</formula></code></field>'
    '<field name="Note" type="text"/><subformref name="S{k}"/></form><view name="V{k}"><code event="selection"><formula>SELECT Form = "F{k}"</formula></code><column title="a"/></view>'
    '<agent name="A{k}"><trigger type="scheduled"><schedule type="daily"/></trigger><code event="action"><formula>x := @DbLookup("":"NoCache"; "":"db{n}.nsf"; "V{n}"; "key{k}"; 2)</formula></code></agent></database>'
)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    body = F.replace(F.replace(F.lit(TEMPLATE), F.lit("{k}"), k), F.lit("{n}"), (F.col("c_custkey") + 1).cast("string"))
    broken = F.when(F.col("c_custkey") % 100 == 7, F.concat(F.lit('<database><form> db.GetView("Broken'), k, F.lit('")'))).otherwise(body)
    return table(spark, sf_dir, "customer").select(F.concat(k, F.lit(".dxl")).alias("source_file"), broken.alias("text"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.written(exports.parsed(_texts(spark, sf_dir)))


OK_SQL = "ok AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, CAST(c_custkey + 1 AS VARCHAR) AS n FROM customer WHERE c_custkey % 100 <> 7)"


@query(f"WITH {OK_SQL} SELECT s || '.dxl' AS source_file, element_type, p || s AS name, CASE WHEN element_type = 'agent' THEN 'scheduled:daily' END AS trigger FROM ok, (VALUES ('form', 'F'), ('view', 'V'), ('agent', 'A')) AS v(element_type, p)")
def export_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.elements(_files(spark, sf_dir)).select("source_file", "element_type", "name", "trigger")


@query("SELECT c_custkey || '.dxl' AS source_file FROM customer WHERE c_custkey % 100 = 7")
def export_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).filter("error is not null").select("source_file")


@query(f"""WITH {OK_SQL} SELECT s || '.dxl' AS source_file, 'INCLUDES_SUBFORM' AS type, 'F' || s AS source_name, 'S' || s AS target_name FROM ok UNION ALL SELECT s || '.dxl', 'SELECTS_FORM', 'V' || s, 'F' || s FROM ok
    UNION ALL SELECT s || '.dxl', 'LOOKUP_VIA_VIEW', 'A' || s, 'V' || n FROM ok UNION ALL SELECT s || '.dxl', 'REFERENCES_DATABASE', 'A' || s, 'db' || n || '.nsf' FROM ok
    UNION ALL SELECT c_custkey || '.dxl', 'ACCESSES_VIEW', c_custkey || '.dxl', 'Broken' || c_custkey FROM customer WHERE c_custkey % 100 = 7""")
def export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.from_exports(_files(spark, sf_dir)).select("source_file", "type", "source_name", "target_name")


@query(f"""WITH {OK_SQL} SELECT 'F' || s AS owner_name, 'inputvalidation' AS event, 'validation' AS category FROM ok UNION ALL SELECT 'V' || s, 'selection', 'view_selection' FROM ok UNION ALL SELECT 'V' || s, 'selection', 'view_selection' FROM ok
    UNION ALL SELECT 'A' || s, 'action', 'general_formula' FROM ok UNION ALL SELECT 'F' || s, 'inputvalidation', 'validation' FROM ok""")
def export_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.blocks(_files(spark, sf_dir)).select("owner_name", "event", "category")


@query(f"WITH {OK_SQL} SELECT 'F' || s AS owner_name, 'Amount' AS field, 'Over ' || s AS messages, 0 AS n_lookups FROM ok UNION ALL SELECT 'F' || s, 'Note', '', 0 FROM ok")
def rules_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return reports.rules_catalog(exports.fields(files), exports.blocks(files)).select("owner_name", "field", "messages", "n_lookups")


@query(f"WITH {OK_SQL} SELECT 'A' || s AS owner_name, '@DbLookup' AS function, 'db' || n || '.nsf' AS target_database, 'V' || n AS target_view, 'key' || s AS return_field FROM ok")
def formula_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lookups(exports.blocks(_files(spark, sf_dir))).select("owner_name", "function", "target_database", "target_view", "return_field")


@query("SELECT element_type, count(*) AS n FROM customer, (VALUES ('form'), ('view'), ('agent')) AS v(element_type) WHERE c_custkey % 100 <> 7 GROUP BY element_type")
def export_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.totals(_files(spark, sf_dir)).groupBy("element_type").agg(F.sum("n").alias("n"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("finding_id"), pick("DOM-001", "PERF-002", "SEC-001", "LS-EXT-001", "DOM-OWN-001", "DOM-BS-001", "DOM-004").alias("rule_id"), pick("CRITICAL", "HIGH", "MEDIUM", "LOW", "HIGH").alias("severity"), (F.col("o_orderkey") % 60 + 40).cast("int").alias("confidence"),
        pick("java", "ssjs", "lotusscript").alias("language"), F.lit(None).cast("string").alias("event"), F.concat(F.lit("E"), (F.col("o_custkey") % 50).cast("string")).alias("element_name"), F.lit("agent").alias("element_type"), (F.col("o_orderkey") % 11 == 0).alias("is_false_positive"), F.lit(None).cast("string").alias("ai_status"),
    )


FINDINGS_SQL = """f AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'DOM-001' WHEN 1 THEN 'PERF-002' WHEN 2 THEN 'SEC-001' WHEN 3 THEN 'LS-EXT-001' WHEN 4 THEN 'DOM-OWN-001' WHEN 5 THEN 'DOM-BS-001' ELSE 'DOM-004' END AS rule_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'HIGH' END AS severity, o_orderkey % 60 + 40 AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'ssjs' ELSE 'lotusscript' END AS language,
    'E' || (o_custkey % 50) AS element_name, o_orderkey % 11 = 0 AS fp FROM orders)"""
_CATEGORY_SQL = """CASE WHEN rule_id = 'DOM-004' THEN 'deadlock' WHEN rule_id = 'PERF-002' THEN 'performance' WHEN rule_id = 'SEC-001' THEN 'security' WHEN rule_id = 'LS-EXT-001' THEN 'external' WHEN language = 'lotusscript' THEN 'other'
    WHEN rule_id = 'DOM-OWN-001' THEN 'ownership' WHEN rule_id = 'DOM-BS-001' THEN 'ai' ELSE 'handle' END"""


@query(f"WITH {FINDINGS_SQL} SELECT o_orderkey FROM f WHERE {_CATEGORY_SQL} = 'handle' AND NOT fp")
def filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.filter_findings(_findings(spark, sf_dir), "handle").select("o_orderkey")


@query(f"WITH {FINDINGS_SQL} SELECT o_orderkey, {_CATEGORY_SQL} AS category, CASE WHEN rule_id LIKE 'DOM-BS%' THEN 'blind_spot' WHEN fp THEN 'false_positive' ELSE 'all' END AS bucket, CASE WHEN confidence >= 90 THEN 'high' WHEN confidence >= 70 THEN 'medium' ELSE 'low' END AS band FROM f")
def finding_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftgraph.functions.classify import confidence_band

    return _findings(spark, sf_dir).select("o_orderkey", views.finding_category().alias("category"), views.finding_bucket().alias("bucket"), confidence_band(F.col("confidence")).alias("band"))


@query(f"WITH {FINDINGS_SQL} SELECT o_orderkey FROM f WHERE NOT fp AND language <> 'lotusscript' AND rule_id IN ('DOM-001', 'DOM-OWN-001', 'DOM-BS-001')")
def handle_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).filter(views.exhausts_handles()).select("o_orderkey")


@query(f"WITH {FINDINGS_SQL}, a AS (SELECT element_name, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS rank FROM f) SELECT 'agent:' || element_name AS node, count(*) AS n, CASE min(rank) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS worst FROM a GROUP BY element_name")
def node_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.node_issues(_findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT element_name, count(*) AS n_findings FROM f GROUP BY element_name ORDER BY n_findings DESC, element_name LIMIT 10")
def review_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.review_budget(_findings(spark, sf_dir), 30, "element_name")


@query(f"""WITH {FINDINGS_SQL}, v AS (SELECT *, o_orderkey % 4 = 1 AS judged, o_orderkey % 100 AS c FROM f), g AS (SELECT *, rule_id = 'DOM-004' OR severity = 'CRITICAL' AS guarded FROM v), r AS (SELECT *, judged AND c >= 75 AND NOT guarded AS lifted FROM g)
    SELECT o_orderkey, CASE WHEN lifted THEN 'LOW' ELSE severity END AS severity, CASE WHEN lifted THEN least(confidence, greatest(40, 100 - c)) ELSE confidence END AS confidence, lifted AS is_false_positive,
    CASE WHEN NOT judged THEN NULL WHEN c < 75 THEN 'LOW_CONFIDENCE' WHEN guarded THEN 'GUARDED' ELSE 'FALSE_POSITIVE' END AS ai_status FROM r""")
def model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 1").select(F.col("o_orderkey").cast("string").alias("finding_id"), F.lit("FALSE_POSITIVE").alias("verdict"), (F.col("o_orderkey") % 100).cast("string").alias("confidence"))
    return audit.with_verdicts(_findings(spark, sf_dir), verdicts).select("o_orderkey", "severity", F.col("confidence").cast("long").alias("confidence"), "is_false_positive", "ai_status")


def _units(spark: SparkSession, sf_dir: str, body: Column, language: str = "ssjs") -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("orders").alias("source_file"), F.concat(F.lit("lib"), key).alias("element_name"), F.lit("scriptlibrary").alias("element_type"), F.lit(language).alias("language"), F.lit(None).cast("string").alias("event"), body.alias("body"), F.lit(1).alias("start_line"))
    return rows.withColumn("body", F.replace("body", F.lit("{k}"), key))


@query("SELECT 'lib' || o_orderkey AS element_name, 'use' || o_orderkey AS caller, 'open' || o_orderkey AS callee, 82 AS confidence FROM orders WHERE o_orderkey % 3 = 0")
def ownership_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    take = "function open{k}() { var doc = db.getView('x'); return doc; } function use{k}() { var d = open{k}();"
    body = F.when(F.col("o_orderkey") % 3 == 0, take + " d.x; }").otherwise(take + " d.recycle(); }")
    return ownership.unassigned(inventory.inventory(_units(spark, sf_dir, body))).select("element_name", "caller", "callee", "confidence")


@query("SELECT o_orderkey, name FROM (SELECT o_orderkey, 'leak' || o_orderkey AS name FROM orders WHERE o_orderkey % 2 = 0)")
def filter_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("o_orderkey") % 2 == 0, "function leak{k}() { var d = db.getView('x'); }").otherwise("function fine{k}() { return 1; }")
    return views.filter_inventory(inventory.inventory(_units(spark, sf_dir, body)), "unprotected", "java_ssjs", "LEAK").select("o_orderkey", "name")


@query("SELECT 'java' AS language, 'getDatabase' AS pattern, 2 * count(*) AS n_hits, count(*) AS n_units FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'java', 'session_getDatabase', count(*), count(*) FROM orders WHERE o_orderkey % 5 = 0")
def upgrade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("o_orderkey") % 5 == 0, 'session.getDatabase("a{k}"); getDatabase(b);').otherwise("Dim d{k} As NotesDatabase(x)")
    return views.upgrade_counts(_units(spark, sf_dir, body, "java")).select("language", "pattern", "n_hits", "n_units")


@query("SELECT o_orderkey, 2 + o_orderkey % 3 AS line FROM orders")
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("// {k}\n"), F.repeat(F.lit("\n"), (F.col("o_orderkey") % 3).cast("int")), F.lit("static Session s;"))
    return rules.findings(_units(spark, sf_dir, body, "java")).select("o_orderkey", F.col("line").cast("long").alias("line"))


@query("SELECT l_orderkey, count(*) AS n_fields FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey HAVING count(*) >= 5")
def wide_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "richtext").otherwise("text")
    fields = table(spark, sf_dir, "lineitem").select(F.lit("f").alias("source_file"), F.lit("form").alias("element_type"), F.col("l_orderkey").alias("owner_name"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"), kind.alias("type"))
    return rules.wide_forms(fields, 5).select(F.col("owner_name").alias("l_orderkey"), "n_fields")


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select(F.lit("finding").alias("kind"), F.col("user_id").alias("item_id"), F.struct("ts", "event_id").alias("at"), "event_type")
    return store.latest_marks(marks).select(F.col("item_id").alias("user_id"), "event_type")


@query("SELECT event_id FROM (SELECT event_id FROM events WHERE event_type ILIKE '%err%' ORDER BY ts DESC, event_id LIMIT 20)")
def filtered_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("nsf_path"), F.col("event_id").alias("graph_id"))
    return store.trend(history, "err", 20).select("event_id")


@query("SELECT p_partkey, 'Decides by a condition.' || CASE WHEN p_partkey % 2 = 0 THEN ' Looks up values in a view.' ELSE ' Rejects values with a message.' END AS said FROM part")
def described_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = F.when(F.col("p_partkey") % 2 == 0, '@If(a; @DbLookup("";"";"v";"k";1); b)').otherwise('@If(a; @Success; @Failure("no"))')
    return table(spark, sf_dir, "part").select("p_partkey", reports.describe(formula).alias("said"))


@query("SELECT p_partkey, 'must be \"' || p_partkey || '\"' AS message FROM part")
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = F.concat(F.lit('@If(x; @Success; @Failure("must be \\"'), F.col("p_partkey").cast("string"), F.lit('\\""))'))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.failure_messages(formula)).alias("message"))
