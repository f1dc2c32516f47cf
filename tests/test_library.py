import pytest
from pyspark.sql import functions as F

from siftgraph.operators import audit, edges, inventory, reports, rules
from siftgraph.sources import exports, store
from siftgraph.streaming import ingest

from .test_exports import ONE

UNITS = "source_file string, element_name string, element_type string, language string, event string, body string, start_line int"
FUNCTIONS = """function safe() { return 1; }
function leak() { var d = db.getView("x"); use(d); }
function good() { var d = db.getView("x"); try { use(d); } finally { d.recycle(); } }
function half() { var a = db.getView("x"); var b = db.getDatabase("y"); a.recycle(); }
function gap() { var a = db.getView("x"); if (q) { return; } a.recycle(); }
function odd() { var s = "}"; }"""


def test_inventory(spark):
    units = spark.createDataFrame([("f", "lib", "scriptlibrary", "ssjs", "library", FUNCTIONS, 1), ("f", "ls", "agent", "lotusscript", "x", "Sub A\nEnd Sub", 1), ("f", "n", "agent", "java", None, None, 1)], UNITS)
    rows = {r["name"]: r for r in inventory.inventory(units).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"safe": "SAFE", "leak": "UNPROTECTED", "good": "PROTECTED", "half": "PARTIAL", "gap": "ESCAPE_PATH_GAP", "odd": "SAFE"}
    assert rows["half"]["unclean"] == ["b"] and rows["leak"]["line"] == 2 and rows["leak"]["severity"] == "MEDIUM"
    one = audit.inventory_summary(inventory.inventory(units)).first()
    assert (one["total"], one["allocators"], one["unprotected"], one["incomplete"]) == (6, 4, 1, 2) and one["coverage_rate"] == 25.0


def test_lotus_functions():
    assert [(n, b) for n, b, _ in inventory.functions_of("Sub A\nx\nEnd Sub\nFunction B(c) As Long\ny\nEnd Function", "lotusscript", None)] == [("A", "x\n"), ("B", "y\n")]
    assert inventory.functions_of("x = 1", "ssjs", "queryopen") == [("queryopen", "x = 1", 0)] and inventory.functions_of("x = 1", "ssjs", None) == []


def test_empty_summary_is_safe(spark):
    empty = spark.createDataFrame([], "status string, allocates boolean, is_false_positive boolean")
    row = audit.inventory_summary(empty).first()
    assert (row["total"], row["safety_rate"], row["coverage_rate"]) == (0, 100.0, 100.0)


def test_triage_and_verdicts(spark):
    items = spark.createDataFrame([("a", "HIGH", "r", None, False), ("b", "HIGH", "r", None, True), ("c", "LOW", "r", None, False)], "item_id string, severity string, reason string, ai_status string, is_false_positive boolean")
    marks = spark.createDataFrame([("a", True, "", "", 1), ("a", False, "x", "", 0), ("b", False, "why", "OK", 1)], "item_id string, is_false_positive boolean, reason string, status string, at int")
    got = {r["item_id"]: (r["is_false_positive"], r["severity"], r["reason"], r["ai_status"]) for r in audit.triaged(items, marks, "item_id").collect()}
    assert got == {"a": (True, "LOW", "r", "FALSE_POSITIVE"), "b": (False, "HIGH", "why", "OK"), "c": (False, "LOW", "r", None)}
    findings = spark.createDataFrame([("1", "DOM-013", "MEDIUM", 90), ("2", "DOM-004", "CRITICAL", 97), ("3", "DOM-013", "HIGH", 90)], "finding_id string, rule_id string, severity string, confidence int")
    verdicts = spark.createDataFrame([("1", "FALSE_POSITIVE", "95"), ("2", "FALSE_POSITIVE", "99"), ("3", "FALSE_POSITIVE", "oops"), ("9", "X", "99")], "finding_id string, verdict string, confidence string")
    out = {r["finding_id"]: (r["severity"], r["is_false_positive"], r["ai_status"], r["confidence"]) for r in audit.with_verdicts(findings, verdicts).collect()}
    assert out["1"] == ("LOW", True, "FALSE_POSITIVE", 40) and out["2"][:3] == ("CRITICAL", False, "GUARDED") and out["3"][1] is False


def test_review_results(spark):
    f = spark.createDataFrame([("1", "DOM-OWN-001", "HIGH", "Lib", 80, None), ("2", "DOM-013", "LOW", "a", 90, "VERIFIED")], "finding_id string, rule_id string, severity string, element_name string, confidence int, ai_status string")
    proposed = spark.createDataFrame([("DOM-BS-002", "HIGH", "lib", 99), ("DOM-BS-002", "HIGH", "other", 99), ("DOM-BS-001", "CRITICAL", "x", 65), ("DOM-BS-001", "HIGH", "x", 65)], "rule_id string, severity string, element_name string, confidence int")
    both = audit.blind_spots(f, proposed)
    assert sorted((r["rule_id"], r["element_name"]) for r in both.filter("ai_status = 'BLIND_SPOT'").collect()) == [("DOM-BS-001", "x"), ("DOM-BS-002", "other")]
    one = audit.discrepancies(both).first()
    assert (one["verified"], one["blind_spots"], one["guarded"]) == (1, 2, 0)
    up = spark.createDataFrame([("1", "LOW", 99), ("2", "CRITICAL", 99), ("2", "HIGH", 99)], "finding_id string, proposed string, confidence int")
    assert {r["finding_id"]: r["severity"] for r in audit.escalated(f, up, "finding_id").collect()} == {"1": "HIGH", "2": "CRITICAL"}


def test_stored_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3), ("b", 2), ("c", None)], "graph_id string, schema_version int")
    assert [r["graph_id"] for r in store.stale(rows, 3).orderBy("graph_id").collect()] == ["b", "c"] and store.stale(rows, 3, True).count() == 3
    for _ in range(2):
        store.overwrite_partition(rows.filter("graph_id = 'a'"), str(tmp_path / "t"), "graph_id", "a")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_prefilter_falls_back(spark):
    units = spark.createDataFrame([("java", "x"), ("xpages", "y")], "language string, body string")
    assert [r["language"] for r in audit.prefilter_or_all(units).collect()] == ["java"]
    assert audit.prefilter_or_all(units.union(spark.createDataFrame([("formula", "@DbLookup(a)")], units.schema))).first()["keywords_matched"] == ["DbLookup"]


@pytest.fixture
def landing(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.dxl").write_text(ONE)
    return tmp_path


def test_streamed_ingest_and_store(spark, landing):
    args = (str(landing / "in"), str(landing / "out"), str(landing / "check"))
    ingest.ingest_exports(spark, *args)
    n = spark.read.parquet(f"{args[1]}/edges").count()
    (landing / "in" / "two.dxl").write_text(ONE.replace("Order", "Bill"))
    ingest.ingest_exports(spark, *args)
    ingest.ingest_exports(spark, *args)
    assert spark.read.parquet(f"{args[1]}/edges").count() == 2 * n
    files = spark.read.parquet(f"{args[1]}/files").filter("batch = 0")
    path = str(landing / "store")
    for gid, at in (("g1", "2024-01-01"), ("g2", "2024-02-01")):
        store.store_graph(path, gid, f"apps/{gid}.nsf", "t", at, {"edges": edges.from_exports(files), "elements": exports.elements(files), "blocks": exports.blocks(files)})
    assert [r["graph_id"] for r in store.list_graphs(spark, path).collect()] == ["g2", "g1"] and store.latest_graph(spark, path, "g1").first()["n_edges"] == n
    assert store.query_edges(store.table_of(spark, path, "edges", "g1"), "SELECTS_FORM", "vw%").count() == 2


def test_reports(spark):
    files = exports.parsed(spark.createDataFrame([("sales.dxl", ONE)], "source_file string, text string")).cache()
    catalog = {r["field"]: r for r in reports.rules_catalog(exports.fields(files), exports.blocks(files)).collect()}
    assert catalog["Status"]["n_lookups"] == 1 and catalog["Status"]["hide_when"] == "!@IsNewDoc" and catalog["Logo"]["default"] is None
    totals = reports.catalog_totals(reports.rules_catalog(exports.fields(files), exports.blocks(files))).first()
    assert (totals["n_forms"], totals["n_fields"], totals["n_validations"], totals["n_lookups"]) == (2, 3, 1, 1)
    at = {(r["field"], r["view"], r["source"]) for r in reports.catalog_lookups(exports.fields(files), exports.blocks(files), edges.from_exports(files)).collect()}
    assert at == {("Status", "vwStatus", "field"), (None, "vwAll", "form")}
    said = spark.range(1).select(reports.field_sentence(F.lit("dtShipDate"), F.lit("@Failure(x)"), F.lit(None), F.lit("@Today")).alias("x")).first()["x"]
    assert said == "Ship Date: Starts as a computed value. Uses the current date. Is checked on save. Rejects values with a message."
    found = rules.findings(exports.code_units(exports.blocks(files)))
    assert "# Code audit" in reports.markdown(found) and reports.snapshot(found, "now").first()["risk"] == "LOW"
    nodes = {r["id"]: r["declared"] for r in reports.viz_nodes(exports.elements(files), edges.from_exports(files)).collect()}
    assert nodes["form:Order"] and not nodes["view:vwStatus"]
    assert spark.range(1).select(reports.describe(F.lit("@If(@IsNewDoc;1;2)")).alias("x")).first()["x"] == "Decides by a condition. Depends on whether the document is new."


def test_signals_and_windows(spark, tmp_path):
    rows = [(1, f"m{k}", f"2024-01-01 00:{k:02d}:00") for k in range(30)]
    spark.createDataFrame(rows, "graph_id int, message string, at string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("graph_id int, message string, at string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.append_signals(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    kept = ingest.last_signals(spark.read.parquet(str(tmp_path / "out")), ["graph_id"], 5, "at")
    assert sorted(r["message"] for r in kept.collect()) == [f"m{k}" for k in range(25, 30)]
    counted = ingest.windowed_counts(spark.read.parquet(str(tmp_path / "out")).withColumn("at", F.col("at").cast("timestamp")), "at", "1 minute", "10 minutes", "graph_id")
    assert sorted(r["n"] for r in counted.collect()) == [10, 10, 10]


def test_functions_within_functions():
    body = "var m = { a: function(x) { function b() { if (1) { s = \"}\"; } } } , c: function() { // don't\n t = '{'; } };\nfunction d() { open"
    assert [(n, at) for n, _, at in inventory.functions_of(body, "ssjs", None)] == [("b", body.index("function b")), ("c", body.index("c: function")), ("d", body.index("function d"))]
    assert dict((n, b) for n, b, _ in inventory.functions_of(body, "ssjs", None)) == {"b": ' if (1) { s = "}"; } ', "c": " // don't\n t = '{'; ", "d": " open"}
    java = "class X { public static int f(int a) throws E { return a; } private void g() { h(); } }"
    assert [n for n, _, _ in inventory.functions_of(java, "java", None)] == ["f", "g"] and inventory.functions_of(java, "ssjs", None) == []


def test_any_exit_before_a_release_is_a_gap(spark):
    bodies = {"second": "if (!x) return; var d = db.getView(v); if (y) return; d.recycle();", "none": "if (!x) return; var d = db.getView(v); d.recycle(); return;", "throws": "var d = db.getView(v); if (y) throw e; d.recycle();"}
    units = spark.createDataFrame([("f", k, "scriptlibrary", "ssjs", None, f"function {k}() {{ {b} }}", 1) for k, b in bodies.items()], "source_file string, element_name string, element_type string, language string, event string, body string, start_line int")
    got = {r["name"]: r["status"] for r in inventory.inventory(units).collect()}
    assert got["second"] == got["throws"] == "ESCAPE_PATH_GAP" and got["none"] == "PROTECTED"


def test_whole_scripts_of_pages():
    long = "database.getView('v'); " * 1000
    found = exports.page_scripts(f"<xp:x><![CDATA[{long}]]></xp:x><script>var a = 1;</script>#{{javascript:go()}}<![CDATA[plain]]><script>var a = 1;</script>")
    assert sorted(found) == sorted(["go()", "var a = 1;", long.strip()])
