import pytest
from pyspark.sql import functions as F

from siftgraph.operators import inventory, ownership, reports, rules, views
from siftgraph.sources import exports

from .test_exports import ONE

UNITS = "source_file string, element_name string, element_type string, language string, event string, body string, start_line int"


@pytest.fixture(scope="module")
def findings(spark):
    rows = [
        ("f", "a", "agent", "java", None, "DOM-001", "CRITICAL", 95, 3, "x f()", False, None), ("f", "csjsLib", "scriptlibrary", "javascript", None, "DOM-014", "HIGH", 70, 1, "y", False, None),
        ("f", "b", "agent", "lotusscript", None, "LS-EXT-001", "HIGH", 90, 1, "z", False, "VERIFIED"), ("f", "c", "form", "formula", None, "FORM-003", "HIGH", 85, 1, "z", True, None), ("f", "d", "agent", "ssjs", None, "DOM-BS-001", "HIGH", 60, 1, "z", False, "BLIND_SPOT"),
        ("f", "e", "agent", "ssjs", None, "DOM-004", "CRITICAL", 97, 1, "z", False, None),
    ]
    return spark.createDataFrame(rows, "source_file string, element_name string, element_type string, language string, event string, rule_id string, severity string, confidence int, line int, evidence string, is_false_positive boolean, ai_status string")


@pytest.mark.parametrize(("which", "names"), [("all", "a csjsLib b c d e"), ("handle", "a csjsLib"), ("external", "b"), ("formula", ""), ("false_positive", "c"), ("verified", "b"), ("blind_spot", "d"), ("ai_discovered", "d"), ("deadlock", "e"), ("high_confidence", "a b e")])
def test_finding_filters(findings, which, names):
    assert sorted(r["element_name"] for r in views.filter_findings(findings, which).collect()) == sorted(names.split())


def test_shapes_scopes_and_families(findings):
    rows = {r["element_name"]: r for r in views.shaped_findings(findings.withColumn("scoped", views.exhausts_handles())).collect()}
    assert rows["a"]["scoped"] and not rows["csjsLib"]["scoped"] and rows["csjsLib"]["language_label"] == "Client JS" and rows["a"]["confidence_band"] == "high" and rows["a"]["location"] == "agent:a:3"
    assert {r["family"]: r["n"] for r in views.families(findings).collect()} == {"DOM": 3, "LS": 1, "DOM-BS": 1}
    assert views.review_budget(findings, 12, "element_name").count() == 4


def test_inventory_views(spark, findings):
    body = 'function leak() { var d = db.getView("x"); }\nfunction ok() { return 1; }\nfunction part() { var a = db.getView("x"); var b = db.getView("y"); a.recycle(); }'
    records = inventory.inventory(spark.createDataFrame([("f", "lib", "scriptlibrary", "ssjs", "library", body, 1), ("f", "csjs1", "scriptlibrary", "javascript", "client_library", body, 1)], UNITS)).cache()
    names = lambda df: sorted((r["element_name"], r["name"]) for r in df.collect())
    assert names(views.filter_inventory(records, "unprotected", "ssjs")) == [("lib", "leak")] and names(views.filter_inventory(records, "partial", "csjs")) == [("csjs1", "part")]
    assert names(views.filter_inventory(records, "safe", "java_ssjs", " OK ")) == [("lib", "ok")] and views.checklist(records).first()["element_name"] == "lib"
    assert {r["status_label"] for r in views.shaped_functions(records).collect()} == {"Unprotected", "Safe", "Partial"}
    own = findings.filter("element_name = 'a'").withColumn("element_name", F.lit("lib")).withColumn("evidence", F.lit("in leak() here"))
    assert names(views.findings_for_functions(records, own)) == [("lib", "leak")]


def test_upgrade_and_lookups(spark):
    rows = [("f", "a", "agent", "java", None, 'session.getDatabase("x"); getDatabase(y)', 1), ("f", "b", "agent", "lotusscript", None, "Set d = New NotesDatabase(a)\nGetDatabase(x)", 1), ("f", "c", "agent", "java", None, 'session.getDatabase("x"); getDatabase(y)', 1)]
    got = {(r["language"], r["pattern"]): r["n_hits"] for r in views.upgrade_counts(spark.createDataFrame(rows, UNITS)).collect()}
    assert got == {("java", "getDatabase"): 2, ("java", "session_getDatabase"): 1, ("lotusscript", "NotesDatabase_ctor"): 1, ("lotusscript", "New_NotesDatabase"): 1, ("lotusscript", "GetDatabase"): 1}
    files = exports.parsed(spark.createDataFrame([("s.dxl", ONE)], "source_file string, text string")).cache()
    found = {(r["function"], r["target_view"], r["target_database"]) for r in views.lookups(exports.blocks(files)).collect()}
    assert found == {("@DbLookup", "vwStatus", "crm.nsf"), ("@DbColumn", "vwAll", None), ("GetView", "vwOrders", None)}
    catalog = reports.rules_catalog(exports.fields(files), exports.blocks(files))
    assert [r["field"] for r in views.filter_catalog(catalog, "Order", True, True, "NEED").collect()] == ["Status"] and views.filter_catalog(catalog, search="nothing such").count() == 0


def test_ownership(spark):
    lib = "function open() { var doc = db.getView('x'); return doc; }\nfunction use() { var d = open(); d.x; }\nfunction fine() { var d = open(); d.recycle(); }"
    other = 'function far() { var d = open(); }'
    units = spark.createDataFrame([("f", "lib", "scriptlibrary", "ssjs", None, lib, 1), ("f", "page", "scriptlibrary", "ssjs", None, other, 1)], UNITS)
    records = inventory.inventory(units)
    assert {(r["element_name"], r["caller"], r["confidence"]) for r in ownership.unassigned(records).collect()} == {("lib", "use", 82)}
    uses = spark.createDataFrame([("page", "lib")], "element_name string, library string")
    assert {(r["element_name"], r["caller"], r["confidence"]) for r in ownership.unassigned(records, uses).collect()} == {("lib", "use", 82), ("page", "far", 72)}


def test_user_rules(spark):
    own = rules.Rule("MY-001", "LOW", 50, ("java",), r"TODO", once=True)
    units = spark.createDataFrame([("f", "a", "agent", "java", None, "// TODO this\n// TODO that", 1)], UNITS)
    assert [(r["rule_id"], r["severity"]) for r in rules.findings(units, [own]).collect()] == [("MY-001", "LOW")]
