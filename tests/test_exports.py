import base64

import pytest
from pyspark.sql import functions as F

from siftgraph.operators import edges as ed
from siftgraph.operators import graph
from siftgraph.sources import exports as ex

SSJS = base64.b64encode(b"\x01\x02\x03" * 4 + b"function go() { return 1; }").decode()
JAVA = base64.b64encode(b"\x00\x01package a; public class B { void f() { } }").decode()
ONE = f"""<database xmlns="http://www.lotus.com/dxl" title="Sales" path="srv!!apps/sales.nsf">
<form name="Order"><pardef id="1"><code event="hidewhen"><formula>!@IsNewDoc</formula></code></pardef>
 <par def="1"><field name="Status" type="keyword"><code event="defaultvalue"><formula>@If(a;"x";"y")</formula></code><code event="inputvalidation"><formula>@If(Status="";@Failure("Need \\"it\\"");@Success)</formula></code>
  <keywords><formula>@DbLookup("":"NoCache"; "":"crm.nsf"; "vwStatus"; "k"; 2)</formula></keywords></field></par>
 <field name="$REF" type="text"/><subformref name="Header"/><code event="querysave"><lotusscript>Use "LibA"
Set v = db.GetView("vwOrders")</lotusscript></code></form>
<subform name="Header"><field name="Logo"/></subform>
<view name="vwOrders"><code event="selection"><formula>SELECT Form = "Order" | Form = "Quote" | form="Order"</formula></code><column title="A"/><column itemname="B"/></view>
<agent name="Nightly"><trigger type="scheduled"><schedule type="daily"/></trigger><code event="action"><formula>@Command([ToolsRunMacro]; "(Clean)") + @DbColumn("";"";"vwAll";1)</formula></code></agent>
<scriptlibrary name="LibA"><item name="$ServerJavaScriptLibrary"><rawitemdata>{SSJS}</rawitemdata></item></scriptlibrary>
<note class="form"><item name="$TITLE"><text>src/B.java</text></item><item name="$FileData"><rawitemdata>{JAVA}</rawitemdata></item></note>
</database>"""
BAD = '<database><form name="x">Set v = db.GetView("vwBroken")'


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dxl")
    (d / "sales.dxl").write_bytes(ONE.encode() + b"\n")
    (d / "bad.XML").write_bytes(BAD.encode() + b"\xff")
    (d / "skip.txt").write_text("no")
    return ex.parsed(ex.read_texts(spark, str(d))).cache()


def test_elements_and_fields(files):
    rows = {(r["element_type"], r["name"]): r for r in ex.elements(files).collect()}
    assert rows.keys() == {("form", "Order"), ("subform", "Header"), ("view", "vwOrders"), ("agent", "Nightly"), ("scriptlibrary", "LibA"), ("javaclass", "src/B.java")}
    assert rows["agent", "Nightly"]["trigger"] == "scheduled:daily" and rows["view", "vwOrders"]["n_columns"] == 2 and rows["form", "Order"]["database_id"] == "sales.nsf"
    status = next(r for r in ex.fields(files).collect() if r["name"] == "Status")
    assert status["hidewhen"] == "!@IsNewDoc" and status["default_value"] == '@If(a;"x";"y")' and len(status["embedded"]) == 3
    assert files.filter("error is not null").select("source_file").first()[0] == "bad.XML"


def test_blocks_and_units(files):
    rows = [(r["owner_name"], r["event"], r["category"]) for r in ex.blocks(files).orderBy("pos", "part", "nth").collect()]
    assert ("Order", "querysave", "state_transition") in rows and ("Order", "inputvalidation", "validation") in rows and ("vwOrders", "selection", "view_selection") in rows
    assert ("Order", "default", "conditional_logic") in rows and sum(r[0] == "vwOrders" for r in rows) == 2
    units = {(r["element_name"], r["language"]): r["body"] for r in ex.code_units(ex.blocks(files)).collect()}
    assert units["LibA", "ssjs"] == "function go() { return 1; }" and units["src/B.java", "java"].startswith("package a;")


def test_edges(files):
    rows = {(r["type"], r["source_name"], r["target_name"]) for r in ed.from_exports(files).collect()}
    assert rows == {
        ("INCLUDES_SUBFORM", "Order", "Header"), ("PARENT_CHILD_REF", "Order", "ParentDocument"), ("SELECTS_FORM", "vwOrders", "Order"), ("SELECTS_FORM", "vwOrders", "Quote"), ("LOOKUP_VIA_VIEW", "Order", "vwStatus"), ("REFERENCES_DATABASE", "Order", "crm.nsf"),
        ("LOOKUP_VIA_VIEW", "Nightly", "vwAll"), ("INVOKES_AGENT", "Nightly", "(Clean)"), ("ACCESSES_VIEW", "Order", "vwOrders"), ("USES_SCRIPT_LIBRARY", "Order", "LibA"), ("ACCESSES_VIEW", "bad.XML", "vwBroken"),
    }
    lookup = next(r for r in ed.from_exports(files).collect() if r["target_name"] == "vwStatus")
    assert lookup["metadata"]["database_ref"] == "crm.nsf" and lookup["evidence"].startswith("@DbLookup(")


def test_score_of_a_graph(files):
    edges = ed.from_exports(files)
    key = lambda t, n: F.concat_ws(":", t, n)
    e = edges.select(key("source_type", "source_name").alias("src"), key("target_type", "target_name").alias("dst"), "type", F.col("source_database").alias("src_db"), F.col("target_database").alias("dst_db"))
    nodes = ex.elements(files).select(key("element_type", "name").alias("node"))
    row = graph.score(nodes, e, ex.blocks(files).select(F.col("body").alias("text"))).first()
    assert row["max_node"] == "form:Order" and row["n_cross"] == 1 and 0 <= row["score"] <= 100 and row["n_hardcoded"] == 1


def test_raw_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_text("class X {}")
    (tmp_path / "y.lss").write_text("Sub A\nEnd Sub")
    assert {(r["source_file"], r["language"]) for r in ex.read_sources(spark, str(tmp_path)).collect()} == {("X.java", "java"), ("y.lss", "lotusscript")}
