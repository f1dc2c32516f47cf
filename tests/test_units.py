import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftgraph.functions import formulas, text
from siftgraph.operators import audit, inventory, ownership, rules, views
from siftgraph.sources import units as un
from tests.test_exports import JAVA, SSJS

UNIT = "source_file string, element_name string, element_type string, language string, event string, body string, start_line int"


def found(text_, name="a.dxl"):
    return [(u["element_type"], u["element_name"], u["language"], u["event"], u["body"], u["start_line"]) for u in un.units_of(text_, name)]


def test_units_have_their_nearest_named_ancestor_and_line():
    xml = """<?xml version='1.0'?>
<database xmlns='http://x' title='D'>
<form name='F'><code event='outer'><code event='inner'><formula>a &gt; b &amp; c</formula></code></code>
<field name='ignored'><code event='defaultvalue'><formula>
   @If(x; y; z)</formula></code></field></form>
<page title='P'><script language='Server-JavaScript'>var a = 12;</script><source type='text/java'>class A { }</source></page>
<agent><code event='action'><script>x = 12345;</script></code></agent><formula>short</formula>
<code event='e'><CSJS>alert(12345)</CSJS></code></database>"""
    assert found(xml) == [
        ("form", "F/outer/inner", "formula", "inner", "a > b & c", 3), ("form", "F/defaultvalue", "formula", "defaultvalue", "@If(x; y; z)", 5),
        ("page", "P", "ssjs", None, "var a = 12;", 6), ("page", "P", "java", None, "class A { }", 6), ("database", "D/action", "ssjs", "action", "x = 12345;", 7), ("database", "D/e", "csjs", "e", "alert(12345)", 8),
    ]


def test_broken_files_and_stored_sources():
    assert found("<a/><form name='F'><java>class Abc</java></form>") == [("form", "F", "java", None, "class Abc", 1)]
    assert found("no <xml", "d/x.dxl") == [("file", "x.dxl", "unknown", None, "no <xml", 1)] and found("", "y.dxl") == []
    assert found("<code event='e'><java>class Abc</java></code>") == [("unknown", "unknown", "java", "e", "class Abc", 1)]
    stored = f"""<database><scriptlibrary
 name="L"><item name="$ServerJavaScriptLibrary"><rawitemdata>{SSJS}</rawitemdata></item></scriptlibrary>
<note><item name="$TITLE"><text>src/B.java</text></item><item name="$FileData"><rawitemdata>{JAVA}</rawitemdata></item></note></database>"""
    assert [x[:4] + x[5:] for x in found(stored)] == [("scriptlibrary", "L", "ssjs", "library", 2), ("javaclass", "src/B.java", "java", None, 1)]
    deep = "<a>" * 20_000 + "<java>class Abc</java>" + "</a>" * 20_000
    assert len(found(deep)) == 1


def test_scan_reads_exports_and_raw_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.dxl").write_bytes(b"<form name='F'><java>class \xffAbc</java></form>")
    (tmp_path / "sub" / "X.JAVA").write_bytes(b"class \xe9X")
    (tmp_path / "y.lss").write_text("Sub A")
    (tmp_path / "z.txt").write_text("no")
    got = {(r["element_name"], r["element_type"], r["language"], r["body"]) for r in un.scan(spark, str(tmp_path)).collect()}
    assert got == {("F", "form", "java", "class Abc"), ("X.JAVA", "odp_file", "java", "class X"), ("y.lss", "odp_file", "lotusscript", "Sub A")}
    assert un.units(spark.createDataFrame([], "source_file string, text string")).count() == 0
    assert un.units(spark.createDataFrame([("n.dxl", None), ("m.java", None)], "source_file string, text string")).select("language", "body").collect() == [("java", "")]


def window(lines, focus, base, before=15, after=45, most=100):
    """What the window must be, line by line."""
    hit = max(0, min(len(lines) - 1, focus - base))
    start, end = max(0, hit - before), min(len(lines), hit + after + 1)
    low, high = max(0, hit - most), min(len(lines), hit + most + 1)
    for k in range(low, high):
        if re.search(r"\bfinally\b|recycle\s*\(|\bDelete\b", lines[k], re.I):
            start, end = min(start, k), max(end, k + 1)
    tries = [k for k in range(low, hit + 1) if re.search(r"\btry\s*\{", lines[k], re.I)]
    start = min([start, *tries[-1:]])
    if end - start > most:
        start = max(0, min(hit - before, end - most))
        end = min(end, start + most)
    return base + start, base + end - 1, lines[start:end]


def test_grown_windows_against_a_walk(spark):
    r = random.Random(4)
    kinds = ["x();"] * 30 + ["try {", "} finally {", "d.recycle();", "Delete d", "", "try{"]
    cases = [(k, [r.choice(kinds) for _ in range(r.choice([1, 3, 40, 150, 400]))], r.randint(-3, 420), r.choice([1, 7])) for k in range(150)]
    df = spark.createDataFrame([(k, "\n".join(lines), focus, base) for k, lines, focus, base in cases], "k int, body string, line int, start_line int")
    got = {x["k"]: x["window"] for x in views.snippets(df.select("k", "line"), df.select("k", "body", "start_line"), ["k"]).collect()}
    for k, lines, focus, base in cases:
        first, last, rows = window(lines if lines[-1:] != [""] or len(lines) == 1 else lines[:-1], focus, base)
        assert (got[k]["first"], got[k]["last"], [x["text"] for x in got[k]["lines"]]) == (first, last, rows), k
        assert [x["line"] for x in got[k]["lines"] if x["kind"] == "problem"] == [max(base, min(focus, base + len(lines) - 1 - (lines[-1] == "" and len(lines) > 1)))]
    one = spark.createDataFrame([(0, "a\r\nd.recycle();\r\n", 1, 999_999), (1, None, 5, 1)], "k int, body string, line int, start_line int")
    rows = {x["k"]: x["window"] for x in views.snippets(one.select("k", "line"), one.select("k", "body", "start_line"), ["k"]).collect()}
    assert rows[0]["snippet"] == "999999▶| a\n1000000 | d.recycle();" and [x["kind"] for x in rows[0]["lines"]] == ["problem", "cleanup"] and rows[1]["snippet"] == "     1▶| "


def test_windows_are_made_by_many_tasks(spark):
    from siftgraph.plans import unit_queries

    found = unit_queries.grown_windows(spark, "/root/testdata/sf0.001")
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 1_500 and max(sizes) < 500  # not one task for one small file of keys
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_spans_that_dont_overlap(spark):
    r = random.Random(2)
    patterns = [r"Call \w+\.r\(\)", r"\.\s*r\([^)]*\)", r"Del \w+", r"\w+\("]
    bodies = ["".join(r.choices(["Call a.r()", ".r(", ")", "Del ", "x", " ", "b("], k=60)) for _ in range(60)] + ["", None]

    def walk(body):
        taken = []
        for n, p in enumerate(patterns):
            taken += [(m.start(), m.end(), n) for m in re.finditer(p, body or "") if all(m.end() <= a or m.start() >= b for a, b, _ in taken)]
        return sorted(taken)

    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {x["k"]: [tuple(s) for s in x["s"]] for x in df.select("k", text.disjoint_spans(F.col("body"), patterns).alias("s")).collect()}
    assert got == {k: walk(b) for k, b in enumerate(bodies)}
    began = time.time()
    assert len(text._taken("Call d.recycle();\n" * 50_000, [re.compile(p) for p in inventory.CLEANUPS])) == 50_000 and time.time() - began < 10


def said(spark, body, **options):
    columns = {k: F.lit(v) if k in ("name", "kind") else v for k, v in options.items()}
    return spark.range(1).select(formulas.describe(F.lit(body).cast("string"), **columns).alias("x")).first()["x"]


def test_formulas_in_plain_words(spark):
    assert said(spark, None) == said(spark, " \n ") == ""
    assert said(spark, '@If(@IsDocBeingSaved; @Failure("a \\"b\\""); @Failure("c"))', role="validation", name="X") == "Blocks save when the document is saved unless the rule passes: “a \"b\"”; “c”."
    assert said(spark, "x", role="validation", name="OHCustId") == "Validates oh cust id on input."
    assert said(spark, "SrcName", role="default", kind="computedWhenComposed") == "Computed by copying the value from “Src Name”."
    assert said(spark, '["Admin"] : "[Ed]" : "[Ed]"', name="DocReaders") == "Restricts document read access to: Admin, [Ed]."
    assert said(spark, "@Subset(@DbName; 1)") == "Captures the current Domino server name from the open database." and said(spark, "@DbName") == "Reads the current database identity (@DbName)."
    assert said(spark, "@Right(@Year(d); 2) + @Month(d)", name="fldJBADate") == "Builds a system/ERP-friendly date string for jba date (year, month, and day packed into a coded format)."
    assert said(spark, "a", role="hidewhen", name="Qty") == "Conditionally hides qty on the form." and said(spark, "@IsNewDoc", role="hidewhen", name="Qty") == "Behaves differently for new documents vs existing ones. Hides qty based on document or field conditions."
    assert said(spark, "Sub Go\nMessagebox \"Hi\"") == "Runs a LotusScript routine (custom server/client procedure). Shows the user a message: “Hi”."
    assert said(spark, "@If(a; b; c)", name="Qty") == "Applies conditional business logic to set qty." and said(spark, "y" * 200 + "!", name="Qty") == f"Business logic on qty: {'y' * 97}…"
    assert said(spark, "@UserRoles + @UserRoles + @DbLookup(a)") == "Checks the current user’s Domino roles before applying the rule. Retrieves related information from another Domino view or database."
    row = spark.range(1).select(formulas.describe_field(F.lit("Qty"), F.lit("unknown"), F.lit(None).cast("string"), *[F.lit(None).cast("string")] * 4, messages=F.array(F.lit("a"), F.lit("b"))).alias("s")).first()["s"]
    assert row["business_summary"] == "Qty is a form field. Blocks save unless the rule passes: “a”; “b”." and row["lookup_summary"] == ""


def test_handles_in_parameters(spark):
    lib = "public void keep(Document doc, int n) { doc.x(); }\npublic Document open(String s) { return d; }\npublic void free(View v) { v.recycle(); }"
    page = "public void go() { keep(d, 1); free(v); Document e = open(x); }\npublic void tidy() { keep(d, 1); d.recycle(); }"
    made = spark.createDataFrame([("f", "lib", "scriptlibrary", "java", None, lib, 1), ("f", "page", "agent", "java", None, page, 1), ("f", "else", "agent", "java", None, page, 1)], UNIT)
    uses = spark.createDataFrame([("page", "LIB")], "element_name string, library string")
    records = inventory.inventory(made)
    got = {(r["element_name"], r["caller"], r["callee"], r["confidence"], r["kind"]) for r in ownership.unassigned(records, uses).collect()}
    assert got == {("page", "go", "keep", 70, "parameter"), ("page", "go", "open", 72, "return")}
    assert {r["name"]: r["signature"] for r in records.filter("element_name = 'lib'").collect()} == {"keep": "public void keep(Document doc, int n)", "open": "public Document open(String s)", "free": "public void free(View v)"}


NEAR = {
    "scaffold": "Document d = db.createDocument(); try { use(d); } finally { close(d); }\n", "recycles": "lotus.domino.Base b; x.recycle(); toLotu ", "loops": "for (;;) { a = db.getVie(x); }\n", "lookups": "@While(a; @DbLooku(b)) Query_String ",
    "branches": "if (a == b) { c(); } while (a) { if (x) { y.recycl(); } }\n", "walks": "doc = v.getNextDocument(doc); old = doc;\n",
}


@pytest.mark.parametrize("kind", NEAR)
def test_units_of_near_misses_take_no_long_time(spark, kind):
    language = "formula" if kind == "lookups" else "java"
    body = NEAR[kind] * (200_000 // len(NEAR[kind]))
    units = spark.createDataFrame([("f", "x", "agent", language, None, body, 1)], UNIT)
    rules.findings(spark.createDataFrame([("f", "x", "agent", language, None, NEAR[kind], 1)], UNIT)).count()
    began = time.time()
    rules.findings(units).count()
    assert time.time() - began < 60


def test_scaffolds_are_what_they_were():
    assert "CREATED" in dir(rules)
    java = lambda s: bool(re.search(rules.SCAFFOLD.replace("++", "+").replace("*+", "*"), s))
    whole = r"(?is)\btry\b.*\bfinally\b.*\.recycle\s*\(|\bfinally\b.*\.recycle\s*\(.*\btry\b"
    r = random.Random(1)
    for _ in range(3000):
        s = " ".join(r.choices(["try", "finally", "d.recycle (", "x", "\n"], k=r.randint(0, 7)))
        assert java(s) == bool(re.search(whole, s)), s


def test_long_texts_in_loops_and_containment(spark):
    body = "While a\n" * 20_000 + "Wend\n" * 20_000
    began = time.time()
    row = spark.createDataFrame([(body, 150_000)], "b string, n int").select(text.loop_around(F.col("b"), F.col("n")).alias("x")).first()["x"]
    assert (row["start"], row["end"]) == (8 * (150_000 // 8), 160_004) and time.time() - began < 20
    texts = spark.createDataFrame([(1, "ab" * 30_000 + "Needle"), (2, "needl"), (3, None)], "k long, t string")
    names = spark.createDataFrame([("needle",), ("ba",), ("",), (None,)], "n string")
    began = time.time()
    assert {tuple(r) for r in audit.containing(texts, ["k"], "t", names, "n").collect()} == {(1, "needle"), (1, "ba")} and time.time() - began < 40
