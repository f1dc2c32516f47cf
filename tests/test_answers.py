import json
import time

import pytest
from pyspark.sql import functions as F

from siftgraph.functions import text
from siftgraph.operators import audit, graph, remedies, reports, rules, views
from siftgraph.sources import store


def test_containing_equals_brute_force(spark):
    texts = [(k, t) for k, t in enumerate(["getView of doc", "DOC", "", None, "a", "xab", "é ü doc", "getview" * 200, "doc"])]
    names = ["doc", "GETVIEW", "a", "ab", "", None, "zzz", "wget", "doc"]
    got = audit.containing(spark.createDataFrame(texts, "k int, t string"), ["k"], "t", spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert sorted(map(tuple, got)) == sorted({(k, n.lower()) for k, t in texts for n in names if t and n and n.lower() in t.lower()})
    empty = spark.createDataFrame([], "name string")
    assert audit.containing(spark.createDataFrame(texts, "k int, t string"), ["k"], "t", empty, "name").count() == 0


def test_loop_around(spark):
    body = "Do While a\n x\nLoop\nWhile b\n y\nWend\nz"
    at = lambda b, n: spark.createDataFrame([(b, n)], "b string, n int").select(text.loop_around(F.col("b"), F.col("n")).alias("x")).first()["x"]
    assert tuple(at(body, body.index("x"))) == (0, body.index("Loop") + 4)
    assert tuple(at(body, body.index("y"))) == (body.index("While b"), body.index("Wend") + 4)
    assert tuple(at("Forall e In c\n x", 14)) == (0, 16)
    assert at("x = 1", 2) is None and at("x\nDo While a", 0) is None and at("", 0) is None and at(None, 0) is None


def test_signatures(spark):
    rows = [("Sub F(a As NotesViewEntry, b As Long)", "LS"), ("public ViewEntry f(lotus.domino.Document d, View v)", "java"), (None, None), ("void f(Viewer v)", "java")]
    got = spark.createDataFrame(rows, "s string, l string").select(text.handle_params(F.col("s"), F.col("l")), text.returns_handle(F.col("s"), F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(["a"], True), (["f", "d", "v"], True), ([], False), ([], False)]


def test_formula_summary(spark):
    rows = [("  \n",), (None,), ('@If(a; @Failure("x"); 1)',), ("@If(a;1;2)",), ("y" * 130,), ("@Command(x)",), ("private sub A",)]
    got = [r[0] for r in spark.createDataFrame(rows, "f string").select(reports.formula_summary(F.col("f"))).collect()]
    assert got == ["Empty logic block."] * 2 + ['Validation error: "x"', "Conditional branching based on field or document state.", "Formula logic: " + "y" * 120 + "…", "Formula logic: @Command(x)", "LotusScript procedure."]


def test_names_of_graphs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"source_files": [{"path": "upload:x/a.dxl", "database_title": "T"}]}, "edges": [{"type": "USES", "other": 1}]}))
    (tmp_path / "b.json").write_text(json.dumps({"meta": {"input_directory": "in\\"}}))
    (tmp_path / "c.json").write_text("{}")
    graphs = store.read_graphs(spark, str(tmp_path))
    got = {r["file"][-6:]: (r["source_name"], r["nsf_path"], r["database_title"]) for r in store.described_graphs(graphs).collect()}
    assert got == {"a.json": ("a.dxl", "upload:x/a.dxl", "T"), "b.json": ("in", "in\\", None), "c.json": (None, "unknown", None)}
    assert graphs.select(F.explode("edges.type")).collect()[0][0] == "USES"


def test_tables_are_declared_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS answers LOCATION '{tmp_path}/db'")
    try:
        assert store.create_tables(spark, f"{tmp_path}/t", "answers") == store.create_tables(spark, f"{tmp_path}/t", "answers")
        assert spark.table("answers.edges").count() == 0 and "graph_id" in spark.table("answers.blocks").columns
    finally:
        spark.sql("DROP DATABASE answers CASCADE")


def test_time_is_utc(spark):
    assert spark.range(1).select(store.utc_now()).first()[0].endswith("Z")


def test_listing_and_matrix(spark):
    snapshots = spark.createDataFrame([("a", 1, 5, 1, 2), ("a", 2, 0, 0, 0)], "graph_id string, at int, critical int, safe int, total int")
    got = store.listed(spark.createDataFrame([("a", "1"), ("b", "2")], "graph_id string, parsed_at string"), snapshots).collect()
    assert [(r["graph_id"], r["n_critical"], r["safety_rate"]) for r in got] == [("b", None, None), ("a", 0, 100.0)]
    edges = spark.createDataFrame([("f", "v"), ("f", "w"), ("e", "w")], "src string, dst string")
    assert [tuple(r) for r in graph.matrix_order(edges).collect()] == [("column", "w", 2), ("column", "v", 1), ("row", "f", 2), ("row", "e", 1)]
    with_empty = graph.matrix_order(edges, False, spark.createDataFrame([("row", "g"), ("row", "f")], "side string, node string"))
    assert ("row", "g", 0) in [tuple(r) for r in with_empty.collect()] and with_empty.count() == 5


def test_elements_by_id(spark):
    elements = spark.createDataFrame([("form", "a:b"), ("page", "p")], "element_type string, name string")
    assert views.element_of(elements, "form:a:b").count() == 1 and views.element_of(elements, "page:p").count() == 0 and views.element_of(elements, "form").count() == 0


def test_gates_without_rows(spark):
    none = graph.validation(spark.createDataFrame([], "type string, target_name string"), spark.createDataFrame([], "trigger string"))
    assert {r["gate"]: r["passed"] for r in none.collect()} == {"bad_lookup_targets": True, "form_selections": False, "agents": False, "agents_without_trigger": True}


def test_upgrade_samples_are_distinct_and_bounded(spark):
    body = "\n".join(["db = s.getDatabase(1);"] * 4)
    units = spark.createDataFrame([("f", "java", body), ("f", "java", body), ("f", "java", None)], "source_file string, language string, body string")
    got = views.upgrade_samples(units).collect()
    assert [r["nth"] for r in got] == list(range(1, len(got) + 1)) and 1 <= len(got) <= 3 and all("\n" not in r["sample"] and len(r["sample"]) <= 120 for r in got)
    assert [tuple(r) for r in views.upgrade_totals(views.upgrade_counts(units)).collect()] == [("java", 4)]


def test_every_rule_has_one_remedy(spark):
    told = [r for r, _, _ in remedies.ADVICE]
    assert len(set(told)) == len(told) and {r.rule_id for r in rules.RULES} <= set(told)
    rows = [("DOM-003", None, None, None, "no variable"), ("DOM-004", "java", True, "d", "d.recycle()"), (None, "java", True, "d", None)]
    got = remedies.with_remedies(spark.createDataFrame(rows, "rule_id string, language string, in_loop boolean, variable string, evidence string")).collect()
    by = {r["rule_id"]: r for r in got}
    assert len(got) == 3 and "handle.recycle()" in by["DOM-003"]["sketch"] and by["DOM-004"]["sketch"] is None and by["DOM-004"]["advice"] and by[None]["topic"] is None


def test_containing_makes_no_pairs_that_do_not_hold(spark):
    texts = spark.range(6_000).select("id", F.concat(F.lit("calls fn"), F.col("id") + 100_000, F.lit("()")).alias("t"))
    names = spark.range(3_000).select(F.concat(F.lit("Fn"), F.col("id") + 200_000).alias("n")).union(spark.createDataFrame([("fn10",), ("Fn100007",), ("()",), ("s f",)], "n string"))
    found = audit.containing(texts, ["id"], "t", names, "n")
    assert {r["n"]: r["count"] for r in found.groupBy("n").count().collect()} == {"fn10": 6_000, "fn100007": 1, "()": 6_000, "s f": 6_000}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" not in plan.lower()  # pairs meet by equality: none is made to be tested
    odd = spark.createDataFrame([(1, "x\U0001f600y\U0001f600zz"), (2, "\U0001f600"), (3, "a\nb" * 3)], "k int, t string")
    got = audit.containing(odd, ["k"], "t", spark.createDataFrame([(n,) for n in ("y\U0001f600z", "\U0001f600", "zz", "z\U0001f600", "\nBa\nB", "ba\nba\n")], "n string"), "n").collect()
    assert sorted(map(tuple, got)) == sorted([(1, "y\U0001f600z"), (1, "\U0001f600"), (1, "zz"), (2, "\U0001f600"), (3, "\nba\nb"), (3, "ba\nba\n")])


@pytest.mark.parametrize("wide", [False, True])
def test_functions_and_findings_of_one_name_are_not_paired(spark, wide):
    functions = spark.range(10_000).select(F.col("id").alias("function_id"), F.lit("open").alias("name"), F.when(F.col("id") % 2 == 0, "lib").otherwise("Web").alias("element"), F.lit("java").alias("language"))
    k = F.col("id")
    severity = F.element_at(F.array(F.lit("LOW"), F.lit("HIGH")), (k % 2 + 1).cast("int"))
    owner = F.when(k % 3 == 0, "my LIB").when(k % 3 == 1, "pe").otherwise("x")
    findings = spark.range(30_000).select(
        k.alias("finding_id"), F.lit("DOM-1").alias("rule_id"), severity.alias("severity"), owner.alias("element_name"), F.when(k >= 29_990, "Opens").otherwise("t").alias("title"), F.lit("calls open()").alias("evidence"),
        F.lit("at open").alias("location"), F.lit("f").alias("source_file"), k.alias("line"), (k == 3).alias("is_false_positive"),
    )
    began = time.time()
    rows = views.related_findings(functions, findings, wide=wide).collect()
    assert time.time() - began < 40
    got = {}
    for r in sorted(rows, key=lambda r: r["nth"]):
        got.setdefault(r["function_id"], []).append(r["finding_id"])
    odd = [i for i in range(1, 30_000, 2) if i != 3]
    shown = lambda i: (["my LIB", "pe", "x"][i % 3], i)
    lib, web = (odd[:8],) * 2 if wide else (sorted((i for i in odd if good(i)), key=shown)[:3] for good in (lambda i: i % 3 == 0 or i >= 29_990, lambda i: i >= 29_990))
    assert len(got) == 10_000 and all(v == (web if i % 2 else lib) for i, v in got.items())
