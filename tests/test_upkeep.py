"""Blocks and notes of the scan for calls to upgrade, guides, samples, stored results and buffers of signals."""

import pytest
from pyspark.sql import functions as F

from siftgraph.operators import audit, graph, guides, inventory, upgrades
from siftgraph.operators.windows import first_distinct
from siftgraph.sources import store, upgrade
from siftgraph.streaming import ingest

BOTH = """<database xmlns="urn:x">
  <agent name="A"><code event="Initialize"><lotusscript>
Sub Initialize
  Dim db As NotesDatabase
  Set db = session.GetDatabase("","app.nsf")
End Sub
  </lotusscript></code></agent>
  <scriptlibrary name="J"><javaproject>
    <java>
public void open(Session s) { Database db = s.getDatabase(null, "app.nsf"); }
    </java>
  </javaproject></scriptlibrary>
</database>"""


def bodies(text):
    return [(b["language"], b["body"]) for b in upgrade.blocks_of(text, "f") if b["language"]]


def test_calls_count_for_their_own_language(spark):
    made = upgrade.blocks(spark.createDataFrame([("a.dxl", BOTH), ("b.dxl", "<lotusscript>x = GetDatabase(1)</lotusscript><note/>"), ("c.dxl", "<a"), ("d.dxl", None), (None, "<java/>")], "source_file string, text string")).cache()
    found = {(r["source_file"], r["language"], r["pattern"]): r["n_hits"] for r in upgrades.hits(made, "source_file").collect()}
    assert found == {("a.dxl", "lotusscript", "GetDatabase"): 1, ("a.dxl", "java", "getDatabase"): 1, ("b.dxl", "lotusscript", "GetDatabase"): 1}
    notes = {(r["source_file"], r["note"]) for r in upgrades.notes(made).collect()}
    assert {n for n in notes if n[0] != "c.dxl"} == {("a.dxl", upgrades.BOTH), ("b.dxl", upgrade.WRAPPED), ("b.dxl", upgrades.ONLY_LOTUS), ("d.dxl", upgrade.WRAPPED)}
    assert [n for f, n in notes if f == "c.dxl"][0].startswith(upgrade.BROKEN)
    assert {(r["language"], r["n_blocks"]) for r in upgrades.by_language(made).collect()} == {("lotusscript", 2), ("java", 1)}
    assert upgrades.samples(made.limit(0)).collect() == [] and upgrades.notes(made.limit(0)).collect() == []


def test_language_of_what_is_around():
    assert bodies("<javaproject><code>int a = 1;</code><text>int b = 2;</text><item>int c = 3;</item></javaproject>") == [("java", "int a = 1;int b = 2;int c = 3;"), ("java", "int a = 1;"), ("java", "int b = 2;")]
    assert bodies("<java><javascript>var a = 1;</javascript><formula><code>@If(a; b)</code></formula></java>")[1:] == [("javascript", "var a = 1;")]
    assert bodies("<javaproject><formula><text>@If(a; b; c)</text></formula></javaproject>") == [("java", "@If(a; b; c)")]  # the formula's own text isn't scanned
    assert bodies("<a><script type='text/java'>int a = 1;</script><script language='lotusscript'>Dim a As b</script><script>var a = 1;</script></a>") == [("java", "int a = 1;"), ("lotusscript", "Dim a As b"), ("javascript", "var a = 1;")]


def test_the_same_text_is_one_block():
    same = "x" * 300
    assert bodies(f"<java> <java>{same}</java> </java>") == [("java", same)]  # a wrapper within a wrapper
    assert len(bodies(f"<a><java>{same}</java><java>{same[:-1]}y</java><java>{same}z</java><java>short</java></a>")) == 2  # first characters and length agree
    assert len(bodies(f"<a><java>{same}</java><ls>{same}</ls></a>")) == 2


def test_scan_of_a_file_and_a_folder(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.dxl").write_text(BOTH)
    (tmp_path / "x" / "y" / "b.xml").write_bytes(b"<java>s.getDatabase(\xff2);</java>")
    assert {r["n_hits"] for r in upgrades.hits(upgrade.scan(spark, str(tmp_path / "x")).filter("language = 'java'")).collect()} == {2}
    assert upgrades.hits(upgrade.scan(spark, str(tmp_path / "x" / "a.dxl"))).count() == 2


def test_samples_are_the_first_distinct_ones(spark):
    rows = [(f"f{k}", "java", f"a{k // 2}.getDatabase(1);\nb.getDatabase(2); c.getDatabase(3); d.getDatabase(4)", 0, None) for k in range(9)]
    got = upgrades.samples(spark.createDataFrame(rows, upgrade.BLOCK)).orderBy("nth").collect()
    assert len(got) == 5 and got[0]["sample"].startswith("a0.getDatabase(1); b.getDatabase(2)") and not any("d.getDatabase(4)" in r["sample"][:25] for r in got)
    few = spark.createDataFrame([(k % 2, f"v{k % 7}", k) for k in range(100)], "k int, v string, at int")
    assert [(r["k"], r["v"], r["nth"]) for r in first_distinct(few, ["k"], ["v"], 2, "at").orderBy("k", "nth").collect()] == [(0, "v0", 1), (0, "v2", 2), (1, "v1", 1), (1, "v3", 2)]


def test_guides_show_the_release_else_the_taking(spark):
    long = "\n".join(["x();"] * 150)
    bodies = {
        "kept": 'var d = db.getView("v");\nuse(d);\nd.recycle();', "open": '\nvar d = db.getView("v");', "none": "return 1;", "walk": 'while (x) {\nvar d = db.getView("v");\n}',
        "long": f'{long}\nvar d = db.getView("v");\n{long}\nd.recycle();', "gone": 'var d = db.getView("v"); if (x) return; d.recycle();',
    }
    units = spark.createDataFrame([("f", k, "scriptlibrary", "ssjs", None, f"function {k}() {{{b}}}", 7) for k, b in bodies.items()], "source_file string, element_name string, element_type string, language string, event string, body string, start_line int")
    got = {r["name"]: r for r in guides.with_guides(inventory.inventory(units)).collect()}
    assert {k: r["focus_line"] for k, r in got.items()} == {"kept": 9, "open": 8, "none": 7, "walk": 8, "long": 308, "gone": 7}
    assert got["open"]["problem"].endswith("once and never calls recycle(). Handles: d.") and "in a loop" in got["walk"]["problem"] and got["walk"]["warning"].startswith("Critical")
    assert got["none"]["sketch"] is None and "d.recycle();" in got["open"]["sketch"] and "left" in got["gone"]["problem"]
    assert len(got["kept"]["window"]["lines"]) == 3 and len(got["long"]["window"]["lines"]) <= 120 and got["long"]["window"]["last"] >= 308
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), ("f", "Delete x", 1, "LotusScript", "PARTIAL", True, ["x", "y"], ["y"]), ("f", "x", 1, "java", "NEW", False, [], [])], "name string, function_body string, line int, language string, status string, in_loop boolean, allocated array<string>, unclean array<string>")
    said = {r["status"]: r for r in guides.with_guides(odd).collect()}
    assert said[None]["problem"] is None and said["NEW"]["problem"] is None and said["PARTIAL"]["guide"] == "Pair each variable that takes a handle with its own Delete before the exit." and said["PARTIAL"]["problem"].endswith("Handles: y.")
    assert guides.with_guides(odd.limit(0)).collect() == []


def test_report_of_an_inventory(spark):
    rows = [("java", "a", "PROTECTED", True, False), ("SSJS", "a", "PARTIAL", True, False), ("java", "a", "UNPROTECTED", True, True), ("xpages", "a", "SAFE", False, False), ("LotusScript", "a", "PROTECTED", True, False), ("javascript", "csjsThing", "SAFE", False, False), ("formula", None, "SAFE", False, None)]
    records = spark.createDataFrame(rows, "language string, element_name string, status string, allocates boolean, is_false_positive boolean").withColumn("severity", F.lit("LOW"))
    r = audit.inventory_report(records).first()
    assert (r["all_functions"], r["lotus_functions"], r["total"], r["safe"], r["protected"], r["any_cleanup"], r["partial"], r["false_positives"]) == (7, 1, 4, 1, 2, 3, 1, 1)
    assert (r["safety_rate"], r["coverage_rate"]) == (75.0, 50.0)
    none = audit.inventory_report(records.limit(0)).first()
    assert (none["total"], none["safety_rate"], none["coverage_rate"]) == (0, 100.0, 100.0)


def test_samples_and_names(spark):
    texts = spark.createDataFrame([("g", "\n".join(f"C:\\d\\{k:02d}" for k in range(25))), ("g", "\\\\srv\\a x 10.0.0.1 10.0.0.1"), ("h", None)], "g string, text string")
    got = {(r["g"], r["sample"]): r["values"] for r in graph.hardcoded_samples(texts, "g").collect()}
    assert set(got) == {("g", "file_paths"), ("g", "ip_addresses")} and got["g", "file_paths"] == [f"C:\\d\\{k:02d}" for k in range(20)] and got["g", "ip_addresses"] == ["10.0.0.1"]
    names = graph.capability_names(spark.createDataFrame([("form", "Order"), ("Form", "Order"), ("library", "Order"), (None, None)], "element_type string, name string"))
    assert [(r["part"], r["name"], r["n"]) for r in names.collect()] == [("forms", "Order", 2)]
    blocks = spark.createDataFrame([("F", "QuerySave", "x", 2, "b"), ("F", "", "validation", 1, "a"), ("F", "click", "validation", 3, "c"), ("G", "querysave", "x", 1, "d"), (None, None, None, None, None)], "owner_name string, event string, category string, pos int, summary string")
    found = graph.lifecycle_summaries(blocks, spark.createDataFrame([("F",), ("F",)], "name string"))
    assert sorted(tuple(r) for r in found.collect()) == [("F", "querysave", 2, "b"), ("F", "validation", 1, "a")]


def test_a_run_without_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    edges = lambda *names: {"edges": spark.createDataFrame([(n,) for n in names], "source_name string")}
    path = str(tmp_path)
    seen = lambda g="g": sorted(r["source_name"] for r in store.table_of(spark, path, "edges", g).collect())
    store.store_graph(path, "g", "a.nsf", "t", "2024-01-01", edges("a", "b"))
    store.store_graph(path, "h", "h.nsf", "t", "2024-01-01", edges("h"))
    put = store._put

    def fails(df, where, *keys):
        if where.endswith("/graphs"):
            raise RuntimeError("lost")
        put(df, where, *keys)

    monkeypatch.setattr(store, "_put", fails)
    with pytest.raises(RuntimeError):
        store.store_graph(path, "g", "a.nsf", "t", "2024-02-01", edges("c"))
    assert seen() == ["a", "b"]
    monkeypatch.setattr(store, "_put", put)
    for _ in range(2):
        store.store_graph(path, "g", "a.nsf", "t", "2024-02-01", edges("c"))
    assert seen() == ["c"] and seen("h") == ["h"] and seen("none") == []
    assert sorted((r["graph_id"], r["n_edges"]) for r in store.manifests(spark, path).collect()) == [("g", 1), ("h", 1)]


def test_results_are_made_once_for_a_version(spark, tmp_path):
    path, made = str(tmp_path), []

    def compute():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "critical int")

    ask = lambda at, version=1, force=False, g="g": store.ensured(spark, path, "snapshots", g, version, at, compute, force)
    rows, kept = ask("t1")
    assert not kept and rows.first()["critical"] == 1
    rows, kept = ask("t2")
    assert kept and rows.first()["critical"] == 1 and rows.first()["made_at"] == "t1" and len(made) == 1
    assert not ask("t3", version=2)[1] and not ask("t4", version=2, force=True)[1] and not ask("t4", version=2, force=True)[1] and not ask("t1", g="h")[1]
    assert sorted(r["made_at"] for r in store.history_of(spark, path, "snapshots", "g").collect()) == ["t1", "t3", "t4"]
    assert [r["made_at"] for r in store.history_of(spark, path, "snapshots", "g", 1).collect()] == ["t4"]


def test_buffers_stay_bounded_over_restarts_and_replays(spark, tmp_path):
    schema = "graph_id int, message string, at string"
    args = (["graph_id"], ["at", "message"], str(tmp_path / "out"), str(tmp_path / "check"), 5)
    made = [(k % 2 if k < 20 else 0, f"m{k:02d}", None if k in (0, 39) else f"{(k * 7) % 40:02d}") for k in range(40)]
    for part in (made[:15], made[15:30], made[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.buffer_signals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), *args)
    held = lambda: sorted((r["graph_id"], r["message"]) for r in ingest.buffered(spark, args[2], ["graph_id"]).collect())
    newest = lambda g: sorted((r for r in made if r[0] == g), key=lambda r: (r[2] or "", r[1]))[-5:]
    assert held() == sorted((g, m) for g in (0, 1) for _, m, _ in newest(g))
    (last,) = (tmp_path / "check" / "commits").glob("2")  # as if the last batch had been lost before it was noted
    last.unlink()
    for crc in (tmp_path / "check" / "commits").glob(".2.crc"):
        crc.unlink()
    before = held()
    ingest.buffer_signals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), *args)
    assert held() == before
