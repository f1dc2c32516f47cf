"""Queries over units of code with their place, windows around findings, formulas in plain words and handles that nobody releases, each with the SQL that checks it.

The inputs are made from the tables by construction: each customer gives an export, each order a unit of code, each part a formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.functions import formulas
from siftgraph.operators import inventory, ownership, views
from siftgraph.plans.catalog import query, table
from siftgraph.sources import units

EXPORT = (
    '<database title="T{k}">\n<form name="F{k}"><code event="querysave"><lotusscript>\n\nDim a{k} As Integer</lotusscript></code></form>\n<agent name="A{k}">\n<code event="action"><javascript>var x{k} = 1;</javascript></code></agent>\n'
    '<view name="V{k}"><code event="selection"><formula>SELECT x{k}</formula></code></view></database>'
)
TWO_ROOTS, BROKEN = '<form name="F{k}">\n<code event="open"><formula>FIELD a := {k}</formula></code></form>\n<note/>', '<form name="x">session.open({k})'


def _filled(template: Column, key: str) -> Column:
    return F.replace(template, F.lit("{k}"), F.col(key).cast("string"))


@query("""WITH c AS (SELECT c_custkey % 100 AS m, CAST(c_custkey AS VARCHAR) AS k, c_custkey || '.dxl' AS source_file FROM customer)
    SELECT source_file, element_type, p || k || e AS element_name, language, event, body_start || k || body_end AS body, line AS start_line
    FROM c, (VALUES ('form', 'F', '/querysave', 'lotusscript', 'querysave', 'Dim a', ' As Integer', 4), ('agent', 'A', '/action', 'ssjs', 'action', 'var x', ' = 1;', 6), ('view', 'V', '/selection', 'formula', 'selection', 'SELECT x', '', 7))
        AS v(element_type, p, e, language, event, body_start, body_end, line) WHERE m NOT IN (7, 8)
    UNION ALL SELECT source_file, 'form', 'F' || k || '/open', 'formula', 'open', 'FIELD a := ' || k, 2 FROM c WHERE m = 7
    UNION ALL SELECT source_file, 'file', source_file, 'unknown', NULL, '<form name="x">session.open(' || k || ')', 1 FROM c WHERE m = 8""")
def xml_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 100
    text = _filled(F.when(kind == 7, TWO_ROOTS).when(kind == 8, BROKEN).otherwise(EXPORT), "c_custkey")
    texts = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".dxl")).alias("source_file"), text.alias("text"))
    return units.units(texts).select("source_file", "element_type", "element_name", "language", "event", "body", "start_line")


# A try, then y lines, the use, z lines and its release, then lines that are of no interest; the window goes from the try to the release or is cut at 100 lines.
@query("""WITH o AS (SELECT o_orderkey, 20 + o_orderkey % 7 AS a, o_orderkey % 50 AS b, o_orderkey % 90 AS c FROM orders),
    p AS (SELECT *, a + b + 1 AS hit, a + b + 2 + c AS mark, a + b + c + 153 AS n FROM o),
    q AS (SELECT *, least(hit - 15, a) AS low, greatest(least(n, hit + 46), mark + 1) AS high FROM p),
    r AS (SELECT *, CASE WHEN high - low > 100 THEN greatest(0, least(hit - 15, high - 100)) ELSE low END AS first FROM q)
    SELECT o_orderkey, 10 + first AS first, 9 + least(high, first + 100) AS last, 10 + hit AS problem, CASE WHEN mark < least(high, first + 100) THEN 10 + mark END AS cleanup FROM r""")
def grown_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    times = lambda line, n: F.repeat(F.lit(line + "\n"), n.cast("int"))
    body = F.concat(times("x();", 20 + k % 7), F.lit("try {\n"), times("y();", k % 50), F.lit("use(d);\n"), times("z();", k % 90), F.lit("d.recycle();\n"), times("w();", F.lit(150)))
    # A key is far smaller than its body and window: keys are dealt out first, to where bodies are made and met, and no body is shuffled or sorted.
    orders = table(spark, sf_dir, "orders").select("o_orderkey").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    made = orders.select("o_orderkey", body.alias("body"), F.lit(10).alias("start_line"))
    found = views.snippets(orders.select("o_orderkey", (31 + k % 7 + k % 50).cast("int").alias("line")).hint("shuffle_hash"), made, ["o_orderkey"])
    of = lambda kind: F.get(F.filter("window.lines", lambda x: x["kind"] == kind), 0)["line"].cast("long")
    return found.select("o_orderkey", F.col("window.first").cast("long").alias("first"), F.col("window.last").cast("long").alias("last"), of("problem").alias("problem"), of("cleanup").alias("cleanup"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Derives a formatted date value for order date.' WHEN 1 THEN 'Blocks save on input unless the rule passes: “Over ' || p_partkey || '”.'
    WHEN 2 THEN 'Defaults to the value of “Other' || p_partkey || '”.' WHEN 3 THEN 'Hides status based on document or field conditions.' WHEN 4 THEN 'Behaves differently for new documents vs existing ones. Runs the Domino command [File' || p_partkey || '].'
    WHEN 5 THEN 'Normalizes or reformats name' || p_partkey || ' as the user leaves the field.' WHEN 6 THEN 'Grants document edit rights to: [Admin], [Ed' || p_partkey || '].' ELSE 'Business logic on total: REM ' || p_partkey END AS said FROM part""")
def formulas_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [
        ("@Year(D{k}) + @Month(D{k})", "default", "fldOrderDate"), ('@If(Qty > {k}; @Success; @Failure("Over {k}"))', "validation", "Qty"), ("Other{k}", "default", "x"), ("@If(a{k}; b; c)", "hidewhen", "Status"),
        ("@If(@IsNewDoc; @Command([File{k}]); @Command([File]))", "logic", "x"), ("@Trim(x{k})", "translation", "Name{k}"), ('"[Admin]" : "[Ed{k}]"', "logic", "DocAuthors"), ("' a note\n  REM {k}  \nFIELD y", "logic", "Total"),
    ]
    said = F.lit(None).cast("string")
    for n, (body, role, name) in enumerate(cases):
        said = F.when(F.col("p_partkey") % len(cases) == n, formulas.describe(_filled(F.lit(body), "p_partkey"), role, _filled(F.lit(name), "p_partkey"))).otherwise(said)
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said"))


@query("""SELECT p_partkey, 'Ship Date' AS label, 'Ship Date is a text ' || CASE WHEN p_partkey % 2 = 0 THEN 'system-calculated field. Computed by copying the value from “Src Field”.' ELSE 'user-editable field. Defaults to the value of “Src Field”.' END
        || CASE WHEN p_partkey % 3 = 0 THEN ' ' || said ELSE '' END || ' Blocks save on input unless the rule passes: “No ' || p_partkey || '”. Conditionally hides ship date on the form.' || CASE WHEN p_partkey % 3 = 0 THEN ' ' || said ELSE '' END AS business_summary,
    CASE WHEN p_partkey % 3 = 0 THEN said ELSE '' END AS lookup_summary FROM (SELECT p_partkey, 'Looks up data via @DbLookup in view “V' || p_partkey || '” using key “k”.' AS said FROM part)""")
def field_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda template: _filled(F.lit(template), "p_partkey")
    none = F.lit(None).cast("string")
    lookup = F.struct(F.lit("@DbLookup").alias("function"), text("V{k}").alias("target_view"), none.alias("target_database"), F.lit("k").alias("lookup_key"), none.alias("return_field"))
    lookups = F.when(F.col("p_partkey") % 3 == 0, F.array(lookup))
    summary = formulas.describe_field(
        F.lit("webShipDate"), F.lit("text"), F.when(F.col("p_partkey") % 2 == 0, "computed").otherwise("editable"), F.lit("SrcField"), text('@If(x; @Success; @Failure("No {k}"))'), F.lit(None).cast("string"), text("a{k}"), lookups=lookups
    )
    return table(spark, sf_dir, "part").select("p_partkey", summary.alias("s")).select("p_partkey", "s.label", "s.business_summary", "s.lookup_summary")


@query("SELECT o_orderkey, 'use' || o_orderkey AS caller, 'keep' AS callee, 78 AS confidence, 'parameter' AS kind, 'doc' AS param FROM orders WHERE o_orderkey % 3 = 0")
def ownership_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    callee = F.when(k % 3 == 2, "public void keep(Document doc) { doc.recycle(); }").otherwise("public void keep(Document doc) { doc.x(); }")
    caller = F.when(k % 3 == 1, "\npublic void use{k}() { keep(d); d.recycle(); }").otherwise("\npublic void use{k}() { keep(d); }")
    made = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("orders").alias("source_file"), k.cast("string").alias("element_name"), F.lit("javaclass").alias("element_type"), F.lit("java").alias("language"), F.lit(None).cast("string").alias("event"), _filled(F.concat(callee, caller), "o_orderkey").alias("body"), F.lit(1).alias("start_line"),
    )
    found = ownership.unassigned(inventory.inventory(made))
    return found.select(F.col("element_name").cast("long").alias("o_orderkey"), "caller", "callee", "confidence", "kind", F.get("params", 0).alias("param"))


@query("SELECT o_orderkey, o_orderkey % 4 + o_orderkey % 3 + o_orderkey % 5 + 1 AS n FROM orders")
def cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    times = lambda line, n: F.repeat(F.lit(line + "\n"), n.cast("int"))
    body = F.concat(times("Call d.recycle();", k % 4), times("e.recycle(a);", k % 3), times("Delete x", k % 5), F.lit("Delete Call f.recycle()"))
    return table(spark, sf_dir, "orders").select("o_orderkey", inventory.n_cleanups(body, F.when(k % 2 == 0, "java").otherwise("lotusscript")).cast("long").alias("n"))
