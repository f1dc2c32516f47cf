"""Queries over calls to upgrade, guides of functions, lists of samples and names, stored results and buffers of signals, each with the SQL that checks it.

The inputs are made from the tables by construction: each customer gives an export, each order a function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.functions import classify
from siftgraph.operators import audit, graph, guides, inventory, upgrades
from siftgraph.plans import queries
from siftgraph.plans.catalog import query, table
from siftgraph.plans.unit_queries import _filled
from siftgraph.sources import store, upgrade
from siftgraph.streaming import ingest

#: A script with two calls, a Java project whose wrapper has the same text as what it wraps, text in the project, a formula that doesn't count, and a script that names its language.
EXPORT = (
    '<database><agent name="A"><code event="Initialize"><lotusscript>Set d{k} = s.GetDatabase("", "a")\nSet e = s.GetDatabase("", "b")</lotusscript></code></agent>'
    '<scriptlibrary name="J"><javaproject><java> Database d{k} = s.getDatabase(null, "x"); </java></javaproject><javaproject>// project {k} <code>session.getDatabase({k});</code></javaproject></scriptlibrary>'
    "<view><formula>@GetDatabase({k}); GetDatabase(1)</formula></view><script language='LotusScript'>CurrentDatabase {k}</script><script>getDatabase({k}); GetDatabase(</script></database>"
)
#: Only one language's calls in two roots, and an export that can't be read.
TWO_ROOTS, BROKEN = "<lotusscript>x = GetDatabase({k})</lotusscript><note/>", "<a>GetDatabase({k})"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 100
    text = _filled(F.when(kind == 7, TWO_ROOTS).when(kind == 8, BROKEN).otherwise(EXPORT), "c_custkey")
    return upgrade.blocks(table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".dxl")).alias("source_file"), text.alias("text")))


_CUSTOMERS = "c AS (SELECT c_custkey % 100 AS m, CAST(c_custkey AS VARCHAR) AS k, c_custkey || '.dxl' AS source_file FROM customer)"


@query(f"""WITH {_CUSTOMERS} SELECT source_file, language, a || k || b AS body, pos FROM c, (VALUES ('lotusscript', 'Set d', ' = s.GetDatabase("", "a")' || chr(10) || 'Set e = s.GetDatabase("", "b")', 0), ('java', 'Database d', ' = s.getDatabase(null, "x");', 1),
    ('lotusscript', 'CurrentDatabase ', '', 4), ('javascript', 'getDatabase(', '); GetDatabase(', 5)) AS v(language, a, b, pos) WHERE m NOT IN (7, 8)
    UNION ALL SELECT source_file, 'java', '// project ' || k || ' session.getDatabase(' || k || ');', 2 FROM c WHERE m NOT IN (7, 8) UNION ALL SELECT source_file, 'java', 'session.getDatabase(' || k || ');', 3 FROM c WHERE m NOT IN (7, 8)
    UNION ALL SELECT source_file, 'lotusscript', 'x = GetDatabase(' || k || ')', 0 FROM c WHERE m = 7""")
def upgrade_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).filter("note is null").select("source_file", "language", "body", "pos")


@query(f"""WITH {_CUSTOMERS}, n AS (SELECT count(*) FILTER (WHERE m NOT IN (7, 8)) AS whole, count(*) FILTER (WHERE m = 7) AS two FROM c), h AS (SELECT 'lotusscript' AS language, 'GetDatabase' AS pattern, 2 * whole + two AS n_hits FROM n
    UNION ALL SELECT 'lotusscript', 'CurrentDatabase', whole FROM n UNION ALL SELECT 'java', 'getDatabase', 3 * whole FROM n UNION ALL SELECT 'java', 'session_getDatabase', 2 * whole FROM n)
    SELECT * FROM h WHERE n_hits > 0""")
def upgrade_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upgrades.hits(_blocks(spark, sf_dir))


@query(f"""WITH {_CUSTOMERS} SELECT source_file, note FROM c, (VALUES (7, '{upgrade.WRAPPED}'), (7, '{upgrades.ONLY_LOTUS}'), (0, '{upgrades.BOTH}')) AS v(kind, note) WHERE m = kind OR kind = 0 AND m NOT IN (7, 8)
    UNION ALL SELECT source_file, '{upgrade.BROKEN}mismatched tag: line 1, column ' || (23 + length(k)) FROM c WHERE m = 8""")
def upgrade_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upgrades.notes(_blocks(spark, sf_dir))


@query(f"""WITH {_CUSTOMERS}, s AS (SELECT 'lotusscript' AS language, 'CurrentDatabase' AS pattern, source_file, 'CurrentDatabase ' || k AS sample FROM c WHERE m NOT IN (7, 8)
    UNION ALL SELECT 'java', 'session_getDatabase', source_file, CASE WHEN n = 2 THEN right('// project ' || k || ' ', 20) ELSE '' END || 'session.getDatabase(' || k || ');' FROM c, (VALUES (2), (3)) AS v(n) WHERE m NOT IN (7, 8)),
    r AS (SELECT *, row_number() OVER (PARTITION BY language, pattern ORDER BY source_file, length(sample) DESC) AS nth FROM s) SELECT language, pattern, CAST(nth AS INTEGER) AS nth, sample FROM r WHERE nth <= 5""")
def upgrade_first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upgrades.samples(_blocks(spark, sf_dir))
    return found.filter(F.col("pattern").isin("CurrentDatabase", "session_getDatabase"))


BODIES = ["return 1;", 'for (;;) { var d = db.getView("{k}"); }', 'var d = db.getView("{k}");\nuse(d);\nd.recycle();', 'var a = db.getView("{k}"); var b = db.getDatabase("y");\n\na.recycle();']


@query("""SELECT o_orderkey, CAST(1 + CASE o_orderkey % 4 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END AS INTEGER) AS focus_line, CAST(CASE o_orderkey % 4 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END AS INTEGER) AS n_lines,
    'f' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN ' takes no handles.' WHEN 1 THEN ' takes handles in a loop and never calls recycle(), so each turn leaves one open. Handles: d.' WHEN 2 THEN ' takes handles and calls recycle() for them. Handles: d.' ELSE ' releases some of its handles, but not all. Handles: b.' END AS problem,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'lifetime' ELSE 'walk' END AS topic FROM orders""")
def function_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(_filled(F.lit("function f{k}() { "), "o_orderkey"), _filled(F.element_at(F.array(*map(F.lit, BODIES)), (F.col("o_orderkey") % 4 + 1).cast("int")), "o_orderkey"), F.lit(" }"))
    made = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("orders").alias("source_file"), F.col("o_orderkey").cast("string").alias("element_name"), F.lit("scriptlibrary").alias("element_type"), F.lit("ssjs").alias("language"), F.lit(None).cast("string").alias("event"), body.alias("body"), F.lit(1).alias("start_line"),
    )
    said = guides.with_guides(inventory.inventory(made))
    return said.select("o_orderkey", F.col("focus_line").cast("int").alias("focus_line"), F.size("window.lines").alias("n_lines"), "problem", "topic")


@query("""WITH t AS (SELECT 'g' || o_custkey % 10 AS g, o_orderkey AS k FROM orders), v AS (SELECT g, 'file_paths' AS sample, 0 AS rank, 'C:\\dir\\' || k % 30 AS value FROM t UNION SELECT g, 'file_paths', 1, '\\\\srv\\' || k % 3 FROM t UNION SELECT g, 'domino_names', 0, 'CN=n' || k % 40 || '/O=x' FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, sample ORDER BY rank, value) AS nth FROM v) SELECT g, sample, string_agg(value, '|' ORDER BY nth) AS listed FROM r WHERE nth <= 20 GROUP BY g, sample""")
def hardcoded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda before, n, after="": F.concat(F.lit(before), (k % n).cast("string"), F.lit(after))
    texts = table(spark, sf_dir, "orders").select(F.concat(F.lit("g"), (F.col("o_custkey") % 10).cast("string")).alias("g"), F.concat_ws("\n", part("C:\\dir\\", 30), part("\\\\srv\\", 3), part("CN=n", 40, "/O=x")).alias("text"))
    return graph.hardcoded_samples(texts, "g").select("g", "sample", F.array_join("values", "|").alias("listed"))


@query(f"""WITH e AS (SELECT name, {queries._case('name', classify.DOMAINS, 'General')} AS domain, CASE k % 4 WHEN 0 THEN 'forms' WHEN 1 THEN 'views' WHEN 2 THEN 'agents' END AS part FROM (SELECT p_size AS k, {queries._NAME_SQL.replace('k %', 'p_partkey %')} AS name FROM part))
    SELECT domain, part, name, count(*) AS n FROM e WHERE part IS NOT NULL GROUP BY ALL""")
def capability_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["form", "view", "agent", "library"])), (F.col("p_size") % 4 + 1).cast("int"))
    return graph.capability_names(table(spark, sf_dir, "part").select(kind.alias("element_type"), queries._name(F.col("p_partkey")).alias("name")))


@query(f"""WITH {queries.BLOCKS_SQL} SELECT owner_name AS form, lower(event) AS stage, o_orderkey AS pos, 'does ' || o_orderkey AS summary FROM b WHERE lower(event) IN ({', '.join(repr(s) for s in classify.STAGES)})""")
def lifecycle_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = queries._blocks(spark, sf_dir).withColumns({"pos": F.col("o_orderkey"), "summary": F.concat(F.lit("does "), F.col("o_orderkey").cast("string"))})
    return graph.lifecycle_summaries(blocks, blocks.select(F.col("owner_name").alias("name")))


@query(f"""WITH {queries.RECORDS_SQL}, l AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'LotusScript' ELSE 'csjs' END AS language FROM r), z AS (SELECT *, language = 'java' AS scoped FROM l)
    SELECT o_orderstatus, count(*) AS all_functions, count(*) FILTER (WHERE language = 'LotusScript') AS lotus_functions, count(*) FILTER (WHERE scoped) AS total, count(*) FILTER (WHERE scoped AND NOT allocates) AS safe,
    count(*) FILTER (WHERE scoped AND allocates AND (fp OR status = 'PROTECTED')) AS protected, count(*) FILTER (WHERE scoped AND allocates AND (fp OR status <> 'UNPROTECTED')) AS any_cleanup FROM z GROUP BY o_orderstatus""")
def inventory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    records = queries._records(spark, sf_dir).withColumns({"language": F.when(k == 0, "java").when(k == 1, "LotusScript").otherwise("csjs"), "element_name": F.lit("x")})
    return audit.inventory_report(records, "o_orderstatus").select("o_orderstatus", "all_functions", "lotus_functions", "total", "safe", "protected", "any_cleanup")


@query("SELECT 'g' || s_suppkey % 3 AS graph_id, count(*) AS n, 1 AS n_manifests FROM supplier GROUP BY 1, s_suppkey % 3")
def stored_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs stored twice, the second time as a retry, as a reader finds them."""
    path = store.shared_dir(spark)
    suppliers = table(spark, sf_dir, "supplier")
    for g in range(3):
        own = suppliers.filter(F.col("s_suppkey") % 3 == g).select(F.col("s_name").alias("source_name"))
        for _ in range(2):
            store.store_graph(path, f"g{g}", f"apps/{g}.nsf", "t", "2024-01-01", {"edges": own})
    rows = [store.table_of(spark, path, "edges", f"g{g}").groupBy(F.lit(f"g{g}").alias("graph_id")).agg(F.count(F.lit(1)).alias("n")) for g in range(3)]
    counted = store.manifests(spark, path).groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("n_manifests"))
    return rows[0].union(rows[1]).union(rows[2]).join(counted, "graph_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 20")
def stateful_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 events of each user, kept in the state of a stream."""
    events, top = table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), store.shared_dir(spark)
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    ingest.buffer_signals(stream, ["user_id"], ["ts", "event_id"], f"{top}/buffers", f"{top}/checkpoint", 20)
    return ingest.buffered(spark, f"{top}/buffers", ["user_id"]).select("event_id", "user_id")
