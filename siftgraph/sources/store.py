"""Graphs as Parquet tables partitioned by graph and run.

A graph's manifest is a partition of its own that goes last and names the run whose rows count. A try that fails leaves rows that no reader sees, and one that
is made again writes the same run and the same manifest anew, so that at any point of failure a retry leaves each row once.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgraph.operators.windows import first_per_key, last_n

MANIFEST = "graph_id string, nsf_path string, database_title string, parsed_at string, n_edges long, n_elements long, n_blocks long, run string"
# Kept points of history and signals, and limits of the queries.
HISTORY, SIGNALS, EDGE_LIMIT, MOST_EDGES, LIST_LIMIT, MOST_LISTED = 24, 500, 500, 5000, 50, 200


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor sees: below spark.checkpoint.dir, or a local one where that is unset and all runs in one process, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that it is computed once however often it is used."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# The shape of a graph file that readers rely on; what a file lacks is null.
_FILE = "struct<path:string,database_id:string,database_path:string,database_title:string>"
_END = "struct<type:string,name:string,database_id:string>"
GRAPH = (
    f"meta struct<parser_version:string,generated_at:string,input_directory:string,source_files:array<{_FILE}>,databases:array<struct<id:string,title:string,path:string,source_file:string>>>, "
    f"edges array<struct<type:string,source:{_END},target:{_END},evidence:string,source_file:string,metadata:map<string,string>>>, "
    "business_logic array<struct<category:string,owner_type:string,owner_name:string,source_file:string,database_id:string,language:string,event:string,context:string,body:string>>"
)


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graph files (one JSON object each), one row a file, with the file's path. Keys that a file lacks are null; a file that is no JSON gives nulls."""
    return spark.read.schema(GRAPH).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, lower: int = 0, upper: int = 0, tasks: int = 1, **options: str) -> DataFrame:
    """A table of a database. With a numeric key and its bounds, tasks read ranges of it side by side; rows beyond the bounds go to the first and last task."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    return (reader.options(partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(tasks)) if key else reader).load()


def create_tables(spark: SparkSession, path: str, database: str = "default") -> list[str]:
    """Declares the stored tables over a folder; doing it again changes nothing. Returns their names."""
    from siftgraph.schemas import BLOCKS, EDGES, ELEMENTS

    declared = {"graphs": MANIFEST, "edges": EDGES, "elements": ELEMENTS, "blocks": BLOCKS}
    for name, columns in declared.items():
        keys = "graph_id" if name == "graphs" else "graph_id, run"
        columns = columns if name == "graphs" else f"{columns}, graph_id string, run string"
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet PARTITIONED BY ({keys}) LOCATION '{path}/{name}'")
    return [f"{database}.{name}" for name in declared]


def base_name(path: Column) -> Column:
    """A path without its upload label and folders; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), "(?i)^upload:", ""), r"[/\\]+$", "")
    return F.nullif(F.regexp_extract(bare, r"([^/\\]*)$", 1), F.lit(""))


def source_name(first_file: Column, database_file: Column, folder: Column) -> Column:
    """What a graph is called by: its first source file, else its first database's file, else the folder it was read from."""
    return F.coalesce(base_name(first_file), base_name(database_file), base_name(folder))


def described_graphs(graphs: DataFrame) -> DataFrame:
    """(file, source_name, nsf_path, database_title) of the rows of read_graphs."""
    first = F.get("meta.source_files", 0)
    path = F.coalesce(F.nullif(first["database_path"], F.lit("")), F.nullif(first["path"], F.lit("")), F.col("meta.input_directory"), F.lit("unknown"))
    return graphs.select("file", source_name(first["path"], F.get("meta.databases", 0)["source_file"], F.col("meta.input_directory")).alias("source_name"), path.alias("nsf_path"), first["database_title"].alias("database_title"))


def utc_now() -> Column:
    """The time of the query in UTC, as ISO 8601 text."""
    return F.concat(F.date_format(F.convert_timezone(None, F.lit("UTC"), F.localtimestamp()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def _put(df: DataFrame, path: str, *keys: str) -> None:
    """Writes df's partitions of a table; those that were there are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _found(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def run_of(nsf_path: str, parsed_at: str) -> str:
    """What a parse is called by; a retry of it has the same name."""
    return hashlib.sha256(f"{nsf_path}\n{parsed_at}".encode()).hexdigest()[:16]


def store_graph(path: str, graph_id: str, nsf_path: str, title: str, parsed_at: str, tables: dict[str, DataFrame]) -> None:
    """Writes edges, elements and blocks as a run, then the manifest that names it. Readers see the run before until then."""
    spark, run = next(iter(tables.values())).sparkSession, run_of(nsf_path, parsed_at)
    counts = {}
    for name, df in tables.items():
        _put(df.withColumns({"graph_id": F.lit(graph_id), "run": F.lit(run)}), f"{path}/{name}", "graph_id", "run")
        counts[name] = spark.read.schema(f"graph_id string, run string, {_columns(df)}").parquet(f"{path}/{name}").filter((F.col("graph_id") == graph_id) & (F.col("run") == run)).count()
    row = graph_id, nsf_path, title, parsed_at, counts.get("edges", 0), counts.get("elements", 0), counts.get("blocks", 0), run
    _put(spark.createDataFrame([row], MANIFEST), f"{path}/graphs", "graph_id")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def ensured(spark: SparkSession, path: str, name: str, graph_id: str, version: int, at: str, compute: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, bool]:
    """(a graph's stored result, whether it was there): rows of another version are computed anew, and all are if forced.

    What is computed goes to the history under its time first and then becomes the graph's result, both by partition: a retry of the same time leaves one of each.
    """
    if not force and (kept := _found(spark, f"{path}/{name}")) is not None:
        rows = kept.filter(F.col("graph_id").eqNullSafe(graph_id) & (F.col("schema_version") == version))
        if not rows.isEmpty():
            return rows, True
    made = written(compute().withColumns({"schema_version": F.lit(version), "made_at": F.lit(at), "graph_id": F.lit(graph_id)}))
    _put(made.withColumn("at_key", F.lit(hashlib.sha256(at.encode()).hexdigest()[:16])), f"{path}/{name}_history", "graph_id", "at_key")
    _put(made, f"{path}/{name}", "graph_id")
    return made, False


def history_of(spark: SparkSession, path: str, name: str, graph_id: str, most: int = HISTORY) -> DataFrame:
    """The newest results of a graph, one row each, where a result is one row."""
    kept = spark.read.parquet(f"{path}/{name}_history").filter(F.col("graph_id") == graph_id).drop("at_key")
    return last_n(kept, ["graph_id"], most, "made_at")


def listed(graphs: DataFrame, snapshots: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest graphs (graph_id, parsed_at, ...) with what their newest snapshot says (graph_id, at, critical, safe, total): n_critical, and safety_rate in percent, null without a snapshot."""
    newest = first_per_key(snapshots, ["graph_id"], F.desc("at")).select("graph_id", F.col("critical").alias("n_critical"), F.when(F.col("total") == 0, 100.0).otherwise(F.round(100 * F.col("safe") / F.col("total"), 1)).alias("safety_rate"))
    few = graphs.orderBy(F.desc("parsed_at"), "graph_id").limit(max(1, min(limit, MOST_LISTED)))
    return few.join(newest, "graph_id", "left").orderBy(F.desc("parsed_at"), "graph_id")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
    return spark.read.schema(MANIFEST).parquet(f"{path}/graphs").select(*names)


def list_graphs(spark: SparkSession, path: str, limit: int = LIST_LIMIT) -> DataFrame:
    return manifests(spark, path).orderBy(F.desc("parsed_at"), "graph_id").limit(max(1, min(limit, MOST_LISTED)))


def latest_graph(spark: SparkSession, path: str, like: str | None = None) -> DataFrame:
    """The newest graph whose path holds `like`; its % and _ are wildcards."""
    rows = manifests(spark, path)
    return (rows.filter(F.col("nsf_path").ilike(f"%{like}%")) if like else rows).orderBy(F.desc("parsed_at"), "graph_id").limit(1)


def table_of(spark: SparkSession, path: str, name: str, graph_id: str) -> DataFrame:
    """One graph's rows of a table, of the run that its manifest names; only that partition is read. A graph without a manifest has none."""
    found = manifests(spark, path).filter(F.col("graph_id") == graph_id).select("run").first()
    return spark.read.parquet(f"{path}/{name}").filter((F.col("graph_id") == graph_id) & (F.col("run") == (found["run"] if found else None))).drop("graph_id", "run")


def query_edges(edges: DataFrame, edge_type: str | None = None, source: str | None = None, limit: int = EDGE_LIMIT) -> DataFrame:
    for wanted in ([F.col("type") == edge_type] if edge_type else []) + ([F.col("source_name").ilike(f"%{source}%")] if source else []):
        edges = edges.filter(wanted)
    return edges.orderBy("type", "source_name", "target_name", "evidence").limit(max(1, min(limit, MOST_EDGES)))


def trend(history: DataFrame, like: str | None = None, n: int = 20) -> DataFrame:
    """The last n points of snapshot history (graph_id, nsf_path, at, ...), oldest first; the filter goes before the limit."""
    rows = history.filter(F.col("nsf_path").ilike(f"%{like}%")) if like else history
    return rows.orderBy(F.desc("at"), "graph_id").limit(n).orderBy("at", "graph_id")


def kept_history(history: DataFrame) -> DataFrame:
    return last_n(history, ["graph_id"], HISTORY, "at")


def kept_signals(signals: DataFrame) -> DataFrame:
    return last_n(signals, ["graph_id"], SIGNALS, "at", "message")


def latest_marks(marks: DataFrame) -> DataFrame:
    """The newest triage mark of each item."""
    return first_per_key(marks, ["kind", "item_id"], F.desc("at"))


def stale(rows: DataFrame, version: int, force: bool = False) -> DataFrame:
    """Stored results (schema_version, ...) to compute anew: of another version, or all."""
    return rows if force else rows.filter(F.coalesce("schema_version", F.lit(-1)) != version)


def overwrite_partition(df: DataFrame, path: str, key: str, value: str) -> None:
    """Replaces one key's rows of a table; running it again changes nothing."""
    df.drop(key).write.mode("overwrite").parquet(f"{path}/{key}={value}")
