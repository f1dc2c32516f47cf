"""Calls that hand a handle over, or take one, where neither side releases it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.functions import text

#: Characters after a call in which its result would be released.
WINDOW = 400
_CALL = r"(?:\b(\w+)\s*=\s*)?\b(?:\w+\s*\.\s*)*(\w+)\s*\("
_HANDLE = r"(?i)\breturn\s+\w*(?:doc|document|view|db|database|entry|nav|coll|collection|item|stream)\w*\b"
_USES = r"""(?im)^\s*Use\s+"([^"]+)\""""
# Confidence within an element and across libraries, what a gap in a parameter takes from it, and its least.
WITHIN, ACROSS, OF_PARAMETER, LEAST = 82, 72, 4, 70


def gaps(calls: DataFrame, defs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(caller, callee, name) of calls (caller, name, scope) to definitions (callee, name, scope) of the same name and scope; scopes lists the scopes in question.

    An equi-join on name and scope: AQE splits a name that many share. Recursion doesn't count.
    """
    own = calls.join(scopes, "scope", "left_semi")
    return own.join(defs, ["name", "scope"]).filter("caller <> callee").select("caller", "callee", "name").distinct()


def _scope(kind: str, *names: Column) -> Column:
    return F.concat_ws("\0", F.lit(kind), *(F.lower(n) for n in names))


def definitions(records: DataFrame) -> DataFrame:
    """(low, scope, callee, returns, params, cleans) of functions that return a handle or take one, for each scope in which they are met: their element, and the library that it is.

    A function returns a handle if its head says so, or if it allocates one and returns a variable named like one; params are its parameters of handle types.
    """
    returns = text.returns_handle(F.col("signature"), F.col("language")) | F.col("function_body").rlike(_HANDLE) & (F.size("allocated") > 0)
    params = text.handle_params(F.regexp_extract(F.coalesce("signature", F.lit("")), r"(?s)\((.*)\)", 1), F.col("language"))
    own = records.select(
        F.lower("name").alias("low"), F.col("name").alias("callee"), returns.alias("returns"), params.alias("params"), (F.col("n_cleanups") > 0).alias("cleans"),
        F.explode(F.array(_scope("element", F.col("element_type"), F.col("element_name")), _scope("library", F.col("element_name")))).alias("scope"),
    )
    return own.filter(F.col("returns") | (F.size("params") > 0))


def calls_of(records: DataFrame, uses: DataFrame | None) -> DataFrame:
    """(source_file, element_name, caller, low, result, after, scope, across) of every call, for each scope that its element sees: itself, and the libraries that it uses."""
    hits = text.matches(F.col("function_body"), _CALL)
    used = F.regexp_extract_all("function_body", F.lit(_USES), F.lit(1))
    own = F.struct(_scope("element", F.col("element_type"), F.col("element_name")).alias("scope"), F.lit(False).alias("across"))
    library = lambda name: F.struct(_scope("library", name).alias("scope"), F.lit(True).alias("across"))
    seen = records.withColumn("seen", F.concat(F.array(own), F.transform(F.array_distinct(used), library)))
    if uses is not None:
        linked = uses.groupBy("element_name").agg(F.array_distinct(F.collect_list(library(F.col("library")))).alias("linked"))  # as many as an element has Use lines
        seen = seen.join(linked, "element_name", "left").withColumn("seen", F.array_distinct(F.concat("seen", F.coalesce("linked", F.expr("cast(array() as array<struct<scope:string,across:boolean>>)")))))
    return seen.select("source_file", "element_name", "element_type", F.col("name").alias("caller"), "function_body", "seen", F.explode(hits).alias("m")).select(
        "source_file", "element_name", "caller", F.lower(F.regexp_extract("m.hit", _CALL, 2)).alias("low"), F.regexp_extract("m.hit", _CALL, 1).alias("result"),
        F.substring("function_body", F.col("m.end") + 1, F.lit(WINDOW)).alias("after"), F.inline("seen"),
    )


def unassigned(records: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Findings DOM-OWN-001 over analysed functions: one for each element, caller and callee.

    A call counts if the callee is in the caller's element or in a library that it uses (uses: element_name, library; else by Use lines), hands over or takes a
    handle, and nothing is released within 400 characters after it. A result that goes nowhere, and a handle that is passed, count as
    released if the callee releases any. Callers and callees meet by name and scope together, so that a name that all elements have makes no pairs of them.
    """
    met = calls_of(records, uses).join(definitions(records), ["low", "scope"]).filter(F.col("low") != F.lower("caller"))
    after = F.col("after").rlike(r"(?i)\.\s*recycle\s*\(|\bDelete\s+[A-Za-z_]")
    released = F.when(F.col("returns"), after | (F.col("result") == "") & F.col("cleans")).otherwise(after | F.col("cleans"))
    base = F.when(F.col("across"), ACROSS).otherwise(WITHIN)
    sure = F.when(F.col("returns"), base).otherwise(F.greatest(F.lit(LEAST), base - OF_PARAMETER))
    found = met.filter(~released).select("source_file", "element_name", "caller", "callee", sure.alias("confidence"), F.when(F.col("returns"), "return").otherwise("parameter").alias("kind"), "params")
    first = F.struct((-F.col("confidence")).alias("rank"), "kind", "params")
    return found.groupBy("source_file", "element_name", "caller", "callee").agg(F.min(first).alias("x")).select(
        "source_file", "element_name", "caller", "callee", (-F.col("x.rank")).alias("confidence"), "x.kind", F.when(F.col("x.kind") == "parameter", F.col("x.params")).alias("params"), F.lit("DOM-OWN-001").alias("rule_id")
    )
