"""The function inventory: functions of code units, what they allocate and release, and their status.

Only cutting a body into functions needs a scan with a state (balanced braces); it gives (name, body) rows.
Everything else is expressions over those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgraph.functions import classify, text
from siftgraph.operators.rules import ANY_LOOP
from siftgraph.sources.arrow import arrow_schema

# Methods that allocate a handle (case as given or with a capital first letter), and handle types.
ALLOCATING = [
    "getDocumentByUNID", "getFirstDocument", "getNextDocument", "getNthDocument", "getNthEntry", "getEntryByKey", "getNextEntry", "getAllDocumentsByKey",
    "getDocumentByKey", "createDocument", "getView", "getDatabase", "createDateTime", "createViewNav", "createViewNavFrom", "getAllEntriesByKey",
    "FTSearch", "search", "createItem", "createMIMEEntity", "createRichTextItem", "createStream", "createName", "createHTTPRequest",
    "getItem", "getFirstItem", "getMIMEEntity", "getEmbeddedObject", "getObjects", "getAllUnreadDocuments",
]
HANDLE_TYPES = ["NotesDocument", "NotesView", "NotesDatabase", "DocumentCollection", "ViewEntryCollection", "ViewNavigator", "MIMEEntity", "RichTextItem"]
LOTUS = ("lotusscript", "ls", "lss", "notes")

_METHODS = "|".join(ALLOCATING)
_CALL = rf"(?i)\b([A-Za-z_]\w*)\s*=\s*(?:[A-Za-z_]\w*\s*\.\s*)?(?:{_METHODS})\s*\("
_SET = rf"(?i)\bSet\s+([A-Za-z_]\w*)\s*=\s*.*?\b(?:{_METHODS})\s*\("
_NEW = r"(?i)\bSet\s+([A-Za-z_]\w*)\s*=\s*(?:New\s+)?Notes\w+\b"
_ANY = rf"(?i)\b(?:{_METHODS})\s*\(|\blotus\.domino\.\w+\b|\b(?:{'|'.join(HANDLE_TYPES)})\b"
_RECYCLE, _DELETE, _BULK = r"(?i)\b([A-Za-z_]\w*)\s*\.\s*recycle\s*\(", r"(?i)\bDelete\s+([A-Za-z_]\w*)\b", r"(?i)\brecycleLotuses\s*\("
# What counts as one cleanup, in this order, of the script language and of the others.
CLEANUPS_LOTUS = [r"(?i)\b(?:Call\s+)?([A-Za-z_]\w*)\s*\.\s*Recycle\s*\(", r"(?i)\bDelete\s+([A-Za-z_]\w*)\b"]
CLEANUPS = [r"(?i)\bCall\s+\w+\.recycle\s*\([^)]*\)", r"(?i)\.\s*recycle\s*\([^)]*\)", r"(?i)\bDelete\s+([A-Za-z_]\w*)\b", r"(?i)\brecycleLotuses\s*\("]
_TRANSFER = r"(?im)\breturn\s+([A-Za-z_]\w*)\s*;?|^\s*Set\s+[A-Za-z_]\w*\s*=\s*([A-Za-z_]\w*)\s*$"
_CONDITIONAL = r"(?is)\bif\b(?![^{;]{0,80}(?:null|undefined|Nothing))[^{;\n]{0,120}(?:\{|\bThen\b)(?:(?!\}|\bEnd\s+If\b).){0,200}?(?:\.\s*recycle\s*\(|\bDelete\s+\w)"
_FINALLY = r"(?i)\bfinally\b"
_RETURN, _EXIT = r"(?i)\breturn\b|\bthrow\b", r"(?i)\bExit\s+(?:Sub|Function)\b|\bGoTo\s+\w+|\bEnd\b\s*$"

_LOTUS_FUNCTION = re.compile(r"^\s*(?:Public\s+|Private\s+|Static\s+)*(Sub|Function)\s+(\w+)[^\n]*\n(.*?)^\s*End\s+\1\b", re.I | re.M | re.S)
#: What a scan of the brace languages meets: texts and comments, which hide all else, the three ways to begin a function, and braces.
_SCAN = re.compile(
    r"(?P<hidden>\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|//[^\n]*|/\*.*?(?:\*/|$))|\bfunction\s+(?P<named>\w+)\s*\([^)]*\)\s*\{|\b(?P<member>\w+)\s*:\s*function\s*\([^)]*\)\s*\{"
    r"|\b(?:public|private|protected|static)\s+[\w<>\[\], .]*?(?P<method>\w+)\s*\([^)]*\)\s*(?:throws\s+[\w, .]+)?\{|(?P<open>\{)|(?P<close>\})", re.S,
)
_HEADS, _WITH_METHODS = ("named", "member", "method"), ("java", "xpages", "source", "script")


def n_cleanups(body: Column, language: Column) -> Column:
    """How many cleanups a body states: matches that overlap one taken before don't count again."""
    count = lambda patterns: F.size(text.disjoint_spans(body, patterns))
    return F.when(F.lower(language).isin(*LOTUS), count(CLEANUPS_LOTUS)).otherwise(count(CLEANUPS))


def functions_of(body: str, language: str, event: str | None) -> list[tuple[str, str, int]]:
    """(name, inner body, offset) of a unit's functions; without any, an event's whole body is one.

    Of functions within each other one counts: of the kind that comes first in _HEADS, else the outer one.
    """
    if language in LOTUS:
        out = [(m[2], m[3], m.start()) for m in _LOTUS_FUNCTION.finditer(body)]
        return out or ([(event, body, 0)] if event else [])
    met: list[list] = []  # kind, start, name, where the inner body begins and ends, the function around it
    open_: list[int | None] = []  # the function that each open brace begins, if it begins one
    inner: int | None = None
    for m in _SCAN.finditer(body):
        kind = m.lastgroup
        if kind == "close":
            if open_ and (done := open_.pop()) is not None:
                met[done][4], inner = m.start(), met[done][5]
        elif kind != "hidden":
            begins = kind in _HEADS and (kind != "method" or language in _WITH_METHODS)
            open_.append(len(met) if begins else None)
            if begins:
                met.append([_HEADS.index(kind), m.start(), m[kind], m.end(), len(body), inner])
                inner = len(met) - 1
    counts: set[int] = set()
    holds: set[int] = set()  # functions around one that counts
    for k in sorted(range(len(met)), key=lambda k: met[k][:2]):
        around, at = [], met[k][5]
        while at is not None:
            around.append(at)
            at = met[at][5]
        if k not in holds and counts.isdisjoint(around):
            counts.add(k)
            holds.update(around)
    out = [(met[k][2], body[met[k][3] : met[k][4]], met[k][1]) for k in sorted(counts)]
    return out or ([(event, body, 0)] if event else [])


#: Characters of the longest head.
LONGEST_HEAD = 4096


def head(body: str, at: int, inner: str, language: str) -> str:
    """What stands before a function's inner body: modifiers and type, name and parameters; nothing where a whole unit counts as one."""
    return "" if inner is body else body[at : at + LONGEST_HEAD].lstrip().split("\n" if language in LOTUS else "{", 1)[0].strip()


def functions(units: DataFrame) -> DataFrame:
    """Units' columns but the body, with name, function_body, line, pos and signature of each function."""
    added = T.StructType([T.StructField("name", T.StringType()), T.StructField("function_body", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("function_pos", T.IntegerType()), T.StructField("signature", T.StringType())])
    kept = [c for c in units.columns if c not in ("body", *added.names)]
    schema = T.StructType([units.schema[c] for c in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = functions_of(row["body"] or "", (row["language"] or "").lower(), row["event"])
                rows += [{**{c: row[c] for c in kept}, "name": n, "function_body": b, "line": (row["start_line"] or 1) + row["body"].count("\n", 0, at), "function_pos": k, "signature": head(row["body"], at, b, (row["language"] or "").lower())} for k, (n, b, at) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, arrow_schema(schema))

    return units.mapInArrow(run, schema)


def _all(body: Column, pattern: str, group: int = 1) -> Column:
    return F.filter(F.regexp_extract_all(body, F.lit(pattern), F.lit(group)), lambda x: x != "")


def analysed(functions_: DataFrame) -> DataFrame:
    """Functions with allocated, cleaned and unclean variables, allocates, n_cleanups, in_loop, status, severity."""
    body = F.col("function_body")
    lotus = F.lower("language").isin(*LOTUS)
    names = lambda *arrays: F.array_sort(F.array_distinct(F.concat(*arrays)))
    out = functions_.withColumns({
        "allocated": F.when(lotus, names(_all(body, _SET), _all(body, _NEW))).otherwise(names(_all(body, _CALL))),
        "cleaned": names(_all(body, _RECYCLE), _all(body, _DELETE)),
        "transferred": names(_all(body, _TRANSFER, 1), _all(body, _TRANSFER, 2)),
        "n_cleanups": n_cleanups(body, F.col("language")),
        "in_loop": body.rlike(ANY_LOOP), "has_finally": body.rlike(_FINALLY),
    })
    first = lambda p: F.when(body.rlike(p), F.regexp_instr(body, F.lit(p)))
    exits = F.when(lotus, text.matches(body, _EXIT)).otherwise(text.matches(body, _RETURN))
    out = out.withColumns({"take_": first(_ANY), "clean_": F.least(first(_RECYCLE), first(_DELETE), first(_BULK))})
    early = F.exists(exits, lambda m: (m["start"] + 1 > F.col("take_")) & (F.col("clean_").isNull() | (F.col("clean_") > m["start"] + 1)))  # at any exit, what came before it
    gap = F.coalesce(early, F.lit(False)) & (lotus | ~F.col("has_finally"))
    out = out.withColumns({"allocates": (F.size("allocated") > 0) | body.rlike(_ANY), "gap": gap})
    status = classify.cleanup_status(F.col("allocated"), F.col("cleaned"), F.col("transferred"), F.col("allocates"), F.col("n_cleanups"), body.rlike(_CONDITIONAL), F.col("has_finally"), F.col("gap"))
    wrapped = body.rlike(r"org\.openntf\.domino") & ~body.rlike(r"\blotus\.domino\b|(?i)\.recycle\s*\(")
    status = F.when(wrapped & status.isin("UNPROTECTED", "PARTIAL", "CONDITIONAL"), "PROTECTED").otherwise(status)
    out = out.withColumns({"unclean": F.array_except("allocated", "cleaned"), "status": status})
    return out.withColumns({"severity": classify.inventory_severity(F.col("status"), F.col("in_loop"), F.lower("language") == "csjs"), "is_false_positive": F.lit(False)}).drop("gap", "has_finally", "take_", "clean_")


def inventory(units: DataFrame) -> DataFrame:
    """Function records of the units whose languages bear handles."""
    return analysed(functions(units.filter(~F.lower(F.coalesce("language", F.lit(""))).isin(*LOTUS, "formula", ""))))
