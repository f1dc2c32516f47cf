"""What the inventory says of each function: where to look first, a window around it, what is wrong, what to do and a sketch.

The texts are a table by status, language family and loop that functions join; they are words of our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.functions import text
from siftgraph.operators import inventory, remedies

GUIDES = "status string, lotus boolean, in_loop boolean, rule_id string, problem string, guide string, warning string"
#: Variables that a text names, and lines up to which a function is shown whole.
NAMED, WHOLE = 8, 100
# Statuses of functions that release something, and what a release looks like, in the order in which they are looked for.
RELEASING = ("PROTECTED", "PARTIAL", "CONDITIONAL")
RELEASES = [r"(?i)\bDelete\s+\w+", r"(?i)\b(?:Call\s+)?\w+\.Recycle\s*\(", r"(?i)\.recycle\s*\("]

#: By status and loop (None: either): the rule whose remedy fits, and the texts. {f}: the function, {v}: its variables, {r}: how the language releases, {w}: where.
TEXTS = [
    ("UNPROTECTED", True, "DOM-002", "{f} takes handles in a loop and never calls {r}, so each turn leaves one open.{v}", "Fetch the next item first, then call {r} on the current one {w} in every turn.", "Critical: a long loop uses up all handles."),
    ("UNPROTECTED", False, "DOM-010", "{f} takes handles once and never calls {r}.{v}", "Call {r} {w} after the last use.", "Not in a loop: tidy it up, but nothing runs out soon."),
    ("PARTIAL", None, "DOM-010", "{f} releases some of its handles, but not all.{v}", "Pair each variable that takes a handle with its own {r} {w}.", "Some {r} is there, but for other names."),
    ("CONDITIONAL", None, "DOM-012", "{f} calls {r} only within conditions.{v}", "Move {r} out of the condition, {w}.", "Where the condition doesn't hold, handles stay open."),
    ("ESCAPE_PATH_GAP", None, "DOM-010", "{f} can be left after it took a handle and before {r}.{v}", "Call {r} before each way out, or {w}.", "An early exit leaves handles open."),
    ("PROTECTED", None, "DOM-002", "{f} takes handles and calls {r} for them.{v}", "Keep {r} on every way out.", "Check that errors and early exits come to it, too."),
    ("SAFE", None, None, "{f} takes no handles.{v}", "Nothing has to be released.", "Look again if it is handed open handles."),
]


def focus(body: Column, status: Column, lotus: Column) -> Column:
    """The 0-based place to look at first: of a function that releases something the first release, by the kinds' order, else where it takes a handle; 0 if there is none."""
    first = lambda p: F.nullif(F.regexp_instr(body, F.lit(p)), F.lit(0)) - 1
    released = F.when(status.isin(*RELEASING), F.coalesce(*(first(p) for p in RELEASES)))
    taken = F.when(lotus, F.coalesce(first(inventory._SET), first(inventory._NEW), first(inventory._ANY))).otherwise(F.coalesce(first(inventory._CALL), first(inventory._ANY)))
    return F.coalesce(released, F.when(status != "ESCAPE_PATH_GAP", taken), F.lit(0))


def _dimension() -> list[tuple]:
    out = []
    for status, loop, rule, *texts in TEXTS:
        for lotus in (False, True):
            say = lambda t: t.replace("{r}", "Delete" if lotus else "recycle()").replace("{w}", "before the exit" if lotus else "in a finally block")  # noqa: B023, E731
            out += [(status, lotus, k, rule, *map(say, texts)) for k in ((loop,) if loop is not None else (False, True))]
    return out


def with_guides(functions_: DataFrame) -> DataFrame:
    """Function records (name, function_body, line, language, status, in_loop, allocated, unclean, ...) with focus_line, window, problem, guide, warning, topic, advice and sketch.

    A function of up to WHOLE lines is shown whole; of a longer one the lines around its focus, grown around releases. A status that the table doesn't know
    has no texts; a null name, body or array counts as empty. The table has a fixed number of rows and is broadcast; no function meets another.
    """
    spark, own = functions_.sparkSession, functions_.columns
    body, lotus = F.coalesce("function_body", F.lit("")), F.coalesce(F.lower("language").isin(*inventory.LOTUS), F.lit(False))
    base = F.coalesce("line", F.lit(1))
    rows = functions_.withColumns({"by_lotus_": lotus, "loop_": F.coalesce("in_loop", F.lit(False)), "lines_": text.lines_of(body), "focus_line": text.line_of(body, focus(body, F.col("status"), lotus), base)})
    whole = F.size("lines_") <= WHOLE
    window = F.when(whole, text.grown_window(F.col("lines_"), F.col("focus_line"), base, WHOLE, WHOLE, WHOLE)).otherwise(text.grown_window(F.col("lines_"), F.col("focus_line"), base, 20, 50, 120))
    none = F.array().cast("array<string>")
    unclean, allocated = F.coalesce("unclean", none), F.coalesce("allocated", none)
    named = F.when(F.size(unclean) > 0, unclean).otherwise(F.when(F.col("status") == "PARTIAL", none).otherwise(allocated))
    said = F.when(F.size(named) > 0, F.concat(F.lit(" Handles: "), F.array_join(F.slice(named, 1, NAMED), ", "), F.lit("."))).otherwise("")
    table = spark.createDataFrame(_dimension(), GUIDES).withColumnsRenamed({"status": "status_", "lotus": "of_lotus_", "in_loop": "of_loop_"})
    met = rows.join(F.broadcast(table), (F.col("status") == F.col("status_")) & (F.col("by_lotus_") == F.col("of_lotus_")) & (F.col("loop_") == F.col("of_loop_")), "left")
    met = met.withColumns({
        "window": window, "problem": F.replace(F.replace(F.col("problem"), F.lit("{v}"), said), F.lit("{f}"), F.coalesce("name", F.lit(""))),
        "variable": F.get(named, 0), "evidence": F.lit(None).cast("string"),
    })
    return remedies.with_remedies(met).select(*own, "focus_line", "window", "problem", "guide", "warning", "topic", "advice", "sketch")
