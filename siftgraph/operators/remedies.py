"""What to do about a finding: advice by rule, language and loop as a small table that findings join, and a sketch that uses the finding's own variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgraph.functions.text import LOTUS

REMEDIES = "rule_id string, topic string, advice string"
SKETCHES = "topic string, lotus boolean, in_loop boolean, sketch string"

#: What each rule's findings are about, and the advice on it.
ADVICE = [
    ("DOM-001", "chain", "Give each call of the chain its own variable, so that every handle can be released."),
    ("DOM-002", "walk", "Fetch the next item before the current one is released, and release the current one in every turn."),
    ("DOM-003", "lifetime", "Release the handle in a finally block, so that errors don't leak it."),
    ("DOM-004", "wrapper", "Leave the release of wrapper objects to the wrapper; release only what was unwrapped."),
    ("DOM-005", "wrapper", "Convert between wrapper and raw types explicitly at the border between the two."),
    ("DOM-006", "shared", "Keep no handle in a static field; keep its id and open it where it is used."),
    ("DOM-007", "shared", "Put ids or plain values in scopes and maps, not handles."),
    ("DOM-008", "walk", "Read column values once in each turn and release what they bring."),
    ("DOM-009", "walk", "Create the date once before the loop, or release it in every turn."),
    ("DOM-010", "lifetime", "Release what is created in a finally block."),
    ("DOM-011", "order", "Use all children before their parent is released."),
    ("DOM-012", "walk", "Release in every turn; only a test for null may stand before it."),
    ("DOM-013", "walk", "Keep the next item apart, release the current one, then go on."),
    ("DOM-014", "lifetime", "Release items and parts of messages after their last use."),
    ("DOM-015", "lifetime", "Release navigators and entry collections after the walk."),
    ("DOM-016", "walk", "Search once before the loop, or release each result within it."),
    ("DOM-017", "lifetime", "Release embedded objects after their content is read."),
    ("DOM-018", "walk", "Release the document of each entry before the next one is fetched."),
    ("DOM-019", "lifetime", "Release the collection after the walk."),
    ("DOM-020", "owned", "Don't release the session or the current database; the platform does."),
    ("DOM-021", "lifetime", "Close and release streams in a finally block."),
    ("DOM-022", "lifetime", "Release the collection as well as its children."),
    ("DOM-023", "shared", "Keep no handles in beans; open them in the method that uses them."),
    ("DOM-024", "owned", "Don't release what the platform provides."),
    ("DOM-025", "wrapper", "In loops over wrapper objects, unwrap first or leave the release to the wrapper."),
    ("PERF-001", "view", "Switch the view's automatic update off while its documents change."),
    ("PERF-002", "view", "Open the view once before the loop."),
    ("PERF-003", "save", "Collect changes and save each document once, after all are made."),
    ("PERF-004", "view", "Walk with first and next instead of by position."),
    ("SEC-001", "secret", "Move the secret to a protected store and speak over an encrypted connection."),
    ("SEC-002", "input", "Check who asks and what they may see before a document is looked up by a value from outside."),
    ("FORM-001", "lookup", "Look up once into a hidden field and reuse its value."),
    ("FORM-002", "lookup", "Move the lookup out of the formula's loop."),
    ("FORM-003", "secret", "Keep secrets and plain addresses out of formulas."),
    ("FORM-004", "summary", "Mark large items as not part of the summary."),
    ("EXT-001", "close", "Open the connection in a try block that closes it."),
    ("EXT-002", "close", "Close the response and its client in a finally block."),
    ("LS-EXT-001", "close", "End the bridge session on every way out."),
    ("LS-EXT-002", "close", "Disconnect on every way out, also in the error handler."),
    ("DOM-OWN-001", "owned_by", "Agree on one owner of the handle, and let that side release it."),
    ("DOM-BS-001", "lifetime", "Have the place read by a person; the passes disagree."),
    ("DOM-BS-002", "lifetime", "Have the place read by a person; the passes disagree."),
]

#: Code for a topic, a language family and a loop; {v} is the finding's variable. What isn't listed has no sketch.
CODE = [
    ("walk", False, True, "while ({v} != null) {\n  var next = list.getNextDocument({v});\n  try { use({v}); } finally { {v}.recycle(); }\n  {v} = next;\n}"),
    ("walk", True, True, "Do Until {v} Is Nothing\n  Set next = list.GetNextDocument({v})\n  Call use({v})\n  Delete {v}\n  Set {v} = next\nLoop"),
    ("walk", False, False, "try { use({v}); } finally { if ({v} != null) {v}.recycle(); }"),
    ("walk", True, False, "Call use({v})\nDelete {v}"),
    ("lifetime", False, True, "// in each turn\ntry { use({v}); } finally { if ({v} != null) {v}.recycle(); }"),
    ("lifetime", False, False, "try { use({v}); } finally { if ({v} != null) {v}.recycle(); }"),
    ("lifetime", True, True, "' in each turn\nCall use({v})\nDelete {v}"),
    ("lifetime", True, False, "On Error Goto leave\nCall use({v})\nleave:\nDelete {v}"),
    ("chain", False, False, "var {v} = db.getView(name);\nvar found = {v}.getDocumentByKey(key);\ntry { use(found); } finally { found.recycle(); {v}.recycle(); }"),
    ("order", False, False, "use({v});\n{v}.recycle();\nparent.recycle();"),
    ("view", False, True, "var {v} = db.getView(name);  // before the loop\n{v}.setAutoUpdate(false);"),
    ("view", True, True, "Set {v} = db.GetView(name) ' before the loop\n{v}.AutoUpdate = False"),
    ("close", False, False, "try (var {v} = open()) { use({v}); }"),
    ("close", True, False, "On Error Goto leave\nCall use({v})\nleave:\nCall {v}.Disconnect()"),
]


def variable_of(evidence: Column) -> Column:
    """The first variable that the evidence assigns to or releases; null if there is none."""
    found = F.coalesce(F.nullif(F.regexp_extract(evidence, r"\b([A-Za-z_]\w*)\s*=(?!=)", 1), F.lit("")), F.nullif(F.regexp_extract(evidence, r"(?i)\b([A-Za-z_]\w*)\s*\.\s*recycle\b", 1), F.lit("")))
    return found


def with_remedies(findings: DataFrame) -> DataFrame:
    """findings (rule_id, language, in_loop, variable, evidence, ...) with topic, advice and sketch; null where a rule has none.

    The sketch for a loop serves where in_loop holds, else the other one, and whichever exists if the topic has only one for the language. The tables
    have a fixed number of rows, so they are broadcast. A null language or in_loop counts as another language and as no loop.
    """
    spark = findings.sparkSession
    advice = spark.createDataFrame(ADVICE, REMEDIES)
    by_place = spark.createDataFrame(CODE, SKETCHES).groupBy("topic", "lotus").pivot("in_loop", [True, False]).agg(F.first("sketch"))
    known = advice.join(by_place, "topic", "left").groupBy("rule_id", "topic", "advice").agg(
        *(F.max(F.when(F.col("lotus") == on, F.struct(F.col("true").alias("loop"), F.col("false").alias("plain")))).alias(name) for name, on in (("lotus_", True), ("other_", False))),
    )
    met = findings.join(F.broadcast(known), "rule_id", "left")
    lotus = F.coalesce(F.lower("language").isin(*LOTUS), F.lit(False))
    code = F.when(lotus, F.col("lotus_")).otherwise(F.col("other_"))
    sketch = F.when(F.coalesce("in_loop", F.lit(False)), F.coalesce(code["loop"], code["plain"])).otherwise(F.coalesce(code["plain"], code["loop"]))
    named = F.coalesce(F.nullif(F.col("variable"), F.lit("")), variable_of(F.col("evidence")), F.lit("handle"))
    return met.withColumn("sketch", F.replace(sketch, F.lit("{v}"), named)).drop("lotus_", "other_")
