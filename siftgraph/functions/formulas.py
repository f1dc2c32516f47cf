"""Formulas in plain words: what a formula does, in sentences that depend on its role, and what a field's formulas do together.

A formula's sentences are an array of clauses, each there if its sign occurs; repeated ones go, and some count only where nothing before them does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs in formulas, words that stay capital, prefixes of names, and the sentences that they give.
FAILURE = r'(?i)@Failure\s*\(\s*"((?:\\.|[^"\\])*+)"'
ROLE = r'\["([^"]+)"\]|"(\[[^\]]+\])"'
SERVER, DATABASE, DIRECTORY, USER_ROLES, NEW = r"(?i)@Subset\s*\(\s*@DbName\s*;\s*1\s*\)", r"(?i)@DbName", r"(?i)@NameLookup", r"(?i)@UserRoles", r"(?i)@IsNewDoc"
SAVED, YEAR, MONTH_OR_DAY, PACKED, IF = r"(?i)@IsDocBeingSaved", r"(?i)@Year\s*\(", r"(?i)@(?:Month|Day)\s*\(", r"(?i)jba|century|@Right\s*\(", r"(?i)@If\s*\("
COMMAND, ROUTINE, QUOTED, NAME = r"(?i)@Command\s*\(\s*\[([^\]]+)\]", r"(?i)\bsub\s+\w+", r'"([^"]{1,80})"', r"^[A-Za-z_][A-Za-z0-9_]*$"
PREFIX, CAMEL, CAPITAL = r"(?i)^(h|tmp|temp|fld|fld_|f_|v_|c_|w_|web)(?=[A-Z_])", r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", ("OH", "OD", "JBA", "ERP", "ADA", "ZIP", "ID", "SKU", "CC")
KINDS = [
    ("computedfordisplay", "display-only calculated field"), ("computedwhencomposed", "set once when the document is created"), ("computed", "system-calculated field"), ("editable", "user-editable field"),
]
SAYS_SERVER, SAYS_DATABASE = "Captures the current Domino server name from the open database.", "Reads the current database identity (@DbName)."
SAYS_DIRECTORY = "Looks up the current user’s directory profile (for example employee ID)."
SAYS_ROLES, SAYS_NEW = "Checks the current user’s Domino roles before applying the rule.", "Behaves differently for new documents vs existing ones."
SAYS_LOOKUP, SAYS_ROUTINE = "Retrieves related information from another Domino view or database.", "Runs a LotusScript routine (custom server/client procedure)."
SAYS_DIALOG = "Shows the user a dialog message."
MOST_MESSAGES, MOST_LOOKUPS, MOST_EXCERPT = 3, 2, 100


def _there(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")).isNotNull(), F.lit(False))


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def label(name: Column) -> Column:
    """A field's name in words: without its prefix, cut at capitals and underscores, each word capitalised. Nothing gives Field."""
    raw = F.regexp_replace(name, r"^\s+|\s+$", "")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, PREFIX, ""), "[_-]", " "), CAMEL, " ")
    spaced = F.regexp_replace(F.regexp_replace(cut, r"\s+", " "), r"^ | $", "")
    rest = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    word = lambda w: F.when(F.upper(w).isin(*CAPITAL) | (F.length(w) <= 2) & F.rlike(w, F.lit(r"^\p{L}+$")), F.upper(w)).when(F.length(w) <= 2, w).otherwise(rest(w))
    words = F.array_join(F.transform(F.split(F.when(spaced == "", raw).otherwise(spaced), " "), word), " ")
    return F.when(F.coalesce(name, F.lit("")) == "", "Field").otherwise(words)


def _lookups(lookups: Column) -> Column:
    """A sentence for each lookup (function, target_view, target_database, lookup_key, return_field)."""
    part = lambda before, c: F.when(F.coalesce(c, F.lit("")) != "", _say(before, c, "”")).otherwise("")
    either = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    said = lambda x: _say(
        "Looks up data via ", either(x["function"], "lookup"), " in view “", either(x["target_view"], "a view"), "”", part(" in database “", x["target_database"]), part(" using key “", x["lookup_key"]), part(" returning “", x["return_field"]), ".",
    )
    return F.transform(lookups, said)


def describe(body: Column, role: str = "logic", name: Column | None = None, kind: Column | None = None, lookups: Column | None = None) -> Column:
    """What a formula does, as default, validation, translation, hidewhen or logic of a field; nothing for a blank one."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    low, given = F.lower(text), F.lower(F.coalesce(name if name is not None else F.lit(""), F.lit("")))
    field = F.lower(label(name) if name is not None else F.lit("This field"))
    field = F.when(given == "", "this field").otherwise(field)
    has = lambda p: F.rlike(text, F.lit(p))
    clauses: list[Column] = []
    none_yet = lambda: reduce(lambda a, b: a & b, [c.isNull() for c in clauses])

    messages = F.transform(F.regexp_extract_all(text, F.lit(FAILURE), F.lit(1)), lambda m: _say("“", F.replace(m, F.lit('\\"'), F.lit('"')), "”"))
    when = F.when(has(SAVED), "when the document is saved").otherwise("on input")
    blocks = _say("Blocks save ", when, " unless the rule passes: ", F.array_join(F.slice(messages, 1, MOST_MESSAGES), "; "), ".")
    clauses.append(F.when(F.size(messages) > 0, blocks).when(F.lit(role == "validation"), _say("Validates ", field, " ", when, ".")))
    if role in ("default", "logic"):
        computed = F.contains(F.lower(F.coalesce(kind if kind is not None else F.lit(""), F.lit(""))), F.lit("computed"))
        copied = F.when(computed, _say("Computed by copying the value from “", label(text), "”.")).otherwise(_say("Defaults to the value of “", label(text), "”."))
        clauses.append(F.when(has(NAME), copied))
    # One pass finds both forms of a role: the second group counts where the first is empty.
    both = F.zip_with(F.regexp_extract_all(text, F.lit(ROLE), F.lit(1)), F.regexp_extract_all(text, F.lit(ROLE), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b))
    roles = F.array_join(F.array_distinct(both), ", ")
    author, reader = F.contains(given, F.lit("author")), F.contains(given, F.lit("reader"))
    granted = F.when(author, _say("Grants document edit rights to: ", roles, ".")).when(reader, _say("Restricts document read access to: ", roles, ".")).otherwise(_say("Uses Domino roles: ", roles, "."))
    clauses.append(F.when((F.size(both) > 0) & (author | reader | F.contains(text, F.lit(":"))), granted))
    clauses.append(F.when(has(SERVER), SAYS_SERVER).when(has(DATABASE), SAYS_DATABASE))
    clauses += [F.when(has(p), said) for p, said in ((DIRECTORY, SAYS_DIRECTORY), (USER_ROLES, SAYS_ROLES), (NEW, SAYS_NEW))]
    packed = _say("Builds a system/ERP-friendly date string for ", field, " (year, month, and day packed into a coded format).")
    clauses.append(F.when(has(YEAR) & has(MONTH_OR_DAY), F.when(has(PACKED), packed).otherwise(_say("Derives a formatted date value for ", field, "."))))
    retrieved = F.when(has(r"(?i)@DbLookup|@DbColumn"), SAYS_LOOKUP)
    if lookups is None:
        clauses.append(retrieved)
    else:
        some = F.coalesce(F.size(lookups) > 0, F.lit(False))
        said = _lookups(lookups)
        clauses += [F.when(some, F.get(said, 0)).otherwise(retrieved), *(F.when(some, F.get(said, k)) for k in range(1, MOST_LOOKUPS))]
    if role == "hidewhen":
        clauses.append(F.when(has(IF) | F.contains(low, F.lit("@is")), _say("Hides ", field, " based on document or field conditions.")).when(none_yet(), _say("Conditionally hides ", field, " on the form.")))
    if role == "translation":
        clauses.append(F.when(none_yet(), _say("Normalizes or reformats ", field, " as the user leaves the field.")))
    clauses.append(F.when(has(COMMAND), _say("Runs the Domino command [", F.regexp_extract(text, COMMAND, 1), "].")))
    clauses.append(F.when(F.startswith(low, F.lit("sub ")) | F.rlike(F.substring(text, 1, 80), F.lit(ROUTINE)), SAYS_ROUTINE))
    shown = F.when(has(QUOTED), _say("Shows the user a message: “", F.regexp_extract(text, QUOTED, 1), "”.")).otherwise(SAYS_DIALOG)
    clauses.append(F.when(has(r"(?i)messagebox|msgbox"), shown))
    clauses.append(F.when(has(IF) & none_yet(), _say("Applies conditional business logic to set ", field, ".")))

    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("'")))
    first = F.coalesce(F.get(lines, 0), F.replace(text, F.lit("\n"), F.lit(" ")))
    excerpt = F.when(F.length(first) > MOST_EXCERPT, _say(F.substring(first, 1, MOST_EXCERPT - 3), "…")).otherwise(first)
    plain = _say("Sets the default/computed value for ", field, " using formula logic.") if role == "default" else _say("Business logic on ", field, ": ", excerpt)
    said = F.array_join(F.array_distinct(F.array_compact(F.array(*clauses))), " ")
    return F.when(text == "", "").when(none_yet(), plain).otherwise(said)


def describe_field(
    name: Column, data_type: Column, kind: Column, default: Column, validation: Column, translation: Column, hide_when: Column, messages: Column | None = None, lookups: Column | None = None
) -> Column:
    """struct<label,business_summary,default_summary,validation_summary,translation_summary,hide_summary,lookup_summary> of a field's formulas.

    messages: what a failing check says, for a field whose validation formula isn't there; lookups: array of structs of lookups of its formulas.
    """
    given = lookups if lookups is not None else F.expr("cast(array() as array<struct<function:string,target_view:string,target_database:string,lookup_key:string,return_field:string>>)")
    first = describe(default, "default", name, kind, given)
    checked = describe(validation, "validation", name, kind)
    if messages is not None:
        quoted = F.transform(F.slice(messages, 1, MOST_MESSAGES), lambda m: _say("“", m, "”"))
        checked = F.when((checked == "") & (F.size(messages) > 0), _say("Blocks save unless the rule passes: ", F.array_join(quoted, "; "), ".")).otherwise(checked)
    tidied, hidden = describe(translation, "translation", name, kind), describe(hide_when, "hidewhen", name, kind)
    looked = F.coalesce(F.array_join(F.slice(_lookups(given), 1, MOST_LOOKUPS + 1), " "), F.lit(""))
    low = F.lower(F.coalesce(kind, F.lit("")))
    of_kind = reduce(lambda c, x: c.when(F.contains(low, F.lit(x[0])), x[1]), KINDS[1:], F.when(F.contains(low, F.lit(KINDS[0][0])), KINDS[0][1])).otherwise("form field")
    of_type = F.when((F.coalesce(data_type, F.lit("")) != "") & (data_type != "unknown"), F.concat(data_type, F.lit(" "))).otherwise("")
    overview = F.replace(_say(label(name), " is a ", of_type, of_kind, "."), F.lit("  "), F.lit(" "))
    pieces = F.array_distinct(F.filter(F.array(overview, first, checked, hidden, looked), lambda x: x != ""))
    return F.struct(
        label(name).alias("label"), F.array_join(pieces, " ").alias("business_summary"), first.alias("default_summary"), checked.alias("validation_summary"), tidied.alias("translation_summary"), hidden.alias("hide_summary"), looked.alias("lookup_summary")
    )
