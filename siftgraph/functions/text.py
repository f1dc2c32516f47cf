"""Text functions: positions, snippets and labels as expressions; scans that need a state as Arrow-batched functions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_of(body: Column, offset: Column, base: Column | int = 1) -> Column:
    """The line of a 0-based offset."""
    before = F.substring(body, F.lit(1), offset)
    return (F.lit(base) if isinstance(base, int) else base) + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def evidence(body: Column, offset: Column, radius: int = 120, most: int = 400) -> Column:
    """From 40 before the 0-based offset to radius after it, trimmed, cut with dots."""
    start = F.greatest(F.lit(0), offset - 40)
    cut = F.trim(F.substring(body, start + 1, offset + radius - start))
    return F.when(F.length(cut) > most, F.concat(F.substring(cut, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(cut)


def within_range(body: Column, start: Column, end: Column) -> Column:
    """The text between two 0-based places, cut to the text's own bounds."""
    low = F.greatest(F.lit(0), start)
    return F.substring(body, low + 1, F.greatest(F.lit(0), end - low))


def line_window(body: Column, line: Column, before: int = 2, after: int = 2) -> Column:
    """array<struct<line,text,highlight>> of the lines around a 1-based line."""
    lines = F.split(body, "\n", -1)
    first = F.greatest(F.lit(1), line - before)
    part = F.slice(lines, first, line + after - first + 1)
    return F.transform(part, lambda t, k: F.struct((first + k).cast("int").alias("line"), t.alias("text"), (first + k == line).alias("highlight")))


# What counts as a cleanup near a finding, on a line that is shown as one, and as the start of a guarded block.
CLEANUP_NEAR, CLEANUP_LINE = r"(?i)\bfinally\b|\.recycle\s*\(|\brecycle\s*\(|\bDelete\b", r"(?i)(?:\.\s*recycle\s*\(|\brecycle\s*\(|\bDelete\s+[A-Za-z_]\w*|\bCall\s+\w+\.Recycle\s*\()"
TRY = r"(?i)\btry\s*\{"


LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(body: Column) -> Column:
    """array<string>: the lines of a text; an end of line at its end begins no further one, and an empty text has one line."""
    return F.split(F.regexp_replace(F.coalesce(body, F.lit("")), rf"(?:{LINE_END})\z", ""), LINE_END, -1)


def flat_lines(body: Column) -> Column:
    """The lines of a text as `lines_of` has them, with a line feed between them."""
    body = F.coalesce(body, F.lit(""))
    flat = F.when(F.rlike(body, F.lit(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")), F.regexp_replace(body, LINE_END, "\n")).otherwise(body)
    return let(flat, lambda t: F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t))


def _feeds(body: Column) -> Column:
    return F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))


def _some_lines(body: Column, first: Column, end: Column) -> Column:
    """The lines of a text with line feeds from place first to before end, as a text."""
    of = lambda t, n: F.call_function("substring_index", t, F.lit("\n"), n)
    return of(of(body, end), first - end)


def grown_window(lines: Column, focus: Column, base: Column, before: int = 15, after: int = 45, most: int = 100) -> Column:
    """struct<first,last,lines,snippet>: the lines around a line of a unit whose first line is base, grown so that they show how handles are released.

    From before lines above to after below, then to every line with a cleanup within most lines, and up to the try that opens last above; no more than
    most lines in all, with the end kept rather than the beginning. lines: array<struct<line,text,highlight,kind>>, kind problem, cleanup or null.
    Only the lines within reach are looked at, so the work for a finding doesn't grow with its unit.
    """
    reach = _reach(F.size(lines), lambda low, high: F.array_join(F.slice(lines, low + 1, high - low), "\n"), focus, base, before, after, most)
    return let(reach, lambda w: let(window_lines(w), lambda rows: window_of(rows)))


def window_reach(flat: Column, focus: Column, base: Column, before: int = 15, after: int = 45, most: int = 100) -> Column:
    """struct<first,hit,text>: which lines of a unit (`flat_lines`) a grown window shows, by number of its first line and of the finding's, and their text. `window_lines` and `window_of` make the window of it."""
    return _reach(_feeds(flat) + 1, lambda low, high: _some_lines(flat, low, high), focus, base, before, after, most)


def _reach(n: Column, near: Callable[[Column, Column], Column], focus: Column, base: Column, before: int, after: int, most: int) -> Column:
    """n: lines of the unit; near: its lines from one place to before another, as a text with line feeds. What `let` gives is copied, so it gives nothing larger than that text."""
    gaps = lambda t, p: F.split(t, p.replace(r"\s", r"[ \t]"), -1)  # noqa: E731  no match goes from one line into the next
    found = lambda g, at: F.when(F.size(g) > 1, at)

    def placed(x: Column) -> Column:
        hit = F.greatest(F.lit(0), F.least(x["n"] - 1, focus - base))  # places count from 0
        return F.struct(x["n"].alias("n"), hit.alias("hit"), F.greatest(F.lit(0), hit - most).alias("low"), F.least(x["n"], hit + most + 1).alias("high"))

    def bounds(x: Column, t: Column) -> Column:
        marks, tries = gaps(t, CLEANUP_NEAR), gaps(_some_lines(t, F.lit(0), x["hit"] - x["low"] + 1), TRY)
        marked = let(marks, lambda g: F.struct(found(g, x["low"] + _feeds(F.get(g, 0))).alias("first"), found(g, x["high"] - _feeds(F.element_at(g, -1))).alias("end")))
        tried = let(tries, lambda g: found(g, x["hit"] - _feeds(F.element_at(g, -1))))
        both = lambda m: F.struct(F.least(F.greatest(F.lit(0), x["hit"] - before), m["first"], tried).alias("start"), F.greatest(F.least(x["n"], x["hit"] + after + 1), m["end"]).alias("end"))  # noqa: E731  nulls are passed over
        first = lambda w: F.when(w["end"] - w["start"] > most, F.greatest(F.lit(0), F.least(x["hit"] - before, w["end"] - most))).otherwise(w["start"])
        return let(let(marked, both), lambda w: F.struct(first(w).alias("first"), w["end"].alias("end")))

    def cut(x: Column, t: Column, w: Column) -> Column:
        end = F.least(w["end"], w["first"] + most)
        return F.struct((base + w["first"]).cast("int").alias("first"), (base + x["hit"]).cast("int").alias("hit"), _some_lines(t, w["first"] - x["low"], end - x["low"]).alias("text"))

    return let(let(F.struct(n.cast("int").alias("n")), placed), lambda x: let(near(x["low"], x["high"]), lambda t: let(bounds(x, t), lambda w: cut(x, t, w))))


def window_lines(reach: Column) -> Column:
    """array<struct<line,text,highlight,kind>> of what `window_reach` gives."""
    freed = lambda t: F.rlike(t, F.lit(CLEANUP_LINE))
    own = lambda k: reach["first"] + k == reach["hit"]
    row = lambda t, k: F.struct((reach["first"] + k).alias("line"), t.alias("text"), (own(k) | freed(t)).alias("highlight"), F.when(own(k), "problem").when(freed(t), "cleanup").alias("kind"))
    return F.transform(F.split(reach["text"], "\n", -1), row)


def window_of(rows: Column) -> Column:
    """struct<first,last,lines,snippet> of the rows of `window_lines`."""
    number = lambda s: F.lpad(s, F.greatest(F.lit(6), F.length(s)), F.lit(" "))
    said = lambda r: F.concat(number(r["line"].cast("string")), F.when(r["kind"] == "problem", "▶| ").otherwise(" | "), r["text"])
    return F.struct(F.get(rows, 0)["line"].alias("first"), F.element_at(rows, -1)["line"].alias("last"), rows.alias("lines"), F.array_join(F.transform(rows, said), "\n").alias("snippet"))


def humanise(name: Column) -> Column:
    """Camel case and underscores to words, each capitalised; a leading lower-case type prefix goes."""
    bare = F.regexp_replace(name, "^[a-z]{1,3}(?=[A-Z])", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\-.]+", " ")
    words = F.filter(F.split(F.trim(spaced), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.upper(w).isin("ID", "URL", "PO", "SKU", "UPC", "API"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")


def failure_messages(formula: Column) -> Column:
    """The literals of failure calls in a validation formula."""
    return F.transform(F.regexp_extract_all(F.coalesce(formula, F.lit("")), F.lit(r'(?i)@failure\(\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), F.lit(1)), lambda m: F.replace(m, F.lit('\\"'), F.lit('"')))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def _split_arguments(text: str | None) -> list[str]:
    """Splits on semicolons outside quotes and parentheses."""
    if text is None:
        return []
    out, depth, quote, at, start = [], 0, "", 0, 0
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == ";" and not depth:
            out.append(text[start:at].strip())
            start = at + 1
        at += 1
    return [*out, text[start:].strip()] if text[start:].strip() or out else []


def _closing(text: str, at: int, opener: str, closer: str) -> int | None:
    """Where what opens at `at` closes, outside quotes and comments of the brace languages; None if it doesn't."""
    depth, quote = 0, ""
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == opener:
            depth += 1
        elif c == closer:
            depth -= 1
            if not depth:
                return at
        at += 1
    return None


def _bodies(text: str | None, name: str) -> list[str]:
    """What stands between the balanced parentheses of each call of name, ignoring case."""
    out, low, word, at = [], (text or "").lower(), (name or "").lower(), 0
    while word and (at := low.find(word, at)) >= 0:
        opened = at + len(word)
        while opened < len(low) and low[opened].isspace():
            opened += 1
        at += len(word)
        if opened < len(low) and low[opened] == "(" and (end := _closing(text, opened, "(", ")")) is not None:
            out.append(text[opened + 1 : end])
    return out


def _brace_block(text: str | None) -> str | None:
    """What stands in the first balanced pair of braces; None if there is none."""
    opened = (text or "").find("{")
    end = _closing(text, opened, "{", "}") if opened >= 0 else None
    return None if end is None else text[opened + 1 : end]


def _taken(text: str | None, patterns: list[re.Pattern]) -> list[tuple[int, int, int]]:
    """(start, end, pattern) of matches taken in the order of the patterns, without those that overlap one taken before. What is taken is disjoint, so only two neighbours count."""
    starts: list[int] = []
    ends: list[int] = []
    kinds: list[int] = []
    for n, pattern in enumerate(patterns):
        found = [(m.start(), m.end()) for m in pattern.finditer(text or "") if m.end() > m.start()]
        fresh = []
        for start, end in found:
            k = bisect_right(starts, start)
            if (k == 0 or ends[k - 1] <= start) and (k == len(starts) or starts[k] >= end):
                fresh.append((start, end, n))
        merged = sorted([*zip(starts, ends, kinds, strict=True), *fresh])  # matches of one pattern don't overlap each other
        starts, ends, kinds = ([x[i] for x in merged] for i in range(3))
    return list(zip(starts, ends, kinds, strict=True))


SPANS = "array<struct<start:int,end:int,pattern:int>>"


def disjoint_spans(text: Column, patterns: list[str]) -> Column:
    """array<struct<start,end,pattern>>: matches of the patterns, the earlier pattern first; one that overlaps what is taken is dropped. Sorted by place."""

    def run(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p) for p in patterns]
        return texts.map(lambda t: [{"start": a, "end": b, "pattern": k} for a, b, k in _taken(t, compiled)], na_action=None)

    return F.pandas_udf(run, SPANS)(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_arguments(text: pd.Series) -> pd.Series:
    return text.map(_split_arguments, na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def call_bodies(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([_bodies(t, n) for t, n in zip(text, name, strict=True)])


@F.pandas_udf(T.StringType())
def brace_block(text: pd.Series) -> pd.Series:
    return text.map(_brace_block, na_action=None)


def literals(argument: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.coalesce(argument, F.lit("")), F.lit('"([^"]*)"'), F.lit(1)), lambda x: F.trim(x) != "")


def last_literal(argument: Column) -> Column:
    found = literals(argument)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def lookup_arguments(arguments: Column) -> Column:
    """struct<view,ret,key,database> of a lookup call's argument list."""
    n = F.size(arguments)
    arg = lambda k: F.when(n >= k, F.get(arguments, k - 1))
    all_ = F.flatten(F.transform(arguments, literals))
    back = lambda k: F.when(F.size(all_) >= 3, F.element_at(all_, -k))
    pick = lambda k, b: F.when(n < 3, back(b)).otherwise(last_literal(arg(k)))
    raw = F.nullif(F.trim(arg(2)), F.lit(""))
    quoted = F.size(F.regexp_extract_all(F.coalesce(arg(2), F.lit("")), F.lit('"([^"]*)"'), F.lit(1))) > 0
    return F.struct(pick(3, 3).alias("view"), pick(4, 2).alias("ret"), pick(5, 1).alias("key"), F.coalesce(last_literal(arg(2)), F.when(~quoted, raw)).alias("database"))


# Types of handles in parameters, of the script language and of the others.
HANDLES_LOTUS = [
    "NotesDocument", "NotesView", "NotesDatabase", "NotesViewEntry", "NotesViewNavigator", "NotesViewNav", "NotesViewEntryCollection", "NotesDocumentCollection",
    "NotesItem", "NotesRichTextItem", "NotesMIMEEntity", "NotesStream", "NotesName", "NotesDateTime", "NotesDateRange", "NotesHTTPRequest",
    "NotesJSONNavigator", "NotesJSONElement", "NotesEmbeddedObject", "NotesACL", "NotesACLEntry", "NotesAgent", "NotesOutline", "NotesRegistration",
]
HANDLES_JAVA = [
    "Document", "View", "Database", "ViewEntry", "ViewNavigator", "ViewEntryCollection", "DocumentCollection", "Item", "RichTextItem", "MIMEEntity",
    "Stream", "Name", "DateTime", "DateRange", "NotesDocument", "NotesView", "NotesDatabase", "lotus.domino.Document", "lotus.domino.View", "lotus.domino.Database",
]
LOTUS = ("lotusscript", "ls", "lss", "notes")


def _one_of(names: list[str]) -> str:
    """Names as one pattern, the longest first."""
    return "|".join(n.replace(".", r"\.") for n in sorted(names, key=len, reverse=True))


def handle_params(signature: Column, language: Column) -> Column:
    """array<string>: names that follow a handle type in a signature, so of handle parameters, and of a function after the type it returns; none for a null signature."""
    names = lambda p: F.regexp_extract_all(F.coalesce(signature, F.lit("")), F.lit(p), F.lit(1))
    lotus = names(rf"(?i)\b([A-Za-z_]\w*)\s+As\s+(?:{_one_of(HANDLES_LOTUS)})\b")
    return F.when(F.lower(language).isin(*LOTUS), lotus).otherwise(names(rf"(?i)\b(?:{_one_of(HANDLES_JAVA)})\s+([A-Za-z_]\w*)\b"))


def returns_handle(signature: Column, language: Column) -> Column:
    """Whether a function's signature says that it gives a handle to its caller."""
    text = F.coalesce(signature, F.lit(""))
    lotus = F.rlike(text, F.lit(rf"(?i)\bAs\s+(?:{_one_of(HANDLES_LOTUS)})\b"))
    return F.when(F.lower(language).isin(*LOTUS), lotus).otherwise(F.rlike(text, F.lit(rf"(?m)^\s*(?:(?:public|private|protected|static)\s+)*(?:{_one_of(HANDLES_JAVA)})\s+[A-Za-z_]")))


# What begins and ends a loop of the script language.
LOOP_START, LOOP_END = r"(?i)\b(?:Do\s+While|Do\s+Until|Forall|(?<!\bDo\s{1,16})(?<![\w.])While)\b", r"(?i)\b(?:Loop|End\s+Forall|Wend)\b"


def loop_around(body: Column, at: Column, starts: str = LOOP_START, ends: str = LOOP_END) -> Column:
    """struct<start,end> of the loop that a 0-based place is in: from the last start at or before it to the first end at or after it, or the body's end; null outside of loops."""
    place, size = at.cast("string"), F.length(body)
    bare = lambda p: p.removeprefix("(?i)")
    # The longest way up to the place after which a loop starts, and the shortest from the place on after which one ends: one match each.
    before = F.concat(F.lit("(?is)^(.{0,"), place, F.lit(f"}})(?:{bare(starts)})"))
    after = F.concat(F.lit("(?is)^(.{"), place, F.lit(f"}}.*?(?:{bare(ends)}))"))
    inside = (at >= 0) & (at <= size)
    first = F.when(inside & F.rlike(body, before), F.length(F.call_function("regexp_extract", body, before, F.lit(1))))
    last = F.when(inside & F.rlike(body, after), F.length(F.call_function("regexp_extract", body, after, F.lit(1)))).otherwise(size)
    return F.when(first < last, F.struct(first.alias("start"), last.alias("end")))


#: Elements of a chunk, within which running sums are made one by one.
CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use, or a function of it for each element, reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def chunks(size: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))


def within(c: Column, size: Column) -> Column:
    """The places of a chunk's elements. Elements are read by place, as a slice would copy the whole array each time."""
    return F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, size) - 1)


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of step over an array of int. An array grows by an element only within chunks, so that the work isn't quadratic."""
    grow = lambda places, of, first: F.aggregate(
        places, F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, i: F.struct(step(acc["at"], of(i)).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], of(i)))).alias("out")), lambda acc: acc["out"],
    )

    def made(v: Column) -> Column:
        totals = F.transform(chunks(F.size(v)), lambda c: F.aggregate(within(c, F.size(v)), start, lambda acc, i: step(acc, F.get(v, i))))
        parts = lambda ends: F.transform(chunks(F.size(v)), lambda c: grow(within(c, F.size(v)), lambda i: F.get(v, i), F.when(c == 0, start).otherwise(F.get(ends, c - 1))))
        return let(grow(totals, lambda x: x, start), lambda ends: F.flatten(parts(ends)))

    return let(values, lambda v: F.when(F.size(v) > 0, made(v)).otherwise(F.expr("cast(array() as array<int>)")))


def matches(body: Column, pattern: Column | str) -> Column:
    """array<struct<start,end,hit>> of a pattern's matches, 0-based: ``split`` gives the gaps, running sums of lengths the places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    zipped = F.zip_with(F.split(body, pattern, -1), F.regexp_extract_all(body, pattern, F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    span = lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("hit"))
    ends = lambda hits: running(F.transform(hits, lambda x: x["gap"] + F.length(x["hit"])), F.lit(0), lambda at, x: at + x)
    made = let(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda hits: F.zip_with(hits, ends(hits), span))
    return F.when(F.rlike(body, pattern), made).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)"))
