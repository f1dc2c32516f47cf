"""Code units of exports and raw sources, each with the element that it belongs to and the line at which it starts.

An export is read as a stream of events with the stack of open elements: a code element's place in the file and its nearest named ancestor are known when it
closes, and nothing but open code is kept. A file of several roots is read again within one; what still isn't well-formed is one unit of unknown language.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftgraph.sources import exports
from siftgraph.sources.arrow import arrow_schema

UNIT = "source_file string, element_name string, element_type string, language string, event string, body string, start_line int, pos int"

# Elements that hold code, elements that name what is in them, shortest body, and languages by the suffix of a raw source.
CODE = {"java", "lotusscript", "javascript", "jscript", "ssjs", "csjs", "formula", "source", "script"}
NAMED = {"form", "subform", "view", "folder", "agent", "scriptlibrary", "sharedfield", "page", "frameset", "outline", "imageresource", "database", "note"}
LEAST = 8
SUFFIXES = {"lss": "lotusscript", "ls": "lotusscript", "java": "java", "jss": "ssjs", "xsp": "xpages"}


class _Reader:
    """Collects units from a parser's events."""

    def __init__(self) -> None:
        self.parser = expat.ParserCreate("utf-8", " ")
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.text
        self.stack: list[tuple[str, dict[str, str]]] = []
        self.open: list[tuple[int, int]] = []  # of each open code element: its number among all, and where its text begins in pieces
        self.pieces: list[tuple[str, int]] = []  # text within open code, with its line
        self.found: list[tuple[int, dict]] = []
        self.n = 0

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        tag = tag.rsplit(" ", 1)[-1].lower()
        self.stack.append((tag, {k.rsplit(" ", 1)[-1].lower(): v for k, v in attributes.items()}))
        if tag in CODE:
            self.open.append((self.n, len(self.pieces)))
        self.n += 1

    def text(self, data: str) -> None:
        if self.open:
            self.pieces.append((data, self.parser.CurrentLineNumber))

    def end(self, _: str) -> None:
        if self.stack[-1][0] in CODE:
            number, first = self.open.pop()
            body = "".join(p for p, _ in self.pieces[first:]).strip()
            if len(body) >= LEAST:
                piece, line = next((p, line) for p, line in self.pieces[first:] if p.strip())
                line += piece[: len(piece) - len(piece.lstrip())].count("\n")
                self.found.append((number, self.unit(body, line)))
            if not self.open:
                self.pieces.clear()
        self.stack.pop()

    def unit(self, body: str, line: int) -> dict:
        tag, own = self.stack[-1]
        around, outer = self.stack[-2] if len(self.stack) > 1 else ("", {})
        event, language = None, tag
        if around == "code":
            event = outer.get("event")
            if tag == "script":
                language = own.get("language") or "ssjs"
        elif tag in ("script", "source"):
            language = (own.get("language") or own.get("type") or tag).lower()
            language = "ssjs" if "javascript" in language else "java" if "java" in language else language
        if language in ("javascript", "jscript", "js"):
            language = "ssjs"
        kind, name = self.owner()
        return {"element_name": name, "element_type": kind, "language": language, "event": event, "body": body, "start_line": line}

    def owner(self) -> tuple[str, str]:
        """(element, name) of the nearest named ancestor; the events of code elements up to it follow its name."""
        events, kind, name = [], "unknown", "unknown"
        for k in range(len(self.stack) - 1, -1, -1):
            tag, own = self.stack[k]
            called = own.get("name") or own.get("title")
            if called and tag in NAMED:
                kind, name = tag, called
                break
            if tag == "code" and own.get("event") and k:
                events.append(own["event"])
        for event in reversed(events):
            name = event if name == "unknown" else f"{name}/{event}"
        return kind, name


def _stored(text: str) -> list[dict]:
    """Script libraries and file resources, whose source is stored in items."""
    low = text.lower()
    if "javascriptlibrary" not in low and "$filedata" not in low:
        return []
    root, out = ET.fromstring(text), []  # noqa: S314
    line_at = lambda place: text.count("\n", 0, place) + 1 if place >= 0 else 1
    for library in (n for n in root.iter() if exports.local(n) == "scriptlibrary"):
        name = exports.attribute(library, "name") or "Unnamed"
        for code in exports.libraries_of(library):
            named = max(text.find(f"name='{name}'"), text.find(f'name="{name}"'))
            mark = "$ServerJavaScriptLibrary" if code["language"] == "ssjs" else "$ClientJavaScriptLibrary"
            out.append({**code, "element_name": name, "element_type": "scriptlibrary", "start_line": line_at(named if named >= 0 else text.find(mark))})
    for note in (n for n in root.iter() if exports.local(n) == "note"):
        if found := exports.resource_of(note):
            out += [{**code, "element_name": found["name"], "element_type": found["element_type"], "start_line": 1} for code in found["code"]]
    return out


def units_of(text: str, source_file: str) -> list[dict]:
    """The code units of one export in the order in which their elements begin."""
    for whole in (text, f"<dxl>{text}</dxl>"):
        reader = _Reader()
        try:
            reader.parser.Parse(whole.encode("utf-8", "replace"), True)
        except expat.ExpatError:
            continue
        found = [u for _, u in sorted(reader.found, key=lambda x: x[0])] + _stored(whole)
        break
    else:
        found = [{"element_name": source_file.rsplit("/", 1)[-1], "element_type": "file", "language": "unknown", "event": None, "body": text, "start_line": 1}]
    return [{**u, "source_file": source_file, "pos": k} for k, u in enumerate(found)]


def _of_source(text: str, source_file: str) -> list[dict]:
    """A raw source is one unit, anything else an export."""
    language = SUFFIXES.get(source_file.rsplit(".", 1)[-1].lower())
    if language is None:
        return units_of(text, source_file)
    return [{"source_file": source_file, "element_name": source_file.rsplit("/", 1)[-1], "element_type": "odp_file", "language": language, "event": None, "body": text, "start_line": 1, "pos": 0}]


def units(texts: DataFrame) -> DataFrame:
    """Code units of texts (source_file, text): exports, or raw sources by the suffix of their name. A null text is an empty one."""
    schema = T._parse_datatype_string(UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch["source_file"].to_pylist(), batch["text"], strict=True):
                yield pa.RecordBatch.from_pylist(_of_source(text.as_py() or "", name or ""), arrow_schema(schema))

    return texts.select("source_file", "text").mapInArrow(run, schema)


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["path"].cast(pa.string()), pa.array([x.as_py().decode("utf-8", "ignore") for x in b["content"]], pa.string())], ["source_file", "text"])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Code units of all exports and raw sources below a folder; bytes that aren't UTF-8 are ignored. One scan reads both kinds."""
    suffixes = ",".join(s for x in ("dxl", "xml", *SUFFIXES) for s in (x, x.upper()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").load(path)
    return units(files.select("path", "content").mapInArrow(_text, "source_file string, text string"))
