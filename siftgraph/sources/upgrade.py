"""Blocks of code by language, for the scan of calls to upgrade.

A block's language is that of its element, or of the nearest element around it that has one: text within a Java project is Java whatever its own tag is.
Wrappers with the same text as the element around them give no block of their own, and of blocks that agree in language, length and first characters the first counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftgraph.sources.arrow import arrow_schema
from siftgraph.sources.units import _text

BLOCK = "source_file string, language string, body string, pos int, note string"

# Elements of each language, elements that take it over from a Java project, the shortest body, what two bodies are compared by, and notes.
LANGUAGES = {
    "lotusscript": "lotusscript", "ls": "lotusscript", "lss": "lotusscript", "java": "java", "javaproject": "java", "javaclass": "java", "code.javaproject": "java", "source": "java",
    "javascript": "javascript", "jscript": "javascript", "ssjs": "javascript", "script": "javascript", "formula": "formula",
}
SCRIPTS, INHERITING = ("javascript", "jscript", "ssjs", "script"), ("code", "text")
LEAST, COMPARED = 8, 200
WRAPPED, BROKEN = "Wrapped non-rooted DXL fragment in <dxl>.", "XML parse error: "


def language_of(tag: str, attributes: dict[str, str]) -> str | None:
    """An element's own language; a script's attribute may name another one."""
    if tag not in SCRIPTS:
        return LANGUAGES.get(tag)
    said = ""
    for name, value in attributes.items():
        if name.lower().endswith("language") or name.lower() == "type":
            said = value.lower()
    if "lotus" in said:
        return "lotusscript"
    return "java" if said == "java" or said.endswith("/java") else "javascript"


class _Reader:
    """Collects blocks from a parser's events; only text within open code is kept."""

    def __init__(self) -> None:
        self.parser = expat.ParserCreate("utf-8", "}")
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.text
        self.stack: list[tuple[int, str | None, str | None, str | None, int]] = []  # number, own language, language of its block, language for what is in it, where its text begins
        self.pieces: list[str] = []
        self.n_open = self.n = 0
        self.texts: dict[int, tuple[int, bytes]] = {}
        self.found: list[tuple[int, int | None, str, str]] = []  # number, number of the code element around it, language, body

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        tag = tag.rsplit("}", 1)[-1].lower()
        around = self.stack[-1][3] if self.stack else None
        own = language_of(tag, attributes)
        taken = own or (around if around == "java" and tag in INHERITING else None)
        self.stack.append((self.n, own, taken, own or around, len(self.pieces)))
        self.n_open += taken is not None
        self.n += 1

    def text(self, data: str) -> None:
        if self.n_open:
            self.pieces.append(data)

    def end(self, _: str) -> None:
        number, own, taken, _, first = self.stack.pop()
        if taken is None:
            return
        body = "".join(self.pieces[first:]).strip()
        self.pieces[first:] = ["".join(self.pieces[first:])]
        self.n_open -= 1
        if not self.n_open:
            self.pieces.clear()
        if own:
            self.texts[number] = self.digest(body)
        if taken != "formula" and len(body) >= LEAST:
            self.found.append((number, self.stack[-1][0] if self.stack and self.stack[-1][1] else None, taken, body))

    @staticmethod
    def digest(body: str) -> tuple[int, bytes]:
        return len(body), hashlib.blake2b(body.encode("utf-8", "replace"), digest_size=16).digest()

    def blocks(self) -> list[tuple[str, str]]:
        seen, out = set(), []
        for _, around, language, body in sorted(self.found, key=lambda x: x[0]):
            key = language, body[:COMPARED], len(body)
            if key not in seen and (around is None or self.texts[around] != self.digest(body)):
                seen.add(key)
                out.append((language, body))
        return out


def blocks_of(text: str, source_file: str) -> list[dict]:
    """The blocks of one export in the order in which their elements begin, and a row with a note where it had to be wrapped in a root or can't be read."""
    failed = None
    for whole, note in ((text, None), (f"<dxl>{text}</dxl>", WRAPPED)):
        reader = _Reader()
        try:
            reader.parser.Parse(whole.encode("utf-8", "replace"), True)
        except expat.ExpatError as e:
            failed = str(e)
            continue
        found = [{"language": language, "body": body, "pos": k, "note": None} for k, (language, body) in enumerate(reader.blocks())]
        found += [{"language": None, "body": None, "pos": len(found), "note": note}] if note else []
        break
    else:
        found = [{"language": None, "body": None, "pos": 0, "note": f"{BROKEN}{failed}"}]
    return [{**b, "source_file": source_file} for b in found]


def blocks(texts: DataFrame) -> DataFrame:
    """Blocks of exports (source_file, text), with rows that have only a note. A null text is an empty one, which is read as an empty fragment."""
    schema = T._parse_datatype_string(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch["source_file"].to_pylist(), batch["text"], strict=True):
                yield pa.RecordBatch.from_pylist(blocks_of(text.as_py() or "", name or ""), arrow_schema(schema))

    return texts.select("source_file", "text").mapInArrow(run, schema)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of one export or of all below a folder; bytes that aren't UTF-8 are ignored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{dxl,xml}").load(path)
    return blocks(files.select("path", "content").mapInArrow(_text, "source_file string, text string"))
