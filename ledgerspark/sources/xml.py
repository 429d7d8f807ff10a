"""XML documents shredded on the executors into rows of (path, kind, json).

Files are read by Spark's binaryFile source, so any file system that Spark knows will do. A document becomes
rows of several kinds; relation() turns one kind into columns. Names in attributes and texts are resolved with the
prefixes in scope, so rows carry Clark names. Document types and entities are refused.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from xml.parsers import expat
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

XML_NS = "http://www.w3.org/XML/1998/namespace"
XLINK = "{http://www.w3.org/1999/xlink}"
#: A start tag whose name stands apart from its bracket, which some writers leave.
TORN_TAG = re.compile(rb"<\s+(?=[A-Za-z_][\w.-]*:)")


class Node:
    """An element with the prefixes in scope."""

    __slots__ = ("element", "scope", "children")

    def __init__(self, element: ET.Element, scope: dict[str, str]):
        self.element, self.scope, self.children = element, scope, []

    def __iter__(self):
        return iter(self.children)

    @property
    def tag(self) -> str:
        return self.element.tag

    @property
    def local(self) -> str:
        return self.element.tag.rpartition("}")[2]

    def get(self, name: str, default=None):
        return self.element.get(name, default)

    @property
    def text(self) -> str:
        return (self.element.text or "").strip()

    def all_text(self) -> str:
        return "".join(self.element.itertext()).strip()

    def name(self, qname: str | None) -> str | None:
        """A prefixed name as Clark text."""
        if not qname:
            return None
        prefix, colon, local = qname.strip().rpartition(":")
        ns = self.scope.get(prefix)
        return f"{{{ns}}}{local}" if ns else local if not colon else qname

    def find(self, *locals_: str) -> Node | None:
        return next((c for c in self.children if c.local in locals_), None)

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    def source(self) -> str:
        return ET.tostring(self.element, encoding="unicode")


def parse(content: bytes) -> Node:
    """The document's root; a document that only torn tags spoil is mended."""
    _refuse_types(content)
    try:
        return _parse(content)
    except ET.ParseError:
        mended = TORN_TAG.sub(b"<", content)
        if mended == content:
            raise
        _refuse_types(mended)
        return _parse(mended)


def _refuse_types(content: bytes) -> None:
    """Raises where the document has a type, wherever it stands; a comment that names one is none."""
    if b"DOCTYPE" not in content and b"D\0O\0C\0T\0Y\0P\0E" not in content:
        return

    def found(*_) -> None:
        raise ValueError("document types aren't read")

    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler = found
    try:
        parser.Parse(content, True)
    except expat.ExpatError:  # the real parser says what is wrong
        return


def _parse(content: bytes) -> Node:
    open_: list[Node] = []
    scopes: list[dict[str, str]] = [{"xml": XML_NS}]
    pending: dict[str, str] = {}
    root = None
    for event, item in ET.iterparse(io.BytesIO(content), events=("start", "end", "start-ns")):
        if event == "start-ns":
            pending[item[0]] = item[1]
        elif event == "start":
            scope = {**scopes[-1], **pending} if pending else scopes[-1]
            pending = {}
            scopes.append(scope)
            node = Node(item, scope)
            if open_:
                open_[-1].children.append(node)
            else:
                root = node
            open_.append(node)
        else:
            open_.pop()
            scopes.pop()
    return root


Shredder = Callable[[Node, str], Iterator[tuple[str, dict]]]
ROWS = "path string, kind string, json string"


def shred(spark: SparkSession, paths: str | list[str], shredder: Shredder, pattern: str | None = None) -> DataFrame:
    """Rows of all documents at paths. One that can't be read gives a single row of kind error."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found += [(path, kind, json.dumps(values)) for kind, values in shredder(parse(bytes(content)), path)]
                except (ET.ParseError, ValueError) as error:
                    found.append((path, "error", json.dumps({"message": str(error)})))
            yield pd.DataFrame(found, columns=["path", "kind", "json"])

    return files.mapInPandas(rows, ROWS)


def relation(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of one kind as columns, with their document's path."""
    return rows.where(F.col("kind") == kind).select("path", F.from_json("json", schema).alias("r")).select("path", "r.*")
