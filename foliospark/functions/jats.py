"""JATS full text to sections: paragraphs by an event parser in Arrow batches, and their merging in SQL.

An article is fed to the parser in blocks, and an element is let go as soon as its text is out: what is held at a time is
the front matter, or one paragraph and those of open sections whose titles haven't come yet. Rows leave in
batches of a bounded size, so neither an article's tree nor all of its rows are ever in memory at once.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from foliospark.session import ship_package

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("ord", T.IntegerType()), ("section", T.StringType()), ("para_ord", T.IntegerType()), ("paragraph", T.StringType()), ("error", T.StringType()))])
BLOCK = 65_536  # characters fed at once
ROWS = 1_000  # rows of a batch

#: Keys for parts without a title of their own.
TITLE, ABSTRACT, PREFACE, UNTITLED, SUBSECTION = "Title", "Abstract", "Body (untitled)", "Untitled Section", "subsection"


def flat_text(node: ET.Element | None) -> str:
    """All text inside a node; pieces between tags are set apart by spaces."""
    return "" if node is None else " ".join(" ".join(node.itertext()).split())


def _paragraphs(children) -> list[str]:
    kept = (c for c in children if not str(c.tag).endswith(("title", "label", "sec")))
    return [t for t in map(flat_text, kept) if t]


def _abstracts(meta: ET.Element) -> Iterator[tuple[str, list[str]]]:
    found = meta.findall("abstract") + meta.findall("trans-abstract")
    for number, node in enumerate(found, 1):
        title = flat_text(node.find("title"))
        key = title or (ABSTRACT if len(found) == 1 else f"{ABSTRACT} {number}")
        yield key, _paragraphs(node)
        for sec in node.findall("sec"):
            yield flat_text(sec.find("title")) or f"{key} {SUBSECTION}", _paragraphs(sec)


def _front(meta: ET.Element) -> list[tuple[str, list[str]]]:
    """Title and abstracts of the article-meta element."""
    title, group = "", meta.find("title-group")
    if group is not None:
        own = group.find("article-title")  # a blank one is no title, and the translated one doesn't replace it
        title = flat_text(group.find("trans-title-group/trans-title") if own is None else own)
    return [(k, p) for k, p in [(TITLE, [title] if title else []), *_abstracts(meta)] if p]


@dataclass
class _Open:
    """A section whose end hasn't come; its paragraphs wait for its title."""

    node: ET.Element
    ord: int
    title: str | None = None
    n: int = 0
    waiting: list[str] = field(default_factory=list)

    def add(self, paragraph: str) -> Iterator[tuple]:
        self.waiting.append(paragraph)
        if self.title is not None:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for p in self.waiting:
            yield self.ord, self.title or UNTITLED, self.n, p
            self.n += 1
        self.waiting.clear()


class _Events:
    """Rows (ord, section, para_ord, paragraph) from the starts and ends of elements."""

    def __init__(self):
        self.path: list[ET.Element] = []
        self.article = self.meta = self.body = self.kept = None
        self.sections: list[_Open] = []
        self.preface: _Open | None = None
        self.number = 0

    def start(self, node: ET.Element) -> None:
        above = self.path[-1] if self.path else None
        self.path.append(node)
        if self.article is None:
            if node.tag == "article" or (above is None and str(node.tag).endswith("article")):
                self.article = node
        elif self.kept is not None:
            return
        elif node.tag == "article-meta" and self.meta is None and above.tag == "front" and len(self.path) > 2 and self.path[-3] is self.article:
            self.meta = self.kept = node
        elif node.tag == "body" and self.body is None and above is self.article:
            self.body, self.preface, self.number = node, _Open(node, self.number, PREFACE), self.number + 1
        elif self.sections and above is self.sections[-1].node or above is self.body is not None:
            if node.tag == "sec":
                self.sections.append(_Open(node, self.number))
                self.number += 1
            elif not str(node.tag).endswith("sec"):
                self.kept = node
            if above is self.body and str(node.tag).endswith("sec"):
                self.preface = None

    def end(self, node: ET.Element) -> Iterator[tuple]:
        self.path.pop()
        above = self.path[-1] if self.path else None
        if self.kept is not None and node is not self.kept:
            return
        self.kept = None
        if node is self.meta:
            found = _front(node)
            begin = 0 if self.body is None else -len(found)  # front matter comes first, wherever it stands
            for i, (key, paragraphs) in enumerate(found, begin):
                yield from ((i, key, j, p) for j, p in enumerate(paragraphs))
            self.number += len(found) if self.body is None else 0
        elif self.sections and node is self.sections[-1].node:
            last = self.sections.pop()
            last.title = last.title or UNTITLED
            yield from last.flush()
        elif self.sections and above is self.sections[-1].node:
            now = self.sections[-1]
            if node.tag == "title" and now.title is None:
                now.title = flat_text(node)
                yield from now.flush()
            elif not str(node.tag).endswith(("title", "label", "sec")) and (text := flat_text(node)):
                yield from now.add(text)
        elif self.preface is not None and above is self.body and not str(node.tag).endswith("title") and (text := flat_text(node)):
            yield from self.preface.add(text)
        if above is not None:
            above.remove(node)


def paragraph_rows(xml: str) -> Iterator[tuple]:
    """(ord, section, para_ord, paragraph, error): sections are numbered in document order, those of one title not yet
    merged, their rows in order of reading. Malformed XML ends with a row of the error; what came before it counts for nothing."""
    parser, events = ET.XMLPullParser(("start", "end")), _Events()

    def read() -> Iterator[tuple]:
        for kind, node in parser.read_events():
            if kind == "start":
                events.start(node)
            else:
                yield from events.end(node)

    try:
        for at in range(0, len(xml) or 1, BLOCK):
            parser.feed(xml[at : at + BLOCK])
            for row in read():
                yield (*row, None)
        parser.close()
        for row in read():
            yield (*row, None)
    except ET.ParseError as e:
        yield None, None, None, None, str(e)


def sections(xml: str) -> list[tuple[str, list[str]]]:
    """(section, paragraphs) in document order, sections of one title not yet merged."""
    found: dict[int, tuple[str, list[str]]] = {}
    for number, section, _, paragraph, error in paragraph_rows(xml):
        if error is not None:
            raise ET.ParseError(error)
        found.setdefault(number, (section, []))[1].append(paragraph)
    return [found[n] for n in sorted(found)]


@udtf(returnType=SCHEMA)
class JatsSections:
    """One row a paragraph, for SQL; malformed XML gives a last row with the error."""

    def eval(self, xml: str):
        if xml is not None:
            yield from paragraph_rows(xml)


def jats_paragraphs(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, ord, section, para_ord, paragraph, error) of every document with sections or an error."""
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType
    names = [f.name for f in SCHEMA]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, rows = [], []

            def batch(keys=b.column(0), places=places, rows=rows):
                columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), *columns], names=["__key", *names])

            for i, text in enumerate(b.column(1)):
                for row in paragraph_rows(text.as_py()) if text.is_valid else ():
                    places.append(i)
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield batch()
                        places.clear(), rows.clear()
            if rows:
                yield batch()

    named = docs.select(F.col(key).alias("__key"), F.col(xml).cast("string").alias("__xml"))
    schema = T.StructType([T.StructField("__key", kind), *SCHEMA])
    return named.mapInArrow(run, schema).withColumnRenamed("__key", key)
