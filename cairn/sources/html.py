"""HTML pages as ordered blocks with the path of headings that leads to each, in one pass over the tags.

The root is the first ``main`` element, else ``body``, else the whole page. In it headings, paragraphs, tables and list items are blocks,
in the order in which they open; a list item within another one is part of that. Elements stay open until their own end tag, or that
of an element around them, comes: an unclosed paragraph holds what follows up to the end of its parent.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "table", "li")
ROOTS = ("main", "body")
#: Elements without content, and those whose text is none of the page's.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
SILENT = frozenset(("script", "style", "template"))
PARSED = "block_id string, ordinal int, block_type string, level int, text string, section_path array<string>, table_rows array<array<string>>"


#: Pages are handed on as soon as so many characters of them are read, whatever the size of Spark's batches.
CHARACTERS = 2_000_000


def small_batches(batch: pa.RecordBatch, html: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of one page or of pages of some CHARACTERS; ``html`` is the column of their text."""
    start, held = 0, 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column(html)), 0)):
        held += size.as_py()
        if held >= CHARACTERS:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def clean(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


class _Element:
    __slots__ = ("tag", "parts", "rows", "within_item", "roots")

    def __init__(self, tag: str, within_item: bool, roots: tuple[bool, bool]) -> None:
        self.tag, self.within_item, self.roots = tag, within_item, roots
        self.parts: list[str] = []
        self.rows: list[list[list[str]]] = []


class Reader(HTMLParser):
    """Collects blocks. ``roots`` of an element tell whether it is in the first ``main`` and in the first ``body``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.blocks: list[_Element] = []
        self.entered: set[str] = set()
        self.silent = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            return
        within = self.open[-1].roots if self.open else (False, False)
        roots = tuple(w or (tag == name and name not in self.entered) for w, name in zip(within, ROOTS, strict=True))
        if tag in ROOTS:
            self.entered.add(tag)
        element = _Element(tag, any(e.tag == "li" for e in self.open), roots)
        if tag == "tr":
            for e in self.open:
                if e.tag == "table":
                    e.rows.append([])
        if tag in ("th", "td"):
            for k, e in enumerate(self.open):
                if e.tag == "table" and e.rows and any(o.tag == "tr" for o in self.open[k:]):
                    e.rows[-1].append(element.parts)
        self.open.append(element)
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.blocks.append(element)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open):
            while True:
                closed = self.open.pop()
                self.silent -= closed.tag in SILENT
                if closed.tag == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent and (text := data.strip()):
            for e in self.open:
                if e.tag in BLOCKS or e.tag in ("th", "td"):
                    e.parts.append(text)


def read(html: str | None, source: str) -> Iterator[tuple]:
    """Rows of PARSED of one page."""
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    root = next((k for k, name in enumerate(ROOTS) if name in reader.entered), None)
    stack: list[str] = []
    ordinal = 0
    for e in reader.blocks:
        if root is not None and not e.roots[root] or (e.tag == "li" and e.within_item):
            continue
        level, rows, kind = None, None, {"p": "paragraph", "li": "list", "table": "table"}.get(e.tag, "heading")
        if kind == "heading":
            level = int(e.tag[1])
            stack = [*stack[: level - 1], clean(e.parts)]
            text = stack[-1]
        elif kind == "table":
            rows = [[clean(cell) for cell in row] for row in e.rows if row]
            text = clean([" | ".join(row) for row in rows])
        else:
            text = clean(e.parts)
        if text:
            yield f"{source}-B{ordinal + 1:03d}", ordinal, kind, level, text, list(stack), rows
            ordinal += 1


def html_blocks(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, block_id, ordinal, block_type, level, text, section_path, table_rows) of every page. Null pages have no blocks; the id may be of any type."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in small_batches(whole, 2)):
            ids, rows, of = batch.column(0), [], []
            for k, (name, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for row in read(text, name or ""):
                    rows.append(row)
                    of.append(k)
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *columns], names=["page_id", "block_id", "ordinal", "block_type", "level", "text", "section_path", "table_rows"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(page_id).cast("string").alias("name"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kind}, {PARSED}")
