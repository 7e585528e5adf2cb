"""Documents to Markdown: headings, lists, and tables as pipe tables, which chunking reads on.

A document is cut into tags and texts by one expression; a stack holds the open lists and tables. Tags that end tags should
close, and do not, are closed by what opens next: a block ends the block before it, an item the item, a cell the cell, and
the end of the document everything.

Inline tags leave their text. Head, scripts, styles and comments are dropped. A cell's line breaks become spaces and its
pipes ``\\|``; a cell over several columns is followed by empty ones, one over several rows stands in the first. Short rows
are filled up. A table inside a cell becomes a table of its own behind the one that holds it, so no text is lost or doubled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.batches import slices

# An unclosed quote or comment is text; no alternative can be read in two ways, so the work is linear.
_PIECES = re.compile(r"""<!--.*?-->|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"[ \t\r\n\f]+")

DROPPED = frozenset({"head", "script", "style", "template", "noscript"})
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hr html legend main nav p section summary".split())
MOST_COLUMNS = 1000


class _Table:
    def __init__(self):
        self.rows: list[list[str]] = []
        self.inner: list[str] = []  # the tables in its cells

    def lines(self) -> list[str]:
        rows = [r for r in self.rows if r]
        width = max(map(len, rows), default=0)
        if not any(map(any, rows)):
            return []
        told = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return [told[0], "|" + " --- |" * width, *told[1:]]


class _Reader:
    """The state between two pieces of one document."""

    def __init__(self):
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.prefix = ""  # of the block to come: a heading's signs or an item's mark
        self.lists: list[int | None] = []  # the next number of each open list, none for bullets
        self.tables: list[tuple[_Table, str]] = []  # with the prefix that waits around it
        self.cell = False
        self.pre = 0

    def flush(self) -> None:
        """The end of a block, or of a cell's line."""
        raw = "".join(self.text)
        self.text = []
        if self.tables:
            if raw := _SPACE.sub(" ", raw).strip(" "):
                rows = self.tables[-1][0].rows
                if not self.cell:
                    rows.append([""])
                    self.cell = True
                rows[-1][-1] = f"{rows[-1][-1]} {raw}".strip().replace("\\|", "|").replace("|", "\\|")
            return
        if self.pre:
            body = raw.strip("\r\n")
        else:
            body = "\n".join(x for x in (_SPACE.sub(" ", line).strip(" ") for line in raw.split("\x00")) if x)
        if body:
            if self.prefix:
                body = self.prefix + body.replace("\n", " " if self.prefix[0] == "#" else "\n" + " " * len(self.prefix))
            self.blocks.append(body)
            self.prefix = ""

    def close_table(self) -> None:
        self.flush()
        table, self.prefix = self.tables.pop()
        self.cell = bool(self.tables)
        made = ["\n".join(lines)] if (lines := table.lines()) else []
        (self.tables[-1][0].inner if self.tables else self.blocks).extend(made + table.inner)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text.append(" " if self.tables else "\n" if self.pre else "\x00")
        elif name == "img":
            self.text.append(html.unescape(_attributes(attributes).get("alt", "")))
        elif name == "table":
            self.flush()
            self.tables.append((_Table(), self.prefix))
            self.cell, self.prefix = False, ""
        elif self.tables and name in ("tr", "td", "th"):
            self.flush()
            rows = self.tables[-1][0].rows
            if name == "tr":
                rows.append([])
                self.cell = False
            else:
                if not rows:
                    rows.append([])
                span = _attributes(attributes).get("colspan", "1")
                wide = min(int(span), MOST_COLUMNS) if span.isdecimal() and span.isascii() else 1
                if self.cell and self.wide > 1:
                    rows[-1] += [""] * (self.wide - 1)
                rows[-1].append("")
                self.cell, self.wide = True, wide
        elif self.tables:
            if name in BLOCKS or name in ("li", "ul", "ol") or re.fullmatch("h[1-6]", name):
                self.flush()
        elif re.fullmatch("h[1-6]", name):
            self.flush()
            self.prefix = "#" * int(name[1]) + " "
        elif name in ("ul", "ol"):
            self.flush()
            self.prefix = ""
            self.lists.append(1 if name == "ol" else None)
        elif name == "li":
            self.flush()
            if not self.lists:
                self.lists.append(None)
            n = self.lists[-1]
            self.prefix = "  " * (len(self.lists) - 1) + ("- " if n is None else f"{n}. ")
            if n is not None:
                self.lists[-1] = n + 1
        elif name == "pre":
            self.flush()
            self.pre += 1
        elif name in BLOCKS:
            self.flush()
            if name == "hr":
                self.blocks.append("---")

    def end(self, name: str, _: str) -> None:
        if name == "table":
            if self.tables:
                self.close_table()
        elif self.tables:
            if name in ("td", "th", "tr"):
                self.flush()
                if self.cell and self.wide > 1:
                    self.tables[-1][0].rows[-1] += [""] * (self.wide - 1)
                self.cell, self.wide = False, 1
            elif name in BLOCKS or name in ("li", "ul", "ol"):
                self.flush()
        elif name in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
            self.prefix = ""
        elif name == "pre":
            self.flush()
            self.pre = max(0, self.pre - 1)
        elif name in BLOCKS or name == "li" or re.fullmatch("h[1-6]", name):
            self.flush()
            self.prefix = ""

    wide = 1


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(text)}


def markdown(document: str) -> str:
    """The document's blocks, parted by an empty line; the items of a list by a line break."""
    reader, at = _Reader(), 0
    while m := _PIECES.match(document, at):
        at = m.end()
        name = (m[2] or "").lower()
        if name in DROPPED and not m[1]:
            ends = re.compile(rf"</{name}\s*>" if name != "head" else r"</head\s*>|(?=<body[\s>])", re.IGNORECASE).search(document, at)
            at = ends.end() if ends else len(document)
        elif name:
            (reader.end if m[1] else reader.start)(name, m[3])
        elif document[m.start()] != "<" or at - m.start() == 1:
            reader.text.append(html.unescape(m[0]).replace("\x00", ""))
    while reader.tables:
        reader.close_table()
    reader.flush()
    return _joined(reader.blocks)


_ITEM = re.compile(r" *(?:- |\d+\. )")


def _joined(blocks: list[str]) -> str:
    out: list[str] = []
    for before, block in zip([None, *blocks], blocks, strict=False):
        if before is not None:
            out.append("\n" if _ITEM.match(before) and _ITEM.match(block) else "\n\n")
        out.append(block)
    return "".join(out)


def parse(documents: DataFrame, content: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """The documents with ``markdown``, ``char_count`` and ``parse_status``; columns of these names are replaced, and where
    ``keep`` is given only its columns stay.

    One document that can't be read is an ``error: ...`` with an empty text, and no other is touched by it. A null is
    ``error: no document``; an empty document is ``ok``. Whole documents are read, in slices of Arrow batches.
    """
    kept = [c for c in documents.columns if c not in ("markdown", "char_count", "parse_status") and (keep is None or c in keep)]
    packed = documents.select(F.col(f"`{content}`").cast("string").alias("content"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"))

    def read(document: str | None) -> tuple[str, str]:
        if document is None:
            return "", "error: no document"
        try:
            return markdown(document), "ok"
        except Exception as e:  # noqa: BLE001  told in the row
            return "", f"error: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [read(x.as_py()) for x in b.column(0)]
            texts, states = (pa.array([x[k] for x in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(1), texts, states], ["row", "markdown", "parse_status"])

    found = packed.mapInArrow(run, StructType([packed.schema["row"], StructField("markdown", StringType()), StructField("parse_status", StringType())]))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], "markdown", F.char_length("markdown").alias("char_count"), "parse_status")
