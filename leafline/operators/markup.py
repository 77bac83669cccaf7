"""Marked-up text as plain text with stand-off marks, and back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Elements and the marks they become, elements that end a line, and those without text.
MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "sup": "sup", "sub": "sub"}
BLOCKS = {"p", "div", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "title", "nav", "section", "article", "header", "footer"}
SILENT = {"script", "style"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TAGS = {"bold": "b", "italic": "i", "underline": "u", "sup": "sup", "sub": "sub"}


@dataclass
class Parsed:
    text: str = ""
    marks: list[tuple[int, int, str]] = field(default_factory=list)
    items: int = 0
    headings: int = 0
    tables: list[list[list[str]]] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.length = 0
        self.open: list[tuple[str, int]] = []
        self.silent = 0
        self.parsed = Parsed()
        self.raw: list[tuple[int, int, str]] = []
        self.cell: list[str] | None = None

    def add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)
        if self.cell is not None:
            self.cell.append(text)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in MARKS:
            self.open.append((tag, self.length))
        elif tag in BLOCKS:
            self.add("\n")
            self.parsed.items += tag == "li"
            self.parsed.headings += tag in HEADINGS
            if tag == "table":
                self.parsed.tables.append([])
            elif tag == "tr" and self.parsed.tables:
                self.parsed.tables[-1].append([])
        elif tag in ("td", "th") and self.parsed.tables and self.parsed.tables[-1]:
            self.add("\t")
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in MARKS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    _, at = self.open.pop(k)
                    self.raw.append((at, self.length, MARKS[tag]))
                    break
        elif tag in ("td", "th") and self.cell is not None:
            self.parsed.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag in BLOCKS:
            self.add("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.add(data)


def squeeze_marked(text: str, marks: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """One space or newline for each run of white space, none at the ends; marks keep to the letters."""
    out: list[str] = []
    place = []
    gap = ""
    for c in text:
        place.append(len(out) + (1 if gap and out else 0) if not c.isspace() else len(out))
        if c.isspace():
            gap = "\n" if "\n" in (c, gap) else " "
        else:
            if gap and out:
                out.append(gap)
            gap = ""
            out.append(c)
    kept = []
    for a, b, kind in marks:
        letters = [i for i in range(a, b) if not text[i].isspace()]
        if letters:
            kept.append((place[letters[0]], place[letters[-1]] + 1, kind))
    return "".join(out), sorted(set(kept))


_BARE_TAG = re.compile("<(/?[A-Za-z][A-Za-z0-9]*)>")
#: Elements in which the parser takes tags for text.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _cut(html: str) -> tuple[list[str], list[str]] | None:
    """The texts of a fragment and the tags behind each (the last one empty), by one search, if every ``<``
    begins a tag without attributes; else null, and only the parser, which is slower, can tell."""
    parts = _BARE_TAG.split(html)
    tags = [t.lower() for t in parts[1::2]]
    if html.count("<") != len(tags) or not _RAW.isdisjoint([t.lstrip("/") for t in tags]):
        return None
    return parts[::2], [*tags, ""]


def _read(html: str) -> _Reader:
    reader, cut = _Reader(), _cut(html)
    if cut is None:
        reader.feed(html)
        reader.close()
        return reader
    for text, tag in zip(*cut, strict=True):
        if text:
            reader.handle_data(unescape(text))
        if tag[:1] == "/":
            reader.handle_endtag(tag[1:])
        elif tag:
            reader.handle_starttag(tag, ())
    return reader


def parse_html(html: str | None) -> Parsed:
    """Text with marks of an HTML fragment; unknown elements are read through."""
    reader = _read(html or "")
    done = reader.parsed
    done.text, done.marks = squeeze_marked("".join(reader.out), reader.raw + [(at, reader.length, MARKS[t]) for t, at in reader.open])
    return done


def tables_of(html: str) -> list[list[list[str]]]:
    """``parse_html(html).tables``, without its text and marks."""
    cut = _cut(html)
    if cut is None:
        return _read(html).parsed.tables
    tables: list[list[list[str]]] = []
    cell: list[str] | None = None
    for text, tag in zip(*cut, strict=True):
        if cell is not None:
            cell.append(unescape(text))
        if tag in ("td", "th"):
            if tables and tables[-1]:
                cell = []
        elif tag in ("/td", "/th"):
            if cell is not None:
                tables[-1][-1].append(" ".join("".join(cell).split()))
                cell = None
        elif tag.lstrip("/") in BLOCKS:
            if cell is not None:
                cell.append("\n")
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
    return tables


_SPAN = re.compile(r"(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1", re.S)


def parse_markdown(text: str | None) -> Parsed:
    """Text with bold and italic marks, list items and headings of a Markdown fragment."""
    done, lines = Parsed(), []
    for line in (text or "").splitlines():
        done.items += bool(re.match(r"\s*(?:[-+*]|\d+[.)])\s+", line))
        done.headings += bool(re.match(r"#{1,6}\s", line))
        lines.append(re.sub(r"^\s*(?:#{1,6}\s+|[-+*]\s+|\d+[.)]\s+)", "", line))
    out, marks, at = [], [], 0

    def walk(part: str) -> None:
        nonlocal at
        m = _SPAN.search(part)
        if not m:
            out.append(part)
            at += len(part)
            return
        out.append(part[: m.start()])
        at += m.start()
        begin = at
        walk(m[2])
        marks.append((begin, at, "bold" if len(m[1]) == 2 else "italic"))
        walk(part[m.end() :])

    walk("\n".join(lines))
    done.text, done.marks = squeeze_marked("".join(out), marks)
    return done


def serialize(text: str, marks: list[tuple[int, int, str]]) -> str:
    """HTML that parses back to the same text and marks; marks that cross are cut where they do."""
    edges = sorted({0, len(text), *(x for a, b, _ in marks for x in (a, b))})
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        kinds = sorted({k for s, e, k in marks if s <= a and b <= e})
        out.append("".join(f"<{TAGS[k]}>" for k in kinds) + escape(text[a:b], quote=False).replace("\n", "<br>") + "".join(f"</{TAGS[k]}>" for k in reversed(kinds)))
    return "".join(out)


def merge_marks(marks: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Marks of one kind that touch or overlap as one."""
    out: list[tuple[int, int, str]] = []
    for a, b, k in sorted(marks, key=lambda m: (m[2], m[0])):
        if out and out[-1][2] == k and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), k)
        else:
            out.append((a, b, k))
    return sorted(out)


def project(text: str) -> tuple[str, list[int]]:
    """Text with line-end hyphens joined and line ends as spaces, and the source place of each character."""
    out, places, i = [], [], 0
    while i < len(text):
        if text[i] == "-" and text[i + 1 : i + 2] == "\n" and i and text[i - 1].islower() and text[i + 2 : i + 3].islower():
            i += 2
            continue
        out.append(" " if text[i] == "\n" else text[i])
        places.append(i)
        i += 1
    return "".join(out), places


def lift_span(places: list[int], start: int, end: int) -> tuple[int, int]:
    """A span of the projected text in the source text."""
    return places[start], places[end - 1] + 1


SHAPE = (
    StructType()
    .add("text", StringType())
    .add("marks", ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", StringType())))
    .add("items", IntegerType())
    .add("headings", IntegerType())
    .add("tables", IntegerType())
)


@F.arrow_udf(SHAPE)
def parsed_html(pages: pa.Array) -> pa.Array:
    got = [parse_html(p) for p in pages.to_pylist()]
    rows = [{"text": g.text, "marks": [{"start": a, "end": b, "kind": k} for a, b, k in g.marks], "items": g.items, "headings": g.headings, "tables": len(g.tables)} for g in got]
    mark = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    return pa.array(rows, pa.struct([("text", pa.string()), ("marks", pa.list_(mark)), ("items", pa.int32()), ("headings", pa.int32()), ("tables", pa.int32())]))
