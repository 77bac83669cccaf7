"""Lines made into paragraphs, footnotes with their labels, and tagged spans."""

from __future__ import annotations

import re
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.scalars import sentence_goes_on


def paragraphs(lines: DataFrame, keys: Sequence[str], order: str, text: str, apart: Column | None = None) -> DataFrame:
    """Lines joined while the sentence goes on; ``apart`` marks lines that always begin a paragraph."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(text).over(w)
    joins = before.isNotNull() & sentence_goes_on(before, F.col(text))
    if apart is not None:
        joins = joins & ~F.coalesce(apart, F.lit(False))
    flagged = lines.withColumn("_new", (~joins).cast("int")).withColumn("paragraph", F.sum("_new").over(w))
    rows = flagged.groupBy(*keys, "paragraph").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l"))
    return rows.select(*keys, "paragraph", F.size("_l").alias("lines"), F.array_join(F.transform("_l", lambda r: r[text]), " ").alias("text"))


LABEL = re.compile(r"\s*(?:\[(\d{1,3})\]|(\d{1,3})[.)]?)\s+")


def accepted_labels(texts: Sequence[str], step: int = 3) -> list[int | None]:
    """Footnote numbers at text starts, each above the last accepted one by at most ``step``."""
    out: list[int | None] = []
    last = 0
    for t in texts:
        m = LABEL.match(t)
        n = int(m[1] or m[2]) if m else None
        good = n is not None and last < n <= last + step
        out.append(n if good else None)
        last = n if good else last  # type: ignore[assignment]
    return out


def footnotes(texts: Sequence[str]) -> list[tuple[int | None, list[str]]]:
    """Notes with their paragraphs; paragraphs without an accepted label go to the note before."""
    notes: list[tuple[int | None, list[str]]] = []
    for text, label in zip(texts, accepted_labels(texts), strict=True):
        if label is not None:
            notes.append((label, [LABEL.sub("", text, count=1)]))
        elif notes:
            notes[-1][1].append(text)
        else:
            notes.append((None, [text]))
    return notes


Span = tuple[int, int, str]


def snap(text: str, start: int, end: int) -> tuple[int, int]:
    """A span on the edges of the words that it touches."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    while 0 < start < len(text) and re.match(r"\w\w", text[start - 1 : start + 1]):
        start -= 1
    while 0 < end < len(text) and re.match(r"\w\w", text[end - 1 : end + 1]):
        end += 1
    return start, end


def repair_spans(text: str, spans: Sequence[Span]) -> list[Span]:
    """Spans on word edges, those of one label joined across punctuation, none overlapping the one before."""
    out: list[Span] = []
    for s, e, label in sorted((*snap(text, s, e), label) for s, e, label in spans if s < e):
        if out and out[-1][2] == label and not re.search(r"\w", text[out[-1][1] : s]):
            out[-1] = (out[-1][0], max(e, out[-1][1]), label)
        elif not out or s >= out[-1][1]:
            out.append((s, e, label))
    return out


def decode_tags(words: Sequence[Span], tags: Sequence[str]) -> list[Span]:
    """BIO tags of words ``(start, end, word)`` as spans; an I without its B begins one."""
    out: list[Span] = []
    before = "O"
    for (start, end, _), tag in zip(words, tags, strict=True):
        if tag != "O":
            label = tag[2:]
            if tag.startswith("I-") and before[2:] == label and before != "O":
                out[-1] = (out[-1][0], end, label)
            else:
                out.append((start, end, label))
        before = tag
    return out


def encode_tags(words: Sequence[Span], spans: Sequence[Span]) -> list[str]:
    """The inverse: BIO tags of the words inside spans."""
    out = []
    for start, end, _ in words:
        home = next(((s, lb) for s, e, lb in spans if s <= start and end <= e), None)
        out.append("O" if home is None else f"{'B' if home[0] == start else 'I'}-{home[1]}")
    return out


def heal(spans: Sequence[Span], blocks: Sequence[tuple[int, int]], label: str) -> list[Span]:
    """Two or more pieces of ``label`` in one block become one span; others inside it go."""
    out = list(spans)
    for a, b in blocks:
        own = [s for s in out if s[2] == label and a <= s[0] and s[1] <= b]
        if len(own) > 1:
            whole = (own[0][0], max(s[1] for s in own), label)
            out = sorted([s for s in out if not (whole[0] <= s[0] and s[1] <= whole[1])] + [whole])
    return out


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows over ``n`` tokens of at most ``size`` that share ``overlap`` with the next."""
    if n <= size:
        return [(0, n)] if n else []
    starts = range(0, n - overlap, size - overlap)
    return [(s, min(n, s + size)) for s in starts]


def to_xml(name: str, title: str, body: Sequence[tuple[str, Sequence[Span]]], notes: Sequence[tuple[int | None, Sequence[str]]] = ()) -> str:
    """One document: paragraphs with tagged spans, then footnotes."""
    def inline(text: str, spans: Sequence[Span]) -> str:
        out, at = [], 0
        for s, e, label in sorted(spans):
            if s >= at:
                out += [escape(text[at:s]), f"<span type={quoteattr(label)}>", escape(text[s:e]), "</span>"]
                at = e
        return "".join([*out, escape(text[at:])])

    rows = [f"<p>{inline(t, s)}</p>" for t, s in body]
    foot = [f"<footnote label={quoteattr('' if n is None else str(n))}>" + "".join(f"<p>{escape(p)}</p>" for p in ps) + "</footnote>" for n, ps in notes]
    return f"<document id={quoteattr(name)}><title>{escape(title)}</title>{''.join(rows)}{''.join(foot)}</document>"
