"""A document's paragraphs told apart: head matter, citations, the writings of a decision, their notes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from leafline.functions import scalars


def writings(paragraphs: DataFrame, keys: Sequence[str], order: str, tagged: Column, caption: Column, author: Column, opens: Column, separate: Column) -> DataFrame:
    """One row a document: ``split``, where the head matter ends, and ``starts``, where writings begin.

    ``order`` counts a document's paragraphs from 0.  Of a paragraph, ``tagged`` says that it has
    any span, ``caption`` that a head-matter span covers it whole, ``author`` that it names an
    author, ``opens`` that it begins with one, ``separate`` that these words name a concurrence or
    a dissent.  The head matter is the leading run of tagged paragraphs or ends after the last
    caption, whichever is later, and lies before the first author.  ``split`` begins a writing;
    so do author lines after it, but for a first one that only names the majority's author."""
    at = F.col(order)
    whole = Window.partitionBy(*keys)
    first = F.coalesce(F.min(F.when(author, at)).over(whole), F.max(at).over(whole) + 1)
    rows = paragraphs.select(*keys, at.alias("_at"), first.alias("_author"), F.coalesce(tagged, F.lit(False)).alias("_tagged"), F.coalesce(caption, F.lit(False)).alias("_caption"), F.coalesce(opens, F.lit(False)).alias("_opens"), F.coalesce(separate, F.lit(False)).alias("_separate"))
    heads = rows.groupBy(*keys, "_author").agg(
        F.min(F.when(~F.col("_tagged"), F.col("_at"))).alias("_gap"),
        F.max(F.when(F.col("_caption") & (F.col("_at") < F.col("_author")), F.col("_at") + 1)).alias("_past"),
        F.array_sort(F.collect_list(F.when(F.col("_opens"), F.struct("_at", "_separate")))).alias("_lines"),
    )
    split = F.greatest(F.least("_author", "_gap"), F.col("_past"))
    lines = heads.withColumn("split", split).withColumn("_lines", F.filter("_lines", lambda x: x["_at"] >= F.col("split")))
    first_line = F.get("_lines", F.lit(0))
    majority = F.coalesce((first_line["_at"] > F.col("split")) & ~first_line["_separate"], F.lit(False))
    kept = F.filter("_lines", lambda x: ~majority | (x["_at"] > first_line["_at"]))
    later = F.filter(F.transform(kept, lambda x: x["_at"]), lambda x: x > F.col("split"))
    return lines.select(*keys, "split", F.concat(F.array("split"), later).alias("starts"))


# The edges that are no words, how much of the text after an author is read, the
# abbreviations whose period ends no sentence, and words that may stand before a role.
EDGE, ROLE_REACH = " \n\t.,;:", 300
ABBREVIATIONS = ("JJ", "Mr", "Mrs", "Ch", "Jr")
BEFORE_ROLE = (("i", "respectfully"), ("i",), ("specially",))


def first_sentence(text: Column) -> Column:
    """The words up to the first that ends a sentence; a single capital and an abbreviation do not."""
    words = F.split(F.trim(F.regexp_replace(F.substring(text, 1, ROLE_REACH), r"(?U)\s+", " ")), " ")
    short = rf"(?:^|[^A-Za-z0-9])(?:[A-Z]|{'|'.join(ABBREVIATIONS)})[.;:!?]$"
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(r"[.;:!?]$") & ~w.rlike(short), i + 1)), lambda i: i.isNotNull())
    return F.array_join(F.when(F.size(ends) > 0, F.slice(words, F.lit(1), F.get(ends, F.lit(0)))).otherwise(words), " ")


def names_role(sentence: Column) -> Column:
    """Whether a sentence begins with a concurrence or a dissent, in brackets or of the writer's own."""
    words = F.transform(F.split(F.regexp_replace(F.lower(sentence), r"^\(\s*", ""), " "), lambda w: F.regexp_extract(w, "^[a-z]+", 0))
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    skip = F.lit(0)
    for lead in reversed(BEFORE_ROLE):
        met = F.lit(True)
        for k, w in enumerate(lead):
            met = met & (word(k) == w)
        skip = F.when(met, len(lead)).otherwise(skip)
    return F.coalesce(F.get(words, skip).isin(*scalars.CONCUR, *scalars.DISSENT), F.lit(False))


def role_words(paragraphs: DataFrame, keys: Sequence[str], order: str, text: Column, heading: Column, author_end: Column) -> DataFrame:
    """``paragraphs`` with ``role_words``, the folded words that name the type of a writing that begins there.

    They are a heading just before, the text up to ``author_end`` (null or 0: no author begins the
    paragraph), and the first sentence after it, or of the next paragraph where nothing stands
    after the author, if it begins with a role."""
    w = Window.partitionBy(*keys).orderBy(order)
    said = F.coalesce(text, F.lit(""))
    rows = paragraphs.withColumn("_said", said).withColumn("_end", F.coalesce(author_end, F.lit(0)))
    rows = rows.withColumn("_head", F.lag(F.when(F.coalesce(heading, F.lit(False)), said)).over(w)).withColumn("_next", F.lead(said).over(w))
    rest = F.ltrim(F.substring("_said", F.col("_end") + 1, F.length("_said")), F.lit(EDGE))
    rest = F.when((rest == "") & F.col("_next").isNotNull(), F.ltrim("_next", F.lit(EDGE))).otherwise(rest)
    rows = rows.withColumn("_sentence", first_sentence(rest))
    parts = F.concat_ws(" ", "_head", F.substring("_said", F.lit(1), F.col("_end")), F.when(names_role(F.col("_sentence")), F.col("_sentence")))
    return rows.withColumn("role_words", F.lower(scalars.squeeze(parts))).drop("_said", "_end", "_head", "_next", "_sentence")


def citations(paragraphs: DataFrame, keys: Sequence[str], order: str, before: Column, first_page: Column, last_page: Column, bare: Column, cites: Column) -> DataFrame:
    """The head-matter paragraphs that are one full citation: ``bare`` ones (no span, mark, list, table,
    quote or page break) with ``cites``, that do not begin a page.  ``before`` says head matter."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(first_page != F.last(last_page, ignorenulls=True).over(w), F.lit(False))
    return paragraphs.withColumn("_turned", turned).where(before & ~F.col("_turned") & bare & cites).drop("_turned")


def syllabus(paragraphs: DataFrame, keys: Sequence[str], order: str, bound: Column, begins: Column, heading: Column, closes: Column) -> DataFrame:
    """``start`` and ``end`` (not included) of each document's syllabus, if it has one.

    A run begins at a paragraph that ``begins`` one, or behind it if that is its ``heading``, and
    ends at the next one that ``closes`` it or at the ``bound``; the first run that holds a
    paragraph counts."""
    at = F.col(order)
    ahead = Window.partitionBy(*keys).orderBy(order)
    yes = lambda c: F.coalesce(c, F.lit(False))
    inside = paragraphs.where(at < bound).withColumn("_bound", bound)
    close = F.when(yes(closes), at)
    here = F.coalesce(F.min(close).over(ahead.rowsBetween(0, Window.unboundedFollowing)), F.col("_bound"))
    after = F.coalesce(F.min(close).over(ahead.rowsBetween(1, Window.unboundedFollowing)), F.col("_bound"))
    runs = inside.select(*keys, yes(begins).alias("_b"), F.when(yes(heading), at + 1).otherwise(at).alias("start"), F.when(yes(heading), after).otherwise(here).alias("end"))
    return runs.where("_b AND end > start").groupBy(*keys).agg(F.min_by(F.struct("start", "end"), "start").alias("_r")).select(*keys, "_r.start", "_r.end")


def page_table(pages: DataFrame, groups: DataFrame, printed: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """Each page with its ``printed`` number, its ``error``, and its ``furniture``: the running heads and
    feet of the body as ``band`` and ``text``, in the order of ``id``."""
    furniture = groups.where("section = 'body' AND band IN ('head', 'foot')")
    packed = furniture.groupBy(*keys, page).agg(F.array_sort(F.collect_list(F.struct("id", "band", F.coalesce("text", F.lit("")).alias("text")))).alias("_f"))
    rows = pages.join(printed, [*keys, page], "left").join(packed, [*keys, page], "left")
    shown = F.transform(F.coalesce("_f", F.array().cast(packed.schema["_f"].dataType)), lambda g: F.struct(g["band"].alias("band"), g["text"].alias("text")))
    return rows.select(*keys, page, "printed", F.when(F.col("error") != "", F.col("error")).alias("error"), shown.alias("furniture"))


def kinds(readings: DataFrame, keys: Sequence[str], rank: str, kind: str) -> DataFrame:
    """The kind that most readers of a group see; of equal ones, that of the first reader by rank."""
    votes = readings.groupBy(*keys, F.coalesce(kind, F.lit("paragraph")).alias(kind)).agg(F.count("*").alias("_n"), F.min(rank).alias("_first"))
    return votes.groupBy(*keys).agg(F.min_by(kind, F.struct(-F.col("_n"), "_first")).alias(kind))


def owners(marks: Sequence[Sequence[str]], pages: Sequence[Sequence[int]], notes: Sequence[tuple[str | None, int | None]]) -> list[int]:
    """The writing of each note ``(label, first page)``, from each writing's marks and pages.

    A note takes an unused mark of its label in a writing from that of the note before on, up to
    the last one that holds its page; without such a mark it goes to the first one that holds its
    page, and without a page it stays with the note before."""
    # the writings of each label's unused marks and of each page, in order: both are searched, not walked
    unused: dict[str, list[int]] = {}
    holders: dict[int, list[int]] = {}
    for writing, (own_marks, own_pages) in enumerate(zip(marks, pages, strict=True)):
        for mark in own_marks:
            unused.setdefault(mark, []).append(writing)
        for page in set(own_pages):
            holders.setdefault(page, []).append(writing)
    out = [0]
    for label, page in notes:
        held = holders.get(page, [])
        held = held[bisect_left(held, out[-1]) :]
        queue = unused.get(label, [])
        place = bisect_left(queue, out[-1])
        if place < len(queue) and queue[place] <= (held[-1] if held else len(pages) - 1):
            out.append(queue.pop(place))
        else:
            out.append(held[0] if held else out[-1])
    return out[1:]


@F.arrow_udf(ArrayType(IntegerType()))
def note_owners(marks: pa.Array, pages: pa.Array, notes: pa.Array) -> pa.Array:
    """``owners`` of each document: arrays of a writing's marks and pages, and of ``label, page`` structs."""
    rows = zip(marks.to_pylist(), pages.to_pylist(), notes.to_pylist(), strict=True)
    return pa.array([owners(m or [], p or [], [(n["label"], n["page"]) for n in ns or []]) for m, p, ns in rows], pa.list_(pa.int32()))
