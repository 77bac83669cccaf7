"""Scalar functions as Column expressions, and those that need Python as Arrow UDFs."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafline.functions import compare, reasons

def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: What Python takes for white space and Java does not, and what both do.
_SEPARATORS, _SPACE = re.compile(r"[\x1c-\x1f]"), re.compile(r"[^\S\x1c-\x1f]+")


def split_words(text: str) -> list[str]:
    """The words of ``squeeze`` of a text."""
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


def bare(c: Column) -> Column:
    """Word characters only, of any script."""
    return F.regexp_replace(c, r"(?U)[^\w]", "")


@F.arrow_udf(StringType())
def compare_text(texts: pa.Array) -> pa.Array:
    """The form in which readings of one text are compared (``compare.key_of``)."""
    return pa.array([None if t is None else compare.key_of(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def strip_star(texts: pa.Array) -> pa.Array:
    """Without a star page of two digits or more in front, and a bracket of numbers after it."""
    return pa.array([None if t is None else reasons.without_star(t) for t in texts.to_pylist()], pa.string())


def heading_words(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(c, r"(?U)[^\p{L}]+", " ")))


def number_type(c: Column) -> Column:
    """range, suffixed, single or null."""
    return F.when(c.rlike(r"^[0-9]+-[0-9]+$"), "range").when(c.rlike(r"^[0-9]+[a-f]$"), "suffixed").when(c.rlike(r"^[0-9]+$"), "single")


def page_span(c: Column, most: int = 200) -> Column:
    """First and last page of a number, a suffixed number or an ascending range of at most ``most`` pages."""
    a, b = F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("int"), F.regexp_extract(c, r"-([0-9]+)$", 1).try_cast("int")
    last = F.when(number_type(c) == "range", b).otherwise(a)
    return F.when(number_type(c).isNotNull() & (last >= a) & (last - a <= most), F.struct(a.alias("first"), last.alias("last")))


def expand_brackets(c: Column) -> Column:
    """``[16-19]`` as 16 to 19, ``[1, 2]`` as both; numbers from 1 to 99 only."""
    inner = F.regexp_extract(c, r"^\[([0-9,\- ]+)\]$", 1)
    a, b = F.regexp_extract(inner, r"^([0-9]+)-([0-9]+)$", 1).try_cast("int"), F.regexp_extract(inner, r"^([0-9]+)-([0-9]+)$", 2).try_cast("int")
    listed = F.transform(F.split(inner, r",\s*"), lambda x: x.try_cast("int"))
    made = F.when(inner == "", F.array().cast("array<int>")).when(a.isNotNull() & (a <= b) & (b - a < 99), F.sequence(a, b)).when(a.isNull(), listed).otherwise(F.array().cast("array<int>"))
    return F.filter(made, lambda x: x.isNotNull() & x.between(1, 99))


def sentence_goes_on(before: Column, after: Column) -> Column:
    """A line goes on in the next: hyphen end, lower-case start, or no sentence end."""
    return F.coalesce(before.rlike(r"-\s*$") | after.rlike(r"^\s*[a-z]") | ~before.rlike(r"[.!?:;][\"')\]]*\s*$"), F.lit(False))


def dehyphenate(c: Column) -> Column:
    """Joins words that a line end has cut at a hyphen before a lower-case letter."""
    return F.regexp_replace(c, r"([a-z])-\n([a-z])", "$1$2")


def strip_line_tokens(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\[[0-9,\- ]+\]\s*", "")


# The apostrophes that an editor's note is spelled with.
APOSTROPHES = ("", "’", "'", "`")
_EDITORS = "|".join(f"editor{before}s{behind}" for before in APOSTROPHES for behind in APOSTROPHES)


def notes(c: Column, most: int = 400) -> Column:
    """Editor's notes in brackets as an array of texts: each to its closing bracket, or ``most``
    characters from the opening one if that comes first."""
    whole, cut = rf"[^\]]{{0,{most}}}\]", rf".{{0,{most}}}"
    return F.regexp_extract_all(c, F.lit(rf"(?is)(\[\s*(?:{_EDITORS})\s+note\b(?:{whole}|{cut}))"), 1)


def split_label(c: Column) -> Column:
    """``label`` and ``rest`` of a footnote whose text begins with a number of up to three digits or
    up to three signs, and a period, a bracket or space after it; null if it does not."""
    pattern = r"^\s*([0-9]{1,3}|[*†‡§¶]{1,3})(?:[.)]\s*|\s+)"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("label"), F.regexp_replace(c, pattern, "").alias("rest")))


# The words of a role, and the types of a writing in the order in which they are tried.
CONCUR = ("concur", "concurs", "concurred", "concurring", "concurrence", "concurrences")
DISSENT = ("dissent", "dissents", "dissented", "dissenting")
_CONCUR, _DISSENT = (rf"(?:{'|'.join(words)})\b" for words in (CONCUR, DISSENT))
#: A dissent in part is one of both kinds, whatever the writing says of its concurrence.
_BOTH = rf"\b{_DISSENT}(?: in part\b|, in part,? (?:and|&|but) {_CONCUR} in part\b)"
STAGES_OF_A_CASE = (("rehearing", "rehearing"), ("on the merits", "on-the-merits"), ("remittitur", "remittitur"), ("motion to strike", "on-motion-to-strike"))


def opinion_type(words: Column, first: Column) -> Column:
    """The type that a writing's role words name; of concurring and dissenting the earlier one.

    The first writing is the majority unless it is called otherwise; null: not read."""
    words = F.lower(squeeze(words))
    role = F.regexp_extract(words, rf"\b({_CONCUR}|{_DISSENT})", 1)
    other = F.when(words.rlike(_BOTH), "concurring-in-part-and-dissenting-in-part").when(role.startswith("dissent"), "dissent").when(role != "", "concurrence")
    for name, value in STAGES_OF_A_CASE:
        other = other.when(words.rlike(rf"\b{name}\b"), value)
    return F.when(first, F.when(words.rlike(r"\bplurality\b"), "plurality").when(words.rlike(r"\bunanimous"), "unanimous").otherwise("majority")).otherwise(other)


def digest(*columns: Column) -> Column:
    """One fingerprint of all inputs, null and empty apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def repair(text: str | None, most: int = 3) -> str | None:
    """JSON that parses after at most ``most`` one-character edits where the parser stops; else null."""
    for _ in range(most + 1):
        try:
            json.loads(text or "")
            return text
        except json.JSONDecodeError as e:
            text, at = text or "", e.pos
            if "Expecting ',' delimiter" in e.msg:
                text = text[:at] + "," + text[at:] if at < len(text) else text + ("]" if text.count("[") > text.count("]") else "}")
            elif "Expecting property name" in e.msg or "Illegal trailing comma" in e.msg or "Expecting value" in e.msg:
                comma = text.rfind(",", 0, at + 1)
                if comma < 0:
                    return None
                text = text[:comma] + text[comma + 1 :]
            elif "Extra data" in e.msg:
                text = text[:at] + text[at + 1 :]
            elif "Unterminated string" in e.msg:
                text += '"'
            else:
                return None
    return None


@F.arrow_udf(StringType())
def repair_json(texts: pa.Array) -> pa.Array:
    return pa.array([repair(t) for t in texts.to_pylist()], pa.string())
